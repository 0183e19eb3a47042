"""Settings: feature toggles, weights and limits, from nested mappings or simple YAML."""

from __future__ import annotations

from dataclasses import dataclass, field


def parse(text: str) -> dict:
    """Nested mappings of a YAML subset: two-blank indentation, scalars, and lists of scalars."""
    root: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, root, None)]
    for raw in text.split("\n"):
        row = raw.split(" #")[0].rstrip()
        bare = row.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(row) - len(row.lstrip())
        while stack[-1][0] >= depth and not (bare.startswith("- ") and stack[-1][0] == depth and stack[-1][2]):
            stack.pop()
        if bare.startswith("- "):
            _, owner, key = stack[-1]
            if key is None:
                raise ValueError(f"a list without a name: {bare}")
            if not isinstance(owner.get(key), list):
                owner[key] = []
            owner[key].append(scalar(bare[2:]))
            continue
        key, _, value = bare.partition(":")
        owner = stack[-1][1]
        if stack[-1][2] is not None:
            if not isinstance(owner.get(stack[-1][2]), dict):
                owner[stack[-1][2]] = {}
            owner = owner[stack[-1][2]]
        owner[key.strip()] = scalar(value) if value.strip() else None
        stack.append((depth, owner, key.strip()))
    return root


def scalar(text: str):
    text = text.strip()
    low = text.lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    if low in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text[0] == "[" and text[-1] == "]":
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return text.strip("\"'")


@dataclass
class Config:
    """Values by dotted path."""

    values: dict = field(default_factory=dict)

    @classmethod
    def of(cls, text: str) -> Config:
        return cls(parse(text))

    def get(self, path: str, default=None):
        at = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at or at[part] is None:
                return default
            at = at[part]
        return at

    def enabled(self, feature: str, default: bool = True) -> bool:
        """Whether a feature is on: `features.NAME` or `features.NAME.enabled`."""
        v = self.get(f"features.{feature}", default)
        return bool(v.get("enabled", default)) if isinstance(v, dict) else bool(v)

    def priority_weights(self) -> tuple[float, float, float]:
        """Weights of relevance, hotspot and nearness; they have to add up to 1, give or take a hundredth."""
        w = tuple(float(self.get(f"smart_pruning.priority_weights.{k}", d)) for k, d in (("relevance", 0.4), ("hotspot", 0.3), ("distance", 0.3)))
        if abs(sum(w) - 1) > 0.01:
            raise ValueError("priority weights have to add up to 1")
        return w

    def fusion_weights(self) -> dict[str, float]:
        w = {k: float(self.get(f"hybrid_retrieval.weights.{k}", d)) for k, d in (("keyword", 0.3), ("vector", 0.5), ("graph", 0.2))}
        if abs(sum(w.values()) - 1) > 0.01:
            raise ValueError("fusion weights have to add up to 1")
        return w


def budget(value, default: int = 8000) -> int:
    """A token budget: the default if it isn't a whole number, 0 if it is negative."""
    try:
        return max(0, int(str(value)))
    except ValueError:
        return default
