"""Column functions over texts, paths and severities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path rules in their order: (glob, kind, confidence). Fixed values.
BOUNDARY_RULES = [
    ("dist/**", "generated", 0.95),
    ("build/**", "generated", 0.95),
    ("out/**", "generated", 0.90),
    ("**/*.d.ts", "generated", 0.85),
    ("**/*.min.js", "generated", 0.95),
    ("**/*.min.css", "generated", 0.95),
    ("**/*.generated.*", "generated", 0.90),
    ("node_modules/**", "library", 0.99),
    ("**/node_modules/**", "library", 0.99),
    ("**/vendor/**", "library", 0.95),
    ("vendor/**", "library", 0.95),
    ("third_party/**", "vendor", 0.95),
    (".venv/**", "library", 0.95),
    ("venv/**", "library", 0.95),
    ("__pycache__/**", "generated", 0.99),
    ("*.pyc", "generated", 0.99),
    ("**/__snapshots__/**", "generated", 0.85),
    (".git/**", "generated", 0.99),
    (".idea/**", "generated", 0.90),
    ("config/**", "config", 0.90),
    ("**/*.config.js", "config", 0.85),
    ("**/*.config.ts", "config", 0.85),
    ("tsconfig.json", "config", 0.95),
    ("package.json", "config", 0.95),
    ("*.yaml", "config", 0.80),
    ("*.yml", "config", 0.80),
    (".eslintrc*", "config", 0.90),
    (".prettierrc*", "config", 0.90),
    ("src/**", "user", 0.85),
    ("lib/**", "user", 0.75),
    ("app/**", "user", 0.85),
]
SEVERITIES = ["low", "moderate", "high", "critical"]
#: Words too common to name anything (fixed values).
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "we", "our", "us",
    "they", "them", "their", "it", "its", "this", "that", "which", "who", "whom", "what", "where", "when", "why", "how", "and",
    "or", "but", "if", "then", "else", "for", "of", "to", "from", "in", "on", "at", "by", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "up", "down", "out", "off", "over", "under", "again",
    "further", "once", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "also", "now", "here", "there", "use", "using", "cache", "data", "system",
    "simple", "record", "mode", "make", "context", "decision", "status", "title", "file", "path", "type", "name",
]


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ** for anything, * within a part of the path, ? for one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def boundary(path: Column, rules: list[tuple[str, str, float]] | None = None) -> Column:
    """struct(kind, confidence, rule) by the first rule that matches; user, 0.50 and default if none does."""
    pair = lambda k, c, r: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(r).alias("rule"))
    out = pair("user", 0.50, "default")
    for glob, kind, confidence in reversed(rules or BOUNDARY_RULES):
        out = F.when(matches_glob(path, glob), pair(kind, confidence, glob)).otherwise(out)
    return out


def is_library(path: Column) -> Column:
    """Whether a path is code of others, or made by tools."""
    return path.rlike("^(node_modules|vendor|dist|build|third_party)/") | boundary(path)["kind"].isin("library", "vendor", "generated")


def is_entry_point(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(r"^(main|index|entry|app|server)\.")


def is_test(path: Column) -> Column:
    return path.rlike("test|spec|mock|fixture")


def severity_rank(severity: Column) -> Column:
    """0 for low to 3 for critical; -1 for any other word."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity)).cast("int") - 1


def redact(text: Column) -> Column:
    """Texts without secrets: one with a private key is replaced as a whole; bearer and access-key tokens, and values of secret
    names, are masked."""
    out = F.regexp_replace(text, r"(Bearer)\s+[A-Za-z0-9._-]+", "$1 [REDACTED]")
    out = F.regexp_replace(out, "AKIA[0-9A-Z]{16}", "AKIA[REDACTED]")
    out = F.regexp_replace(out, r'((?:token|secret|api_key|password)\s*=\s*)"[^"\n]*"', '$1"[REDACTED]"')
    return F.when(text.rlike(r"(?i)BEGIN\s+.*PRIVATE\s+KEY"), "[REDACTED: private key detected]").otherwise(out)


def is_unsafe_prompt(text: Column) -> Column:
    return F.coalesce(text.rlike(r"IGNORE\s+PREVIOUS\s+INSTRUCTIONS|rm\s+-rf|sudo|curl\s+http|wget\s+http|BEGIN\s+.*PRIVATE\s+KEY"), F.lit(False))


def camel_case(name: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(name, "_")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.initcap), ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def role_edge_type(role: Column) -> Column:
    """The edge type of an occurrence's roles: the first of definition (1), import (2) and write (4); else a call."""
    bit = lambda n: role.bitwiseAND(F.lit(n)) != 0
    return F.when(bit(1), "DEFINES").when(bit(2), "IMPORTS").when(bit(4), "MODIFIES").otherwise("CALLS")


def symbol_kind(symbol: Column) -> Column:
    return F.when(symbol.contains("`") & symbol.contains("()"), "function").when(symbol.contains("#"), "class").when(symbol.contains("."), "variable").otherwise("symbol")


def contract_type(path: Column) -> Column:
    return F.when(path.endswith(".proto"), "proto").when(path.rlike(r"(^|/)(openapi|swagger)\.(ya?ml|json)$"), "openapi").when(path.rlike(r"\.(graphql|gql)$"), "graphql").when(path.endswith(".d.ts") | path.rlike(r"/types/.*\.ts$"), "typescript").otherwise("unknown")


def severity_icon(severity: Column) -> Column:
    return F.when(severity == "critical", "[!!]").when(severity == "high", "[!]").when(severity == "moderate", "[~]").otherwise("[ ]")


def progress_bar(share: Column, width: int = 20) -> Column:
    full = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def version_compatibility(ours: Column, theirs: Column) -> Column:
    """compatible if two versions share what stands before their first dot, else incompatible; unknown if one isn't known."""
    unsure = lambda v: v.isNull() | v.isin("", "unknown", "not-installed")
    return F.when(unsure(ours) | unsure(theirs), "unknown").when(F.substring_index(ours, ".", 1) == F.substring_index(theirs, ".", 1), "compatible").otherwise("incompatible")
