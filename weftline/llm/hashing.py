"""Words of texts as 64-bit hashes, computed with numpy over whole batches, and compact blocks of sorted keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text a numpy step works on.
STEP_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the multipliers are those of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The end token's hash; no word has it but by a chance of 2**-64.
END = mix(np.array([12345], np.uint64))[0]


class _Powers:
    """Powers of the hash's base and of its inverse, as far as they have been needed."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, STEP_BYTES + (1 << 16))
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.up, cls.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse))
        return cls.up, cls.down


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, its first byte's place, number of each text's words, all texts' bytes), in small letters (A-Z).

    The texts stand in the bytes one behind the other, after one blank each.
    """
    flat = [t.encode().lower() if t else b"" for t in texts]
    b = np.frombuffer(b" " + b" ".join(flat) + b" ", np.uint8)
    up, down = _Powers.of(len(b))
    blank = _BLANK[b]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_ENTRY[b] * up[: len(b)])])
    h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    text_end = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
    return h, begin, np.diff(np.searchsorted(begin, text_end + 1), prepend=0), b


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token of all texts, number of each text's tokens): words in small letters (A-Z), then one end."""
    h, _, words, _ = words_of(texts)
    n = words + 1
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = h, END
    return out, n


def steps(batch: pa.RecordBatch, text: int, size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about `size` characters of text each, and their texts."""
    lo, n, texts = 0, 0, []
    for k, t in enumerate(batch.column(text)):
        texts.append(t.as_py())
        n += len(texts[-1] or "")
        if n >= size:
            yield batch.slice(lo, k + 1 - lo), texts
            lo, n, texts = k + 1, 0, []
    if texts:
        yield batch.slice(lo), texts


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts (1 each if None)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(keys) else np.empty(0)
    return keys[first], n.astype(np.int64)


def _planes(column: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, the numbers by byte plane) of non-negative integers, with no more planes than the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if not len(column) or w == 8 or int(column.max()) < 1 << 8 * w)
    c = np.asarray(column).astype(f"<u{width}")
    return width, c.view(np.uint8).reshape(len(c), width).T.tobytes()


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys and columns of numbers below 2**64 as one compressed block: differences, by byte plane."""
    import zstandard

    planes = [_planes(np.diff(keys, prepend=np.uint64(0))), *map(_planes, columns)]
    return len(keys).to_bytes(8, "little") + bytes(w for w, _ in planes) + zstandard.ZstdCompressor(level=1).compress(b"".join(p for _, p in planes))


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    n, widths, at = int.from_bytes(block[:8], "little"), block[8 : 9 + columns], 0
    data, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[9 + columns :], max_output_size=n * sum(widths)), np.uint8), []
    for w in widths:
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(f"<u{w}").ravel())
        at += n * w
    return [np.cumsum(out[0], dtype=np.uint64), *(c.astype(np.int64) for c in out[1:])]


def blocks(bucket: np.ndarray, buckets: int, keys: np.ndarray, *columns: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """A row (bucket, kind, block) for each bucket that has keys."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        i = order[edges[b] : edges[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind], pa.int32()), pa.array([packed(keys[i], *(c[i] for c in columns))], pa.binary())], ["bucket", "kind", "block"])


BLOCKS = "bucket int, kind int, block binary"
