"""Interpolated modified Kneser-Ney language model of any order from 2, counted in Spark and scored from memory-mapped arrays.

Words are hashed to 64 bits with numpy over whole batches. Counting takes a shuffle of compact blocks for words (by range of hash)
and one for each order, each counted within its task first: n-grams of the highest order (by hash of the n-gram, so that no word
gathers in one task), what they say of the n-grams one word shorter, and so on down to single words (by range of word number).
Each group writes a file of sorted arrays to the shared folder. Frequent words get small numbers (by the logarithm of their counts,
then by hash), so that blocks of n-grams pack well. An n-gram's key in its file is 48 bits of a hash besides those that choose the
file: an n-gram that wasn't seen is taken for another one by a chance of about a file's n-grams (a million) in 2**48. Scoring tasks
map the files and look up runs of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import BLOCKS, blocks, mix, packed, steps, summed, token_hashes, unpacked
from weftline.llm.shared import map_array, put_bytes, released, shared_dir, small_batches

#: Text bytes a word file is for, and training tokens a file of n-grams is for.
WORD_FILE_BYTES, GRAM_FILE_TOKENS = 64 << 20, 2_000_000
#: Keys that a counting task holds before it hands them on.
HELD = 3_000_000
#: Files of words at most have 2**MOST_WORD_BITS; words are numbered by LEVELS classes of counts, frequent ones first.
MOST_WORD_BITS, LEVELS = 18, 16
#: Bits of a key that index a file of n-grams, and that are stored for each n-gram.
INDEX_BITS, KEY_BITS = 16, 48
#: Distinct words must be numbered in 32 bits.
MOST_WORDS = (1 << 32) - 2


def columns_of(words: list[np.ndarray]) -> list[np.ndarray]:
    """N-grams as columns: the first two words as one key, then the others; a single word is a key itself."""
    w = [x.astype(np.uint64) for x in words[:2]]
    return [w[0] << np.uint64(32) | w[1] if len(w) > 1 else w[0], *words[2:]]


def words_of_grams(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The words of n-grams of two or more."""
    return [columns[0] >> np.uint64(32), columns[0] & np.uint64(0xFFFFFFFF), *columns[1:]]


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """One key for each n-gram: exact up to pairs, hashed beyond."""
    key = columns[0]
    for w in columns[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64) + np.uint64(1))
    return key


def summed_grams(columns: list[np.ndarray], values: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in order, and the sums of each one's values (its number if None).

    Columns are folded into one key from left to right: the rank of what stands before, and the next word.
    """
    key, levels, place = columns[0], [], None
    for c in columns[1:]:
        order = np.argsort(key)
        place = order if place is None else place[order]
        key = key[order]
        new = changes([key])
        levels.append(key[new])
        key = (np.cumsum(new) - 1).astype(np.uint64) << np.uint64(32) | c[place].astype(np.uint64)
    if values is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        place, key = order if place is None else place[order], key[order]
    first = np.flatnonzero(changes([key])) if len(key) else np.empty(0, np.int64)
    left, out = key[first], []
    for level in reversed(levels):
        out.insert(0, left & np.uint64(0xFFFFFFFF))
        left = level[(left >> np.uint64(32)).astype(np.int64)]
    sums = [np.diff(np.append(first, len(key)))] if values is None else [np.add.reduceat(v[place], first) if len(first) else np.empty(0, np.int64) for v in values]
    return [left, *out], sums


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(columns) == 1:
        np.not_equal(columns[0][1:], columns[0][:-1], out=out[1:])
    else:
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


class Counter:
    """Counts keys (in one or more columns); hands on blocks of (bucket, keys, counts) when it holds many."""

    def __init__(self, bucket_of, buckets: int):
        self.bucket_of, self.buckets, self.keys, self.counts, self.held = bucket_of, buckets, [], [], 0

    def add(self, *keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = summed_grams(keys)
        self.keys.append(k)
        self.counts.append(n[0])
        self.held += len(n[0])
        if self.held > HELD:
            k, (n,) = self._all()
            self.keys, self.counts, self.held = [k], [n], len(n)
            if self.held > HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            k, (n,) = self._all()
            self.keys, self.counts, self.held = [], [], 0
            yield from blocks(self.bucket_of(*k), self.buckets, *k, n)

    def _all(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return summed_grams([np.concatenate(c) for c in zip(*self.keys, strict=True)], [np.concatenate(self.counts)])


def _bits(n: float) -> int:
    """Enough bits for n buckets."""
    return max(3, math.ceil(math.log2(max(n, 1))))


def level_of(counts: np.ndarray) -> np.ndarray:
    """The class of a word's count: 0 for the most frequent words, LEVELS - 1 for those seen once."""
    return LEVELS - 1 - np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), LEVELS - 1)


def with_large(columns: list[np.ndarray]) -> list[bytes]:
    """Columns of numbers, a byte each, and the numbers from 255 on with their places."""
    small, large = [], []
    for c in columns:
        i = np.flatnonzero(c >= 255)
        small.append(np.minimum(c, 255).astype("u1").tobytes())
        large.append(np.concatenate([[len(i)], i, c[i]]).astype("<u8").tobytes())
    return [*small, *large]


def taken(column: np.ndarray, large: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The numbers at places i of a column of with_large()."""
    v = column[i].astype(np.int64)
    if (wide := v == 255).any():
        n = int(large[0])
        v[wide] = large[1 + n : 1 + 2 * n][np.searchsorted(large[1 : 1 + n], i[wide].astype(np.uint64))]
    return v


def coded(values: list[np.ndarray]) -> list[bytes]:
    """Rows of numbers as a byte each: the place of the row in a table of the 255 most frequent rows of small numbers, or 255 for the
    others, which follow with their places."""
    bits = 16 if len(values) == 1 else 20 // len(values)
    key, fits = np.zeros(len(values[0]), np.int64), np.ones(len(values[0]), bool)
    for k, v in enumerate(values):
        key |= np.minimum(v, (1 << bits) - 1) << k * bits
        fits &= v < 1 << bits
    found, n = np.unique(key[fits], return_counts=True)
    common = np.sort(found[np.argsort(-n, kind="stable")[:255]])
    at = np.searchsorted(common, key).clip(max=max(0, len(common) - 1))
    known = fits & (common[at] == key) if len(common) else np.zeros(len(key), bool)
    code = np.where(known, at, 255).astype("u1")
    rest = np.flatnonzero(~known)
    table = np.zeros((len(values), 256), np.int64)
    for k in range(len(values)):
        table[k, : len(common)] = common >> k * bits & (1 << bits) - 1
    width = 8 if len(rest) and max(int(v[rest].max()) for v in values) >= 1 << 32 else 4
    return [code.tobytes(), table.astype("<i8").tobytes(), np.array([len(rest), width], "<u8").tobytes(), rest.astype("<u4").tobytes(), *(v[rest].astype(f"<u{width}").tobytes() for v in values)]


class Grams:
    """A file of n-grams, open for reading: an index by the first bits of the keys, the other bits of each, and coded values."""

    def __init__(self, raw: np.ndarray, width: int):
        self.n, at = int(raw[:8].view("<u8")[0]), 8
        if not self.n:
            return
        size = 4 * ((1 << INDEX_BITS) + 1)
        self.index, at = raw[at : at + size].view("<u4"), at + size
        self.low, at = raw[at : at + 4 * self.n].view("<u4"), at + 4 * self.n
        self.code, at = raw[at : at + self.n], at + self.n
        self.table, at = np.frombuffer(raw[at : at + 8 * 256 * width].tobytes(), "<i8").reshape(width, 256), at + 8 * 256 * width
        rest, wide = np.frombuffer(raw[at : at + 16].tobytes(), "<u8").tolist()
        at += 16
        self.places, at = np.frombuffer(raw[at : at + 4 * rest].tobytes(), "<u4"), at + 4 * rest
        self.wide = np.frombuffer(raw[at : at + wide * rest * width].tobytes(), f"<u{wide}").reshape(width, rest)

    @staticmethod
    def content(keys: np.ndarray, values: list[np.ndarray]) -> list[bytes]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        index = np.searchsorted(keys, np.arange((1 << INDEX_BITS) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - INDEX_BITS))
        return [len(keys).to_bytes(8, "little"), index.astype("<u4").tobytes(), (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), *coded([v[order] for v in values])]

    def values(self, keys: np.ndarray) -> np.ndarray:
        """The values of each key, a row for each number; zeros for unseen ones."""
        if not self.n:
            return np.zeros((1, len(keys)), np.int64)
        first, q = (keys >> np.uint64(KEY_BITS - INDEX_BITS)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lo, hi = self.index[first].astype(np.int64), self.index[first + 1].astype(np.int64)
        stop = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.low[np.minimum(mid, self.n - 1)] < q)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, self.n - 1)
        hit = (lo < stop) & (self.low[at] == q)
        code = self.code[at]
        out = self.table[:, code]
        out[:, ~hit] = 0
        if (rare := hit & (code == 255)).any():
            out[:, rare] = self.wide[:, np.searchsorted(self.places, at[rare].astype(np.uint32))]
        return out


class Model:
    """A model's place and numbers; opens its files where it is used."""

    def __init__(self, path: str, word_bits: int, bases: np.ndarray, words: int, tokens: int, order: int = 2):
        self.path, self.word_bits, self.bases, self.tokens = path, word_bits, bases, tokens
        self.words, self.order = words, order
        self.gram_bits, self.ranges, self.pair_types = 3, 1, 0
        self.discounts: dict[int, list[float]] = {}
        self.seen_once_to_more: dict[int, int] = {}  # words by how many different words came before: 1, 2, 3 or more
        self._open: dict[str, object] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _raw(self, name: str) -> np.ndarray:
        """A file's bytes; those of an empty one if there is none."""
        try:
            raw = np.asarray(map_array(f"{self.path}/{name}", np.uint8))
        except FileNotFoundError:
            raw = np.empty(0, np.uint8)
        return raw if len(raw) else np.zeros(8, np.uint8)

    def _words(self, b: int) -> tuple:
        """(hashes, ranks, counts, large counts) of a file of words."""
        got = self._open.get(f"words-{b}")
        if got is None:
            raw = self._raw(f"words-{b}")
            n = int(raw[:8].view("<u8")[0])
            got = self._open[f"words-{b}"] = (raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 8 + 12 * n].view("<u4"), raw[8 + 12 * n : 8 + 13 * n], np.frombuffer(raw[8 + 13 * n :].tobytes(), "<u8"))
        return got

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, training count) of each hash; hashes are sorted."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(64 - self.word_bits)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange((1 << self.word_bits) + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            keys, ranks, counts, large = self._words(b)
            if len(keys):
                own = slice(edges[b], edges[b + 1])
                i = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
                hit, n = keys[i] == hashes[own], taken(counts, large, i)
                number[own] = np.where(hit, self.bases[b, level_of(n)] + ranks[i], -1)
                count[own] = np.where(hit, n, 0)
        return number, count

    def token_numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """numbers() of hashes in any order."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = self.numbers(distinct)
        return number[back], count[back]

    def _hashed(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(file, key in it) of n-grams."""
        h = mix(gram_key(columns))
        return (h >> np.uint64(64 - self.gram_bits)).astype(np.int64), (h << np.uint64(self.gram_bits)) >> np.uint64(64 - KEY_BITS)

    def gram_bucket(self, *columns: np.ndarray) -> np.ndarray:
        return self._hashed(*columns)[0]

    def gram_width(self, k: int) -> int:
        """Numbers kept of an n-gram of k words: its count, and below the highest order what follows it (total, n1, n2, n3+)."""
        return 1 if k == self.order else 5

    def put_grams(self, k: int, b: int, columns: list[np.ndarray], values: list[np.ndarray]) -> None:
        put_bytes(f"{self.path}/grams-{k}-{b}", Grams.content(self._hashed(*columns)[1], values))

    def gram_values(self, k: int, columns: list[np.ndarray]) -> np.ndarray:
        """The numbers kept of each n-gram of k words, a row for each number; zeros for unseen ones."""
        bucket, keys = self._hashed(*columns)
        # in order of file and key, as the files are
        order = np.argsort(mix(gram_key(columns)))
        bucket, keys = bucket[order], keys[order]
        out = np.zeros((self.gram_width(k), len(keys)), np.int64)
        edges = np.searchsorted(bucket, np.arange((1 << self.gram_bits) + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            name = f"grams-{k}-{b}"
            if name not in self._open:
                self._open[name] = Grams(self._raw(name), self.gram_width(k))
            out[:, order[edges[b] : edges[b + 1]]] = self._open[name].values(keys[edges[b] : edges[b + 1]])
        return out


    def word_stats(self, number: np.ndarray) -> np.ndarray:
        """Per word number (the last is the start of a text): total, n1, n2, n3+ as first of a pair, and words before it."""
        out = np.zeros((5, len(number)), np.int64)
        part = number % self.ranges
        for r in np.unique(part).tolist():
            own = np.flatnonzero(part == r)
            name = f"stats-{r}"
            if name not in self._open:
                raw = self._raw(name)
                n = int(raw[:8].view("<u8")[0])
                large, columns = np.frombuffer(raw[8 + 5 * n :].tobytes(), "<u8"), []
                for c in range(5):
                    size = int(large[0]) if len(large) else 0
                    columns.append((raw[8 + c * n : 8 + (c + 1) * n], large[: 1 + 2 * size]))
                    large = large[1 + 2 * size :]
                self._open[name] = n, columns
            n, columns = self._open[name]
            if n:
                for row, (c, large) in zip(out, columns, strict=True):
                    row[own] = taken(c, large, number[own] // self.ranges)
        return out


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its doc_id as text leaves 2 by 7. A null doc_id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _one(b: int, *values: int) -> pa.Table:
    return pa.table({"b": pa.array([b], pa.int32()), **{f"x{i}": pa.array([v], pa.int64()) for i, v in enumerate(values)}})


def _tally(k: int, seen: np.ndarray) -> pa.RecordBatch:
    """How many n-grams of k words were seen once to four times, as a block of its own bucket."""
    return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([k], pa.int32()), pa.array([packed(np.arange(4, dtype=np.uint64), seen)], pa.binary())], ["bucket", "kind", "block"])


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count all texts of docs into a new model of n-grams of up to `order` words in the shared folder.

    Null and empty texts are an end token alone. Texts begin with order - 1 start tokens. Orders below the highest count the
    different words before an n-gram.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    path = shared_dir(docs.sparkSession, "kneser-ney")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_WORD_BITS, _bits(size / WORD_FILE_BYTES))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lambda k: (k >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)
        for batch in batches:
            for _, texts in steps(batch, 0):
                yield from counter.add(token_hashes(texts)[0])
        yield from counter.flush()

    def write_words(group: pa.Table) -> pa.Table:
        b, parts = group["bucket"][0].as_py(), [unpacked(x.as_py(), 1) for x in group["block"]]
        keys, n = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        level = level_of(n)
        each = np.bincount(level, minlength=LEVELS)
        ranks, order = np.empty(len(n), np.int64), np.argsort(level, kind="stable")
        ranks[order] = np.arange(len(n)) - np.repeat(np.cumsum(each) - each, each)
        put_bytes(f"{path}/words-{b}", [len(keys).to_bytes(8, "little"), keys.astype("<u8").tobytes(), ranks.astype("<u4").tobytes(), *with_large([n])])
        return pa.table({"b": pa.array([b], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "each": pa.array([each.tolist()], pa.list_(pa.int64()))})

    made = rows.mapInArrow(released(words), BLOCKS).groupBy("bucket").applyInArrow(write_words, "b int, n long, each array<long>").collect()
    each = np.zeros((1 << bits, LEVELS), np.int64)  # a row for each file, of which there are 2**MOST_WORD_BITS at most
    for x in made:
        each[x["b"]] = x["each"]
    upto = np.cumsum(each.T.ravel())  # level by level, and in a level file by file
    bases = (upto - each.T.ravel()).reshape(LEVELS, 1 << bits).T.copy()
    model = Model(path, bits, bases, int(upto[-1]), sum(x["n"] for x in made), order)
    if model.words > MOST_WORDS:
        raise ValueError("too many distinct words to number in 32 bits")
    if not model.tokens:
        return model
    model.gram_bits = _bits(model.tokens / GRAM_FILE_TOKENS)
    model.ranges = ranges = 1 << max(0, model.gram_bits - 2)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        counter = Counter(m.gram_bucket, 1 << m.gram_bits)
        for batch in batches:
            for _, texts in steps(batch, 0):
                h, n = token_hashes(texts)
                yield from counter.add(*columns_of(windows(m, m.token_numbers(h)[0], n)))
        yield from counter.flush()

    def write_grams(k: int):
        """Writes the n-grams of k words of a bucket, and hands on what they say of those of k - 1: counts (kind 0) and followers (1)."""

        def sent_on(columns: list[np.ndarray], *values: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            if k == 2:
                return blocks((columns[0] % np.uint64(ranges)).astype(np.int64), ranges, *columns, *values, kind=kind)
            return blocks(model.gram_bucket(*columns), 1 << model.gram_bits, *columns, *values, kind=kind)

        def write(group: pa.Table) -> pa.Table:
            b, parts = group["bucket"][0].as_py(), []
            if b < 0:
                return group
            width = model.gram_width(k)
            for kind, block in zip(group["kind"].to_pylist(), group["block"], strict=True):
                got = unpacked(block.as_py(), k - 2 + (4 if kind else 1))
                none = np.zeros(len(got[0]), np.int64)
                parts.append([*got[: k - 1], *([none, *got[k - 1 :]] if kind else [got[k - 1], *[none] * (width - 1)])])
            got = [np.concatenate(c) for c in zip(*parts, strict=True)]
            columns, values = summed_grams(got[: k - 1], got[k - 1 :])
            model.put_grams(k, b, columns, values)
            live = values[0] > 0  # start tokens alone only come before
            n, words = values[0][live], words_of_grams([c[live] for c in columns])
            if not len(n):
                return pa.Table.from_batches([_tally(k, np.zeros(4, np.int64))])
            at = np.flatnonzero(changes(words[:-1]))
            followers = [np.add.reduceat(x, at) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))]
            ends, (before,) = summed_grams(columns_of(words[1:]))
            out = [*sent_on(columns_of([w[at] for w in words[:-1]]), *followers, kind=1), *sent_on(ends, before, kind=0)]
            return pa.Table.from_batches([*out, _tally(k, np.bincount(np.minimum(n, 5), minlength=6)[1:5])])

        return write

    def write_stats(group: pa.Table) -> pa.Table:
        r = group["bucket"][0].as_py()
        if r < 0:
            return pa.concat_tables([_one(-k, *unpacked(x.as_py(), 1)[1].tolist(), 0) for k, x in zip(group["kind"].to_pylist(), group["block"], strict=True)])
        size = (model.words - r) // ranges + 1
        columns = np.zeros((5, size), np.int64)
        for kind, block in zip(group["kind"].to_pylist(), group["block"], strict=True):
            keys, *got = unpacked(block.as_py(), 4 if kind else 1)
            i = keys.astype(np.int64) // ranges
            for row, x in zip(columns[:4] if kind else columns[4:], got, strict=True):
                row[i] += x  # a block has each word once
        put_bytes(f"{path}/stats-{r}", [size.to_bytes(8, "little"), *with_large(list(columns))])
        return _one(r, *np.bincount(np.minimum(columns[4], 5), minlength=6)[1:5].tolist(), int(columns[4].sum()))

    found = rows.mapInArrow(released(grams), BLOCKS)
    for k in range(order, 1, -1):
        found = found.groupBy("bucket").applyInArrow(write_grams(k), BLOCKS)
    made = found.groupBy("bucket").applyInArrow(write_stats, "b int, x0 long, x1 long, x2 long, x3 long, x4 long").collect()
    model.pair_types = sum(x["x4"] for x in made)
    for k in range(order, 0, -1):
        own = [x for x in made if (x["b"] == -k if k > 1 else x["b"] >= 0)]
        n = [sum(x[f"x{i}"] for x in own) for i in range(4)]
        model.discounts[k] = _discounts(n)
        if k == 1:
            model.seen_once_to_more = {1: n[0], 2: n[1], 3: model.words - n[0] - n[1]}
    return model


def windows(model: Model, number: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The words of the n-gram of the highest order that ends at each token; the number of words stands for the start of a text."""
    place = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
    out = [number]
    for back in range(1, model.order):
        w = np.full_like(number, model.words)
        w[back:] = number[:-back]
        w[place < back] = model.words
        out.insert(0, w)
    return out


def log_probabilities(model: Model, number: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of each token's interpolated probability, given word numbers (-1: unknown) of texts with n tokens."""
    uniform = 1.0 / (model.words + 1)
    if not model.tokens:
        return np.full(len(number), math.log10(uniform))
    words = windows(model, number, n)
    before = words[-2]
    all_numbers = np.unique(np.concatenate([number, before]))
    all_numbers = all_numbers[all_numbers >= 0]
    stats = model.word_stats(all_numbers)
    d1 = np.array(model.discounts[1])
    # single words, by how many different words came before
    cont = stats[4]
    rest = sum(d1[min(k, 3)] * c for k, c in model.seen_once_to_more.items()) / model.pair_types
    one = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / model.pair_types + rest * uniform
    p = np.where(number >= 0, one[np.maximum(np.searchsorted(all_numbers, number), 0).clip(max=max(0, len(one) - 1))] if len(one) else 0.0, rest * uniform)
    for k in range(2, model.order + 1):
        gram, d = words[-k:], np.array(model.discounts[k])
        known = np.all([w >= 0 for w in gram[:-1]], axis=0)
        if k == 2:
            total, n1, n2, n3 = stats[:4, np.searchsorted(all_numbers, before[known])]
        else:
            total, n1, n2, n3 = model.gram_values(k - 1, columns_of([w[known] for w in gram[:-1]]))[1:]
        count = np.zeros(int(known.sum()), np.int64)
        both = number[known] >= 0
        count[both] = model.gram_values(k, columns_of([w[known][both] for w in gram]))[0]
        seen = np.maximum(total, 1)
        higher = np.maximum(count - d[np.minimum(count, 3)], 0) / seen + (d[1] * n1 + d[2] * n2 + d[3] * n3) / seen * p[known]
        p[known] = np.where(total > 0, higher, p[known])
    return np.log10(p)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs.

    base_score adds one to each word's count; score is the model's log10 probability of the whole text. A null or empty text is
    an end token alone. A model without training text gives every token the probability 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part, texts in steps(batch, 2):
                h, n = token_hashes(texts)
                number, count = m.token_numbers(h)
                start = np.cumsum(n) - n
                base = np.log10((count + 1) / (m.tokens + 1 * (m.words + 1)))
                own = np.add.reduceat(log_probabilities(m, number, n), start)
                columns = [part.column(0), part.column(1), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), start)), pa.array(np.full(len(n), m.tokens)), pa.array(np.add.reduceat(base, start)), pa.array(own), pa.array(10 ** np.minimum(-own / n, 300))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(released(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Train a model of an order on the rows that aren't held out, and score all."""
    return score(docs, train(docs.filter(~held_out(F.col(doc_id))), text, order), doc_id, text)
