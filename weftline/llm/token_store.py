"""Token ids of documents in a binary format with Elias-Fano coded boundaries.

A shard file holds a run of documents in ascending doc_id order:

    magic b"WLTOK001", then little-endian int64: n_docs, n_tokens, bytes an id, first token's place in the whole corpus,
    bytes of the document-id section, bytes of the boundary section; then the document-id section (null flags, the ids'
    least value, an Elias-Fano sequence of the others' distances to it), the boundary section (Elias-Fano sequence of the
    documents' ends) and the ids.

An Elias-Fano sequence of n numbers up to u keeps the low floor(log2(u / n)) bits of each number packed, and the high bits in
unary as a bit vector; the position of every SELECT_STEP-th one bit is kept, so that select reads a bounded stretch.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.shared import KEPT, cut, few_parts, get_bytes, put_bytes, released, shared_dir, small, small_batches

MAGIC = b"WLTOK001"
HEADER = struct.Struct("<8s6q")
SELECT_STEP = 256
#: Bytes of ids that a worker keeps before it goes on in another shard.
SHARD_BYTES = 16 << 20
#: Words whose ids a worker keeps; beyond it starts anew.
CACHE_WORDS = 1_000_000


class EliasFano:
    """A monotone sequence of non-negative integers in near-minimal space, with random access by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        flags = np.zeros((n, bits), np.uint8)
        for b in range(bits):
            flags[:, b] = (v >> np.uint64(b)) & np.uint64(1)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(flags, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SELECT_STEP].astype("<u4" if n and ones[-1] < 1 << 32 else "<u8"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<5q", self.n, self.low_bits, len(self.low), len(self.high), self.samples.itemsize)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_buffer(cls, data) -> tuple[EliasFano, int]:
        """The sequence at the start of data, and its length in bytes."""
        n, bits, a, b, wide = struct.unpack_from("<5q", data)
        at, count = 40 + a + b, -(-n // SELECT_STEP)
        low, high = np.frombuffer(data, np.uint8, a, 40), np.frombuffer(data, np.uint8, b, 40 + a)
        return cls(n, bits, low, high, np.frombuffer(bytes(data[at : at + count * wide]), f"<u{wide}")), at + count * wide

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        start = i * self.low_bits
        word = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little")
        return (word >> start % 8) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """The i-th number: the place of the i-th one bit less i, and the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        while left:
            window = np.flatnonzero(np.unpackbits(self.high[at // 8 : at // 8 + 64], bitorder="little"))
            window = window[window > at % 8] + at // 8 * 8
            if len(window) >= left:
                at, left = int(window[left - 1]), 0
            elif len(window):
                at, left = int(window[-1]), left - len(window)
            else:  # no more one bits within reach: go on behind it
                at = (at // 8 + 64) * 8 - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            flags = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for b in range(self.low_bits):
                out |= flags[:, b].astype(np.uint64) << np.uint64(b)
        return out


#: A normaliser and pre-tokeniser under which a run of these small letters is one token before merging, and a run
#: of ASCII punctuation behind it another (fixed values of the public tokenizer's definition).
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
KNOWN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: A full stop or comma between an ASCII letter and white space: a token of its own.
_STOP = re.compile(rb"[.,](?<=[a-z].)(?=[ \n])")


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library.

    With the normaliser and pre-tokeniser known above, which never merge over ASCII white space, texts are encoded word by word:
    a word of letters by the library's model straight away, any other word through the whole of it; words seen are kept, up to
    CACHE_WORDS. Any other tokenizer is given whole texts.
    """

    def __init__(self, definition: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id, d = Tokenizer.from_str(definition), end_id, json.loads(definition)
        pre = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = (d["normalizer"] or {}).get("normalizers") == KNOWN_NORMALIZERS and len(pre) == 2 and pre[0].get("pattern") == {"Regex": KNOWN_SPLIT} and pre[0]["invert"] and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
        self.word = re.compile(f"([{LETTERS}]+)([!-/:-@\\[-`{{-~]*)").fullmatch if plain else None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x17F)} if plain else {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.stems: dict[str, bytes] = {}
        self.pool = array("I")
        self.starts, self.lengths = array("q"), array("q")

    def _stem(self, stem: str) -> bytes:
        got = self.stems.get(stem)
        if got is None:
            if len(self.stems) > CACHE_WORDS // 2:
                self.stems.clear()
            text = stem if stem.isascii() else stem.translate(self.as_bytes)
            got = self.stems[stem] = array("I", [x.id for x in self.tokenizer.model.tokenize(text)]).tobytes()
        return got

    def word_ids(self, word: str) -> bytes:
        """The ids of one word, 4 bytes each."""
        if m := self.word(word.lower()):
            return self._stem(m[1]) + self._stem(m[2]) if m[2] else self._stem(m[1])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _numbers(self, text: str) -> list[int]:
        """The places in the store of the words of a text, and of the end id."""
        raw = text.encode()
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            # no special token and no combining mark: small letters, and stops cut off, give the same ids with fewer words
            raw = _STOP.sub(rb" \g<0>", raw.lower())
        words = raw.split()  # bytes.split() cuts at ASCII white space only
        found, k = list(map(self.index.get, words)), -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            i = self.index.get(words[k])
            found[k] = self._keep(words[k], self.word_ids(words[k].decode())) if i is None else i
        return found

    def _keep(self, word: bytes, ids: bytes) -> int:
        i = self.index[word] = len(self.starts)
        self.starts.append(len(self.pool))
        self.lengths.append(len(ids) // 4)
        self.pool.frombytes(ids)
        return i

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id; the number of each text's ids)."""
        if not self.word:
            whole = [[*x.ids, self.end_id] for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(whole), np.uint32), np.fromiter(map(len, whole), np.int64, len(whole))
        if len(self.index) > CACHE_WORDS:
            self.clear()
        end = self.index.get(b"\n")  # no word
        if end is None:
            end = self._keep(b"\n", array("I", [self.end_id]).tobytes())
        found = [self._numbers(t) if t else [] for t in texts]
        for x in found:
            x.append(end)
        at = np.fromiter(chain.from_iterable(found), np.int64)
        n = np.frombuffer(self.lengths, np.int64)[at].copy()
        upto = np.cumsum(n)
        first = np.frombuffer(self.starts, np.int64)[at] - (upto - n)
        ids = np.frombuffer(self.pool, np.uint32)[np.repeat(first, n) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.cumsum([len(x) for x in found])
        return ids, np.diff(upto[ends - 1], prepend=0)


_KEPT: dict[tuple[int, int], WordEncoder] = {}


def _encoder(definition: str, end_id: int) -> WordEncoder:
    """The worker's encoder, kept between tasks."""
    key = (hash(definition), end_id)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = WordEncoder(definition, end_id)
    KEPT["token_store"] = _KEPT.clear
    return _KEPT[key]


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, start: int, width: int = 4) -> bytes:
    """A shard file's content. Nulls come first among doc_ids, which ascend; width: bytes an id."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    numbers = struct.pack("<2q", nulls, least) + EliasFano.of((known - np.int64(least)).astype(np.uint64)).to_bytes()
    ends = EliasFano.of(np.cumsum(lengths)).to_bytes()
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), width, start, len(numbers), len(ends)) + numbers + ends + ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard file, open for reading."""

    def __init__(self, data):
        magic, self.n_docs, self.n_tokens, width, self.start, a, b = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        self.nulls, self.least = struct.unpack_from("<2q", data, at)
        self.numbers, _ = EliasFano.from_buffer(data[at + 16 : at + a])
        self.ends, _ = EliasFano.from_buffer(data[at + a : at + a + b])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_tokens, at + a + b)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(x) for x in self.numbers.all().astype(np.int64) + np.int64(self.least)]

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the shard, by select."""
        return self.ids[(self.ends[i - 1] if i else 0) : self.ends[i]]


def most_id(definition: str, end_id: int) -> int:
    """The largest id that a tokenizer, or the end of a document, can give."""
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values()])


def write_tokens(docs: DataFrame, path: str, definition: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, width: int = 4) -> DataFrame:
    """Encode every text, write shard files below path in ascending doc_id order, and return their manifest.

    definition: the tokenizer's JSON. width: bytes an id; ids that don't fit it are refused beforehand. A null or empty text is its
    end id alone. Rows with equal doc_id stay apart, in the order of their texts' hashes, by which many such rows are split; null
    doc_ids come first. An empty table gives no shard. The manifest has part, shard (their order), file, n_docs, n_tokens and start
    (ids of all shards before).
    """
    spark = docs.sparkSession
    if most_id(definition, end_id) >= 1 << 8 * width:
        raise ValueError(f"the tokenizer has ids that {width} bytes can't hold")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, k = TaskContext.get().partitionId(), _encoder(definition, end_id), 0
        numbers, lengths, ids = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal k, numbers, lengths, ids
            all_ids, all_lengths = np.concatenate(ids), np.concatenate(lengths)
            name = f"{path}/tokens-{part:06d}-{k:05d}.bin"
            put_bytes(name, [shard_bytes(numbers, all_lengths, all_ids, 0, width)])
            row = {"part": [part], "shard": [k], "file": [name], "n_docs": [len(numbers)], "n_tokens": [len(all_ids)]}
            k, numbers, lengths, ids = k + 1, [], [], []
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                got, n = encoder.encode(some.column(1).to_pylist())
                numbers += some.column(0).to_pylist()
                lengths.append(n)
                ids.append(got.astype(f"<u{width}"))
                if sum(map(len, ids)) * width >= SHARD_BYTES:
                    yield flush()
        if numbers:
            yield flush()

    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    made = cut(ordered.select("doc_id", "text").mapInArrow(released(write, "token_store"), "part int, shard int, file string, n_docs long, n_tokens long"), "token-manifest")
    # starts: ids of the partitions before (a row for each partition on the driver), and of the shards before in the partition
    totals = sorted((x["part"], x["n"]) for x in made.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = [0, *accumulate(n for _, n in totals)][: len(totals)]
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=True)], "part int, _before long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return made.withColumn("start", within - F.col("n_tokens")).join(small(offsets), "part").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the shard files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(get_bytes(file))
                ends, numbers = shard.ends.all().astype(np.int64), shard.doc_ids()
                for lo in range(0, shard.n_docs, 10_000):
                    hi = min(shard.n_docs, lo + 10_000)
                    begin = int(ends[lo - 1]) if lo else 0
                    ids = memoryview(shard.ids[begin : int(ends[hi - 1])].astype("<u4").tobytes())
                    e = ends[lo:hi]
                    s = np.concatenate([[begin], e[:-1]])
                    sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((s - begin).tolist(), (e - begin).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[lo:hi], pa.int64()), pa.array(s + start, pa.int64()), pa.array(e - s, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").repartition(few_parts(manifest.sparkSession, manifest.count())).mapInArrow(released(read, "token_store"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_round_trip(docs: DataFrame, definition: str, *, end_id: int = 1, width: int = 4) -> DataFrame:
    """Write the documents' ids to shard files in the shared folder, and read them back."""
    path = shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, definition, end_id=end_id, width=width))
