"""Line dedup by an exact set-similarity join.

A line is the set of its words, each known by 40 bits of its hash throughout (two different words are taken for one by a chance of
2**-40 a pair). Two lines match if the Jaccard similarity of their sets is 4/5 or more; a line goes if an earlier
line (by doc_id, then line number) matches it. Equal sets are one class, which stands for its first line.

The join: the words of every class are ordered by rarity (counts over all lines, in a table of fixed size). Two matching classes
share a word among the first ones of both, so a class is posted under its first words only. Postings meet by word; pairs there
pass a length filter, a positional filter (what can still follow the shared word) and a bitmap filter (set bits of the
exclusive-or of word parities are at most the symmetric difference), and are then verified on the whole sets, which the posting
tasks left in files in the shared folder. A class that has been found to match an earlier one needs no further pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.hashing import BLOCKS, blocks, mix, steps, unpacked, words_of
from weftline.llm.shared import cut, map_array, put_bytes, released, released_group, shared_dir, small_batches

#: The least Jaccard similarity, as a fraction.
NUM, DEN = 4, 5
#: Counters of the rarity table (a power of two), and how many a block of it has.
COUNTERS_BITS, COUNTERS_BLOCK_BITS = 20, 14
#: Text bytes that a group of postings is for, and that a file of classes is for.
POSTING_BYTES, CLASS_BYTES = 12 << 20, 48 << 20
#: Words of a file of sets, classes in a word's group beyond which its earliest ones go first, and pairs of a step.
SET_FILE_WORDS, CROWD, TILE, PAIRS = 2_000_000, 1024, 512, 500_000
#: Text of a step: its arrays take some 25 times as much.
STEP = 1 << 19
LAST = np.iinfo(np.int64).max
#: A place in a file of sets: the attempt of the task that wrote it, the file's number in it, and the row.
FILE_BITS, ROW_BITS = 10, 22
_TOKEN = np.uint64((1 << 40) - 1)


def least_overlap(a, b):
    """Shared words that sets of a and b words must have to match."""
    return (NUM * (a + b) + NUM + DEN - 1) // (NUM + DEN)


class Lines:
    """The lines with words of some texts: text, line number, size, class, bitmap and words in order of rarity."""

    def __init__(self, texts: list[str | None], levels: np.ndarray):
        h, begin, words, b = words_of(texts)
        breaks = np.flatnonzero(b == 10)
        text = np.repeat(np.arange(len(texts)), words)
        line = np.searchsorted(breaks, begin)
        first = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(line, prepend=-1)) if len(h) else np.empty(0, np.int64)
        starts = np.cumsum([1, *(len(t.encode()) + 1 if t else 1 for t in texts)])[:-1]
        self.text, self.number = text[first], line[first] - np.searchsorted(breaks, starts)[text[first]]
        token = levels[(h >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
        edges, found, sizes = np.append(first, len(h)), [], []
        for lo in range(0, len(first), 1 << 16):  # a line's number within the step fits 16 bits
            hi = min(len(first), lo + (1 << 16))
            own = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(edges[lo : hi + 1]))
            keys = np.sort(own << np.uint64(48) | token[edges[lo] : edges[hi]])
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            sizes.append(np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=hi - lo))
            found.append(keys & np.uint64((1 << 48) - 1))
        self.words = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        self.start = np.cumsum(self.size) - self.size
        if len(first):
            self.cls = mix(np.add.reduceat(mix(self.words), self.start) + self.size.astype(np.uint64))
            bit = np.uint64(1) << (self.words & np.uint64(63))
            upper = (self.words & np.uint64(64)) != 0
            self.bitmap = [np.bitwise_xor.reduceat(np.where(upper == u, bit, np.uint64(0)), self.start) for u in (False, True)]
        else:
            self.cls, self.bitmap = np.empty(0, np.uint64), [np.empty(0, np.uint64)] * 2


def flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i] to start[i] + n[i] - 1 for all i, one after the other."""
    upto = np.cumsum(n)
    return np.repeat(start - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x).astype(np.uint64)
    return x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)


def joined(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return hi.astype(np.uint64) << np.uint64(32) | lo.astype(np.uint64)


class SetFiles:
    """Files of classes: class, doc_id, line, size and words; a place in them is a file's name and a row.

    A file is named by the attempt of the task that writes it, so that no two files share a name, and a repeated task never changes
    a file that others read.
    """

    def __init__(self, path: str):
        self.path, self.open, self.written = path, {}, 0

    def write(self, cls, doc, line, size, words) -> np.ndarray:
        """Places of the rows, in new files."""
        from pyspark import TaskContext

        task, places, upto = TaskContext.get(), [], np.concatenate([[0], np.cumsum(size)])
        attempt = task.taskAttemptId() if task else 0
        low = words & _TOKEN
        for lo in range(0, len(cls), 1 << ROW_BITS):
            if self.written >> FILE_BITS or attempt >> (64 - FILE_BITS - ROW_BITS):
                raise ValueError("a partition has too many words, or the application too many tasks, to name the files of sets")
            hi = min(len(cls), lo + (1 << ROW_BITS))
            name, own = attempt << FILE_BITS | self.written, low[upto[lo] : upto[hi]]
            put_bytes(f"{self.path}/sets-{name:x}", [(hi - lo).to_bytes(8, "little"), cls[lo:hi].astype("<u8").tobytes(), doc[lo:hi].astype("<i8").tobytes(), line[lo:hi].astype("<u4").tobytes(), size[lo:hi].astype("<u4").tobytes(), (own & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (own >> np.uint64(32)).astype("u1").tobytes()])
            self.written += 1
            places.append(np.uint64(name << ROW_BITS) | np.arange(hi - lo, dtype=np.uint64))
        return np.concatenate(places)

    def _file(self, name: int) -> list[np.ndarray]:
        got = self.open.get(name)
        if got is None:
            raw = map_array(f"{self.path}/sets-{name:x}", np.uint8)
            n, at, got = int(raw[:8].view("<u8")[0]), 8, []
            for kind in ("<u8", "<i8", "<u4", "<u4"):
                size = n * np.dtype(kind).itemsize
                got.append(raw[at : at + size].view(kind))
                at += size
            words = (len(raw) - at) // 5
            start = np.cumsum(got[3], dtype=np.int64) - got[3]
            got += [start, raw[at : at + 4 * words].view("<u4"), raw[at + 4 * words :]]
            self.open[name] = got
        return got

    def _by_file(self, places: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        if not len(places):
            return
        files = places >> np.uint64(ROW_BITS)
        order = np.argsort(files, kind="stable")
        names, first = np.unique(files[order], return_index=True)
        for name, i in zip(names.tolist(), np.split(order, first[1:]), strict=True):
            yield self._file(name), i, (places[i] & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)

    def heads(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, doc_id, line) at each place."""
        cls, doc, line = np.empty(len(places), np.uint64), np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        for f, i, row in self._by_file(places):
            cls[i], doc[i], line[i] = f[0][row], f[1][row], f[2][row]
        return cls, doc, line

    def words(self, places: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The words of all places' sets, one after the other."""
        out = np.empty(int(size.sum()), np.uint64)
        to = np.cumsum(size) - size
        for f, i, row in self._by_file(places):
            at = flat(f[4][row], size[i])
            out[flat(to[i], size[i])] = f[5][at].astype(np.uint64) | f[6][at].astype(np.uint64) << np.uint64(32)
        return out


class Matcher:
    """The postings of one group, and which of their classes match an earlier one."""

    def __init__(self, files: SetFiles, token, place, size, pos, low, high):
        order = np.argsort(token, kind="stable")
        t = token[order]
        again = np.zeros(len(t), bool)
        same = t[1:] == t[:-1]
        again[1:] |= same
        again[:-1] |= same
        order = order[again]  # a word that one class has is no meeting
        cls, doc, line = files.heads(place[order])
        # numbers of the classes in order of their first lines
        by = np.lexsort((line, doc, cls))
        first = by[np.concatenate([[True], cls[by][1:] != cls[by][:-1]])] if len(by) else by
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((cls[first], line[first], doc[first]))] = np.arange(len(first))
        rank_of = rank[np.searchsorted(cls[first], cls)]
        self.files, self.classes, self.gone = files, np.empty(len(first), np.uint64), np.zeros(len(first), bool)
        self.classes[rank] = cls[first]
        self.token, self.rank, rows = token[order], rank_of, order
        keep = np.lexsort((self.rank, size[rows], self.token))
        fresh = np.concatenate([[True], (self.token[keep][1:] != self.token[keep][:-1]) | (self.rank[keep][1:] != self.rank[keep][:-1])]) if len(keep) else np.empty(0, bool)
        keep = keep[fresh]
        self.token, self.rank, rows = self.token[keep], self.rank[keep], rows[keep]
        self.place, self.size, self.pos, self.low, self.high = place[rows], size[rows], pos[rows], low[rows], high[rows]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs pass the positional and the bitmap filter."""
        need = least_overlap(self.size[i], self.size[j])
        ok = np.minimum(self.size[i] - self.pos[i], self.size[j] - self.pos[j]) >= need
        i, j, apart = i[ok], j[ok], (self.size[i] + self.size[j] - 2 * need)[ok]
        ok[ok] = np.bitwise_count(self.low[i] ^ self.low[j]).astype(np.int64) + np.bitwise_count(self.high[i] ^ self.high[j]) <= apart
        return ok

    def verify(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs match."""
        out = np.empty(len(i), bool)
        total = np.cumsum(self.size[i] + self.size[j])
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS)))
            hi = min(hi, lo + (1 << 22))
            a, b = i[lo:hi], j[lo:hi]
            n = np.arange(hi - lo, dtype=np.uint64) << np.uint64(40)
            keys = np.sort(np.concatenate([np.repeat(n, self.size[x]) | self.files.words(self.place[x], self.size[x]) for x in (a, b)]))
            shared = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(40)).astype(np.int64), minlength=hi - lo)
            out[lo:hi] = shared >= least_overlap(self.size[a], self.size[b])
            lo = hi
        return out

    def settle(self, i: np.ndarray, j: np.ndarray) -> None:
        """Verify filtered pairs, each later class against earlier ones in turn until one matches."""
        late = self.rank[i] > self.rank[j]
        later, earlier = np.where(late, i, j), np.where(late, j, i)
        ok = ~self.gone[self.rank[later]]
        later, earlier = later[ok], earlier[ok]
        order = np.lexsort((self.rank[earlier], self.rank[later]))
        later, earlier = later[order], earlier[order]
        tries = 1
        while len(later):
            r = self.rank[later]
            start = np.flatnonzero(np.diff(r, prepend=-1))
            turn = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
            now = turn < tries
            hit = self.verify(later[now], earlier[now])
            self.gone[r[now][hit]] = True
            rest = ~now
            later, earlier = later[rest], earlier[rest]
            left = ~self.gone[self.rank[later]]
            later, earlier, tries = later[left], earlier[left], tries * 2

    def run(self) -> np.ndarray:
        """The classes that match an earlier one."""
        n = len(self.token)
        if not n:
            return self.classes[:0]
        start = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1]]))
        count = np.diff(np.append(start, n))
        crowded = count > CROWD
        for s, c in zip(start[crowded].tolist(), count[crowded].tolist(), strict=True):
            self._crowd(np.arange(s, s + c))
        group = np.repeat(np.arange(len(start)), count)
        # rows are in order of size within a word: the longer partner of each row stands behind it, up to 5/4 of its size
        key = group.astype(np.int64) << 32 | self.size
        upto = np.searchsorted(key, group.astype(np.int64) << 32 | np.minimum(self.size * DEN // NUM, (1 << 32) - 1), side="right")
        eligible = (self.pos < self.size - (2 * NUM * self.size + NUM + DEN - 1) // (NUM + DEN) + 1) & ~crowded[group]
        partners = np.where(eligible, np.maximum(upto - np.arange(n) - 1, 0), 0)
        total, lo = np.cumsum(partners), 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS))))
            i = np.repeat(np.arange(lo, hi), partners[lo:hi])
            j = flat(np.arange(lo, hi) + 1, partners[lo:hi])
            ok = self.near(i, j)
            self.settle(i[ok], j[ok])
            lo = hi
        return self.classes[self.gone]

    def _crowd(self, rows: np.ndarray) -> None:
        """One word's rows: the earliest tile against all later rows that are still there, then the next one."""
        rows = rows[np.argsort(self.rank[rows], kind="stable")]
        for lo in range(0, len(rows), TILE):
            early, late = rows[lo : lo + TILE], rows[lo + 1 :]
            late = late[~self.gone[self.rank[late]]]
            for at in range(0, len(late), PAIRS // TILE):
                part = late[at : at + PAIRS // TILE]
                part = part[~self.gone[self.rank[part]]]
                a, b = np.repeat(early, len(part)), np.tile(part, len(early))
                ok = (self.rank[a] < self.rank[b]) & (np.maximum(self.size[a], self.size[b]) * NUM <= np.minimum(self.size[a], self.size[b]) * DEN)
                a, b = a[ok], b[ok]
                ok = self.near(a, b)
                self.settle(a[ok], b[ok])


def rarity_levels(rows: DataFrame) -> np.ndarray:
    """A level from 0 (rare) to 255 for each counter, from the counts of all words of all lines."""
    size, per = 1 << COUNTERS_BITS, 1 << COUNTERS_BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in steps(batch, 1, STEP):
                total += np.bincount((words_of(texts)[0] >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64), minlength=size)
        some = np.flatnonzero(total)
        yield from blocks(some >> COUNTERS_BLOCK_BITS, size // per, some.astype(np.uint64), *halves(total[some]))

    def add(group: pa.Table) -> pa.Table:
        b = group["bucket"][0].as_py()
        total = np.zeros(per, np.float64)
        for block in group["block"]:
            keys, hi, lo = unpacked(block.as_py(), 2)
            total[keys.astype(np.int64) - b * per] += joined(hi, lo).astype(np.float64)
        levels = np.minimum(255, np.floor(6 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return pa.table({"bucket": pa.array([b], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for row in rows.mapInArrow(released(count), BLOCKS).groupBy("bucket").applyInArrow(released_group(add), "bucket int, levels binary").collect():  # a byte a counter
        out[row["bucket"] * per : (row["bucket"] + 1) * per] = np.frombuffer(row["levels"], np.uint8)
    return out


class Verdicts:
    """Which line of each class stays, looked up in files of sorted classes."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.open = path, bits, {}

    def _file(self, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
        got = self.open.get(name)
        if got is None:
            try:
                raw = map_array(f"{self.path}/{name}", np.uint8)
            except FileNotFoundError:
                raw = np.zeros(8, np.uint8)
            n, at, got = int(raw[:8].view("<u8")[0]), 8, []
            for kind in kinds:
                size = n * np.dtype(kind).itemsize
                got.append(raw[at : at + size].view(kind))
                at += size
            self.open[name] = got
        return got

    def first(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, line of each class' first line, whether it goes too)."""
        doc, line, gone = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64), np.zeros(len(cls), bool)
        bucket = (cls >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[b] : edges[b + 1]]
            keys, docs, lines = self._file(f"classes-{b}", ("<u8", "<i8", "<u4"))
            i = np.searchsorted(keys, cls[at])
            doc[at], line[at] = docs[i], lines[i]
            (out,) = self._file(f"gone-{b}", ("<u8",))
            if len(out):
                gone[at] = out[np.minimum(np.searchsorted(out, cls[at]), len(out) - 1)] == cls[at]
        return doc, line, gone


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without the lines that match an earlier line, and a column _lines: struct(n_lines, removed).

    n_lines counts the \\n-split lines that have a word; removed lists the numbers (from 0) of those taken out. Lines without
    words stay, except that a text of which all lines with words go becomes empty. A null text stays null. Rows with the same
    doc_id count as one document: equal lines at the same place of theirs are one line. Null doc_ids come last, and count as one
    such id. All other columns stay, whatever their names; a column _lines is replaced. An empty table gives an empty result. docs is read three times
    and has to give the same rows each time, as a table does.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != "_lines"]
    path = shared_dir(spark, "line-dedup")
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))).alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    posting_bits, bits = (max(3, int(total // n).bit_length()) for n in (POSTING_BYTES, CLASS_BYTES))
    levels = spark.sparkContext.broadcast(rarity_levels(rows).tobytes())  # 2**20 bytes

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, files, held, n = np.frombuffer(levels.value, np.uint8), SetFiles(path), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cls, doc, line, size, low, high, words = (np.concatenate(c) for c in zip(*held, strict=True))
            place = files.write(cls, doc, line, size, words)
            prefix = size - (NUM * size + DEN - 1) // DEN + 1
            row = np.repeat(np.arange(len(cls)), prefix)
            pos = flat(np.zeros(len(cls), np.int64), prefix)
            token = words[(np.cumsum(size) - size)[row] + pos] & _TOKEN
            order = np.argsort(token, kind="stable")
            row, pos, token = row[order], pos[order], token[order]
            bucket = (mix(token) >> np.uint64(64 - posting_bits)).astype(np.int64)
            yield from blocks(bucket, 1 << posting_bits, token, *halves(place[row]), size[row], pos, *halves(low[row]), *halves(high[row]), kind=0)
            order = np.argsort(cls, kind="stable")
            yield from blocks((cls[order] >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, cls[order], *halves(doc[order]), line[order], kind=1)
            held.clear()

        for batch in batches:
            for part, texts in steps(batch, 1, STEP):
                lines = Lines(texts, table)
                if not len(lines.cls):
                    continue
                doc = part.column(0).to_numpy(zero_copy_only=False)[lines.text]
                order = np.lexsort((lines.number, doc, lines.cls))
                new = order[np.concatenate([[True], lines.cls[order][1:] != lines.cls[order][:-1]])]
                held.append((lines.cls[new], doc[new], lines.number[new], lines.size[new], lines.bitmap[0][new], lines.bitmap[1][new], lines.words[flat(lines.start[new], lines.size[new])]))
                n += int(lines.size[new].sum())
                if n >= SET_FILE_WORDS:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        b, parts = group["bucket"][0].as_py(), group["block"]
        if group["kind"][0].as_py() == 0:
            token, p1, p0, size, pos, l1, l0, h1, h0 = (np.concatenate(c) for c in zip(*(unpacked(x.as_py(), 8) for x in parts), strict=True))
            gone = Matcher(SetFiles(path), token, joined(p1, p0), size, pos, joined(l1, l0), joined(h1, h0)).run()
            return pa.table({"cls": pa.array(gone.view(np.int64))})
        cls, d1, d0, line = (np.concatenate(c) for c in zip(*(unpacked(x.as_py(), 3) for x in parts), strict=True))
        doc = joined(d1, d0).view(np.int64)
        order = np.lexsort((line, doc, cls))
        order = order[np.concatenate([[True], cls[order][1:] != cls[order][:-1]])]
        put_bytes(f"{path}/classes-{b}", [len(order).to_bytes(8, "little"), cls[order].astype("<u8").tobytes(), doc[order].astype("<i8").tobytes(), line[order].astype("<u4").tobytes()])
        return pa.table({"cls": pa.array([], pa.int64())})

    def write_gone(group: pa.Table) -> pa.Table:
        b, cls = group["b"][0].as_py(), np.unique(group["cls"].to_numpy().view(np.uint64))
        put_bytes(f"{path}/gone-{b}", [len(cls).to_bytes(8, "little"), cls.astype("<u8").tobytes()])
        return pa.table({"n": pa.array([len(cls)], pa.int64())})

    gone = cut(rows.mapInArrow(released(post), BLOCKS).groupBy("kind", "bucket").applyInArrow(released_group(meet), "cls long"), "line-matches")
    gone = gone.distinct().withColumn("b", F.shiftrightunsigned("cls", 64 - bits).cast("int"))
    gone.groupBy("b").applyInArrow(released_group(write_gone), "n long").agg(F.sum("n")).collect()

    kept = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(int(LAST))).alias("id"))
    kind = T.StructType().add("n_lines", T.IntegerType()).add("removed", T.ArrayType(T.IntegerType()))
    schema = docs.select(*(F.col(f"`{c}`") for c in names)).schema.add("_lines", kind)
    at = names.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, verdicts = np.frombuffer(levels.value, np.uint8), Verdicts(path, bits)
        for batch in batches:
            for part, texts in steps(batch, at, STEP):
                lines = Lines(texts, table)
                doc = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)[lines.text]
                first_doc, first_line, out = verdicts.first(lines.cls)
                out |= (first_doc != doc) | (first_line != lines.number)
                n = np.bincount(lines.text, minlength=len(texts))
                ends = np.cumsum(n).tolist()
                removed, lo = [], 0
                for k, hi in enumerate(ends):
                    bad = lines.number[lo:hi][out[lo:hi]].tolist()
                    removed.append(bad)
                    if bad:
                        drop = set(bad)
                        texts[k] = "" if len(bad) == hi - lo else "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in drop)
                    lo = hi
                columns = [*part.columns[:at], pa.array(texts, pa.string()), *part.columns[at + 1 : -1]]
                info = pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(removed, pa.list_(pa.int32()))], ["n_lines", "removed"])
                yield pa.RecordBatch.from_arrays([*columns, info], schema.names)

    return kept.mapInArrow(released(apply), schema)
