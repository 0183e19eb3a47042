"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are dealt to tiles by population count. Two fingerprints within the radius differ in population count by
no more than it, so only tile pairs that near are compared, in full, with numpy exclusive-or and bit counts. Tiles are files in
the shared folder that each comparing task reads; a task returns a spanning forest of the links it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import Forest, components
from weftline.llm.shared import cut, few_parts, map_array, put_bytes, released, shared_dir, small, small_batches

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Least and most expected fingerprints of a tile; between, a 64th of all.
TILE = (1024, 131_072)
#: Exclusive-ors held at once.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each k-word shingle (all words if fewer than k; none without words), words in lower case (A-Z)."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    starts = (ends - n)[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, fp long) of every row, and the long column `row` if given; a null or empty text has fingerprint zero."""
    own = [row] if row else []

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *own])

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *own).mapInArrow(released(make), ", ".join(["doc_id long, fp long", *(f"{c} long" for c in own)]))


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Forest:
    """The links of a's (first) and b's fingerprints (after them; the same ones if `same`) as a forest."""
    forest, shift, step = Forest(len(a) + (0 if same else len(b))), 0 if same else len(a), max(1, BLOCK // max(1, len(b)))
    for lo in range(0, len(a), step):
        rest = lo if same else 0
        near = np.bitwise_count(a[lo : lo + step, None] ^ b[None, rest:]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            forest.unite_pairs(i + lo, j + rest + shift)
    return forest


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius, for distinct long fingerprints in a column fp."""
    spark, path = fps.sparkSession, shared_dir(fps.sparkSession, "simhash-tiles")
    keyed = fps.select("fp", F.bit_count("fp").alias("p"))
    counts = {x["p"]: x["count"] for x in keyed.groupBy("p").count().collect()}  # 65 rows at most
    edge = min(TILE[1], max(TILE[0], sum(counts.values()) // 64))
    cuts = [math.ceil(counts.get(p, 0) / edge) for p in range(65)]
    cuts_of = F.array(*map(F.lit, cuts))
    tiled = keyed.withColumn("s", F.pmod(F.xxhash64("fp"), F.get(cuts_of, F.col("p"))).cast("int"))

    def write(group: pa.Table) -> pa.Table:
        p, s = group.column("p")[0].as_py(), group.column("s")[0].as_py()
        put_bytes(f"{path}/{p}-{s}", [np.sort(group.column("fp").to_numpy().view(np.uint64)).tobytes()])
        return pa.table({"p": pa.array([p], pa.int32()), "s": pa.array([s], pa.int32()), "n": pa.array([group.num_rows], pa.int64())})

    tiles = cut(tiled.groupBy("p", "s").applyInArrow(write, "p int, s int, n long"), "simhash-tiles")
    near = F.explode(F.sequence("p", F.least(F.lit(64), F.col("p") + radius)))
    pairs = tiles.select("p", "s", near.alias("q")).withColumn("k", F.get(cuts_of, F.col("q"))).filter("k > 0")
    pairs = pairs.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).filter("q > p or t >= s").drop("k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, s, q, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = (p, s) == (q, t)
                a = np.array(map_array(f"{path}/{p}-{s}", np.uint64))
                b = a if same else np.array(_tile(f"{path}/{q}-{t}"))
                member, root = near_pairs(a, b, radius, same).stars()
                values = (a if same else np.concatenate([a, b])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values[member]), pa.array(values[root])], ["a", "b"])

    n_pairs = sum(cuts[p] * (cuts[p] + 1) // 2 + cuts[p] * sum(cuts[p + 1 : p + radius + 1]) for p in range(65))
    return pairs.select("p", "s", "q", "t").repartition(few_parts(spark, n_pairs)).mapInArrow(compare, "a long, b long")


def _tile(uri: str) -> np.ndarray:
    """A tile's fingerprints; none if it has no file because no fingerprint fell to it."""
    try:
        return map_array(uri, np.uint64)
    except FileNotFoundError:
        return np.empty(0, np.uint64)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable by links) of every row of docs.

    Null and empty texts have fingerprint zero, which links like any other. Rows with the same doc_id are separate copies of
    it. Null doc_ids are kept and never a component's id, unless it has no other. Other columns are ignored.
    """
    own = cut(fingerprints(docs, doc_id, text, shingle), "simhash")
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(link_fingerprints(fps.select("fp"), radius))
    rooted = fps.join(linked, fps["fp"] == linked["node"]).select("fp", "root", "least")
    best = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    moved = cut(rooted.join(small(best), "root").select("fp", "component_id"), "simhash-components")
    of = fps.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each group of near-duplicates, the one with the least doc_id (null ones last).

    Rows are told apart by a number of their own, so that doc_ids may be null or repeated; columns of any name come through.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = cut(docs.select(whole.alias("row"), F.monotonically_increasing_id().alias("_row")), "simhash-rows")
    texts = marked.select(F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{text}`").alias("text"), "_row")
    own = cut(fingerprints(texts, "doc_id", "text", shingle, "_row"), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    fps = cut(own.groupBy("fp").agg(F.min(place).alias("first")), "simhash-distinct")
    linked = components(link_fingerprints(fps.select("fp"), radius))
    firsts = fps.join(linked, fps["fp"] == linked["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    gone = cut(own.select("_row").join(firsts.select("first._row"), "_row", "left_anti"), "simhash-gone")
    return marked.join(small(gone), "_row", "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
