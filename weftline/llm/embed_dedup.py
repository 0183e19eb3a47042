"""Near-duplicate vectors by an exact subspace pigeonhole join on cosine.

Unit vectors with cosine c or more are at most sqrt(2 - 2c) apart. After a fixed random rotation the dimensions are split into
blocks; the squared distances in the blocks sum up to the whole, so in at least one block it is within that block's share of the
budget (in proportion to its dimensions). Each block is range-joined: vectors are dealt to grid cells over its leading
coordinates, with cells as wide as the block's radius, and compared with the same and half of the adjoining cells, in order of the
block's last coordinate. A pair is verified with the given vectors in double precision, in the first block where it is a candidate. Crowded cells are split into
tiles, and every two tiles meet in a task of their own.

Links aren't returned one by one: a task returns how many each vector has, and a spanning forest of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import Forest, components
from weftline.llm.shared import cut, map_array, put_bytes, shared_dir, small

#: Dimensions of a block, and of its grid.
BLOCK_DIMS, GRID_DIMS = 8, 2
#: Vectors of a tile, and rows and columns of one step of a comparison.
TILE, STEP, SPAN = 4096, 256, 1024
#: Room for rounding in the candidate search; candidates are verified without it.
SLACK = 1e-6


def rotation(dims: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix that depends on nothing but its size and the seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Plan:
    """Rotation, blocks and their radii for vectors of `dims` dimensions."""

    def __init__(self, dims: int, least: float):
        self.turn, self.budget = rotation(dims), 2 - 2 * least
        self.blocks = [slice(lo, min(lo + BLOCK_DIMS, dims)) for lo in range(0, dims, BLOCK_DIMS)]
        self.radius2 = [self.budget * (b.stop - b.start) / dims + SLACK for b in self.blocks]
        self.width = [math.sqrt(r) + SLACK for r in self.radius2]

    def cells(self, turned: np.ndarray, k: int) -> np.ndarray:
        b = self.blocks[k]
        out = np.zeros((len(turned), GRID_DIMS), np.int64)
        lead = turned[:, b.start : min(b.stop, b.start + GRID_DIMS)]
        out[:, : lead.shape[1]] = np.floor(lead / self.width[k])
        return out


def _forward(dims: int) -> list[tuple[int, ...]]:
    """Half of the adjoining cells: those whose first non-zero step is forward."""
    return [s for s in itertools.product((-1, 0, 1), repeat=dims) if next((x for x in s if x), 0) > 0]


def near_in_block(x: np.ndarray, y: np.ndarray, radius2: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) with a squared distance of at most radius2 and some slack, for coordinates of one block; each pair once if
    both sides are the same.

    Both sides are taken in order of the block's last coordinate, in steps of x against the stretch of y that is near enough in it.
    Squared distances come from a single product of rows that carry their norms.
    """
    by_x, by_y = np.argsort(x[:, -1], kind="stable"), np.argsort(y[:, -1], kind="stable")
    x, y = x[by_x], y[by_y]
    reach, line_x, line_y = math.sqrt(radius2) + 1e-6, x[:, -1], y[:, -1]
    one_x, one_y = np.ones((len(x), 1)), np.ones((len(y), 1))
    left = np.hstack([-2 * x, (x * x).sum(axis=1, keepdims=True), one_x]).astype(np.float32)
    right = np.ascontiguousarray(np.hstack([y, one_y, (y * y).sum(axis=1, keepdims=True)]).astype(np.float32).T)
    most = np.float32(radius2 + 1e-5)
    for lo in range(0, len(x), STEP):
        hi = min(len(x), lo + STEP)
        start, stop = np.searchsorted(line_y, [line_x[lo] - reach, line_x[hi - 1] + reach])
        for at in range(max(start, lo) if same else start, stop, SPAN):
            near = np.flatnonzero(left[lo:hi] @ right[:, at : min(stop, at + SPAN)] <= most)
            if len(near):
                i, j = np.divmod(near, min(stop, at + SPAN) - at)
                i, j = i + lo, j + at
                if same:
                    i, j = i[i < j], j[i < j]
                yield by_x[i], by_y[j]


def link_pairs(a: np.ndarray, b: np.ndarray, plan: Plan, k: int, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) that link and whose first candidate block is k; unit vectors in double precision."""
    ta, tb = a @ plan.turn, b @ plan.turn
    s = plan.blocks[k]
    for i, j in near_in_block(ta[:, s], tb[:, s], plan.radius2[k], same):
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            square = (ta[x] - tb[y]) ** 2
            first = square[:, s].sum(axis=1) <= plan.radius2[k]
            for e in range(k):
                first &= square[:, plan.blocks[e]].sum(axis=1) > plan.radius2[e]
            x, y = x[first], y[first]
            good = (a[x] * b[y]).sum(axis=1) >= least
            yield x[good], y[good]


def _name(path: str, cell: str, tile: int) -> str:
    return f"{path}/{cell}/{tile}"


def _load(name: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, copies, unit vectors) of a tile; empty ones if no vector fell to it."""
    try:
        raw = map_array(name, np.uint8)
    except FileNotFoundError:
        raw = np.zeros(8, np.uint8)
    n = int(raw[:8].view("<i8")[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dims))
    at = 8 + 16 * n
    return np.array(raw[8 : 8 + 8 * n].view("<i8")), np.array(raw[8 + 8 * n : at].view("<i8")), normalised(raw[at:].view("<f8").reshape(n, dims))


def find_links(classes: DataFrame, least: float, dims: int) -> DataFrame:
    """Rows (kind, a, b) for distinct vectors (n, v, copies): kind 0, a forest's link; kind 1, vectors of a class link with b others more."""
    spark, path = classes.sparkSession, shared_dir(classes.sparkSession, "vector-tiles")
    sent = spark.sparkContext.broadcast(Plan(dims, least))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                turned = normalised(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)) @ plan.turn
                cells = [[",".join(map(str, (k, *row))) for row in plan.cells(turned, k).tolist()] for k in range(len(plan.blocks))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(zip(*cells, strict=True)), pa.list_(pa.string()))], ["n", "v", "copies", "cells"])

    dealt = classes.select("n", "v", "copies").mapInArrow(deal, "n long, v array<double>, copies long, cells array<string>")
    # how crowded a cell is decides into how many tiles it goes
    crowd = cut(dealt.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "vector-crowds")
    homes = dealt.select("n", "v", "copies", F.explode("cells").alias("cell")).join(small(crowd), "cell")
    homes = homes.withColumn("tile", F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int")).drop("tiles")

    def write(group: pa.Table) -> pa.Table:
        cell, tile = group["cell"][0].as_py(), group["tile"][0].as_py()
        v = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        put_bytes(_name(path, cell, tile), [group.num_rows.to_bytes(8, "little"), group["n"].to_numpy().astype("<i8").tobytes(), group["copies"].to_numpy().astype("<i8").tobytes(), v.astype("<f8").tobytes()])
        return pa.table({"cell": [cell], "tile": pa.array([tile], pa.int32())})

    tiles = cut(homes.groupBy("cell", "tile").applyInArrow(write, "cell string, tile int"), "vector-tiles")
    # a job is two tiles: of one cell (each two once), or of a cell and one that adjoins it forward
    numbered = tiles.join(small(crowd), "cell")
    own = numbered.select(F.col("cell").alias("c1"), F.col("tile").alias("t1"), F.col("cell").alias("c2"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("t2"))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in _forward(GRID_DIMS)))
    p, d = F.split("cell", ","), F.col("d")
    ahead = F.concat_ws(",", F.get(p, F.lit(0)), *((F.get(p, F.lit(i + 1)).cast("long") + F.get(d, F.lit(i))).cast("string") for i in range(GRID_DIMS)))
    across = tiles.select(F.col("cell"), F.col("tile").alias("t1"), F.explode(steps).alias("d")).select(F.col("cell").alias("c1"), "t1", ahead.alias("c2"))
    across = across.join(small(crowd.withColumnRenamed("cell", "c2")), "c2").select("c1", "t1", "c2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t2"))
    jobs = cut(own.unionByName(across), "vector-jobs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in batches:
            for c1, t1, c2, t2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same, k = (c1, t1) == (c2, t2), int(c1.partition(",")[0])
                ids, copies, a = _load(_name(path, c1, t1), dims)
                b = a
                if not same:
                    more, more_copies, b = _load(_name(path, c2, t2), dims)
                    ids, copies = np.concatenate([ids, more]), np.concatenate([copies, more_copies])
                forest, count = Forest(len(ids)), np.zeros(len(ids), np.int64)
                for i, j in link_pairs(a, b, plan, k, least, same):
                    j = j if same else j + len(a)
                    forest.unite_pairs(i, j)
                    np.add.at(count, i, copies[j])
                    np.add.at(count, j, copies[i])
                member, root = forest.stars()
                some = np.flatnonzero(count)
                kind = np.concatenate([np.zeros(len(member), np.int32), np.ones(len(some), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids[member], ids[some]])), pa.array(np.concatenate([ids[root], count[some]]))], ["kind", "a", "b"])

    n_jobs = jobs.count()
    parts = max(1, min(n_jobs, 16 * spark.sparkContext.defaultParallelism + n_jobs // 256))
    return jobs.select("c1", "t1", "c2", "t2").repartition(parts).mapInArrow(compare, "kind int, a long, b long")


def near_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of rows: vec_id, n_links, component_id and kept (it is its component's least id).

    Equal vectors are compared once and stand for each other: they link with one another and share their links. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing; vectors of different sizes don't link either.
    Rows that repeat a vec_id are separate vectors. A null vec_id is the id of no component, unless it has no other. Other
    columns are ignored, labels too; an empty table gives an empty result.
    """
    v = F.col(vector)
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are equal, so adding 0.0 makes equal vectors hash alike
    exact = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, exact).alias("v"))
    given = base
    for salt in itertools.count():  # should two vectors have one hash, all are hashed anew
        base = given.withColumn("n", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(salt))))
        classes = base.filter("n is not null").groupBy("n", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        classes = cut(classes, "vector-classes")
        if not classes.groupBy("n").count().filter("count > 1").limit(1).collect():
            break
    found = None
    for size in [x[0] for x in classes.select(F.size("v")).distinct().collect()]:  # vectors' sizes, a few
        links = find_links(classes.filter(F.size("v") == size), least, size)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "kind int, a long, b long")
    found = cut(found, "vector-links")
    counts = found.filter("kind = 1").groupBy(F.col("a").alias("n")).agg(F.sum("b").alias("others"))
    linked = components(found.filter("kind = 0").select("a", "b"))
    rooted = classes.join(linked, classes["n"] == linked["node"]).select("n", "root", "least")
    best = cut(rooted.groupBy("root").agg(F.min("least").alias("first")), "vector-roots")
    moved = rooted.join(small(best), "root").select("n", "first")
    table = classes.join(counts, "n", "left").join(moved, "n", "left")
    table = cut(table.select("n", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id")), "vector-classes")
    out = base.select("vec_id", "n").join(small(table), "n", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
