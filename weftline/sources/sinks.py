"""Sinks: appended rows, vector indexes, session turns, snapshots and reports."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.scoring import retained


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def record_feedback(rows: DataFrame, path: str) -> None:
    """Append verdicts (file, line_no, rule, verdict) on anomalies."""
    if rows.filter("verdict not in ('accepted', 'rejected')").limit(1).collect():
        raise ValueError("a verdict is accepted or rejected")
    append_json(rows, path)


def record_actions(old: DataFrame, new: DataFrame, now: int, days: int = 90, most: int | None = 10_000) -> DataFrame:
    """The history with new actions: no older than so many days, the newest `most` of them (all if None)."""
    return retained(old.unionByName(new.select(*old.columns)), now, days, most)


def save_turns(old: DataFrame, new: DataFrame, window: int = 10) -> DataFrame:
    """The turns of all conversations with new ones, the newest of a (conv_id, turn) counting, cut to the window."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    one = both.groupBy("conv_id", "turn").agg(F.max_by(F.struct(*old.columns), "_new").alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return one.withColumn("_r", rank).filter(F.col("_r") <= window).drop("_r")


def build_vectors(files: DataFrame, embed) -> DataFrame:
    """file, hash, embedding: each distinct text (by md5) is embedded once by embed(DataFrame of hash, text) -> hash, embedding."""
    keyed = files.select("file", F.md5("text").alias("hash"), "text")
    return keyed.select("file", "hash").join(embed(keyed.dropDuplicates(["hash"]).select("hash", "text")), "hash")


def update_vectors(index: DataFrame, files: DataFrame, embed) -> DataFrame:
    """The index after a change of files: texts that it knows aren't embedded again, and files that are gone drop out."""
    keyed = files.select("file", F.md5("text").alias("hash"), "text")
    known = index.select("hash", "embedding").dropDuplicates(["hash"])
    new = build_vectors(keyed.join(known.select("hash"), "hash", "left_anti"), embed)
    return keyed.select("file", "hash").join(known, "hash").select("file", "hash", "embedding").unionByName(new.select("file", "hash", "embedding"))


def snapshot(imports: DataFrame, violations: DataFrame, cycles: DataFrame, edges: DataFrame, version: str, timestamp: str) -> DataFrame:
    """One row: timestamp, version, modules, total_coupling, dependency_violations, cyclic_dependencies, boundary_clarity (the share of
    imports that stay within the first folder of their path)."""
    top = lambda c: F.substring_index(c, "/", 1)
    inside = F.avg((top(F.col("source")) == top(F.col("target"))).cast("double"))
    n = imports.agg(F.count_distinct(top(F.col("source"))).alias("modules"), F.count("*").alias("total_coupling"), F.round(F.coalesce(inside, F.lit(1.0)), 4).alias("boundary_clarity"))
    n = n.join(violations.agg(F.count("*").alias("dependency_violations"))).join(cycles.agg(F.count("*").alias("cyclic_dependencies")))
    return n.select(F.lit(timestamp).alias("timestamp"), F.lit(version).alias("version"), *n.columns)


def module_metrics(imports: DataFrame) -> DataFrame:
    """module, coupling_out, coupling_in: imports that leave and reach each first folder."""
    top = lambda c: F.substring_index(c, "/", 1)
    across = imports.select(top(F.col("source")).alias("s"), top(F.col("target")).alias("t")).filter("s <> t")
    out, into = across.groupBy(F.col("s").alias("module")).agg(F.count("*").alias("coupling_out")), across.groupBy(F.col("t").alias("module")).agg(F.count("*").alias("coupling_in"))
    return out.join(into, "module", "full_outer").select("module", F.coalesce("coupling_out", F.lit(0)).alias("coupling_out"), F.coalesce("coupling_in", F.lit(0)).alias("coupling_in"))


def _first(rows: DataFrame, order: list[str], most: int | None) -> list:
    """The first `most` rows in an order, or all if None; warns if there are more."""
    ordered = rows.orderBy(*order)
    got = (ordered if most is None else ordered.limit(most + 1)).collect()
    if most is not None and len(got) > most:
        warnings.warn(f"the report has the first {most} rows only", stacklevel=3)
    return got[:most]


def write_json(rows: DataFrame, path: str) -> None:
    """A report's rows as JSON lines below a folder, of any number."""
    rows.write.mode("overwrite").json(path)


def to_json(rows: DataFrame, order: list[str], most: int | None = 1000) -> str:
    """A report's rows as a JSON array, for a person: the first `most` in an order (all if None); write_json() for many."""
    return "[" + ",".join(r["_j"] for r in _first(rows.select(F.to_json(F.struct("*")).alias("_j"), *order), order, most)) + "]"


def to_markdown(rows: DataFrame, order: list[str], most: int | None = 100) -> str:
    """A report's rows as a markdown table, the first `most` (all if None)."""
    cells = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in _first(rows, order, most)]
    line = lambda c: "| " + " | ".join(c) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, cells)])


def to_text(rows: DataFrame, order: list[str], most: int | None = 100) -> str:
    """A report's rows as `name: value` lines, the first `most` (all if None)."""
    return "\n".join(", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in _first(rows, order, most))
