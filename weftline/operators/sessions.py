"""Conversations: windows of turns, the focus they build up, and the boosts it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Boosts of a file in the accumulated focus, in the last three turns, and in the last turn (fixed values).
BOOSTS = (0.2, 0.3, 0.5)


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The newest n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def focus_symbols(turns: DataFrame) -> DataFrame:
    """conv_id, turn, symbol: the distinct words of at least three letters of each turn, in small letters."""
    return turns.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("symbol"))


def accumulated_focus(turns: DataFrame, window: int = 10, most: int = 50) -> DataFrame:
    """conv_id, symbol, n: the symbols of the last turns; where there are more than `most`, the most frequent (ties by name)."""
    n = focus_symbols(last_turns(turns, window)).groupBy("conv_id", "symbol").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "symbol")
    return n.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def focus_boosts(candidates: DataFrame, accumulated: DataFrame, recent: DataFrame, last: DataFrame, share: float = 0.5) -> DataFrame:
    """Candidates (symbol, relevance_score) raised for being in focus: the boosts add up to `share` of the score at most."""
    out, total = candidates, F.lit(0.0)
    for name, rows, w in zip(("_a", "_r", "_l"), (accumulated, recent, last), BOOSTS, strict=True):
        out = out.join(rows.select("symbol", F.lit(w).alias(name)).distinct(), "symbol", "left")
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    boost = F.least(total, F.col("relevance_score") * share)
    return out.withColumn("boost", F.round(boost, 6)).withColumn("relevance_score", F.round(F.col("relevance_score") + boost, 6)).drop("_a", "_r", "_l")


def sessionised(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, session_start, session_end, n: events of a key with less than a gap between them."""
    out = events.groupBy(F.col(key), F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def session_list(turns: DataFrame, window: int = 10, most: int = 50) -> DataFrame:
    """conv_id, turns (kept in the window), focus_count (symbols in the accumulated focus) of every conversation."""
    kept = last_turns(turns, window).groupBy("conv_id").agg(F.count("*").alias("turns"))
    focus = accumulated_focus(turns, window, most).groupBy("conv_id").agg(F.count("*").alias("focus_count"))
    return kept.join(focus, "conv_id", "left").select("conv_id", "turns", F.coalesce("focus_count", F.lit(0)).alias("focus_count"))


def resume(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, status of the conversations asked for (a column conv_id): resumed, or not_found."""
    known = turns.select("conv_id", F.lit(1).alias("_k")).distinct()
    return wanted.select("conv_id").distinct().join(known, "conv_id", "left").select("conv_id", F.when(F.col("_k").isNotNull(), "resumed").otherwise("not_found").alias("status"))


def clear(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """The turns of all conversations but those in gone (a column conv_id)."""
    return turns.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")
