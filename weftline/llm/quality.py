"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import cut, small

#: ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many repeated windows are looked up one after the other; beyond it by sorting.
FEW = 32


def words_of(text: Column) -> Column:
    """The maximal runs of characters that aren't ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """The line in lower case (A-Z), white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE + "+", " "))


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at `starts`."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def _by_lookup(windows: Column, twice: Column) -> Column:
    at = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
    return _covered(F.array_compact(at))


def _by_sort(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        near = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
        return F.filter(F.transform(s, lambda x, k: F.when(near(k, -1) | near(k, 1), x["i"])), lambda i: i.isNotNull())

    return _covered(bound(placed, starts))


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; one row in, one row out.

    Null and empty texts have zeros and fail. All columns of docs stay; any that has one of these names is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"_w": words_of(F.col(text)), "_l": lines_of(F.col(text)), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")})
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_win": F.when(F.size("_w") >= 3, bound(F.col("_w"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))),
    }).drop("_w", "_l")
    twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False))))
    out = out.withColumn("_twice", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), bound(F.sort_array("_win"), twice)))
    n = F.when(F.size("_twice") <= FEW, bound(F.struct("_win", "_twice"), lambda x: _by_lookup(x["_win"], x["_twice"]))).when(F.size("_twice") > FEW, _by_sort(F.col("_win")))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_twice").isNotNull(), n), F.lit(0)).cast("long")).drop("_win", "_twice")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = 50) -> DataFrame:
    """(host, line hash, n_docs) of the normalised lines that more than max_docs documents (rows) of one host have."""
    hashes = F.array_distinct(F.transform(lines_of(F.col(text)), lambda x: F.xxhash64(normalised(x))))
    rows = docs.select(F.col(host).alias("_host"), F.explode(hashes).alias("_line"))
    return rows.groupBy("_host", "_line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 50, min_words: int = 50, min_share: float = 0.3) -> DataFrame:
    """One row per row of docs with its base metrics, n_removed_words and kept.

    A line is removed where more than max_docs documents of its host have it (compared after normalisation). A document is
    depleted, and not kept, if fewer than min_words words or less than min_share of its words remain. Rows count as
    documents, repeated rows included. A null host is a host of its own; a null doc_id is allowed. Columns besides
    doc_id, text and host are not carried, so clashing names do no harm; an empty table gives an empty result.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    often = small(cut(frequent_lines(d, "text", "host", max_docs), "frequent-lines"))
    # repeated rows have the same lines: counting each (document, place) once gives what one of the rows loses
    line = F.posexplode(F.transform(lines_of(F.col("text")), lambda x: F.struct(F.xxhash64(normalised(x)).alias("_line"), F.size(words_of(x)).alias("_n"))))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = d.select("doc_id", "host", key.alias("_key"), line.alias("_at", "_x")).select("doc_id", "host", "_key", "_at", "_x.*")
    lost = lines.join(often.select("_host", "_line"), (lines["_line"] == often["_line"]) & lines["host"].eqNullSafe(often["_host"])).drop(often["_line"])
    lost = lost.groupBy("doc_id", "host", "_key", "_at").agg(F.max("_n").alias("_n"))
    lost = lost.groupBy(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("_key").alias("_k")).agg(F.sum("_n").alias("_lost"))
    m = base_metrics(d.withColumn("_key", key), "text").drop("text")
    out = m.join(lost, m["doc_id"].eqNullSafe(lost["_d"]) & m["host"].eqNullSafe(lost["_h"]) & (m["_key"] == lost["_k"]), "left")
    out = out.withColumn("n_removed_words", F.coalesce("_lost", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < min_words) | (left < min_share * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))
