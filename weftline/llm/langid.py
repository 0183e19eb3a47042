"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies a host's prior, the likelihood of the text (letter 3-grams, hashed), and the likelihoods
of the declared markup language and of the address suffix given the language. Priors and both tables of likelihoods come from
grouped aggregations of the text evidence over all rows; a host's prior is smoothed towards its parent's, and so on up to the
corpus. The class `und` has texts that are no known language: all 3-grams are equally likely under it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.shared import cut, released, small, small_batches

BUCKETS = 1 << 16
#: Labelled rows a language is fitted on (in expectation; rows by hash of their text).
SAMPLE = 2000
#: Neighbouring 3-grams say much the same: a text counts as this many independent ones at most.
EFFECTIVE = 200
#: Rows that a parent's shares count for in a child's prior, and all rows' in a table of likelihoods.
PRIOR_ROWS = 20.0
UND = "und"
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_BLANK = int((0x202020 * 0x9E3779B1) >> 16 & (BUCKETS - 1))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte 3-grams of all texts in small letters, non-letters as blanks; where each text's begin)."""
    flat = [b" " + t.lower().encode().translate(_LETTERS) + b" " if t else b"   " for t in texts]
    n = np.fromiter(map(len, flat), np.int64, len(flat))
    b = np.frombuffer(b"".join(flat) + b"  ", np.uint8).astype(np.uint32)
    code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(BUCKETS - 1)
    starts = np.cumsum(n) - n
    ends = starts + n  # the last two 3-grams of a text reach into the next one
    code[ends - 1] = _BLANK
    code[ends - 2] = _BLANK
    return code, starts


class Profiles(NamedTuple):
    """Languages, and log likelihoods of shape folds x languages x BUCKETS: those of a fold are for scoring its rows."""

    langs: list[str]
    table: np.ndarray


def fold_of(text: Column, folds: int) -> Column:
    """The fold of a row, by hash of its text, so that copies of a text share one."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(text.cast("string")), 32), F.lit(folds)).cast("int")


def fit_profiles(docs: DataFrame, text: str, label: str, sample: int = SAMPLE, folds: int = 1) -> Profiles:
    """Profiles of the labels, from a sample of labelled rows.

    Rows without a label don't count. Every label is fitted, so that memory grows by BUCKETS cells a language and fold. With folds,
    the rows of a fold are scored by profiles fitted on the others only; a language that has rows in no other fold is fitted on all.
    """
    own = docs.select(F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t"), fold_of(F.col(text), folds).alias("f")).filter(F.col("l").isNotNull() & (F.col("l") != UND))
    counts: dict[str, int] = {}
    for x in own.groupBy("l").count().collect():  # a row for each language
        counts[x["l"]] = x["count"]
    langs = sorted(counts)
    if not langs:
        return Profiles([], np.zeros((folds, 0, BUCKETS)))
    share = F.create_map(*(F.lit(v) for x in langs for v in (x, min(1.0, sample * folds / max(1, folds - 1) / counts[x]))))
    hashed = F.pmod(F.xxhash64("t"), F.lit(1_000_000)) / F.lit(1e6)
    picked = own.filter(hashed < F.element_at(share, F.col("l")))
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs) * folds, BUCKETS), np.int64)
        for batch in batches:
            labels, texts, fold = (c.to_pylist() for c in batch.columns)
            for x, f in {*zip(labels, fold, strict=True)}:
                code, _ = grams([t for t, y, g in zip(texts, labels, fold, strict=True) if y == x and g == f])
                total[f * len(langs) + place[x]] += np.bincount(code, minlength=BUCKETS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    rows = picked.mapInArrow(released(count), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # folds x languages x BUCKETS at most
    total = np.zeros((folds * len(langs), BUCKETS))
    total[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["n"].to_numpy()
    total = total.reshape(folds, len(langs), BUCKETS)
    total[:, :, _BLANK] = 0
    others = total.sum(axis=0) - total if folds > 1 else total
    others = np.where(others.any(axis=2, keepdims=True), others, total.sum(axis=0))
    return Profiles(langs, np.log((others + 0.5) / (others.sum(axis=2, keepdims=True) + 0.5 * BUCKETS)))


def text_evidence(rows: DataFrame, text: str, profiles: np.ndarray) -> DataFrame:
    """rows without the column text, and with _ll, the tempered log likelihoods of the text under each language and `und`."""
    folds, langs = profiles.shape[:2]
    table = np.empty((langs + 1, folds * BUCKETS), np.float32)  # a row for each class, fold by fold
    table[:-1] = profiles.transpose(1, 0, 2).reshape(langs, folds * BUCKETS)
    table[-1] = -np.log(BUCKETS)
    table[:, _BLANK::BUCKETS] = 0
    sent = rows.sparkSession.sparkContext.broadcast(table)
    keep = [f for f in rows.schema if f.name != text]
    schema = T.StructType([*keep]).add("_ll", T.ArrayType(T.DoubleType()))
    sources = rows.select(*(F.col(f.name) for f in keep), F.col(text).cast("string").alias("_text"), fold_of(F.col(text), folds).alias("_fold"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                code, starts = grams(some.column(some.num_columns - 2).to_pylist())
                n = np.add.reduceat((code != _BLANK).astype(np.int64), starts)
                if folds > 1:
                    fold = some.column(some.num_columns - 1).to_numpy().astype(np.uint32)
                    code = code + np.repeat(fold * np.uint32(BUCKETS), np.diff(starts, append=len(code)))
                ll = np.stack([np.add.reduceat(x[code], starts, dtype=np.float64) for x in m], axis=1)
                ll *= np.minimum(1.0, EFFECTIVE / np.maximum(n, 1))[:, None]
                ll[n == 0, -1] += 50.0  # no letters at all
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1, dtype=np.int32) * m.shape[0]), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-2], lists], schema.names)

    return sources.mapInArrow(released(score), schema)


def _posterior(logs: Column) -> Column:
    """Shares in proportion to the exponentials."""
    top = F.transform(F.array(F.array_max(logs)), lambda m: F.transform(logs, lambda x: F.exp(x - m)))[0]
    return F.transform(F.array(top), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def _sums(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The classes' soft counts by keys: n0 to n{k-1}."""
    return rows.groupBy(*keys).agg(*(F.sum(F.get("_p", F.lit(i))).alias(f"n{i}") for i in range(k)))


def _array(k: int, prefix: str = "n") -> Column:
    return F.array(*(F.col(f"{prefix}{i}") for i in range(k)))


def host_priors(counts: DataFrame, levels: list[str], k: int) -> DataFrame:
    """Log priors of every host: its soft counts plus PRIOR_ROWS times the shares of its parent, itself so smoothed.

    counts: soft counts n0.. by all levels, the coarsest first. The corpus itself is the root, smoothed towards equal shares.
    """
    total = counts.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(k))).first()
    size = sum(total)
    up = [(x + PRIOR_ROWS / k) / (size + PRIOR_ROWS) for x in total]
    table, above = None, []
    for d in range(1, len(levels) + 1):
        own = counts.groupBy(*levels[:d]).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k)))
        if table is None:
            joined = own.withColumns({f"u{i}": F.lit(up[i]) for i in range(k)})
        else:
            parent = table.select(*(F.col(c).alias(f"_{c}") for c in above), *(F.col(f"u{i}") for i in range(k)))
            on = [own[c].eqNullSafe(F.col(f"_{c}")) for c in above]
            joined = own.join(small(parent), on).drop(*(f"_{c}" for c in above))
        n = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
        table = joined.select(*levels[:d], *(((F.col(f"n{i}") + PRIOR_ROWS * F.col(f"u{i}")) / (n + PRIOR_ROWS)).alias(f"u{i}") for i in range(k)))
        above = levels[:d]
        table = cut(table, "language-hosts")
    return table.select(*levels, F.array(*(F.log(f"u{i}") for i in range(k))).alias("_prior"))


def value_likelihoods(counts: DataFrame, column: str, k: int) -> DataFrame:
    """Log likelihood of each non-null value of a column under each class, smoothed by the value's share of all rows."""
    own = counts.filter(F.col(column).isNotNull()).groupBy(column).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k)))
    total = own.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(k))).first()
    size = max(sum(total), 1e-9)
    share = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0)) / F.lit(size)
    return own.select(column, F.array(*(F.log((F.col(f"n{i}") + PRIOR_ROWS * share) / F.lit(total[i] + PRIOR_ROWS)) for i in range(k))).alias(f"_l_{column}"))


def identify(rows: DataFrame, *, text: str = "text", label: str | None = "lang", declared: str | None = "lang", suffix: str | None = None, hosts: tuple[str, ...] = ("source",), keep: list[str] | None = None, least: float = 0.5, profiles: Profiles | None = None) -> DataFrame:
    """The columns `keep` of rows (all if None) and _lang, a struct of language, confidence, text_language and accepted.

    label: the column that profiles are fitted on, unless they are given, in two folds: a row is scored by profiles that it had no
    part in, so that its own label speaks by its likelihood as declared language alone. declared, suffix and hosts (the coarsest
    first) name columns of evidence; a null is no evidence, and a null host a host of its own. A row is accepted if its likeliest
    class is a language with a posterior of at least `least`. Null and empty texts, and those without letters, are `und` and
    rejected; without any labelled row every row is. Ties go to the language first in the alphabet. One row out for each row in;
    a column _lang of rows is replaced, and no other column name clashes. Texts are scored once: the evidence is written to the
    shared folder with the columns to keep.
    """
    keep = [c for c in rows.columns if c != "_lang"] if keep is None else keep
    small_batches(rows.sparkSession)
    langs, table = profiles or fit_profiles(rows, text, label, folds=2)
    classes, k = [*langs, UND], len(langs) + 1
    fields = {"_declared": declared, "_suffix": suffix, **{f"_host{i}": c for i, c in enumerate(hosts)}}
    fields = {a: F.col(f"`{c}`").cast("string") for a, c in fields.items() if c}
    carried = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("struct<_: int>")
    own = rows.select(carried.alias("_row"), *(c.alias(a) for a, c in fields.items()), F.col(f"`{text}`").cast("string").alias("_text"))
    levels, others = [a for a in fields if a.startswith("_host")], [a for a in fields if not a.startswith("_host")]
    out = cut(text_evidence(own, "_text", table), "language-evidence")
    # a row for each host and each value that occurs with it: all tables below are sums over it
    counts = cut(_sums(out.withColumn("_p", _posterior(F.col("_ll"))), list(fields), k), "language-counts")
    logs = F.col("_ll")
    add = lambda a, b: F.zip_with(a, F.coalesce(b, F.array(*[F.lit(0.0)] * k)), lambda x, y: x + y)
    if levels:
        prior = small(cut(host_priors(counts, levels, k), "language-priors")).alias("_h")
        out = out.alias("_r").join(prior, [F.col(f"_r.{c}").eqNullSafe(F.col(f"_h.{c}")) for c in levels], "left").select("_r.*", "_prior")
        logs = add(logs, F.col("_prior"))
    for c in others:
        out = out.join(small(cut(value_likelihoods(counts, c, k), "language-values")), c, "left")
        logs = add(logs, F.col(f"_l_{c}"))
    names = F.array(*map(F.lit, classes))
    best = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    out = out.withColumn("_post", _posterior(logs))
    language = best(F.col("_post"))
    verdict = F.struct(language.alias("language"), F.array_max("_post").alias("confidence"), best(F.col("_ll")).alias("text_language"), ((language != UND) & (F.array_max("_post") >= least)).alias("accepted"))
    return out.select(*(F.col(f"_row.`{c}`") for c in keep), verdict.alias("_lang"))


def identify_pages(pages: DataFrame, profiles: Profiles) -> DataFrame:
    """page_id and _lang of rows of raw pages: identify() by markup language, last label of the host, and hosts below it, from url and html.

    A script or style element without an end reaches to the end of the page.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", " "), r"<[^>]*>", " ")
    rows = pages.select("page_id", body.alias("text"), F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([A-Za-z]+)""", 1)), F.lit("")).alias("markup"), F.nullif(host, F.lit("")).alias("host"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("site", F.substring_index("host", ".", -2))
    return identify(rows, label=None, declared="markup", suffix="suffix", hosts=("site", "host"), keep=["page_id"], profiles=profiles)
