"""Reports and plans around the main operators: error mentions, prompt signals, affected files, components, indexing modes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.text import imports

#: What an error text may name: (kind, pattern, most). Fixed values.
MENTIONS = [
    ("file", r"([a-zA-Z0-9_/.-]+\.(?:ts|tsx|js|jsx|py|go|java|rs):[0-9]+)", 10),
    ("symbol", r"\b([a-zA-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b", 10),
    ("symbol", r"\b([a-z]+_[a-z_]+)\b", 5),
    ("symbol", r"'([a-zA-Z_][a-zA-Z0-9_]*)'", 5),
]
#: Weights of the signals of a prompt (fixed values).
SIGNALS = {"explicit": 0.8, "implicit": 0.6, "historical": 0.6, "code": 0.7}
#: What a prompt that wants a repair says (fixed value).
REPAIR = "(?i)(fix|bug|error|crash|fail|问题|错误|修复)"
#: Tools of a plan by tier: (tier, tool, timeout in ms). Fixed values.
PLAN = [(0, "index_status", 500), (1, "search", 2000), (1, "context", 3500)]


def error_mentions(errors: DataFrame, text: str = "text") -> DataFrame:
    """The columns of errors with kind, name and line of everything that their texts name, each once."""
    def of(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"))

    found = F.flatten(F.array(*(F.transform(F.slice(F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(1)), 1, n), of(kind)) for kind, rx, n in MENTIONS)))
    rows = errors.select(*errors.columns, F.explode(F.array_distinct(found)).alias("_f"))
    is_file = F.col("_f.kind") == "file"
    out = rows.select(*errors.columns, F.col("_f.kind").alias("kind"), F.when(is_file, F.regexp_replace("_f.m", ":[0-9]+$", "")).otherwise(F.col("_f.m")).alias("name"), F.when(is_file, F.regexp_extract("_f.m", ":([0-9]+)$", 1).cast("int")).alias("line"))
    return out


def prompt_signals(text: Column, file: Column, history: Column, function: Column) -> Column:
    """The signals of a prompt as an array of struct(type, match, weight): a wish to repair, a file, a history, a function."""
    one = lambda cond, kind, match: F.when(cond, F.struct(F.lit(kind).alias("type"), match.alias("match"), F.lit(SIGNALS[kind]).alias("weight")))
    repair = F.coalesce(text.rlike(REPAIR), F.lit(False))
    return F.array_compact(F.array(one(repair, "explicit", F.lit("fix/bug")), one(F.coalesce(file, F.lit("")) != "", "implicit", file), one(F.coalesce(history, F.lit(False)), "historical", F.lit("with-history")), one(F.coalesce(function, F.lit("")) != "", "code", function)))


def tool_plan(tier: int) -> list[dict]:
    """The tools to run up to a tier."""
    return [{"tier": t, "tool": n, "timeout_ms": ms} for t, n, ms in PLAN if t <= tier]


def affected_files(impact: DataFrame, most: int = 20) -> DataFrame:
    """One row: how many nodes are affected, and the first `most` files (in order) among them; all of them are
    impact.select("file_path").distinct()."""
    files = impact.select("file_path").distinct().orderBy("file_path").limit(most)
    return impact.agg(F.count("*").alias("n_affected")).join(files.agg(F.array_sort(F.collect_list("file_path")).alias("files")))


def code_components(files: DataFrame, folders: list[str] = ("scripts", "src", "hooks")) -> tuple[DataFrame, DataFrame]:
    """(components: path, module; dependencies: source, target) of the files in some top folders."""
    own = files.filter(F.substring_index("file", "/", 1).isin(list(folders)))
    parts = own.select(F.col("file").alias("path"), F.substring_index("file", "/", 1).alias("module"))
    return parts, imports(own).select("source", "target").distinct()


def update_mode(parser_ok: Column, cache_ok: Column, cache_version: Column, store_version: Column, changed: Column, most: int = 10) -> Column:
    """How a syntax-tree cache follows a change: FALLBACK, FULL_REBUILD or INCREMENTAL."""
    stale = store_version.isNotNull() & (F.coalesce(cache_version, F.lit("")) != store_version)
    return F.when(~parser_ok, "FALLBACK").when(~cache_ok | stale | (changed > most), "FULL_REBUILD").otherwise("INCREMENTAL")


def index_report(index: DataFrame | None, changed: DataFrame) -> str:
    """no_index, up_to_date or updated."""
    return "no_index" if index is None else "updated" if changed.limit(1).collect() else "up_to_date"


def record_status_counts(records: DataFrame) -> DataFrame:
    """status, n over decision records; the first word of the status in small letters, unknown if there is none."""
    word = F.coalesce(F.nullif(F.lower(F.regexp_extract("status", r"([A-Za-z]+)", 1)), F.lit("")), F.lit("unknown"))
    return records.groupBy(word.alias("status")).agg(F.count("*").alias("n"))


def hot_files(commits: DataFrame, exclude: str = r"(^|/)(node_modules|dist|build)/", least: int = 3, most: int = 20) -> DataFrame:
    """file, freq of the files changed at least so often, the most frequent first."""
    n = commits.filter(~F.col("file").rlike(exclude)).groupBy("file").agg(F.count("*").alias("freq"))
    return n.filter(F.col("freq") >= least).orderBy(F.desc("freq"), "file").limit(most)


def normalised_scores(hotspots: DataFrame) -> DataFrame:
    """file, share: hotspot scores over the largest, 2 decimals."""
    most = hotspots.agg(F.max("score").alias("_m"))
    return hotspots.join(F.broadcast(most)).select("file", F.round(F.when(F.col("_m") > 0, F.col("score") / F.col("_m")).otherwise(0.0), 2).alias("share"))


def package_usage(files: DataFrame, package: str) -> DataFrame:
    """file, line_no of the imports of a package or of a path in it."""
    return imports(files).filter((F.col("target") == package) | F.col("target").startswith(package + "/")).select(F.col("source").alias("file"), "line_no")


def supervise(start: Callable[[], object], most: int = 3, wait: float = 0.0) -> str:
    """Run a streaming query (something with awaitTermination) and start it again when it fails, `most` times: STOPPED or FAILED."""
    for attempt in range(most + 1):
        try:
            start().awaitTermination()
            return "STOPPED"
        except Exception:  # noqa: BLE001  whatever ended the query counts as one failure
            if attempt < most:
                time.sleep(wait)
    return "FAILED"
