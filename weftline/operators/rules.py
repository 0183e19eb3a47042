"""Architecture rules, file orphans, vulnerability reports and tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import glob_regex, is_entry_point, is_test, matches_any, redact, severity_rank
from weftline.operators.graph import cycles
from weftline.storage import small


def parse_rules(text: str) -> list[dict]:
    """Rules from a YAML-like document: a list of mappings with scalar values and inline or dashed lists."""
    rules: list[dict] = []
    key = None
    for raw in text.split("\n"):
        row = raw.split(" #")[0].rstrip()
        bare = row.strip()
        if not bare or bare.startswith("#") or bare == "rules:":
            continue
        if bare.startswith("- name:"):
            rules.append({"name": _scalar(bare[7:])})
            key = None
        elif rules and bare.startswith("- ") and key:
            rules[-1].setdefault(key, []).append(_scalar(bare[2:]))
        elif rules and ":" in bare:
            key, _, value = bare.partition(":")
            value = value.strip()
            if value.startswith("["):
                rules[-1][key] = [_scalar(x) for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                rules[-1][key] = _scalar(value)
    return rules


def _scalar(text: str) -> str:
    return text.strip().strip("\"'")


def rule_violations(imports: DataFrame, rules: list[dict], ignore: list[str] | None = None) -> DataFrame:
    """rule, severity, source, target, line_no of the imports (source, target, line_no) that a rule forbids: the source matches its
    `from`, the target one of `cannot_import`. Cycle rules and ignored sources or targets are left out. Rules are few, so that they
    become one expression, and imports are read once."""
    ignored = matches_any(F.col("source"), ignore or []) | matches_any(F.col("target"), ignore or [])
    checks = [F.when(F.col("source").rlike(glob_regex(r["from"])) & matches_any(F.col("target"), r["cannot_import"]), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "error")).alias("severity"))) for r in rules if r.get("type") != "cycle-detection" and r.get("from") and r.get("cannot_import")]
    if not checks:
        return imports.limit(0).select(F.lit("").alias("rule"), F.lit("").alias("severity"), "source", "target", "line_no")
    return imports.filter(~ignored).select(F.explode(F.array_compact(F.array(*checks))).alias("r"), "source", "target", "line_no").select("r.*", "source", "target", "line_no")


def rule_table_violations(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (name, severity, source_regex, target_regex), broadcast if it is small."""
    on = F.expr("source rlike source_regex and target rlike target_regex")
    return imports.join(small(rules), on).select(F.col("name").alias("rule"), "severity", "source", "target", "line_no")


def layer_violations(imports: DataFrame, layers: DataFrame) -> DataFrame:
    """Imports from one module to another that the layers (from, to, allow) forbid; a module is the first part of a path."""
    first = lambda c: F.substring_index(c, "/", 1)
    bad = layers.filter("not allow").select(F.col("from").alias("_f"), F.col("to").alias("_t"))
    return imports.join(small(bad), (first(F.col("source")) == F.col("_f")) & (first(F.col("target")) == F.col("_t"))).drop("_f", "_t")


def file_orphans(files: DataFrame, imports: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Files (file) that no import resolves to (resolved), entry points, tests and excluded paths aside."""
    own = files.select("file").filter(~is_entry_point(F.col("file")) & ~is_test(F.col("file")) & ~matches_any(F.col("file"), exclude or []))
    return own.join(imports.filter("resolved is not null").select(F.col("resolved").alias("file")), "file", "left_anti")


def orphan_summary(files: DataFrame, found: DataFrame) -> DataFrame:
    n = files.agg(F.count("*").alias("total")).join(found.agg(F.count("*").alias("orphans")))
    return n.withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("orphans") / F.col("total")).otherwise(0.0), 4))


def report(violations: DataFrame, edges: DataFrame, orphans: DataFrame, on_violation: str = "warn") -> DataFrame:
    """One row: violations, cycles, orphans, blocked (there are violations or cycles, and they are to block)."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    out = n(violations, "violations").join(n(cycles(edges), "cycles")).join(n(orphans, "orphans"))
    return out.withColumn("blocked", F.lit(on_violation == "block") & (F.col("violations") + F.col("cycles") > 0))


def coupling(imports: DataFrame) -> DataFrame:
    """file, coupling: the number of files that import each file."""
    return imports.filter("resolved is not null").groupBy(F.col("resolved").alias("file")).agg(F.count_distinct("source").alias("coupling"))


# ---------------------------------------------------------------- vulnerabilities

V7 = "vulnerabilities map<string, struct<name: string, severity: string, isDirect: boolean, via: array<string>, effects: array<string>, fixAvailable: string, dev: boolean>>"
V6 = "advisories map<string, struct<module_name: string, severity: string, title: string, patched_versions: string>>"


def vulnerabilities(documents: DataFrame, threshold: str = "low", include_dev: bool = True) -> DataFrame:
    """package, severity, title, fixable of audit documents (a column `text`) in either layout, from a severity on.

    An entry of `via` is a name, or an object of which the title counts. Only the newer layout marks development packages.
    """
    doc = documents.select(F.from_json("text", f"{V7}, {V6}").alias("d"))
    new = doc.select(F.explode("d.vulnerabilities").alias("k", "v"))
    via = F.transform("v.via", lambda x: F.coalesce(F.get_json_object(x, "$.title"), x))
    new = new.select(F.coalesce("v.name", "k").alias("package"), "v.severity", F.array_join(via, "; ").alias("title"), F.coalesce(~F.col("v.fixAvailable").isin("false", ""), F.lit(False)).alias("fixable"), F.coalesce("v.dev", F.lit(False)).alias("dev"))
    old = doc.select(F.explode("d.advisories").alias("k", "v")).select(F.col("v.module_name").alias("package"), "v.severity", F.col("v.title").alias("title"), F.coalesce(~F.col("v.patched_versions").isin("", "<0.0.0"), F.lit(False)).alias("fixable"), F.lit(False).alias("dev"))
    out = new.unionByName(old).filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold)))
    return (out if include_dev else out.filter("not dev")).drop("dev")


def severity_histogram(found: DataFrame) -> DataFrame:
    """One row with the number of each severity, and their total."""
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "moderate", "low")), F.count("*").alias("total"))


def histogram_map(rows: DataFrame, column: str) -> DataFrame:
    """One row with a map from value to count, in order of the values."""
    n = rows.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


# ---------------------------------------------------------------- tool results


def claim_conflicts(results: DataFrame) -> DataFrame:
    """claim_key, polarities, conflict over the claims (tool, claim_key, polarity) of several tools."""
    return results.groupBy("claim_key").agg(F.count_distinct("polarity").alias("polarities")).withColumn("conflict", F.col("polarities") > 1)


def fuse_results(results: DataFrame, budget: int = 12_000) -> DataFrame:
    """One row: the lines `tool | status | summary` in order of seq, redacted and without unsafe ones, cut to a number of characters."""
    from weftline.functions.text import is_unsafe_prompt

    safe = results.withColumn("_unsafe", is_unsafe_prompt(F.col("summary")))
    line = F.concat_ws(" | ", "tool", "status", F.when(F.col("_unsafe"), "[filtered]").otherwise(redact(F.col("summary"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n")
    return safe.agg(F.substring(text, 1, budget).alias("text"), (F.length(text) > budget).alias("truncated"), F.coalesce(F.bool_or("_unsafe"), F.lit(False)).alias("filtered"))


def time_budget(tools: DataFrame, wall_ms: int = 5000) -> DataFrame:
    """Which tools (seq, tool, timeout_ms, cost_ms) run one after the other within a wall budget: started_ms, status.

    A tool may take the lesser of its timeout and what is left; one that would start with nothing left is skipped.
    """
    spent = F.sum(F.least("timeout_ms", "cost_ms")).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = tools.withColumn("started_ms", F.coalesce(spent, F.lit(0)))
    allowed = F.least(F.col("timeout_ms"), wall_ms - F.col("started_ms"))
    return out.withColumn("status", F.when(F.col("started_ms") >= wall_ms, "skipped").when(F.col("cost_ms") > allowed, "timeout").otherwise("ok"))
