"""Registered queries of scores, text functions and rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as x
from weftline.operators import rules, scoring
from weftline.operators import text as lines
from weftline.sources import tables as t

C, S = t.COMMITS_SQL, t.SIGNALS_SQL
PATHS = ["dist/x.js", "src/a.ts", "zzz", "a/b.d.ts", "lib/x.sh", "vendor/y.go", "a/vendor/y.go", "config/z.json", "a.yaml", "x/a.yaml", "node_modules/m/i.js", "p/node_modules/m/i.js", "tsconfig.json", "app/m.py", "third_party/q.c", ".git/HEAD", "a/x.min.js", "b.pyc"]


def _now(spark: SparkSession, d: str) -> int:
    return t.table(spark, d, "events").agg(F.unix_timestamp(F.max("ts"))).first()[0]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Made-up line counts: the commits' files exist by name only."""
    return t.commits(spark, d).select("file").distinct().select("file", (_number("file") * 37 % 400 + 1).alias("lines"))


def _number(column: str):
    return F.regexp_extract(column, "([0-9]+)", 1).cast("long")


def churn(spark: SparkSession, d: str) -> DataFrame:
    return scoring.churn(t.commits(spark, d), _now(spark, d) - 30 * 86400)


def file_age(spark: SparkSession, d: str) -> DataFrame:
    return scoring.file_age(t.commits(spark, d), _now(spark, d))


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return scoring.hotspots(t.commits(spark, d), _lines(spark, d))


def hotspots_bug(spark: SparkSession, d: str) -> DataFrame:
    return scoring.hotspots(t.commits(spark, d), _lines(spark, d), mode="bug")


def hotspots_weighted(spark: SparkSession, d: str) -> DataFrame:
    return scoring.hotspots(t.commits(spark, d), _lines(spark, d), mode="weighted", now=_now(spark, d))


def commit_types(spark: SparkSession, d: str) -> DataFrame:
    return t.commits(spark, d).select("sha", scoring.commit_type(F.col("subject")).alias("c")).select("sha", "c.*")


def commit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.commit_histogram(t.commits(spark, d))


def preferences(spark: SparkSession, d: str) -> DataFrame:
    return scoring.preferences(t.signals(spark, d), _now(spark, d), top=None)


def linear_decay(spark: SparkSession, d: str) -> DataFrame:
    s = t.signals(spark, d).select(F.col("symbol").alias("file_path"), "timestamp", F.when(F.col("action") == "edit", 2.0).when(F.col("action") == "ignore", 0.5).otherwise(1.5).alias("weight"))
    return scoring.linear_decay(s, _now(spark, d))


def retained(spark: SparkSession, d: str) -> DataFrame:
    return scoring.retained(t.signals(spark, d), _now(spark, d), 10).groupBy("action").agg(F.count("*").alias("n"))


def intent_types(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations")
    return c.select("conv_id", "turn", scoring.intent_type(F.col("text")).alias("intent"), scoring.is_non_code(F.col("text")).alias("non_code"))


def churn_entropy(spark: SparkSession, d: str) -> DataFrame:
    n = t.table(spark, d, "events").groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), "user_id").agg(F.count("*").alias("n"))
    return scoring.entropy(n, ["month"], "n")


def month_steps(spark: SparkSession, d: str) -> DataFrame:
    n = t.table(spark, d, "events").groupBy("event_type", F.date_trunc("month", "ts").cast("date").alias("timestamp")).agg(F.count("*").alias("n"))
    return scoring.snapshot_steps(n, "n", "event_type")


def event_trend(spark: SparkSession, d: str) -> DataFrame:
    n = t.table(spark, d, "events").groupBy(F.date_trunc("month", "ts").cast("date").alias("timestamp")).agg(F.count("*").alias("n"))
    return scoring.trend(n, "n")


def fault_locations(spark: SparkSession, d: str) -> DataFrame:
    c = t.commits(spark, d)
    named = c.select(F.col("file").alias("file_path")).distinct().select("file_path", (_number("file_path") % 5).alias("depth"))
    named = named.select("file_path", scoring.chain_scores(F.col("depth")).alias("chain"), (F.col("depth") * 7 + 1).cast("int").alias("line"))
    history = scoring.commit_histogram(c).select(F.col("file").alias("file_path"), F.col("n_fix").alias("n_fixes"))
    heat = scoring.hotspots(c, _lines(spark, d), top=100).select(F.col("file").alias("file_path"), "score")
    return scoring.fault_locations(named, history, heat, "TypeError: x is undefined", top=20).select("file_path", "score", "from_line", "to_line")


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", x.boundary(F.col("path")).alias("b")).select("path", "b.*")


def redaction(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select("doc_id", F.md5("text").alias("before"), F.md5(x.redact(F.col("text"))).alias("after"))
    return docs.filter("before <> after").select("doc_id", "after")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return t.links(spark, d).groupBy("href").agg(F.count("*").alias("n"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    ln = lines.lines(t.table(spark, d, "documents"), "doc_id", "text").filter(F.length("line") > 20)
    return ln.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("file").alias("docs"), F.min("file").alias("first")).filter("n > 2").select(F.md5("line").alias("line"), "n", "docs", "first")


def suffixes(spark: SparkSession, d: str) -> DataFrame:
    files = t.table(spark, d, "events").select(F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.initcap("event_type"), F.lit(".ts")).alias("file")).distinct()
    return lines.suffix_patterns(files)


def labelled_quality(spark: SparkSession, d: str) -> DataFrame:
    """How often documents with few letters are labelled as poor."""
    docs = t.table(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit("[#*$%&]")) * 20 > F.length("text")).alias("flagged"))
    return docs.join(t.table(spark, d, "labels"), "doc_id").groupBy("flagged", "quality").agg(F.count("*").alias("n"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").select(F.element_at(F.split(F.lit("low,moderate,high,critical"), ","), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("severity"))
    return rules.severity_histogram(o.filter(x.severity_rank(F.col("severity")) >= 1))


def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """Imports between the folders of the graph that a rule forbids."""
    n = t.nodes(spark, d)
    e = t.edges(spark, d).filter("edge_type <> 'REFERENCES'")
    imports = e.join(n.select(F.col("id").alias("source_id"), F.col("file_path").alias("source")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("file_path").alias("target")), "target_id").select("source", "target", F.lit(1).alias("line_no")).distinct()
    rs = [{"name": "no-geo", "from": "customer/**", "cannot_import": ["nation/**"], "severity": "error"}, {"name": "no-first", "from": "order/*", "cannot_import": ["customer/0", "customer/1"], "severity": "warning"}]
    return rules.rule_violations(imports, rs, ignore=["customer/2"])


def component_drift(spark: SparkSession, d: str) -> DataFrame:
    n, r = t.table(spark, d, "nation"), t.table(spark, d, "region")
    path = lambda df, rx: df.select(F.concat(F.lit(rx), F.col("n_name")).alias("path"))
    planned = path(n.filter("n_nationkey < 20"), "a/")
    found = path(n.filter("n_nationkey >= 5 and n_nationkey < 18"), "a/").unionByName(path(n.filter("n_nationkey >= 18"), "b/"))
    deps = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), "n_nationkey")
    return scoring.component_drift(planned, found, deps.filter("n_nationkey > 3"), deps)


QUERIES = {f.__name__: f for f in (churn, file_age, hotspots, hotspots_bug, hotspots_weighted, commit_types, commit_histogram, preferences, linear_decay, retained, intent_types, churn_entropy, month_steps, event_trend, fault_locations, boundaries, redaction, page_links, repeated_lines, suffixes, labelled_quality, severity_counts, rule_violations, component_drift)}


def _type_sql(column: str, value: int) -> str:
    low = f"lower({column})"
    cases = " ".join("WHEN " + " OR ".join(f"regexp_matches({low}, '{p}')" for p in ps) + f" THEN {(repr(kind), f'CAST({conf} AS DOUBLE)')[value]}" for kind, conf, ps in scoring.COMMIT_RULES)
    return f"CASE {cases} ELSE {chr(39) + 'chore' + chr(39) if not value else 'CAST(0.7 AS DOUBLE)'} END"


_NOW = "(SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events)"
_N = "CAST(regexp_extract({c}, '([0-9]+)', 1) AS BIGINT)"
_HOT = f"""c AS (SELECT *, {_type_sql('subject', 0)} = 'fix' AS bug FROM ({C})), h AS (SELECT file, count(*) AS freq, count(*) FILTER (bug) AS bugs, max(ts) AS last, {_N.format(c='file')} * 37 % 400 + 1 AS lines FROM c GROUP BY file)"""
_TOP = "ORDER BY score DESC, file LIMIT"
_INTENT = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in scoring.INTENT_RULES)
_BOUND = lambda i: " ".join(f"WHEN regexp_matches(path, '{x.glob_regex(g)}') THEN {(repr(k), f'CAST({c} AS DOUBLE)', repr(g))[i]}" for g, k, c in x.BOUNDARY_RULES)
_MONTH = "CAST(date_trunc('month', ts) AS DATE)"
SQL = {
    "churn": f"SELECT file, count(*) AS freq FROM ({C}) WHERE ts >= {_NOW} - 30 * 86400 GROUP BY 1",
    "file_age": f"SELECT file, CAST(greatest(({_NOW} - max(ts)) // 86400, 0) AS BIGINT) AS age_days FROM ({C}) GROUP BY 1",
    "hotspots": f"WITH {_HOT} SELECT file, freq, lines, CAST(freq * lines AS DOUBLE) AS score FROM h {_TOP} 20",
    "hotspots_bug": f"WITH {_HOT} SELECT file, freq, lines, round(freq * lines * (1 + CAST(1 AS DOUBLE) * bugs / freq), 0) AS score FROM h {_TOP} 20",
    "hotspots_weighted": f"""WITH {_HOT}, m AS (SELECT max(freq) AS f, max(lines) AS l, max(bugs) AS b FROM h)
SELECT file, freq, lines, round((CAST(0.4 AS DOUBLE) * (freq / f) + CAST(0.2 AS DOUBLE) * (lines / l) + CAST(0.2 AS DOUBLE) * CASE WHEN b > 0 THEN bugs / b ELSE 0 END) * CAST(CASE WHEN ({_NOW} - last) // 86400 <= 30 THEN 1.2 ELSE 1 END AS DOUBLE), 6) AS score FROM h, m {_TOP} 20""",
    "fault_locations": f"""WITH {_HOT}, t AS (SELECT file, CAST(freq * lines AS DOUBLE) AS score FROM h {_TOP} 100), x AS (SELECT file, bugs, {_N.format(c='file')} % 5 AS depth FROM h),
s AS (SELECT x.file AS file_path, round(CAST(0.4 AS DOUBLE) * greatest(0, 1 - CAST(0.2 AS DOUBLE) * depth) + CAST(0.3 AS DOUBLE) * (bugs / (SELECT max(bugs) FROM h)) + CAST(0.15 AS DOUBLE) * coalesce(t.score / (SELECT max(score) FROM t), 0) + CAST(0.15 AS DOUBLE) * CAST(0.5 AS DOUBLE), 4) AS score, depth FROM x LEFT JOIN t USING (file))
SELECT file_path, score, CAST(greatest(depth * 7 + 1 - 5, 1) AS INT) AS from_line, CAST(depth * 7 + 16 AS INT) AS to_line FROM s ORDER BY score DESC, file_path LIMIT 20""",
    "commit_types": f"SELECT sha, {_type_sql('subject', 0)} AS type, {_type_sql('subject', 1)} AS confidence FROM ({C})",
    "commit_histogram": f"""WITH c AS (SELECT *, {_type_sql('subject', 0)} AS t FROM ({C})) SELECT file, count(*) AS n_commits, {', '.join(f"count(*) FILTER (t = '{k}') AS n_{k}" for k in scoring.COMMIT_TYPES)},
round(avg(CAST(t = 'fix' AS DOUBLE)), 4) AS bug_ratio, max(ts) FILTER (t = 'fix') AS last_fix, coalesce(string_agg(DISTINCT sha, ',' ORDER BY sha) FILTER (t = 'fix'), '') AS fixes FROM c GROUP BY 1""",
    "preferences": f"""WITH s AS (SELECT *, greatest(({_NOW} - timestamp) // 86400, 0) AS age FROM ({S})),
g AS (SELECT symbol_id, min(symbol) AS symbol, count(*) AS frequency, sum(CAST(CASE action WHEN 'view' THEN 1.5 WHEN 'edit' THEN 2.0 WHEN 'ignore' THEN -0.5 ELSE 1 END AS DOUBLE) / (1 + age)) AS s,
  min(timestamp) FILTER (action = 'ignore') AS i, max(timestamp) FILTER (action = 'edit') AS e FROM s GROUP BY 1)
SELECT symbol_id, symbol, frequency, round(s + CASE WHEN e >= i THEN 1.5 ELSE 0 END, 6) AS score FROM g""",
    "linear_decay": f"SELECT symbol AS file_path, round(sum(CAST(CASE action WHEN 'edit' THEN 2.0 WHEN 'ignore' THEN 0.5 ELSE 1.5 END AS DOUBLE) * greatest(0, 1 - (({_NOW} - timestamp) / 86400) / CAST(90 AS DOUBLE))), 6) AS score FROM ({S}) GROUP BY 1",
    "retained": f"SELECT action, count(*) AS n FROM ({S}) WHERE timestamp >= {_NOW} - 10 * 86400 GROUP BY 1",
    "intent_types": f"SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '[a-zA-Z]') THEN 'feature' {_INTENT} ELSE 'feature' END AS intent, regexp_matches(text, '(?i){scoring.NON_CODE}') AS non_code FROM conversations",
    "churn_entropy": f"WITH n AS (SELECT {_MONTH} AS month, user_id, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT month, n / sum(n) OVER (PARTITION BY month) AS p FROM n) SELECT month, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1",
    "month_steps": f"WITH n AS (SELECT event_type, {_MONTH} AS timestamp, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY timestamp) AS prior FROM n) SELECT *, n - prior AS change FROM l",
    "event_trend": f"WITH n AS (SELECT {_MONTH} AS m, count(*) AS n FROM events GROUP BY 1), f AS (SELECT arg_min(n, m) AS first, arg_max(n, m) AS last FROM n) SELECT *, CASE WHEN last > first THEN 'increasing' WHEN last < first THEN 'decreasing' ELSE 'stable' END AS trend FROM f",
    "boundaries": f"SELECT path, CASE {_BOUND(0)} ELSE 'user' END AS kind, CASE {_BOUND(1)} ELSE CAST(0.5 AS DOUBLE) END AS confidence, CASE {_BOUND(2)} ELSE 'default' END AS rule FROM (SELECT unnest({PATHS}) AS path)",
    "redaction": r"""WITH d AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?i)BEGIN\s+.*PRIVATE\s+KEY') THEN '[REDACTED: private key detected]' ELSE
regexp_replace(regexp_replace(regexp_replace(text, '(Bearer)\s+[A-Za-z0-9._-]+', '\1 [REDACTED]', 'g'), 'AKIA[0-9A-Z]{16}', 'AKIA[REDACTED]', 'g'), '((?:token|secret|api_key|password)\s*=\s*)"[^"\n]*"', '\1"[REDACTED]"', 'g') END AS t FROM documents)
SELECT doc_id, md5(t) AS after FROM d WHERE md5(t) <> md5(text)""",
    "page_links": """SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY 1""",
    "repeated_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT md5(line) AS line, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM l WHERE length(line) > 20 GROUP BY l.line HAVING count(*) > 2",
    "suffixes": "WITH f AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT upper(event_type[1]) || event_type[2:] AS suffix, count(*) AS count FROM f WHERE length(event_type) >= 4 GROUP BY 1) SELECT suffix, count, least(1.0, count / 9.0) AS confidence FROM s WHERE count >= 3",
    "labelled_quality": "SELECT len(regexp_extract_all(text, '[#*$%&]')) * 20 > length(text) AS flagged, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "severity_counts": "SELECT count(*) FILTER (o_orderkey % 4 = 3) AS critical, count(*) FILTER (o_orderkey % 4 = 2) AS high, count(*) FILTER (o_orderkey % 4 = 1) AS moderate, CAST(0 AS BIGINT) AS low, count(*) FILTER (o_orderkey % 4 > 0) AS total FROM orders",
    "rule_violations": f"""WITH n AS ({t.NODES_SQL}), e AS ({t.EDGES_SQL}), i AS (SELECT DISTINCT s.file_path AS source, x.file_path AS target FROM e JOIN n s ON s.id = source_id JOIN n x ON x.id = target_id WHERE edge_type <> 'REFERENCES')
SELECT 'no-geo' AS rule, 'error' AS severity, source, target, CAST(1 AS INT) AS line_no FROM i WHERE source LIKE 'customer/%' AND target LIKE 'nation/%' AND source <> 'customer/2'
UNION ALL SELECT 'no-first', 'warning', source, target, CAST(1 AS INT) FROM i WHERE source LIKE 'order/%' AND target IN ('customer/0', 'customer/1')""",
    "component_drift": """WITH p AS (SELECT n_name AS b, 'a/' || n_name AS path FROM nation WHERE n_nationkey < 20), f AS (SELECT n_name AS b, CASE WHEN n_nationkey < 18 THEN 'a/' ELSE 'b/' END || n_name AS path FROM nation WHERE n_nationkey >= 5),
a AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM p)), r AS (SELECT * FROM p WHERE path NOT IN (SELECT path FROM f)), m AS (SELECT * FROM a WHERE b IN (SELECT b FROM r)),
c AS (SELECT (SELECT count(*) FROM a WHERE path NOT IN (SELECT path FROM m)) AS added, (SELECT count(*) FROM r WHERE b NOT IN (SELECT b FROM m)) AS removed, (SELECT count(*) FROM m) AS moved, (SELECT count(*) FROM nation WHERE n_nationkey <= 3) AS new_dependencies),
s AS (SELECT *, 15 * added + 20 * removed + 10 * moved + 5 * new_dependencies AS score FROM c) SELECT *, CASE WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level FROM s""",
}
