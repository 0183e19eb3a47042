"""Registered queries of the operators over source texts and documents, on small inline inputs, with their SQL twins.

The tables at hand hold no source code, so that the inputs are stated here and reach both engines as the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as x
from weftline.operators import assist, rules, scoring
from weftline.operators import text as t
from weftline.sources import files as src

FILES = [
    ("src/app.ts", "import { load, save as store } from './lib/io';\nimport Main from 'react';\nconst fs = require('fs');\nexport class App extends Base implements Runner {\n}\nexport async function start_up(q: string): Result {\n  const user_name = await load(q);\n  console.log(user_name);\n  try {\n    await store(q);\n  } catch (e) {\n  }\n  var old = 1;\n  return old;\n}\nfunction stop(v) {\n  start_up(v)\n}"),
    ("src/lib/io.ts", "import { App } from '../app';\nexport function load(a) {\n  if (a && a.b) {\n    return fetch(a);\n  }\n  for (;;) {}\n}\nexport const save = async (a) => 1\ninterface Row {}\ntype Id = string"),
    ("run.sh", "source ./env.sh\n. common.sh\necho done"),
    ("api/users.proto", "service Users {\n  rpc GetUser (Q) returns (R);\n}\nmessage Q {}\nenum Kind {}"),
    ("api/schema.graphql", "type User {\n}\ninput Find {\n}\nquery getUser"),
    ("docs/adr/0001-store.md", "# ADR-001: Keep a store\n\n## Status\nAccepted\n\n## Context\nWe need `GraphStore` and user_id.\nAlso src/app.ts here.\n## Decision\nUse it.\n## Consequences\nNone known."),
]
SYMBOLS = [("app", "GetUser", None), ("app", "fetchUserById", None), ("app", "saveOrder", None), ("svc", "GetUser", "proto"), ("svc", "createUser", "openapi"), ("svc", "OrderSaved", "graphql"), ("app", "GetUser", "proto")]
AUDIT = '{"vulnerabilities": {"lodash": {"name": "lodash", "severity": "high", "via": [{"title": "Prototype Pollution"}], "effects": [], "fixAvailable": true}, "minimist": {"name": "minimist", "severity": "low", "via": ["lodash"], "effects": [], "fixAvailable": false}, "qs": {"name": "qs", "severity": "critical", "via": [{"title": "DoS"}, "lodash"], "effects": [], "fixAvailable": true}}}'
OLD_TREE = [("1", "function", "f", 1, 3, 0), ("2", "class", "A", 4, 9, 2), ("3", "block", None, 1, 1, 0)]
NEW_TREE = [("1", "function", "f", 11, 13, 0), ("2", "class", "A", 4, 12, 3), ("4", "function", "g", 1, 2, 0)]
ERRORS = ["TypeError: x is undefined at src/types.ts:12", "SyntaxError in load_all", "y not defined", "fetch failed for getUser", "403 forbidden", "odd"]
TREE = "id string, type string, name string, start_line int, end_line int, child_count int"


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "file string, text string")


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return t.imports(_files(spark))


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    return t.resolve_imports(t.imports(_files(spark)), _files(spark))


def import_names(spark: SparkSession, d: str) -> DataFrame:
    return t.import_map(_files(spark))


def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    return t.symbols(_files(spark))


def function_index(spark: SparkSession, d: str) -> DataFrame:
    return t.function_index(_files(spark))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return t.calls(_files(spark)).select("file", "caller", "callee")


def contract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return t.contract_symbols(_files(spark))


def contract_types(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("file", x.contract_type(F.col("file")).alias("type"))


def local_symbols(spark: SparkSession, d: str) -> DataFrame:
    return t.local_symbols(_files(spark).filter(F.col("file").endswith(".ts")))


def decision_records(spark: SparkSession, d: str) -> DataFrame:
    return t.decision_records(_files(spark).filter(F.col("file").endswith(".md")))


def record_sections(spark: SparkSession, d: str) -> DataFrame:
    return t.sections(_files(spark).filter(F.col("file").endswith(".md"))).select("section", "body")


def style_anomalies(spark: SparkSession, d: str) -> DataFrame:
    found = t.anomalies(_files(spark)).filter("rule in ('console_use', 'snake_variable', 'snake_function', 'var_use')")
    return found.select("file", "line_no", "rule", "severity", "confidence")


def error_handling(spark: SparkSession, d: str) -> DataFrame:
    return t.anomalies(_files(spark)).filter("rule in ('unhandled_await', 'catch_without_log', 'bare_fetch')").select("file", "line_no", "rule")


def branch_complexity(spark: SparkSession, d: str) -> DataFrame:
    return t.complexity(_files(spark))


def tree_definitions(spark: SparkSession, d: str) -> DataFrame:
    return src.definitions(_files(spark).filter(F.col("file").endswith(".ts"))).filter("name is not null").select("file", "type", "name", "start_line")


def virtual_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(SYMBOLS, "repo string, symbol string, contract_type string")
    local = rows.filter("contract_type is null").select("repo", "symbol")
    return scoring.virtual_edges(local, rows.filter("contract_type is not null"), 0.6).select("source_symbol", "target_symbol", "exact_match", "confidence", "confidence_level")


def vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    return rules.vulnerabilities(spark.createDataFrame([(AUDIT,)], "text string"), "high")


def tree_delta(spark: SparkSession, d: str) -> DataFrame:
    return scoring.tree_delta(spark.createDataFrame(OLD_TREE, TREE), spark.createDataFrame(NEW_TREE, TREE)).select("key", "status", "type")


def error_types(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(e,) for e in ERRORS], "text string").select("text", scoring.error_type(F.col("text")).alias("type"))


def error_files(spark: SparkSession, d: str) -> DataFrame:
    found = assist.error_mentions(spark.createDataFrame([(e,) for e in ERRORS], "text string"))
    return found.filter("kind = 'file'").select("name", "line")


def pattern_decay(spark: SparkSession, d: str) -> DataFrame:
    p = spark.range(20).select(F.concat(F.lit("p"), "id").alias("pattern_id"), (F.col("id") / 20 + 0.1).alias("confidence"), (F.lit(100 * 86400) - F.col("id") * 3 * 86400).alias("last_confirmed"))
    return scoring.pattern_decay(p, 100 * 86400).select("pattern_id", "confidence")


def snapshot_drift(spark: SparkSession, d: str) -> DataFrame:
    cols = "total_coupling int, dependency_violations int, boundary_clarity double, cyclic_dependencies int"
    files = "path string, coupling int"
    return scoring.snapshot_drift(spark.createDataFrame([(100, 1, 0.9, 0)], cols), spark.createDataFrame([(115, 2, 0.75, 1)], cols), spark.createDataFrame([("a", 10), ("b", 8)], files), spark.createDataFrame([("a", 25), ("b", 15)], files))


QUERIES = {f.__name__: f for f in (import_edges, resolved_imports, import_names, source_symbols, function_index, call_edges, contract_symbols, contract_types, local_symbols, decision_records, record_sections, style_anomalies, error_handling, branch_complexity, tree_definitions, virtual_edges, vulnerabilities, tree_delta, error_types, error_files, pattern_decay, snapshot_drift)}


def _quote(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows) + f") AS v({columns})"


_L = f"f AS (SELECT * FROM {_values(FILES, 'file, text')}), l AS (SELECT file, CAST(i AS INT) AS line_no, ls[i] AS line FROM (SELECT file, string_split(text, chr(10)) AS ls FROM f), unnest(range(1, len(ls) + 1)) AS u(i))"
_JS, _SH = r"\.(ts|tsx|js|jsx|mjs|cjs)$", r"\.(sh|bash)$"
_IMPORTS = rf"""i AS (SELECT * FROM (SELECT file AS source, regexp_extract(line, '(?:import|export)\b.*\bfrom\s+[''"]([^''"]+)[''"]', 1) AS target, line_no FROM l WHERE regexp_matches(file, '{_JS}')
UNION ALL SELECT file, regexp_extract(line, 'require\(\s*[''"]([^''"]+)[''"]\s*\)', 1), line_no FROM l WHERE regexp_matches(file, '{_JS}')
UNION ALL SELECT file, regexp_extract(line, '^\s*(?:source|\.)\s+["'']?([^\s"'']+)', 1), line_no FROM l WHERE regexp_matches(file, '{_SH}')) WHERE target <> '')"""
_DEF = r"(?:^|\s)(?:async\s+)?(?:function|def)\s+(\w+)"
_FUN = r"w AS (SELECT *, last_value(nullif(regexp_extract(line, '(?:function|def)\s+(\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS function FROM l)"
_SYMBOL_RULES = [("DEFINES", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("DEFINES", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("IMPORTS", r"import\b.*from\s+[''\"]([^''\"]+)[''\"]"), ("IMPLEMENTS", r"class\s+\w+.*\bimplements\s+(\w+)"), ("EXTENDS", r"class\s+\w+\s+extends\s+(\w+)"), ("RETURNS_TYPE", r"\)\s*:\s*([A-Z]\w*)")]
_DEFS = [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("variable", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)")]
_VERBS = "|".join(v for vs in scoring.VERBS.values() for v in vs)
_VERB_OF = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '^({'|'.join(vs)})') THEN '{k}'" for k, vs in scoring.VERBS.items()) + " ELSE '' END"
_NOUNS = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '([A-Z]?[a-z]+|[A-Z]+)', 1), lambda w: lower(w)), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^({_VERBS})$'))"
_BASE = lambda c: f"regexp_replace(lower({c}), '^({_VERBS})', '')"
_DBL = lambda v: f"CAST({v} AS DOUBLE)"
_CODE = "regexp_replace(line, '//.*$', '')"
SQL = {
    "import_edges": f"WITH {_L}, {_IMPORTS} SELECT * FROM i",
    "resolved_imports": f"""WITH {_L}, {_IMPORTS}, r AS (SELECT *, CASE WHEN target LIKE '../%' THEN regexp_replace(regexp_replace(source, '/[^/]*$', ''), '/?[^/]*$', '') || '/' || target[4:] ELSE CASE WHEN contains(source, '/') THEN regexp_replace(source, '/[^/]*$', '') || '/' ELSE '' END || target[3:] END AS base FROM i WHERE regexp_matches(target, '^\\.\\.?/')),
t AS (SELECT r.*, k, ltrim(base, '/') || ['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js'][k] AS try FROM r, unnest(range(1, 9)) AS u(k))
SELECT source, target, line_no, arg_min(f.file, k) AS resolved FROM t LEFT JOIN f ON f.file = try GROUP BY ALL""",
    "import_names": rf"""WITH {_L}, m AS (SELECT file, line, regexp_extract(line, 'from\s+[''"]([^''"]+)[''"]', 1) AS module FROM l WHERE regexp_matches(line, '^\s*import\b.*\bfrom\b'))
SELECT DISTINCT file, name, module FROM (SELECT file, regexp_extract(line, 'import\s+([A-Za-z_$][\w$]*)\s*(?:,|from)', 1) AS name, module FROM m UNION ALL SELECT file, regexp_extract(line, '\*\s+as\s+([\w$]+)', 1), module FROM m
UNION ALL SELECT file, trim(regexp_replace(n, '^.*\bas\s+', '')), module FROM (SELECT file, unnest(string_split(regexp_extract(line, '\{{([^}}]*)\}}', 1), ',')) AS n, module FROM m)) WHERE name <> ''""",
    "source_symbols": f"WITH {_L} SELECT * FROM (" + " UNION ALL ".join(f"SELECT file, line_no, '{k}' AS edge_type, regexp_extract(line, '{rx}', 1) AS name FROM l WHERE regexp_matches(file, '{_JS}')" for k, rx in _SYMBOL_RULES) + ") WHERE name <> ''",
    "function_index": f"WITH {_L}, d AS (SELECT file, line_no, regexp_extract(line, '{_DEF}', 1) AS name FROM l) SELECT name, file, line_no FROM d WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY file, line_no) = 1",
    "call_edges": rf"""WITH {_L}, {_FUN}, c AS (SELECT file, function AS caller, unnest(regexp_extract_all(line, '\b([A-Za-z_]\w*)\s*\(', 1)) AS callee, regexp_extract(line, '(?:function|def)\s+(\w+)', 1) AS own FROM w)
SELECT file, caller, callee FROM c WHERE caller IS NOT NULL AND callee <> own AND callee NOT IN ({', '.join(repr(k) for k in t.KEYWORDS)})""",
    "contract_symbols": f"WITH {_L} SELECT DISTINCT file, symbol FROM (" + " UNION ALL ".join(f"SELECT file, regexp_extract(line, '{rx}', 1) AS symbol FROM l WHERE regexp_matches(file, '{ext}')" for ext, rx in [(r"\.proto$", r"^\s*(?:service|message|enum|rpc)\s+(\w+)"), (r"\.(graphql|gql)$", r"^\s*(?:type|input|interface|enum)\s+(\w+)"), (r"\.(graphql|gql)$", r"^\s*(?:query|mutation|subscription)\s+(\w+)"), (r"\.ts$", r"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|type|class|enum)\s+(\w+)")]) + ") WHERE symbol <> ''",
    "contract_types": f"WITH {_L} SELECT file, CASE WHEN file LIKE '%.proto' THEN 'proto' WHEN regexp_matches(file, '(^|/)(openapi|swagger)\\.(ya?ml|json)$') THEN 'openapi' WHEN regexp_matches(file, '\\.(graphql|gql)$') THEN 'graphql' WHEN file LIKE '%.d.ts' THEN 'typescript' ELSE 'unknown' END AS type FROM f",
    "local_symbols": rf"WITH {_L} SELECT DISTINCT file, symbol FROM (SELECT file, regexp_extract(line, '(?:^|\s)function\s+(\w+)', 1) AS symbol FROM l UNION ALL SELECT file, regexp_extract(line, '(?:^|\s)const\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\()', 1) FROM l) WHERE symbol <> '' AND file LIKE '%.ts'",
    "decision_records": f"WITH {_L} SELECT file, '001' AS id, 'Keep a store' AS title, " + ", ".join(f"string_agg(trim(line), ' ' ORDER BY line_no) FILTER (s = '{k}' AND line NOT LIKE '## %' AND trim(line) <> '') AS {k.lower()}" for k in ("Status", "Context", "Decision", "Consequences")) + " FROM (SELECT *, last_value(nullif(regexp_extract(line, '^##\\s+(.*\\S)', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s FROM l WHERE file LIKE '%.md') GROUP BY file",
    "record_sections": f"WITH {_L}, h AS (SELECT *, nullif(regexp_extract(line, '^#{{1,6}}\\s+(.*\\S)\\s*$', 1), '') AS head FROM l WHERE file LIKE '%.md'), s AS (SELECT *, last_value(head IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h) SELECT section, coalesce(string_agg(trim(line), ' ' ORDER BY line_no) FILTER (head IS NULL AND trim(line) <> ''), '') AS body FROM s GROUP BY section",
    "style_anomalies": f"WITH {_L} SELECT file, line_no, rule, severity, {_DBL('confidence')} AS confidence FROM (" + " UNION ALL ".join(f"SELECT file, line_no, '{n}' AS rule, '{sev}' AS severity, {c} AS confidence FROM l WHERE regexp_matches(file, '{_JS}') AND regexp_matches({_CODE}, '{rx}')" for n, sev, c, rx in [("console_use", "info", 0.6, r"console\.(log|warn|error|info|debug)"), ("snake_variable", "info", 0.6, r"(?:const|let|var)\s+([a-z][a-z0-9]*_\w+)"), ("snake_function", "info", 0.6, r"function\s+([a-z][a-z0-9]*_\w+)"), ("var_use", "warning", 0.7, r"\bvar\b")]) + ")",
    "error_handling": rf"""WITH {_L}, c AS (SELECT *, {_CODE} AS code FROM l WHERE regexp_matches(file, '{_JS}')),
w AS (SELECT *, sum(len(regexp_extract_all(code, 'try\s*\{{')) - len(regexp_extract_all(code, 'catch\s*\('))) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS open,
  max(CAST(regexp_matches(line, 'console\.|logger\.|log\.|throw') AS INT)) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS logged FROM c)
SELECT file, line_no, 'unhandled_await' AS rule FROM w WHERE regexp_matches(code, '\bawait\s') AND open <= 0 AND NOT contains(code, '.catch(')
UNION ALL SELECT file, line_no, 'catch_without_log' FROM w WHERE regexp_matches(code, 'catch\s*\(') AND logged = 0
UNION ALL SELECT file, line_no, 'bare_fetch' FROM w WHERE regexp_matches(code, '\bfetch\s*\(') AND NOT regexp_matches(code, 'await\s+fetch|\.then|\.catch') AND open <= 0""",
    "branch_complexity": rf"WITH {_L}, {_FUN} SELECT file, function, CAST(1 + sum(len(regexp_extract_all({_CODE}, '\b(if|for|while|case|catch)\b|&&|\|\||\?[^.?:]'))) AS BIGINT) AS complexity FROM w WHERE function IS NOT NULL GROUP BY ALL",
    "tree_definitions": f"WITH {_L} SELECT * FROM (" + " UNION ALL ".join(f"SELECT file, '{k}' AS type, regexp_extract(line, '{rx}', 1) AS name, line_no AS start_line FROM l WHERE file LIKE '%.ts'" for k, rx in _DEFS) + ") WHERE name <> ''",
    "virtual_edges": f"""WITH s AS (SELECT * FROM {_values(SYMBOLS, 'repo, symbol, contract_type')}), p AS (SELECT a.symbol AS a, b.symbol AS b, b.contract_type AS k FROM s a JOIN s b ON a.repo <> b.repo WHERE a.contract_type IS NULL AND b.contract_type IS NOT NULL),
n AS (SELECT *, CASE WHEN lower(a) = lower(b) THEN {_DBL(1)} WHEN starts_with(lower(a), lower(b)) OR starts_with(lower(b), lower(a)) OR ({_BASE('a')} <> '' AND {_BASE('b')} <> '' AND (starts_with({_BASE('a')}, {_BASE('b')}) OR starts_with({_BASE('b')}, {_BASE('a')}))) THEN {_DBL(0.7)} END AS m,
  CASE WHEN ({_VERB_OF('a')} <> '' AND {_VERB_OF('a')} = {_VERB_OF('b')}) OR list_has_any({_NOUNS('a')}, {_NOUNS('b')}) THEN {_DBL(0.6)} ELSE {_DBL(0.5)} END AS g FROM p),
c AS (SELECT a AS source_symbol, b AS target_symbol, m AS exact_match, round({_DBL(0.6)} * m + {_DBL(0.3)} * g + {_DBL(0.1)} * CAST(CASE k WHEN 'proto' THEN 0.1 WHEN 'graphql' THEN 0.08 ELSE 0.05 END AS DOUBLE), 4) AS confidence FROM n WHERE m IS NOT NULL)
SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence < 0.5 THEN 'low' ELSE 'medium' END AS confidence_level FROM c WHERE confidence >= 0.6""",
    "vulnerabilities": f"""WITH j AS (SELECT CAST({_quote(AUDIT)} AS JSON) -> 'vulnerabilities' AS v), k AS (SELECT unnest(json_keys(v)) AS k, v FROM j), r AS (SELECT v -> k AS o FROM k)
SELECT o ->> 'name' AS package, o ->> 'severity' AS severity, array_to_string(list_transform(CAST(o -> 'via' AS JSON[]), lambda e: coalesce(e ->> 'title', e ->> '$')), '; ') AS title, (o ->> 'fixAvailable') = 'true' AS fixable FROM r WHERE o ->> 'severity' IN ('high', 'critical')""",
    "tree_delta": f"""WITH o AS (SELECT CASE WHEN name IS NOT NULL THEN type || ':' || name ELSE id END AS key, * FROM {_values(OLD_TREE, 'id, type, name, a, b, c')}), n AS (SELECT CASE WHEN name IS NOT NULL THEN type || ':' || name ELSE id END AS key, * FROM {_values(NEW_TREE, 'id, type, name, a, b, c')})
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.b - o.a <> n.b - n.a OR o.c <> n.c THEN 'modified' ELSE 'unchanged' END AS status, coalesce(n.type, o.type) AS type FROM o FULL JOIN n ON o.key = n.key""",
    "error_types": "SELECT text, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p, _, _ in scoring.ERROR_RULES) + f" ELSE 'unknown' END AS type FROM {_values([(e,) for e in ERRORS], 'text')}",
    "error_files": f"SELECT regexp_extract(m, '^(.*):', 1) AS name, CAST(regexp_extract(m, ':([0-9]+)$', 1) AS INT) AS line FROM (SELECT unnest(regexp_extract_all(text, '([a-zA-Z0-9_/.-]+\\.(?:ts|tsx|js|jsx|py|go|java|rs):[0-9]+)', 1)) AS m FROM {_values([(e,) for e in ERRORS], 'text')})",
    "pattern_decay": f"SELECT 'p' || i AS pattern_id, round((i / 20 + {_DBL(0.1)}) * pow({_DBL(0.95)}, least(i * 3, 31)), 4) AS confidence FROM range(20) AS r(i) WHERE i / 20 + {_DBL(0.1)} >= 0.3",
    "snapshot_drift": f"SELECT {_DBL(15)} AS coupling_percent, CAST(15 AS BIGINT) AS coupling, CAST(10 AS BIGINT) AS violations, CAST(10 AS BIGINT) AS blur, CAST(10 AS BIGINT) AS cycles, CAST(5 AS BIGINT) AS hot, CAST(50 AS BIGINT) AS score, 'high' AS level",
}
