"""Registered queries of the operators over source texts, on a source tree made from whole tables, with their SQL twins.

The tables hold no source code: TREE makes a file for every customer, by the same SQL text in both engines.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as x
from weftline.operators import assist, graph, rules, scoring
from weftline.operators import retrieval as r
from weftline.operators import text as t
from weftline.sources import files as src
from weftline.sources import sinks, tables, wire
from weftline.storage import shared_root

#: A script file for every customer: k, file, text. {t}: the table.
TREE = """SELECT k, CASE WHEN k % 13 = 0 THEN 'vendor/v' || k || '.js' WHEN k % 29 = 0 THEN 'src/m' || (k % 7) || '/d' || k || '/index.ts'
WHEN k % 23 = 0 THEN 'src/m' || (k % 7) || '/f' || k || '.spec.ts' ELSE 'src/m' || (k % 7) || '/f' || k || '.ts' END AS file,
'import {{ f' || (k + 7) || ', g' || (k + 7) || ' as h' || k || ' }} from ' || chr(39) || './f' || (k + 7) || chr(39) || ';' || chr(10)
|| 'import Main' || (k % 9) || ' from ' || chr(39) || '../m' || ((k + 1) % 7) || '/f' || (k + 1) || chr(39) || ';' || chr(10)
|| 'import fs from ' || chr(39) || 'pkg' || (k % 5) || '/sub' || chr(39) || ';' || chr(10)
|| 'export class C' || k || ' extends Base' || (k % 3) || ' implements Run' || (k % 4) || ' {{}}' || chr(10)
|| 'export async function load' || k || '(arg' || k || ') {{' || chr(10)
|| '  const my_value = await read' || (k % 50) || '(arg' || k || ');' || chr(10)
|| repeat('  step(1);' || chr(10), CAST(k % 9 AS INT))
|| '  return f' || (k + 7) || '(my_value);' || chr(10) || '}}' || chr(10)
|| 'function handle' || (k % 20) || '(q) {{' || chr(10) || '  if (q && q.ok) {{' || chr(10) || '    console.log(q);' || chr(10) || '  }}' || chr(10)
|| '  fetch(q);' || chr(10) || CASE WHEN k % 11 = 0 THEN '}}}}' ELSE '}}' END AS text
FROM (SELECT c_custkey AS k FROM {t})"""
#: The same in DuckDB, and its lines.
T = TREE.format(t="customer")
L = f"f AS ({T}), l AS (SELECT file, CAST(i AS INT) AS line_no, s[i] AS line FROM (SELECT file, string_split(text, chr(10)) AS s FROM f), unnest(range(1, len(s) + 1)) AS u(i))"
#: Its imports, and those that resolve to a file.
IMPORTS = f"""{L}, js AS (SELECT * FROM l WHERE regexp_matches(file, '\\.(ts|tsx|js|jsx|mjs|cjs)$')),
imp AS (SELECT file AS source, regexp_extract(line, '(?:import|export)\\b.*\\bfrom\\s+[''"]([^''"]+)[''"]', 1) AS target, line_no FROM js WHERE regexp_matches(line, '(?:import|export)\\b.*\\bfrom\\s+[''"]([^''"]+)[''"]'))"""
RESOLVED = f"""{IMPORTS}, rel AS (SELECT *, CASE WHEN target LIKE '../%' THEN regexp_replace(regexp_replace(source, '/[^/]*$', ''), '/?[^/]*$', '') || '/' || substr(target, 4) ELSE regexp_replace(source, '/[^/]*$', '') || '/' || substr(target, 3) END AS base0 FROM imp WHERE target LIKE './%' OR target LIKE '../%'),
res AS (SELECT source, target, line_no, CASE WHEN ltrim(base0, '/') || '.ts' IN (SELECT file FROM f) THEN ltrim(base0, '/') || '.ts' END AS resolved FROM rel)"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(TREE, t=tables.table(spark, d, "customer"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark, d).select("file", "text")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return t.resolve_imports(t.imports(f), f)


def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return t.corpus(files(spark, d), ["ts"], ["vendor/**"], keep=400)


def tree_imports(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)


def definition_search(spark: SparkSession, d: str) -> DataFrame:
    return t.find_definition(files(spark, d), "handle7")


def usage_search(spark: SparkSession, d: str) -> DataFrame:
    return t.usages(files(spark, d), "read6")


def parameter_flow(spark: SparkSession, d: str) -> DataFrame:
    return t.parameter_flow(files(spark, d), "read6")


def usage_kinds(spark: SparkSession, d: str) -> DataFrame:
    ln = t.lines(files(spark, d)).select(t.usage_kind(F.col("line"), "my_value").alias("usage"), t.definition_kind(F.col("line"), "my_value").alias("definition"))
    return ln.filter("usage is not null or definition is not null").groupBy("usage", "definition").agg(F.count("*").alias("n"))


def tree_symbols(spark: SparkSession, d: str) -> DataFrame:
    return t.symbols(files(spark, d)).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def tree_complexity(spark: SparkSession, d: str) -> DataFrame:
    return t.complexity(files(spark, d))


def skeletons(spark: SparkSession, d: str) -> DataFrame:
    return t.skeleton(files(spark, d)).select("file", "n_lines", "n_kept", F.length("text").cast("long").alias("n_chars"))


def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return t.compression(f, t.skeleton(f))


def budgeted_context(spark: SparkSession, d: str) -> DataFrame:
    return t.concatenated(files(spark, d), 100).select("file", "tokens", "used", F.length("text").alias("n_chars"), "truncated")


def function_signatures(spark: SparkSession, d: str) -> DataFrame:
    return t.signatures(files(spark, d))


def syntax_check(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file", t.is_balanced(F.col("text")).alias("balanced"))


def file_orphans(spark: SparkSession, d: str) -> DataFrame:
    return rules.file_orphans(files(spark, d), resolved(spark, d), exclude=["vendor/**"])


def orphan_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.orphan_summary(files(spark, d), file_orphans(spark, d))


def file_coupling(spark: SparkSession, d: str) -> DataFrame:
    return rules.coupling(resolved(spark, d))


def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    layers = spark.createDataFrame([("m0", "m1", False), ("m1", "m2", True), ("m3", "m4", False)], "`from` string, `to` string, allow boolean")
    inner = lambda c: F.regexp_replace(c, "^src/", "").alias(c)
    imports = resolved(spark, d).filter("resolved is not null").select(inner("source"), F.regexp_replace("resolved", "^src/", "").alias("target"), "line_no")
    return rules.layer_violations(imports, layers)


def import_snapshot(spark: SparkSession, d: str) -> DataFrame:
    i = resolved(spark, d).filter("resolved is not null").select("source", F.col("resolved").alias("target"))
    return sinks.snapshot(i.select(F.regexp_replace("source", "^src/", "").alias("source"), F.regexp_replace("target", "^src/", "").alias("target")), layer_violations(spark, d), i.limit(0), i, "1", "now")


def module_metrics(spark: SparkSession, d: str) -> DataFrame:
    inner = lambda c, n: F.regexp_replace(c, "^src/", "").alias(n)
    return sinks.module_metrics(resolved(spark, d).filter("resolved is not null").select(inner("source", "source"), inner("resolved", "target")))


def package_usage(spark: SparkSession, d: str) -> DataFrame:
    return assist.package_usage(files(spark, d), "pkg3")


def learned_patterns(spark: SparkSession, d: str) -> DataFrame:
    return t.learn_patterns(files(spark, d), [("async_try_catch", r"async\s+function", 3), ("guard", r"if \(", 10_000), ("logging", r"console\.log", 100)])


def pattern_violations(spark: SparkSession, d: str) -> DataFrame:
    return t.pattern_violations(files(spark, d), learned_patterns(spark, d)).groupBy("pattern", "line_no").agg(F.count("*").alias("n"))


def code_components(spark: SparkSession, d: str) -> DataFrame:
    parts, deps = assist.code_components(files(spark, d), ["src", "vendor"])
    return parts.groupBy("module").agg(F.count("*").alias("n")).unionByName(deps.agg(F.lit("dependencies").alias("module"), F.count("*").alias("n")))


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("file")
    return files(spark, d).select("file", x.is_library(f).alias("library"), x.is_entry_point(f).alias("entry"), x.is_test(f).alias("test"), x.stem(f).alias("stem"), x.dirname(f).alias("folder"))


def tree_definitions_store(spark: SparkSession, d: str) -> DataFrame:
    """The named definitions of all files as nodes of the graph store."""
    return src.tree_nodes(src.definitions(files(spark, d))).select("id", "symbol", "kind", "line_start")


def import_expansion(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    anchors = f.select(F.col("file").alias("file_path"), F.length("text").alias("rank"))
    return graph.expand_imports(anchors, resolved(spark, d).filter("resolved is not null").select("source", F.col("resolved").alias("target")), 5, 1)


def name_rerank(spark: SparkSession, d: str) -> DataFrame:
    c = tree(spark, d).select(F.col("file").alias("file_path"), (F.col("k") % 1000).alias("mtime"))
    return r.rerank_by_name(c, "the spec index", 15).select("file_path", "rerank")


def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    return t.anomalies(files(spark, d)).groupBy("rule", "severity", "type").agg(F.count("*").alias("n"))


def _contract_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CONTRACTS, t=tables.table(spark, d, "supplier"))


CONTRACTS = """SELECT CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'api/p' || s_suppkey || '.proto' WHEN 1 THEN 'gql/g' || s_suppkey || '.graphql' WHEN 2 THEN 'd' || s_suppkey || '/openapi.json' ELSE 'e' || s_suppkey || '/openapi.yaml' END AS file,
CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'message M' || s_suppkey || ' {{}}' || chr(10) || 'service S' || s_suppkey || ' {{'
WHEN 1 THEN 'type T' || s_suppkey || ' {{' || chr(10) || '}}' || chr(10) || 'query q' || s_suppkey
WHEN 2 THEN '{{"paths": {{"/n/' || s_suppkey || '": {{"get": {{}}, "post": {{}}}}}}, "components": {{"schemas": {{"N' || s_suppkey || '": {{}}}}}}}}'
ELSE 'paths:' || chr(10) || '  /y/' || s_suppkey || ':' || chr(10) || '    get:' || chr(10) || '    delete:' || chr(10) || 'components:' || chr(10) || '  schemas:' || chr(10) || '    Y' || s_suppkey || ':' END AS text FROM {t}"""
_CON = f"""con AS ({CONTRACTS.format(t='supplier')}), sym AS (SELECT file, unnest(CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN ['M' || s_suppkey, 'S' || s_suppkey] WHEN 1 THEN ['T' || s_suppkey, 'q' || s_suppkey]
WHEN 2 THEN ['GET /n/' || s_suppkey, 'POST /n/' || s_suppkey, 'N' || s_suppkey] ELSE ['DELETE /y/' || s_suppkey, 'GET /y/' || s_suppkey, 'Y' || s_suppkey] END) AS symbol,
CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'proto' WHEN 1 THEN 'graphql' ELSE 'openapi' END AS type FROM con JOIN supplier ON regexp_extract(file, '(\\d+)', 1) = CAST(s_suppkey AS VARCHAR))"""


def openapi_json(spark: SparkSession, d: str) -> DataFrame:
    return t.openapi_json(_contract_files(spark, d).filter("file like '%.json'"))


def openapi_yaml(spark: SparkSession, d: str) -> DataFrame:
    return t.openapi_yaml(_contract_files(spark, d).filter("file like '%.yaml'"))


def _federation(spark: SparkSession, d: str) -> DataFrame:
    return src.contracts(_contract_files(spark, d), "suppliers")


def contract_index(spark: SparkSession, d: str) -> DataFrame:
    c = _federation(spark, d).select(F.explode("contracts").alias("c"))
    return c.select("c.path", "c.type", F.array_join("c.symbols", ",").alias("symbols"), "c.hash")


def contract_listing(spark: SparkSession, d: str) -> DataFrame:
    return scoring.list_contracts(_federation(spark, d), "suppliers")


def contract_search(spark: SparkSession, d: str) -> DataFrame:
    return scoring.search_contracts(_federation(spark, d), "GET /n/1")


def federation_totals(spark: SparkSession, d: str) -> DataFrame:
    both = src.update_index(_federation(spark, d), src.contracts(_contract_files(spark, d).filter("file like 'api/%'"), "protos"))
    return scoring.federation_totals(src.update_index(both, _federation(spark, d)))


def virtual_edge_search(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' symbols against those of a federation, and the edges that name one of them, the surest first."""
    local = tables.table(spark, d, "supplier").select(F.lit("app").alias("repo"), F.concat(F.lit("fetchM"), "s_suppkey").alias("symbol"))
    remote = _contract_files(spark, d).filter("file like 'api/%'").select(F.lit("svc").alias("repo"), F.concat(F.lit("getM"), F.regexp_extract("file", r"(\d+)", 1)).alias("symbol"), F.lit("proto").alias("contract_type"))
    return scoring.search_edges(scoring.virtual_edges(local, remote, 0.55), "m1", 0.55).select("source_symbol", "target_symbol", "confidence")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RECORDS, t=tables.table(spark, d, "supplier"))


RECORDS = """SELECT 'docs/adr/' || s_suppkey || '-choice.md' AS file, '# ADR-' || s_suppkey || ': Choose store ' || s_suppkey || chr(10) || chr(10) || '## Status' || chr(10)
|| CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'Accepted' WHEN 1 THEN 'proposed, see below' ELSE '' END || chr(10) || '## Context' || chr(10)
|| 'We use `supplier_' || s_suppkey || '` and GraphStore with MAX_DEPTH' || (s_suppkey % 4) || ' in src/m' || (s_suppkey % 7) || '/f.ts.' || chr(10)
|| '## Container Inventory' || chr(10) || '| Name | Tech |' || chr(10) || '| --- | --- |' || chr(10) || '| box' || s_suppkey || ' | spark |' || chr(10)
|| '## Dependencies' || chr(10) || '| Component | Needs |' || chr(10) || '|---|---|' || chr(10) || '| box' || s_suppkey || ' | db' || (s_suppkey % 5) || ', none; bus |' || chr(10)
|| '## Profile' || chr(10) || '- Language: Scala ' || (s_suppkey % 3) || chr(10) || '**Build**: sbt' AS text FROM {t}"""


def record_statuses(spark: SparkSession, d: str) -> DataFrame:
    return assist.record_status_counts(t.decision_records(_markdown(spark, d)))


def record_table(spark: SparkSession, d: str) -> DataFrame:
    return t.decision_records(_markdown(spark, d)).select("file", "id", "title", "status", "context")


def record_folder(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(src.record_folder(_markdown(spark, d).unionByName(files(spark, d))),)], "folder string")


def record_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("file", F.explode(t.record_keywords(F.regexp_extract("text", "(We use [^\n]*)", 1))).alias("keyword"))


def record_links(spark: SparkSession, d: str) -> DataFrame:
    """Records linked to the nodes that their keywords name, ten for each keyword, besides the links there are."""
    k = record_keywords(spark, d).select(F.col("file").alias("record"), "keyword").unionByName(tables.table(spark, d, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("record"), F.lit("nation_1").alias("keyword")))
    have = spark.createDataFrame([("region/1", "N:1", "ADR_RELATED")], "source_id string, target_id string, edge_type string")
    return t.link_keywords(k, tables.nodes(spark, d), have)


def component_table(spark: SparkSession, d: str) -> DataFrame:
    return t.c4_components(_markdown(spark, d)).select("file", "c0", "c1")


def dependency_table(spark: SparkSession, d: str) -> DataFrame:
    return t.c4_dependencies(_markdown(spark, d))


def profile_values(spark: SparkSession, d: str) -> DataFrame:
    return t.section_values(_markdown(spark, d).select("file", F.regexp_extract("text", "(?s)(## Profile.*)", 1).alias("text")))


def old_audit(spark: SparkSession, d: str) -> DataFrame:
    """Advisories of the older layout, one document for each supplier."""
    key = F.col("s_suppkey").cast("string")
    severity = F.element_at(F.array(*map(F.lit, x.SEVERITIES)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit('{"advisories": {"'), key, F.lit('": {"module_name": "pkg'), key, F.lit('", "severity": "'), severity, F.lit('", "title": "T'), key, F.lit('", "patched_versions": "'), F.when(F.col("s_suppkey") % 2 == 0, "<0.0.0").otherwise(">=2"), F.lit('"}}}'))
    return rules.vulnerabilities(tables.table(spark, d, "supplier").select(text.alias("text")), "moderate")


INDEX = """SELECT array(named_struct('relativePath', 'src/f' || k || '.ts', 'text', '',
'symbols', array(named_struct('symbol', 'pkg f' || k || '#', 'displayName', CASE WHEN k % 2 = 0 THEN 'F' || k ELSE '' END, 'relationships', array(named_struct('symbol', 'pkg f' || (k % 10) || '#', 'isImplementation', k % 3 = 0, 'isTypeDefinition', k % 3 = 1, 'isDefinition', false, 'isReference', true)))),
'occurrences', array(named_struct('range', array(CAST(k AS INT), 1, 2), 'symbol', 'pkg f' || k || '#', 'symbolRoles', CAST(k % 8 AS INT)), named_struct('range', array(7), 'symbol', 'pkg g().' || (k % 10), 'symbolRoles', CAST(NULL AS INT))))) AS documents
FROM (SELECT s_suppkey AS k FROM {t})"""


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A symbol index with a document for each supplier, written as JSON and read back."""
    path = f"{shared_root(spark)}/symbol-index-{spark.sparkContext.applicationId}-{id(spark.sql) % 10**9}"
    spark.sql(INDEX, t=tables.table(spark, d, "supplier")).write.mode("overwrite").json(path)
    return src.symbol_index(spark.read.schema(src.SYMBOL_INDEX).json(path))


def _binary_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same index as messages, each of one document, read as such."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"content": [wire.encode(json.loads(x), "Index") for x in pdf["json"]]})

    rows = spark.sql(INDEX, t=tables.table(spark, d, "supplier")).select(F.to_json(F.struct("documents")).alias("json"))
    return src.symbol_index(wire.decoded_indexes(rows.mapInPandas(run, "content binary"), src.SYMBOL_INDEX))


def binary_index_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _binary_index(spark, d)[0]


def binary_index_edges(spark: SparkSession, d: str) -> DataFrame:
    return _binary_index(spark, d)[1].select("source_id", "target_id", "edge_type", "line")


def index_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[0]


def index_edges(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[1].select("source_id", "target_id", "edge_type", "line")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return src.symbol_index_stats(*_index(spark, d))


QUERIES = {f.__name__: f for f in (corpus_scan, tree_imports, definition_search, usage_search, parameter_flow, usage_kinds, tree_symbols, tree_complexity, skeletons, compression_ratio, budgeted_context, function_signatures, syntax_check, file_orphans, orphan_summary, file_coupling, layer_violations, import_snapshot, module_metrics, package_usage, learned_patterns, pattern_violations, code_components, path_classes, tree_definitions_store, import_expansion, name_rerank, unused_imports, openapi_json, openapi_yaml, contract_index, contract_listing, contract_search, federation_totals, virtual_edge_search, record_statuses, record_table, record_folder, record_keywords, record_links, component_table, dependency_table, profile_values, old_audit, index_nodes, index_edges, index_stats, binary_index_nodes, binary_index_edges)}

_ORPHANS = f"{RESOLVED}, own AS (SELECT file FROM f WHERE NOT regexp_matches(split_part(file, '/', -1), '^(main|index|entry|app|server)\\.') AND NOT regexp_matches(file, 'test|spec|mock|fixture') AND file NOT LIKE 'vendor/%'), orp AS (SELECT file FROM own WHERE file NOT IN (SELECT resolved FROM res WHERE resolved IS NOT NULL))"
_LAYER = f"{RESOLVED}, inn AS (SELECT regexp_replace(source, '^src/', '') AS source, regexp_replace(resolved, '^src/', '') AS target, line_no FROM res WHERE resolved IS NOT NULL), bad AS (SELECT * FROM inn WHERE (split_part(source, '/', 1), split_part(target, '/', 1)) IN (('m0', 'm1'), ('m3', 'm4')))"
_SKEL = """sk AS (SELECT file, k, k % 9 + 14 + CAST(k % 11 = 0 AS BIGINT) * 0 AS n_lines, k % 9 AS r, text FROM f),
sk2 AS (SELECT file, text, n_lines, CASE WHEN r + 2 > 5 THEN n_lines - (r + 2 - 5) + 1 ELSE n_lines END AS n_kept, r, k FROM sk)"""
_PAT = f"""{L}, hit AS (SELECT 'async_try_catch' AS pattern, 3 AS least, file, line_no FROM l WHERE regexp_matches(line, 'async\\s+function') UNION ALL SELECT 'guard', 10000, file, line_no FROM l WHERE regexp_matches(line, 'if \\(') UNION ALL SELECT 'logging', 100, file, line_no FROM l WHERE regexp_matches(line, 'console\\.log')),
pat AS (SELECT pattern, count(*) AS occurrences, array_to_string(list(file || ':' || line_no ORDER BY file, line_no)[1:3], ', ') AS examples, CASE WHEN count(*) >= any_value(least) THEN least(CAST(1 AS DOUBLE), count(*) / (3 * any_value(least))) ELSE count(*) / any_value(least) END AS confidence FROM hit GROUP BY pattern)"""
_MD = f"md AS (SELECT s_suppkey AS k, r.* FROM ({RECORDS.format(t='supplier')}) r JOIN supplier ON file = 'docs/adr/' || s_suppkey || '-choice.md')"
_REC = f"{_MD}, rec AS (SELECT file, CAST(k AS VARCHAR) AS id, 'Choose store ' || k AS title, CASE CAST(k % 3 AS INT) WHEN 0 THEN 'Accepted' WHEN 1 THEN 'proposed, see below' ELSE '' END AS status, 'We use `supplier_' || k || '` and GraphStore with MAX_DEPTH' || (k % 4) || ' in src/m' || (k % 7) || '/f.ts.' AS context FROM md)"
_KEY = f"{_MD}, key AS (SELECT file, unnest(['supplier_' || k, 'GraphStore', 'MAX_DEPTH' || (k % 4), 'src/m' || (k % 7) || '/f.ts', 'f.ts']) AS keyword FROM md)"
_IX = """ix AS (SELECT s_suppkey AS k, 'src/f' || s_suppkey || '.ts' AS path FROM supplier),
inodes AS (SELECT 'pkg f' || k || '#' AS id, CASE WHEN k % 2 = 0 THEN 'F' || k ELSE 'pkg f' || k || '#' END AS symbol, 'class' AS kind, path AS file_path FROM ix UNION ALL SELECT 'file:' || path, path, 'file', path FROM ix),
iedges AS (SELECT 'pkg f' || k || '#' AS source_id, 'pkg f' || (k % 10) || '#' AS target_id, CASE k % 3 WHEN 0 THEN 'IMPLEMENTS' WHEN 1 THEN 'EXTENDS' ELSE 'CALLS' END AS edge_type, CAST(NULL AS INT) AS line FROM ix
UNION ALL SELECT 'file:' || path, 'pkg f' || k || '#', CASE WHEN k & 1 <> 0 THEN 'DEFINES' WHEN k & 2 <> 0 THEN 'IMPORTS' WHEN k & 4 <> 0 THEN 'MODIFIES' ELSE 'CALLS' END, CAST(k AS INT) FROM ix
UNION ALL SELECT 'file:' || path, 'pkg g().' || (k % 10), 'CALLS', CAST(7 AS INT) FROM ix)"""
SQL = {
    "corpus_scan": f"SELECT file, substr(replace(text, chr(10), ' '), 1, 400) AS text, length(text) > 400 AS cut FROM ({T}) WHERE file LIKE '%.ts' AND file NOT LIKE 'vendor/%'",
    "tree_imports": f"WITH {RESOLVED} SELECT * FROM res",
    "definition_search": f"WITH {L} SELECT * FROM l WHERE regexp_matches(line, '(function|def|class|const|let|var|interface|type|enum)\\s+handle7\\b') ORDER BY file, line_no LIMIT 1",
    "usage_search": f"WITH {L} SELECT * FROM l WHERE regexp_matches(line, '\\bread6\\s*\\(') ORDER BY file, line_no LIMIT 10",
    "parameter_flow": f"WITH {L} SELECT file, line_no, regexp_extract(line, '\\bread6\\s*\\(([^)]*)\\)', 1) AS arguments FROM l WHERE regexp_matches(line, '\\bread6\\s*\\([^)]+\\)') AND NOT regexp_matches(line, '(function|def)\\s+read6\\b')",
    "usage_kinds": f"""WITH {L}, u AS (SELECT CASE WHEN regexp_matches(line, '\\bmy_value\\s*\\(') THEN 'function_call' WHEN regexp_matches(line, '\\breturn\\b.*\\bmy_value\\b') THEN 'return_value' WHEN regexp_matches(line, '=\\s*[^=].*\\bmy_value\\b|=\\s*my_value\\b') THEN 'assignment' WHEN regexp_matches(line, '\\(.*\\bmy_value\\b.*\\)') THEN 'parameter_pass' END AS usage,
CASE WHEN regexp_matches(line, '(const|let|var)\\s+my_value\\b') THEN 'variable' END AS definition FROM l) SELECT usage, definition, count(*) AS n FROM u WHERE usage IS NOT NULL OR definition IS NOT NULL GROUP BY ALL""",
    "tree_symbols": f"""WITH {L}, js AS (SELECT * FROM l), s AS (SELECT 'DEFINES' AS edge_type, regexp_extract(line, '(?:export\\s+)?(?:async\\s+)?function\\s+(\\w+)', 1) AS name FROM js UNION ALL SELECT 'DEFINES', regexp_extract(line, '(?:export\\s+)?(?:abstract\\s+)?class\\s+(\\w+)', 1) FROM js
UNION ALL SELECT 'IMPORTS', regexp_extract(line, 'import\\b.*from\\s+[''"]([^''"]+)[''"]', 1) FROM js UNION ALL SELECT 'IMPLEMENTS', regexp_extract(line, 'class\\s+\\w+.*\\bimplements\\s+(\\w+)', 1) FROM js UNION ALL SELECT 'EXTENDS', regexp_extract(line, 'class\\s+\\w+\\s+extends\\s+(\\w+)', 1) FROM js)
SELECT edge_type, count(*) AS n, count(DISTINCT name) AS names FROM s WHERE name <> '' GROUP BY 1""",
    "tree_complexity": f"""WITH f AS ({T}) SELECT file, unnest(['load' || k, 'handle' || (k % 20)]) AS function, unnest([CAST(1 AS BIGINT), CAST(3 AS BIGINT)]) AS complexity FROM f""",
    "skeletons": f"WITH f AS ({T}), {_SKEL} SELECT file, n_lines, n_kept, CAST(length(text) - CASE WHEN r + 2 > 5 THEN length(array_to_string(string_split(text, chr(10))[11:r + 7], chr(10))) - 8 ELSE 0 END AS BIGINT) AS n_chars FROM sk2",
    "compression_ratio": f"WITH f AS ({T}), {_SKEL}, c AS (SELECT sum(length(text)) AS before, sum(length(text) - CASE WHEN r + 2 > 5 THEN length(array_to_string(string_split(text, chr(10))[11:r + 7], chr(10))) - 8 ELSE 0 END) AS after FROM sk2) SELECT CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, round(after / before, 4) AS ratio FROM c",
    "budgeted_context": f"""WITH f AS ({T}), n AS (SELECT file, text, CAST(14 + k % 9 AS BIGINT) AS tokens FROM f), u AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM n)
SELECT file, tokens, used, CAST(length(array_to_string(string_split(text, chr(10))[1:CASE WHEN used > 100 THEN 100 - used + tokens ELSE tokens END], chr(10))) AS INT) AS n_chars, used > 100 AS truncated FROM u WHERE used - tokens < 100""",
    "function_signatures": f"""WITH {L} SELECT file, line_no, regexp_extract(line, 'function\\s+(\\w+)\\(', 1) AS name, trim(line) AS signature FROM l WHERE regexp_matches(line, 'function\\s+\\w+\\(')""",
    "syntax_check": f"SELECT file, k % 11 <> 0 AS balanced FROM ({T})",
    "file_orphans": f"WITH {_ORPHANS} SELECT * FROM orp",
    "orphan_summary": f"WITH {_ORPHANS} SELECT (SELECT count(*) FROM f) AS total, count(*) AS orphans, round(count(*) / (SELECT count(*) FROM f), 4) AS ratio FROM orp",
    "file_coupling": f"WITH {RESOLVED} SELECT resolved AS file, count(DISTINCT source) AS coupling FROM res WHERE resolved IS NOT NULL GROUP BY 1",
    "layer_violations": f"WITH {_LAYER} SELECT * FROM bad",
    "import_snapshot": f"WITH {_LAYER} SELECT 'now' AS timestamp, '1' AS version, count(DISTINCT split_part(source, '/', 1)) AS modules, count(*) AS total_coupling, round(avg(CASE WHEN split_part(source, '/', 1) = split_part(target, '/', 1) THEN 1 ELSE 0 END), 4) AS boundary_clarity, (SELECT count(*) FROM bad) AS dependency_violations, CAST(0 AS BIGINT) AS cyclic_dependencies FROM inn",
    "module_metrics": f"WITH {_LAYER}, a AS (SELECT split_part(source, '/', 1) AS s, split_part(target, '/', 1) AS t FROM inn), o AS (SELECT s AS module, count(*) AS n FROM a WHERE s <> t GROUP BY 1), i AS (SELECT t AS module, count(*) AS n FROM a WHERE s <> t GROUP BY 1) SELECT module, coalesce(o.n, 0) AS coupling_out, coalesce(i.n, 0) AS coupling_in FROM o FULL JOIN i USING (module)",
    "package_usage": f"WITH {IMPORTS} SELECT source AS file, line_no FROM imp WHERE target = 'pkg3' OR target LIKE 'pkg3/%'",
    "learned_patterns": f"WITH {_PAT} SELECT pattern, occurrences, examples, confidence FROM pat",
    "pattern_violations": f"WITH {_PAT} SELECT 'async_try_catch' AS pattern, line_no, count(*) AS n FROM l WHERE regexp_matches(line, 'async\\s+function') AND (SELECT confidence FROM pat WHERE pattern = 'async_try_catch') >= 0.85 GROUP BY line_no",
    "code_components": f"WITH {IMPORTS} SELECT split_part(file, '/', 1) AS module, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT 'dependencies', count(*) FROM (SELECT DISTINCT source, target FROM imp)",
    "path_classes": f"SELECT file, file LIKE 'vendor/%' AS library, file LIKE '%/index.ts' AS entry, file LIKE '%spec%' AS test, regexp_replace(split_part(file, '/', -1), '\\.[^.]*$', '') AS stem, regexp_replace(file, '/[^/]*$', '') AS folder FROM ({T})",
    "tree_definitions_store": f"""WITH f AS ({T}), dd AS (SELECT file, unnest(['class', 'function', 'variable', 'function']) AS kind, unnest(['C' || k, 'load' || k, 'my_value', 'handle' || (k % 20)]) AS symbol, unnest([4, 5, 6, 9 + k % 9]) AS line_start FROM f)
SELECT file || ':' || kind || ':' || line_start AS id, symbol, kind, CAST(line_start AS INT) AS line_start FROM dd""",
    "import_expansion": f"WITH {RESOLVED}, a AS (SELECT file FROM f ORDER BY length(text), file LIMIT 5) SELECT min(resolved) AS file_path, source AS anchor FROM res JOIN a ON a.file = source WHERE resolved IS NOT NULL GROUP BY source",
    "name_rerank": f"""WITH f AS ({T}), o AS (SELECT file, CAST(regexp_matches(lower(split_part(file, '/', -1)), 'the|spec|index') AS INT) AS m, len(string_split(file, '/')) AS depth, k % 1000 AS mtime FROM f)
SELECT file AS file_path, CAST(row_number() OVER (ORDER BY m DESC, depth, mtime DESC, file) AS INT) AS rerank FROM o ORDER BY rerank LIMIT 15""",
    "unused_imports": f"""WITH f AS ({T}) SELECT rule, severity, type, n FROM (
SELECT 'unhandled_await' AS rule, 'warning' AS severity, 'missing_error_handler' AS type, count(*) AS n FROM f UNION ALL SELECT 'bare_fetch', 'warning', 'missing_error_handler', count(*) FROM f UNION ALL SELECT 'console_use', 'info', 'inconsistent_api_call', count(*) FROM f
UNION ALL SELECT 'snake_variable', 'info', 'naming_violation', count(*) FROM f UNION ALL SELECT 'unused_import', 'info', 'unused_import', 3 * count(*) FROM f) WHERE n > 0""",
    "openapi_json": f"WITH {_CON} SELECT file, symbol FROM sym WHERE file LIKE '%.json'",
    "openapi_yaml": f"WITH {_CON} SELECT file, symbol FROM sym WHERE file LIKE '%.yaml'",
    "contract_index": f"WITH {_CON} SELECT file AS path, any_value(type) AS type, string_agg(symbol, ',' ORDER BY symbol) AS symbols, md5(any_value(con.text)) AS hash FROM sym JOIN con USING (file) GROUP BY file",
    "contract_listing": f"WITH {_CON} SELECT 'suppliers' AS repo, file AS path, type, CAST(count(*) AS INT) AS n_symbols FROM sym GROUP BY ALL",
    "contract_search": f"WITH {_CON} SELECT 'suppliers' AS repo, file AS path, type, symbol FROM sym WHERE contains(lower(symbol), 'get /n/1')",
    "federation_totals": f"WITH {_CON} SELECT CAST(2 AS BIGINT) AS repositories, (SELECT count(*) FROM con) + (SELECT count(*) FROM con WHERE file LIKE 'api/%') AS contracts, (SELECT count(*) FROM sym) + (SELECT count(*) FROM sym WHERE type = 'proto') AS symbols",
    "virtual_edge_search": """WITH a AS (SELECT 'm' || s_suppkey AS b, s_suppkey FROM supplier), g AS (SELECT 'm' || s_suppkey AS b, s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)
SELECT 'fetchM' || a.s_suppkey AS source_symbol, 'getM' || g.s_suppkey AS target_symbol, round(CAST(0.6 AS DOUBLE) * 0.7 + CAST(0.3 AS DOUBLE) * 0.6 + CAST(0.1 AS DOUBLE) * 0.1, 4) AS confidence
FROM a JOIN g ON starts_with(a.b, g.b) OR starts_with(g.b, a.b) WHERE contains('fetch' || a.b, 'm1') OR contains('get' || g.b, 'm1')""",
    "record_statuses": f"WITH {_REC} SELECT CASE WHEN status = '' THEN 'unknown' ELSE lower(regexp_extract(status, '([A-Za-z]+)', 1)) END AS status, count(*) AS n FROM rec GROUP BY 1",
    "record_table": f"WITH {_REC} SELECT * FROM rec",
    "record_folder": "SELECT 'docs/adr' AS folder",
    "record_keywords": f"WITH {_KEY} SELECT * FROM key",
    "record_links": f"""WITH {_KEY}, n AS ({tables.NODES_SQL}), k AS (SELECT file AS record, keyword FROM key UNION SELECT 'region/' || r_regionkey, 'nation_1' FROM region),
m AS (SELECT record, keyword, id, CASE WHEN symbol = keyword THEN 0 ELSE 1 END AS o FROM k JOIN n ON contains(symbol, keyword) OR contains(file_path, keyword)),
q AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY record, keyword ORDER BY o, id) <= 10)
SELECT DISTINCT record AS source_id, id AS target_id, 'ADR_RELATED' AS edge_type FROM q WHERE NOT (record = 'region/1' AND id = 'N:1')""",
    "component_table": f"WITH {_MD} SELECT file, 'box' || k AS c0, 'spark' AS c1 FROM md",
    "dependency_table": f"WITH {_MD} SELECT 'box' || k AS component, unnest(['db' || (k % 5), 'bus']) AS dependency FROM md",
    "profile_values": f"WITH {_MD} SELECT file, 'Profile' AS section, unnest(['Language', 'Build']) AS key, unnest(['Scala ' || (k % 3), 'sbt']) AS value FROM md",
    "old_audit": "SELECT 'pkg' || s_suppkey AS package, ['low', 'moderate', 'high', 'critical'][s_suppkey % 4 + 1] AS severity, 'T' || s_suppkey AS title, s_suppkey % 2 = 1 AS fixable FROM supplier WHERE s_suppkey % 4 > 0",
    "index_nodes": f"WITH {_IX} SELECT * FROM inodes",
    "binary_index_nodes": f"WITH {_IX} SELECT * FROM inodes",
    "binary_index_edges": f"WITH {_IX} SELECT DISTINCT source_id, target_id, edge_type, line FROM iedges",
    "index_edges": f"WITH {_IX} SELECT DISTINCT source_id, target_id, edge_type, line FROM iedges",
    "index_stats": f"WITH {_IX} SELECT (SELECT count(*) FROM ix) AS documents, (SELECT count(*) FROM ix) AS symbols, count(*) AS edges, " + ", ".join(f"count(*) FILTER (edge_type = '{e}') AS {e.lower()}" for e in ("DEFINES", "IMPORTS", "CALLS", "MODIFIES", "IMPLEMENTS", "EXTENDS")) + " FROM (SELECT DISTINCT source_id, target_id, edge_type FROM iedges)",
}
