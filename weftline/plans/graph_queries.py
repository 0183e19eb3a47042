"""Registered queries of the graph operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.operators import store
from weftline.schemas import EDGE_TYPES
from weftline.sources import tables as t

N, E = t.NODES_SQL, t.EDGES_SQL
TR = t.TRANSITIONS_SQL.format(where="")
REACH = """r(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT {far}, depth + 1 FROM r JOIN e ON e.{near} = r.id WHERE depth < {most})"""
IMPACT = "SELECT n.id, n.symbol, n.file_path, CAST(d.depth AS INT) AS depth, round(pow(0.8, d.depth), 3) AS confidence FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0) d JOIN n ON n.id = d.id"


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.stats(t.nodes(spark, d), t.edges(spark, d))


def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    return g.orphans(t.nodes(spark, d), t.edges(spark, d), exclude="order/1")


def page_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = t.table(spark, d, "pages")
    nodes = pages.select(F.col("url").alias("id")).distinct()
    edges = pages.select(F.col("url").alias("source_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target_id")).distinct()
    return nodes, edges


def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    return g.dangling(*page_links(spark, d))


def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return g.query_edges(g.edge_types(t.edges(spark, d), ["IMPORTS", "DEFINES"]), target="N:3")


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return t.nodes(spark, d).filter(F.col("id") == "C:7")


def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return t.nodes(spark, d).filter(F.col("file_path") == "customer/1").select("id", "symbol", "kind")


def upstream_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbours(t.nodes(spark, d), t.edges(spark, d), "C:7", upstream=True)


def downstream_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbours(t.nodes(spark, d), t.edges(spark, d), "O:7")


def closure(spark: SparkSession, d: str) -> DataFrame:
    return g.closure(t.edges(spark, d))


def closure_cyclic(spark: SparkSession, d: str) -> DataFrame:
    return g.closure(t.transitions(spark, d))


def closure_increment(spark: SparkSession, d: str) -> DataFrame:
    return g.extend_closure(g.closure(t.edges(spark, d).filter("edge_type in ('IMPORTS', 'DEFINES')")), "R:1", "W:0")


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    found = g.shortest_path(t.edges(spark, d), "O:1", [f"R:{k}" for k in range(5)])
    return found.select(F.array_join("path", ">").alias("path"), F.array_join("edge_types", ",").alias("edge_types"), "length")


def typed_path(spark: SparkSession, d: str) -> DataFrame:
    """From a customer to the regions by imports and definitions, and from an order, whose edge to its customer is a call: no path."""
    e, regions, types = t.edges(spark, d), [f"R:{k}" for k in range(5)], ["IMPORTS", "DEFINES"]
    found = g.shortest_path(e, "C:1", regions, types=types).unionByName(g.shortest_path(e, "O:1", regions, types=types))
    return found.select(F.array_join("path", ">").alias("path"), "length")


def impact_forward(spark: SparkSession, d: str) -> DataFrame:
    nodes = t.nodes(spark, d)
    return g.impact(nodes, t.edges(spark, d), nodes.filter("file_path = 'order/0'").select("id"), types=None)


def impact_reverse(spark: SparkSession, d: str) -> DataFrame:
    nodes = t.nodes(spark, d)
    return g.impact(nodes, t.edges(spark, d), nodes.filter("id = 'R:1'").select("id"), types=None, upstream=True)


def impact_file(spark: SparkSession, d: str) -> DataFrame:
    return g.file_impact(t.nodes(spark, d), t.edges(spark, d), "customer/0")


def cycles(spark: SparkSession, d: str) -> DataFrame:
    return g.cycles(t.transitions(spark, d)).select(F.array_join("cycle", ">").alias("cycle"), "length")


def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.cycle_nodes(t.transitions(spark, d))


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return g.strong_components(t.transitions(spark, d))


def dependency_lists(spark: SparkSession, d: str) -> DataFrame:
    return g.dependency_lists(t.edges(spark, d)).withColumn("targets", F.array_join("targets", ","))


def module_graph(spark: SparkSession, d: str) -> DataFrame:
    return g.module_graph(t.nodes(spark, d), t.edges(spark, d))


def file_graph(spark: SparkSession, d: str) -> DataFrame:
    e = t.edges(spark, d)
    up = e.filter("edge_type = 'DEFINES'").unionByName(e.filter("target_id like 'N:%'"))
    return g.file_graph(t.nodes(spark, d).withColumn("file_path", F.concat(F.lit("geo/"), "file_path")), up, "geo/")


def dependency_trace(spark: SparkSession, d: str) -> DataFrame:
    roots = t.nodes(spark, d).filter("file_path = 'supplier/0'").select("id")
    return g.dependency_trace(t.edges(spark, d), roots, "R:2").select(F.array_join("path", ">").alias("path"), "length")


def diagram(spark: SparkSession, d: str) -> DataFrame:
    return g.mermaid(module_graph(spark, d))


def call_chain(spark: SparkSession, d: str) -> DataFrame:
    return g.call_chain(t.transitions(spark, d), "view")


def last_call_path(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events")
    calls = e.select(F.col("event_type").alias("caller"), F.element_at(F.split(F.lit("error,purchase,signup,view,done"), ","), (F.col("event_id") % 5 + 1).cast("int")).alias("callee"), F.col("event_id").alias("position"))
    return g.last_call_path(calls, "click")


def edge_ids(spark: SparkSession, d: str) -> DataFrame:
    return t.edges(spark, d).filter("edge_type = 'IMPORTS'").select(store.edge_id().alias("id"), "source_id", "target_id")


def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """The nation edges, with one line number changed and one edge more."""
    old = t.edges(spark, d).filter("edge_type = 'DEFINES'").withColumn("id", store.edge_id()).withColumns({"file_path": F.lit(None).cast("string"), "line": F.lit(1), "created_at": F.lit(0).cast("long")})
    new = old.filter("source_id = 'N:3'").drop("id").withColumn("line", F.lit(9)).unionByName(spark.createDataFrame([("N:3", "R:9", "DEFINES", None, 5, 0)], "source_id string, target_id string, edge_type string, file_path string, line int, created_at long").select("source_id", "target_id", "edge_type", "file_path", "line", "created_at"))
    return store.upsert_edges(old, new).select("id", "source_id", "target_id", "edge_type", "line")


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = store.delete_nodes(t.nodes(spark, d), t.edges(spark, d), t.nodes(spark, d).filter("id in ('N:3', 'C:1')").select("id"))
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))


QUERIES = {f.__name__: f for f in (graph_stats, graph_orphans, graph_dangling, edge_filter, node_lookup, file_symbols, upstream_neighbours, downstream_neighbours, closure, closure_cyclic, closure_increment, shortest_paths, typed_path, impact_forward, impact_reverse, impact_file, cycles, cycle_nodes, strong_components, dependency_lists, module_graph, file_graph, dependency_trace, diagram, call_chain, last_call_path, edge_ids, upsert_edges, delete_cascade)}

_CLOSURE = "c(source_id, target_id, depth) AS (SELECT DISTINCT source_id, target_id, 1 FROM e UNION SELECT c.source_id, e.target_id, depth + 1 FROM c JOIN e ON c.target_id = e.source_id WHERE depth < {most})"
_LEAST = "SELECT source_id, target_id, CAST(min(depth) AS INT) AS depth FROM c GROUP BY ALL"
SQL = {
    "graph_stats": f"WITH n AS ({N}), e AS ({E}) SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, " + ", ".join(f"count(*) FILTER (edge_type = '{x}') AS {x.lower()}" for x in EDGE_TYPES) + " FROM e",
    "graph_orphans": f"WITH n AS ({N}), e AS ({E}) SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.target_id = n.id) AND NOT contains(file_path, 'order/1')",
    "graph_dangling": """WITH e AS (SELECT DISTINCT url AS source_id, target_id FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target_id FROM pages))
SELECT source_id, target_id, CASE WHEN source_id NOT IN (SELECT url FROM pages) AND target_id NOT IN (SELECT url FROM pages) THEN 'both' WHEN source_id NOT IN (SELECT url FROM pages) THEN 'source' ELSE 'target' END AS missing
FROM e WHERE source_id NOT IN (SELECT url FROM pages) OR target_id NOT IN (SELECT url FROM pages)""",
    "edge_filter": f"SELECT * FROM ({E}) WHERE edge_type IN ('IMPORTS', 'DEFINES') AND target_id = 'N:3'",
    "node_lookup": f"SELECT * FROM ({N}) WHERE id = 'C:7'",
    "file_symbols": f"SELECT id, symbol, kind FROM ({N}) WHERE file_path = 'customer/1'",
    "upstream_neighbours": f"WITH n AS ({N}), e AS ({E}) SELECT * FROM n WHERE id IN (SELECT source_id FROM e WHERE target_id = 'C:7' AND edge_type = 'CALLS')",
    "downstream_neighbours": f"WITH n AS ({N}), e AS ({E}) SELECT * FROM n WHERE id IN (SELECT target_id FROM e WHERE source_id = 'O:7' AND edge_type = 'CALLS')",
    "closure": f"WITH RECURSIVE e AS ({E}), {_CLOSURE.format(most=5)} {_LEAST}",
    "closure_cyclic": f"WITH RECURSIVE e AS ({TR}), {_CLOSURE.format(most=5)} {_LEAST}",
    "closure_increment": f"WITH RECURSIVE e AS (SELECT * FROM ({E}) WHERE edge_type IN ('IMPORTS', 'DEFINES') UNION ALL SELECT 'R:1', 'W:0', 'IMPORTS'), {_CLOSURE.format(most=5)} {_LEAST}",
    "shortest_paths": f"""WITH RECURSIVE e AS ({E}), p(id, path, types, length) AS (SELECT 'O:1', 'O:1', '', 0
UNION ALL SELECT e.target_id, path || '>' || e.target_id, types || CASE WHEN types = '' THEN '' ELSE ',' END || e.edge_type, length + 1 FROM p JOIN e ON e.source_id = p.id WHERE length < 10)
SELECT path, types AS edge_types, CAST(length AS INT) AS length FROM p WHERE id LIKE 'R:%'""",
    "typed_path": f"""WITH RECURSIVE e AS (SELECT * FROM ({E}) WHERE edge_type IN ('IMPORTS', 'DEFINES')), p(id, path, length) AS (SELECT * FROM (VALUES ('C:1', 'C:1', 0), ('O:1', 'O:1', 0))
UNION ALL SELECT e.target_id, path || '>' || e.target_id, length + 1 FROM p JOIN e ON e.source_id = p.id WHERE length < 10)
SELECT path, CAST(length AS INT) AS length FROM p WHERE id LIKE 'R:%'""",
    "impact_forward": f"WITH RECURSIVE n AS ({N}), e AS ({E}), seeds AS (SELECT id FROM n WHERE file_path = 'order/0'), {REACH.format(near='source_id', far='target_id', most=5)} {IMPACT}",
    "impact_reverse": f"WITH RECURSIVE n AS ({N}), e AS ({E}), seeds AS (SELECT 'R:1' AS id), {REACH.format(near='target_id', far='source_id', most=5)} {IMPACT}",
    "impact_file": f"WITH RECURSIVE n AS ({N}), e AS (SELECT * FROM ({E}) WHERE edge_type = 'CALLS'), seeds AS (SELECT id FROM n WHERE file_path = 'customer/0'), {REACH.format(near='target_id', far='source_id', most=5)} {IMPACT}",
    "cycles": f"""WITH RECURSIVE e AS ({TR}), p(path, first, last, length) AS (SELECT DISTINCT [source_id], source_id, source_id, 1 FROM e
UNION ALL SELECT list_append(path, e.target_id), first, e.target_id, length + 1 FROM p JOIN e ON e.source_id = p.last WHERE e.target_id > first AND NOT list_contains(path, e.target_id) AND length < 8)
SELECT array_to_string(list_append(path, first), '>') AS cycle, CAST(length AS INT) AS length FROM p WHERE EXISTS (SELECT 1 FROM e WHERE e.source_id = p.last AND e.target_id = p.first)""",
    "cycle_nodes": f"WITH RECURSIVE e AS ({TR}), {_CLOSURE.format(most=20)} SELECT source_id AS id, CAST(min(depth) AS INT) AS length FROM c WHERE source_id = target_id GROUP BY 1",
    "strong_components": f"WITH RECURSIVE e AS ({TR}), {_CLOSURE.format(most=20)} SELECT a.source_id AS id, min(a.target_id) AS component FROM c a JOIN c b ON a.source_id = b.target_id AND a.target_id = b.source_id GROUP BY 1",
    "dependency_lists": f"SELECT source_id AS id, string_agg(target_id, ',' ORDER BY target_id) AS targets, CAST(count(*) AS INT) AS n_targets FROM (SELECT DISTINCT source_id, target_id FROM ({E})) GROUP BY 1",
    "module_graph": f"WITH n AS ({N}), e AS ({E}) SELECT split_part(s.file_path, '/', 1) AS source_module, split_part(x.file_path, '/', 1) AS target_module, count(*) AS n FROM e JOIN n s ON s.id = e.source_id JOIN n x ON x.id = e.target_id WHERE s.kind <> x.kind GROUP BY ALL",
    "file_graph": f"WITH n AS ({N}), e AS ({E}) SELECT DISTINCT 'geo/' || s.file_path AS source_file, 'geo/' || x.file_path AS target_file, e.edge_type FROM e JOIN n s ON s.id = e.source_id JOIN n x ON x.id = e.target_id WHERE (edge_type = 'DEFINES' OR target_id LIKE 'N:%') AND s.file_path <> x.file_path",
    "dependency_trace": f"""WITH RECURSIVE e AS MATERIALIZED ({E}), p(id, path, length) AS (SELECT id, id, 0 FROM ({N}) WHERE file_path = 'supplier/0'
UNION ALL SELECT e.target_id, path || '>' || e.target_id, length + 1 FROM p JOIN e ON e.source_id = p.id WHERE length < 8 AND id <> 'R:2' AND NOT list_contains(string_split(path, '>'), e.target_id))
SELECT path, CAST(length AS INT) AS length FROM p WHERE id = 'R:2'""",
    "diagram": f"WITH n AS ({N}), e AS ({E}), m AS (SELECT DISTINCT '  ' || s.kind || ' --> ' || x.kind AS line FROM e JOIN n s ON s.id = e.source_id JOIN n x ON x.id = e.target_id WHERE s.kind <> x.kind) SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM m",
    "call_chain": f"""WITH e AS ({TR}), a AS (SELECT target_id AS v, target_id = 'view' AS c FROM e WHERE source_id = 'view'),
b AS (SELECT DISTINCT a.v AS u, e.target_id AS v, e.target_id IN ('view', a.v) AS c FROM a JOIN e ON e.source_id = a.v WHERE NOT a.c)
SELECT 'callees' AS direction, CAST(1 AS INT) AS depth, 'view' AS caller, v AS callee, c AS cycle FROM a UNION ALL SELECT 'callees', CAST(2 AS INT), u, v, c FROM b
UNION ALL SELECT * FROM (SELECT 'callers', CAST(1 AS INT), source_id, 'view', source_id = 'view' FROM e WHERE target_id = 'view' ORDER BY source_id LIMIT 5)""",
    "last_call_path": """WITH RECURSIVE o AS (SELECT event_type AS caller, arg_max(['error', 'purchase', 'signup', 'view', 'done'][event_id % 5 + 1], event_id) AS callee FROM events GROUP BY 1),
w(path) AS (SELECT ['click'] UNION ALL SELECT list_append(path, callee) FROM w JOIN o ON o.caller = path[-1] WHERE NOT list_contains(path, callee) AND len(path) <= 5),
f AS (SELECT path, (SELECT callee FROM o WHERE caller = path[-1]) AS nxt FROM w ORDER BY len(path) DESC LIMIT 1)
SELECT CAST(i - 1 AS INT) AS step, path[i] AS symbol, CASE WHEN len(path) > 5 THEN 'truncated' WHEN nxt IS NULL THEN 'end' ELSE 'cycle' END AS outcome FROM f, unnest(range(1, len(path) + 1)) AS u(i)""",
    "edge_ids": f"SELECT md5(source_id || ':' || target_id || ':' || edge_type) AS id, source_id, target_id FROM ({E}) WHERE edge_type = 'IMPORTS'",
    "upsert_edges": f"""WITH e AS (SELECT source_id, target_id, edge_type, CAST(CASE WHEN source_id = 'N:3' THEN 9 ELSE 1 END AS INT) AS line FROM ({E}) WHERE edge_type = 'DEFINES' UNION ALL SELECT 'N:3', 'R:9', 'DEFINES', CAST(5 AS INT))
SELECT md5(source_id || ':' || target_id || ':' || edge_type) AS id, source_id, target_id, edge_type, line FROM e""",
    "delete_cascade": f"SELECT (SELECT count(*) FROM ({N}) WHERE id NOT IN ('N:3', 'C:1')) AS nodes, (SELECT count(*) FROM ({E}) WHERE source_id NOT IN ('N:3', 'C:1') AND target_id NOT IN ('N:3', 'C:1')) AS edges",
}
