"""The data model's views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (table, key, prefix, kind) of the node views.
KINDS = [("orders", "o_orderkey", "O", "order"), ("customer", "c_custkey", "C", "customer"), ("nation", "n_nationkey", "N", "nation"), ("region", "r_regionkey", "R", "region"), ("supplier", "s_suppkey", "S", "supplier"), ("part", "p_partkey", "P", "part")]


def node_id(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for every order, customer, nation, region, supplier and part; a hundred keys share a file."""
    out = None
    for name, key, prefix, kind in KINDS:
        rows = table(spark, sf_dir, name).select(node_id(prefix, key).alias("id"), F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("symbol"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}/"), F.floor(F.col(key) / 100).cast("string")).alias("file_path"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to customer, customer and supplier to nation, nation to region, order to part."""
    def link(name: str, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(node_id(*a).alias("source_id"), node_id(*b).alias("target_id"), F.lit(kind).alias("edge_type"))

    out = link("orders", ("O", "o_orderkey"), ("C", "o_custkey"), "CALLS")
    out = out.unionByName(link("customer", ("C", "c_custkey"), ("N", "c_nationkey"), "IMPORTS"))
    out = out.unionByName(link("supplier", ("S", "s_suppkey"), ("N", "s_nationkey"), "IMPORTS"))
    out = out.unionByName(link("nation", ("N", "n_nationkey"), ("R", "n_regionkey"), "DEFINES"))
    return out.unionByName(link("lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), "REFERENCES").distinct())


def transitions(spark: SparkSession, sf_dir: str, users: int | None = None) -> DataFrame:
    """Which event type follows which for a user: a cyclic graph. users: only user ids below it."""
    e = table(spark, sf_dir, "events")
    if users is not None:
        e = e.filter(F.col("user_id") < users)
    prior = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = e.select(prior.alias("source_id"), F.col("event_type").alias("target_id")).filter("source_id is not null")
    return out.distinct().withColumn("edge_type", F.lit("CALLS"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, symbol_id, action, timestamp (seconds) of user events."""
    kind = F.col("event_type")
    action = F.when(kind.isin("purchase", "signup"), "edit").when(kind == "error", "ignore").otherwise("view")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("sym"), (F.col("user_id") % 50).cast("string")).alias("symbol"), F.concat(F.lit("src/f"), (F.col("user_id") % 50).cast("string"), F.lit(".ts::sym")).alias("symbol_id"), action.alias("action"), F.unix_timestamp("ts").alias("timestamp"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, ts (seconds), subject, file of user events."""
    kind = F.col("event_type")
    head = F.when(kind == "error", "fix: handle error").when(kind == "signup", "feat: add signup").when(kind == "purchase", "refactor: simplify purchase").when(kind == "view", "docs: describe view").otherwise("update click")
    return table(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("sha"), F.unix_timestamp("ts").alias("ts"), F.concat(head, F.lit(" "), F.col("event_id").cast("string")).alias("subject"), F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".ts")).alias("file"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, href: the links of raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables and of the graph."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    nodes(spark, sf_dir).createOrReplaceTempView("nodes")
    edges(spark, sf_dir).createOrReplaceTempView("edges")


#: The same views in SQL.
NODES_SQL = " UNION ALL ".join(f"SELECT '{p}:' || {k} AS id, '{kind}_' || {k} AS symbol, '{kind}' AS kind, '{kind}/' || CAST({k} // 100 AS BIGINT) AS file_path FROM {t}" for t, k, p, kind in KINDS)
EDGES_SQL = """SELECT 'O:' || o_orderkey AS source_id, 'C:' || o_custkey AS target_id, 'CALLS' AS edge_type FROM orders
UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'IMPORTS' FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'IMPORTS' FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'DEFINES' FROM nation
UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'P:' || l_partkey, 'REFERENCES' FROM lineitem"""
TRANSITIONS_SQL = """SELECT DISTINCT source_id, target_id, 'CALLS' AS edge_type FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source_id,
event_type AS target_id FROM events {where}) WHERE source_id IS NOT NULL"""
SIGNALS_SQL = """SELECT 'sym' || (user_id % 50) AS symbol, 'src/f' || (user_id % 50) || '.ts::sym' AS symbol_id,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'edit' WHEN event_type = 'error' THEN 'ignore' ELSE 'view' END AS action, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM events"""
COMMITS_SQL = """SELECT md5(CAST(event_id AS VARCHAR)) AS sha, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE event_type WHEN 'error' THEN 'fix: handle error' WHEN 'signup' THEN 'feat: add signup'
WHEN 'purchase' THEN 'refactor: simplify purchase' WHEN 'view' THEN 'docs: describe view' ELSE 'update click' END || ' ' || event_id AS subject, 'src/f' || user_id || '.ts' AS file FROM events"""
