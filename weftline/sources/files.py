"""Sources outside of tables: source trees, symbol indexes, commit logs, contracts, query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import contract_type, matches_any, role_edge_type, symbol_kind
from weftline.operators.store import edge_id
from weftline.operators.text import contract_symbols, lines, openapi_json, openapi_yaml
from weftline.sources import wire

#: Folders that may hold decision records, in the order in which they count (fixed values).
RECORD_FOLDERS = ["docs/adr", "doc/adr", "ADR", "adr"]
#: A symbol index in JSON: documents with symbols (with relationships) and occurrences (with a bit mask of roles).
SYMBOL_INDEX = (
    "documents array<struct<relativePath: string, text: string, "
    "symbols: array<struct<symbol: string, displayName: string, relationships: array<struct<symbol: string, isImplementation: boolean, isTypeDefinition: boolean, isDefinition: boolean, isReference: boolean>>>>, "
    "occurrences: array<struct<range: array<int>, symbol: string, symbolRoles: int>>>>"
)


def read_tree(spark: SparkSession, root: str, most_bytes: int = 1 << 20, pattern: str = "*") -> DataFrame:
    """file (relative), text, mtime, size of the files below a folder; larger ones are listed, but their text is null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    top = "/" + root.split("://")[-1].strip("/") + "/"
    return raw.select(F.expr("substring_index(path, '/', -1)").alias("name"), F.regexp_replace(path, "^" + top.replace(".", r"\."), "").alias("file"), F.when(F.col("length") < most_bytes, F.decode("content", "utf-8")).alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def changed_files(tree: DataFrame, since: str | None, manifest: DataFrame | None = None, first: int | None = 100) -> DataFrame:
    """Files newer than a time, or not in the manifest (file) of an earlier run; never indexed: the first `first` files, or all if None."""
    if since is None:
        return tree if first is None else tree.orderBy("file").limit(first)
    newer = tree.filter(F.col("mtime") > F.lit(since).cast("timestamp"))
    if manifest is None:
        return newer
    unknown = tree.join(manifest.select("file").distinct(), "file", "left_anti")
    return newer.unionByName(unknown.select(*newer.columns)).dropDuplicates(["file"])


def is_fresh(tree: DataFrame, index_time: str) -> bool:
    """Whether nothing in the tree is newer than the index."""
    return not tree.filter(F.col("mtime") > F.lit(index_time).cast("timestamp")).limit(1).collect()


def staged_files(changes: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """file of the staged changes (status, file) that add, copy, modify or rename one, of some extensions; a renamed file's new name."""
    path = F.element_at(F.split("file", "\t"), -1)
    own = changes.filter(F.substring("status", 1, 1).isin("A", "C", "M", "R")).select(path.alias("file")).distinct()
    return own if extensions is None else with_extensions(own, extensions)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """status, file of the lines of `git diff --cached --name-status` output."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("status"), F.get(parts, F.lit(1)).alias("file")).filter("file is not null")


def with_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.filter(F.lower(F.element_at(F.split("file", r"\."), -1)).isin(extensions))


def record_folder(tree: DataFrame) -> str | None:
    """The first of the known folders that has a markdown file."""
    order = F.coalesce(*(F.when(F.col("file").startswith(f + "/"), F.lit(i)) for i, f in enumerate(RECORD_FOLDERS)))
    best = tree.filter(F.col("file").endswith(".md")).agg(F.min(order).alias("i")).first()["i"]
    return None if best is None else RECORD_FOLDERS[best]


def symbol_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a symbol index in the SYMBOL_INDEX layout: symbols become nodes, relationships edges between them, and
    occurrences edges from a file's node; a file's node is made once. The first set role counts."""
    d = documents.select(F.explode("documents").alias("d")).select("d.*")
    sym = d.select("relativePath", F.explode("symbols").alias("s"))
    name = F.coalesce(F.nullif("s.displayName", F.lit("")), "s.symbol")
    nodes = sym.select(F.col("s.symbol").alias("id"), name.alias("symbol"), symbol_kind(F.col("s.symbol")).alias("kind"), F.col("relativePath").alias("file_path"))
    rel = sym.select("relativePath", F.col("s.symbol").alias("source_id"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.isImplementation"), "IMPLEMENTS").when(F.col("r.isTypeDefinition"), "EXTENDS").when(F.col("r.isDefinition"), "DEFINES").otherwise("CALLS")
    edges = rel.select("source_id", F.col("r.symbol").alias("target_id"), kind.alias("edge_type"), F.col("relativePath").alias("file_path"), F.lit(None).cast("int").alias("line"))
    occ = d.select("relativePath", F.explode("occurrences").alias("o"))
    files = occ.select("relativePath").distinct().select(F.concat(F.lit("file:"), "relativePath").alias("id"), F.col("relativePath").alias("symbol"), F.lit("file").alias("kind"), F.col("relativePath").alias("file_path"))
    seen = occ.select(F.concat(F.lit("file:"), "relativePath").alias("source_id"), F.col("o.symbol").alias("target_id"), role_edge_type(F.coalesce("o.symbolRoles", F.lit(0))).alias("edge_type"), F.col("relativePath").alias("file_path"), F.get("o.range", F.lit(0)).alias("line"))
    edges = edges.unionByName(seen)
    return nodes.unionByName(files).dropDuplicates(["id"]), edges.withColumn("id", edge_id()).dropDuplicates(["id"])


def read_symbol_index(spark: SparkSession, path: str, fields: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """symbol_index() of files: JSON by their ending, else protocol buffers, with the field numbers of the published format or others
    (see wire.FIELDS)."""
    if path.endswith(".json"):
        return symbol_index(spark.read.schema(SYMBOL_INDEX).option("multiLine", True).json(path))
    raw = spark.read.format("binaryFile").load(path)
    return symbol_index(wire.decoded_indexes(raw, SYMBOL_INDEX, fields or wire.FIELDS))


def symbol_index_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_if(F.col("kind") == "file").alias("documents"), F.count_if(F.col("kind") != "file").alias("symbols"))
    return n.join(edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("edge_type") == t).alias(t.lower()) for t in ("DEFINES", "IMPORTS", "CALLS", "MODIFIES", "IMPLEMENTS", "EXTENDS"))))


def commit_log(text: DataFrame) -> DataFrame:
    """sha, ts, subject, file of a log (column value) of `sha|seconds|subject` lines, each followed by its file names.

    The log is one file, so that a commit's head is the last one above a name; read it as one partition per log.
    """
    from pyspark.sql.window import Window

    own = text.withColumn("_n", F.monotonically_increasing_id())
    head = F.when(F.col("value").rlike(r"^[0-9a-f]{7,40}\|\d+\|"), F.col("value"))
    seen = own.withColumn("_h", F.last(head, ignorenulls=True).over(Window.partitionBy(F.spark_partition_id()).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.split("_h", r"\|", 3)
    return seen.filter(head.isNull() & (F.trim("value") != "") & F.col("_h").isNotNull()).select(F.get(parts, F.lit(0)).alias("sha"), F.get(parts, F.lit(1)).cast("long").alias("ts"), F.get(parts, F.lit(2)).alias("subject"), F.col("value").alias("file"))


def contracts(tree: DataFrame, repo: str, skip: list[str] | None = None) -> DataFrame:
    """A row of a federation index for a tree: name, contracts with path, type, symbols and hash."""
    c = tree.withColumn("type", contract_type(F.col("file"))).filter("type <> 'unknown'")
    if skip:
        c = c.filter(~matches_any(F.col("file"), skip))
    yaml = c.filter("type = 'openapi' and file not like '%.json'")
    found = contract_symbols(c.select("file", "text")).unionByName(openapi_json(c.filter("type = 'openapi' and file like '%.json'").select("file", "text"))).unionByName(openapi_yaml(yaml.select("file", "text")))
    names = found.groupBy("file").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    rows = c.join(names, "file", "left").select(F.struct(F.col("file").alias("path"), "type", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), F.md5("text").alias("hash")).alias("c"))
    return rows.agg(F.array_sort(F.collect_list("c")).alias("contracts")).select(F.lit(repo).alias("name"), "contracts")


def update_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with repositories that it doesn't have yet (by name)."""
    return index.unionByName(new.join(index.select("name"), "name", "left_anti").select(*index.columns))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """query, expected (array) of a JSON-lines file."""
    return spark.read.schema("query string, expected array<string>").json(path).filter("query is not null")


def definitions(files: DataFrame) -> DataFrame:
    """A flat tree of each file: id, parent_id, type, name, start_line, end_line, child_count; a definition goes to the next one."""
    from pyspark.sql.window import Window

    ln = lines(files)
    rules = [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("variable", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)")]
    hit = F.filter(F.array(*(F.struct(F.lit(k).alias("type"), F.regexp_extract("line", rx, 1).alias("name")) for k, rx in rules)), lambda h: h["name"] != "")
    found = ln.withColumn("h", F.get(hit, F.lit(0))).withColumn("_last", F.max("line_no").over(Window.partitionBy("file"))).filter("h is not null")
    nxt = F.lead("line_no").over(Window.partitionBy("file").orderBy("line_no"))
    out = found.select("file", F.concat_ws(":", "file", "h.type", "line_no").alias("id"), F.concat(F.lit("file:"), "file").alias("parent_id"), "h.type", "h.name", F.col("line_no").alias("start_line"), F.coalesce(nxt - 1, "_last").alias("end_line"), F.lit(0).alias("child_count"))
    top = ln.groupBy("file").agg(F.max("line_no").alias("n")).join(out.groupBy("file").agg(F.count("*").alias("c")), "file", "left")
    return out.unionByName(top.select("file", F.concat(F.lit("file:"), "file").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("program").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), F.coalesce("c", F.lit(0)).cast("int").alias("child_count")))


def tree_nodes(tree: DataFrame) -> DataFrame:
    """The named definitions as nodes of the graph store."""
    return tree.filter("name is not null").select("id", F.col("name").alias("symbol"), F.col("type").alias("kind"), F.col("file").alias("file_path"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
