"""The graph store: nodes and edges as versioned tables, with import, upsert, delete, audit and migration.

Every change is a function of the tables' rows; Store keeps them as parquet parts and a pointer file, so that a failed write leaves
the old state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schemas import EDGES, IMPORT_DOCUMENT, NODES, absent, bad_edges, bad_nodes

SCHEMA_VERSION = 4


def edge_id(source: str = "source_id", target: str = "target_id", kind: str = "edge_type"):
    """An edge's id: at most one edge per source, target and type."""
    return F.md5(F.concat_ws(":", source, target, kind))


def _fit(rows: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new; of rows with the same key the last one stays (of new's, that with the largest _seq if there is one)."""
    seq = F.col("_seq") if "_seq" in new.columns else F.lit(1)
    cols = old.columns
    rows = old.select(*cols, F.lit(0).cast("long").alias("_seq")).unionByName(new.select(*cols, seq.cast("long").alias("_seq")))
    last = F.max_by(F.struct(*cols), F.struct("_seq", F.xxhash64(*cols)))
    return rows.groupBy(F.col(key).alias("_key")).agg(last.alias("r")).select("r.*")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    if bad_nodes(new).limit(1).collect():
        raise ValueError("a node needs id, symbol, kind and file_path")
    return upsert(_fit(nodes, NODES), _with_seq(new, NODES))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    if bad_edges(new).limit(1).collect():
        raise ValueError("an edge needs source_id, target_id and a known edge_type")
    return upsert(_fit(edges, EDGES), _with_seq(new.withColumn("id", edge_id()), EDGES))


def _with_seq(rows: DataFrame, schema: T.StructType) -> DataFrame:
    out = rows.select(F.struct(*rows.columns).alias("r"), (F.col("_seq") if "_seq" in rows.columns else F.lit(1)).alias("_seq"))
    return out.select(*((F.col(f"r.{f.name}") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields), "_seq")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes in ids (a column `id`) and the edges at them."""
    ids = ids.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id").distinct(), "id", "left_anti")


def read_import(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an import document, {nodes: [...], edges: [...]}; a later row counts over an earlier one. One bad row fails all."""
    doc = spark.read.schema(IMPORT_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.posexplode("nodes").alias("_seq", "n")).select("n.*", "_seq")
    edges = doc.select(F.posexplode("edges").alias("_seq", "e")).select("e.*", "_seq")
    clean = lambda df: df.withColumns({c: F.when(~absent(F.col(c)), F.col(c)) for c, t in df.dtypes if t == "string"})
    nodes, edges = clean(nodes), clean(edges)
    if bad_nodes(nodes).limit(1).collect() or bad_edges(edges).limit(1).collect():
        raise ValueError("the document has a row that lacks a required field or has an unknown edge type")
    return nodes, edges


def checksum(rows: DataFrame) -> tuple[int, int]:
    """(rows, the sum of a hash of each): the same for any order of the rows; repeated rows count each time."""
    own = sorted(rows.columns)
    # hashes skip nulls, so that where they are is hashed besides
    h = F.xxhash64(*(F.col(f"`{c}`") for c in own), *(F.col(f"`{c}`").isNull() for c in own))
    got = rows.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return got[0], int(got[1])


def migrate_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of older layouts (name or symbol, type or kind, file or file_path, line or line_start) in the present one."""
    names = {"symbol": ["symbol", "name"], "kind": ["kind", "type"], "file_path": ["file_path", "file"], "line_start": ["line_start", "line"]}
    have = nodes.columns
    for new, olds in names.items():
        found = [c for c in olds if c in have]
        nodes = nodes.withColumn(new, F.coalesce(*(F.col(c) for c in found)) if found else F.lit(None))
    return _fit(nodes, NODES)


def migrate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables in the present layout; fails if a row would be lost. Edges may have ends that are no nodes, as they may in the
    store: graph.dangling() lists them."""
    new_nodes, new_edges = migrate_nodes(nodes), _fit(edges.withColumn("id", edge_id()), EDGES)
    if new_nodes.count() != nodes.count() or new_edges.count() != edges.count():
        raise ValueError("migration changed the number of rows")
    return new_nodes, new_edges


#: Plan nodes that do more than read, by their class names (fixed values of the planner).
_ACTS = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement", "org.apache.spark.sql.catalyst.plans.logical.ScriptTransformation")


def select_only(spark: SparkSession, text: str, **args) -> DataFrame:
    """Any query over the registered views; parameters are bound, never spliced in.

    The statement is parsed first, and refused if any part of its plan is a command, writes, or runs a script, however it begins.
    """
    jvm = spark._jvm
    acts = [jvm.java.lang.Class.forName(n) for n in _ACTS]
    try:
        left = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    except ParseException as e:
        raise ValueError("not a query") from e
    while left:
        node = left.pop()
        if any(c.isInstance(node) for c in acts):
            raise ValueError("only queries are allowed")
        for below in (node.children(), node.innerChildren()):
            left += [x for x in (below.apply(i) for i in range(below.size())) if hasattr(x, "children")]
    return spark.sql(text, args=args or None)


#: Parts a stored table is dealt to by id; a change rewrites the parts that it touches.
PARTS = 64


class Store:
    """Nodes and edges below a folder, in PARTS parts each by hash of the id.

    A pointer file names the folder of every part. A change writes new folders for the parts that it touches, and then replaces the
    pointer in one step: readers find the old state or the new one. Of two writers that began from the same state the second one
    fails, and may try again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _state(self) -> dict | None:
        """What the pointer says: the version, and for each table its parts' folders."""
        if not self._fs.exists(self._at("CURRENT")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def init(self) -> None:
        """Empty tables, unless there are some."""
        if self._state() is None:
            self._replace(None, {"nodes": {}, "edges": {}})

    def _replace(self, old: dict | None, new: dict) -> None:
        """Replace the pointer, if it is still the old one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new = new | {"version": uuid.uuid4().hex[:12]}
        if not self._fs.createNewFile(self._at("LOCK")):
            raise RuntimeError("another writer is at work, or left its LOCK behind")
        try:
            if (self._state() or {}).get("version") != (old or {}).get("version"):
                raise RuntimeError("another writer changed the store since this change began")
            out = self._fs.create(self._at(f"CURRENT.{new['version']}"), True)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = self.spark.sparkContext._gateway.new_array(kinds, 1)
            how[0] = kinds.OVERWRITE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("CURRENT").toUri(), conf).rename(self._at(f"CURRENT.{new['version']}"), self._at("CURRENT"), how)
        finally:
            self._fs.delete(self._at("LOCK"), False)

    def _read(self, state: dict, name: str, parts: list[str] | None = None) -> DataFrame:
        """A table, or some of its parts."""
        schema = NODES if name == "nodes" else EDGES
        found = [f"{self.path}/{v}/{name}/_part={k}" for k, v in state[name].items() if parts is None or k in parts]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _write(self, state: dict, name: str, parts: list[str], rows: DataFrame) -> dict:
        """The state in which these parts of a table have these rows."""
        version = uuid.uuid4().hex[:12]
        # the planner deals the rows by part, splits large parts over tasks and joins small ones
        rows.withColumn("_part", _part()).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{version}/{name}")
        folder = self._at(f"{version}/{name}")
        full = {str(x.getPath().getName()).partition("=")[2] for x in self._fs.listStatus(folder) if x.isDirectory()}
        kept = {k: v for k, v in state[name].items() if k not in parts}
        return state | {name: kept | dict.fromkeys(sorted(full), version)}

    @property
    def nodes(self) -> DataFrame:
        return self._read(self._state(), "nodes")

    @property
    def edges(self) -> DataFrame:
        return self._read(self._state(), "edges")

    def put(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Upsert nodes and edges in one step: both or none."""
        old = state = self._state()
        for name, rows, change in (("nodes", nodes, upsert_nodes), ("edges", edges, upsert_edges)):
            if rows is not None:
                rows = rows if name == "nodes" else rows.withColumn("id", edge_id())
                parts = _parts_of(rows)
                state = self._write(state, name, parts, change(self._read(state, name, parts), rows))
        self._replace(old, state)

    def load(self, path: str) -> None:
        """Import a document."""
        self.put(*read_import(self.spark, path))

    def delete_node(self, node: str) -> None:
        """Delete a node and the edges at it."""
        ids = self.spark.createDataFrame([(node,)], "id string")
        old = self._state()
        parts, edges = _parts_of(ids), self._read(old, "edges")
        state = self._write(old, "nodes", parts, self._read(old, "nodes", parts).join(ids, "id", "left_anti"))
        gone = edges.filter((F.col("source_id") == node) | (F.col("target_id") == node)).select("id")
        parts = _parts_of(gone)
        if parts:
            state = self._write(state, "edges", parts, delete_edges(self._read(old, "edges", parts), gone))
        self._replace(old, state)

    def delete_edge(self, edge: str) -> None:
        old, ids = self._state(), self.spark.createDataFrame([(edge,)], "id string")
        parts = _parts_of(ids)
        self._replace(old, self._write(old, "edges", parts, delete_edges(self._read(old, "edges", parts), ids)))

    def node(self, node: str) -> DataFrame:
        """A node by its id, from the one part that can have it."""
        parts = _parts_of(self.spark.createDataFrame([(node,)], "id string"))
        return self._read(self._state(), "nodes", parts).filter(F.col("id") == node)

    def views(self) -> None:
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")


def _part():
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")


def _parts_of(rows: DataFrame) -> list[str]:
    """The parts that rows fall to: PARTS at most."""
    return [str(x[0]) for x in rows.select(_part()).distinct().collect()]
