"""Graph operators over typed, directed edges (source_id, target_id, edge_type).

Walks are loops of joins: each step joins the frontier with the edges, drops what was seen, and is cut to the shared folder. A
frontier is broadcast only while it is small, so that the edges needn't move.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.schemas import EDGE_TYPES
from weftline.storage import BROADCAST_ROWS, cut, is_empty, rows_upto, small, stored


def edge_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """The edges of some types (all if None)."""
    return edges if types is None else edges.filter(F.col("edge_type").isin(types))


def query_edges(edges: DataFrame, source: str | None = None, target: str | None = None, edge_type: str | None = None) -> DataFrame:
    """The edges that meet every condition given."""
    for column, value in (("source_id", source), ("target_id", target), ("edge_type", edge_type)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    return edges


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the number of edges of each known type."""
    counts = edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("edge_type") == t).alias(t.lower()) for t in EDGE_TYPES))
    return nodes.agg(F.count("*").alias("nodes")).join(counts)


def orphans(nodes: DataFrame, edges: DataFrame, exclude: str | None = None) -> DataFrame:
    """Nodes with no incoming edge; exclude: a text that the path may not contain."""
    out = nodes.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")
    return out if exclude is None else out.filter(~F.col("file_path").contains(exclude))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no node: edge columns and missing (source, target or both)."""
    s, t = nodes.select(F.col("id").alias("source_id"), F.lit(1).alias("_s")), nodes.select(F.col("id").alias("target_id"), F.lit(1).alias("_t"))
    out = edges.join(s, "source_id", "left").join(t, "target_id", "left").filter("_s is null or _t is null")
    missing = F.when(F.col("_s").isNull() & F.col("_t").isNull(), "both").when(F.col("_s").isNull(), "source").otherwise("target")
    return out.select(*edges.columns, missing.alias("missing"))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, upstream: bool = False, edge_type: str = "CALLS") -> DataFrame:
    """The nodes one edge away."""
    near, far = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    hit = edges.filter((F.col(near) == node) & (F.col("edge_type") == edge_type)).select(F.col(far).alias("id")).distinct()
    return nodes.join(small(cut(hit, "neighbours")), "id")


#: Steps after which a long walk's pairs are cut again, so that their plan stays short.
RECUT = 16


def closure(edges: DataFrame, max_depth: int | None = 5, types: list[str] | None = None) -> DataFrame:
    """(source_id, target_id, depth) of all pairs within max_depth steps (any number if None), with the least depth; (x, x) on a cycle."""
    step = stored(edge_types(edges, types).select("source_id", "target_id").distinct(), "closure-edges")
    seen = cut(step.withColumn("depth", F.lit(1)), "closure")
    frontier = seen
    for depth in itertools.count(2) if max_depth is None else range(2, max_depth + 1):
        reach = frontier.select("source_id", F.col("target_id").alias("_via")).join(step.select(F.col("source_id").alias("_via"), "target_id"), "_via").select("source_id", "target_id").distinct()
        frontier = cut(reach.join(seen, ["source_id", "target_id"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if is_empty(frontier):
            break
        seen = seen.unionByName(frontier)
        if depth % RECUT == 0:
            seen = cut(seen, "closure")
    return seen


def extend_closure(known: DataFrame, source: str, target: str, max_depth: int = 5) -> DataFrame:
    """The closure after one more edge: everything that reaches its start goes on to everything that its end reaches."""
    spark = known.sparkSession
    start = known.filter(F.col("target_id") == source).select(F.col("source_id").alias("s"), F.col("depth").alias("a")).unionByName(spark.createDataFrame([(source, 0)], "s string, a int"))
    end = known.filter(F.col("source_id") == target).select(F.col("target_id").alias("t"), F.col("depth").alias("b")).unionByName(spark.createDataFrame([(target, 0)], "t string, b int"))
    new = start.join(small(end), F.col("a") + F.col("b") + 1 <= max_depth).select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), (F.col("a") + F.col("b") + 1).alias("depth"))
    return known.select("source_id", "target_id", "depth").unionByName(new).groupBy("source_id", "target_id").agg(F.min("depth").alias("depth"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, upstream: bool = False) -> DataFrame:
    """(seed, id, depth): everything within max_depth steps of each seed (a column `id`), seeds themselves at depth 0."""
    near, far = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    step = stored(edges.select(F.col(near).alias("_near"), F.col(far).alias("_far")), "reach-edges")
    frontier = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct(), "reach")
    seen = frontier
    for depth in range(1, max_depth + 1):
        hit = small(frontier).join(step, F.col("id") == F.col("_near")).select("seed", F.col("_far").alias("id")).distinct()
        frontier = cut(hit.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if is_empty(frontier):
            break
        seen = seen.unionByName(frontier)
    return seen


def nearest(edges: DataFrame, seeds: DataFrame, max_depth: int, upstream: bool = False) -> DataFrame:
    """(id, depth): how far every node within max_depth steps is from the nearest seed (a column `id`), seeds themselves at 0.

    One search from all seeds together, so that it keeps a row for each node reached, however many seeds reach it.
    """
    near, far = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    step = stored(edges.select(F.col(near).alias("_near"), F.col(far).alias("_far")), "nearest-edges")
    seen = frontier = cut(seeds.select("id", F.lit(0).alias("depth")).distinct(), "nearest")
    for depth in range(1, max_depth + 1):
        hit = small(frontier.select("id")).join(step, F.col("id") == F.col("_near")).select(F.col("_far").alias("id")).distinct()
        frontier = cut(hit.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "nearest")
        if is_empty(frontier):
            break
        seen = seen.unionByName(frontier)
        if depth % RECUT == 0:
            seen = cut(seen, "nearest")
    return seen


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, max_depth: int = 5, decay: float = 0.8, threshold: float = 0.1, upstream: bool = False, types: list[str] | None = ("CALLS",)) -> DataFrame:
    """The nodes that a change of the seeds (a column `id`) affects: id, symbol, file_path, depth, confidence.

    Confidence is decay ** depth, from the nearest seed, in three decimals; nodes below the threshold are left out. With decay in
    (0, 1) the threshold bounds the depth, so that no step is made for nodes that would be dropped.
    """
    if not 0 < decay <= 1 or not 0 <= threshold <= 1 or max_depth < 1:
        raise ValueError("max_depth from 1, decay in (0, 1], threshold in [0, 1]")
    depth = max([0, *(d for d in range(1, max_depth + 1) if round(decay**d, 3) >= threshold)])
    found = nearest(edge_types(edges, list(types) if types else None), seeds, depth, upstream).filter("depth > 0")
    return found.join(nodes, "id").select("id", "symbol", "file_path", "depth", F.round(F.pow(F.lit(decay), F.col("depth")), 3).alias("confidence"))


def file_impact(nodes: DataFrame, edges: DataFrame, path: str, **options) -> DataFrame:
    """What depends on any symbol of a file: reverse impact() from its symbols, the nearest symbol counting."""
    return impact(nodes, edges, nodes.filter(F.col("file_path") == path).select("id"), upstream=True, **options)


def shortest_path(edges: DataFrame, source: str, target: str | list[str], max_depth: int = 10, types: list[str] | None = None) -> DataFrame:
    """The shortest path from source to each target: path (node ids), edge_types, length; no row if there is none within max_depth.

    Of equally short paths the one first in order of its nodes' ids (then edge types) counts. max_depth outside 1 to 10 is 10.
    One search serves all targets, and ends when it has found them.
    """
    max_depth = max_depth if 1 <= max_depth <= 10 else 10
    targets = [target] if isinstance(target, str) else list(dict.fromkeys(target))
    spark, step = edges.sparkSession, stored(edge_types(edges, types).select("source_id", "target_id", "edge_type"), "path-edges")
    frontier = spark.createDataFrame([(source, [source], [])], "id string, path array<string>, edge_types array<string>")
    seen, found, left = frontier.select("id"), frontier.filter(F.col("id").isin(targets)), len(targets) - (source in targets)
    for _ in range(max_depth if left else 0):
        hit = small(frontier).join(step, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id"), F.concat("path", F.array("target_id")).alias("path"), F.concat("edge_types", F.array("edge_type")).alias("edge_types"))
        best = hit.groupBy("id").agg(F.min(F.struct("path", "edge_types")).alias("b")).select("id", "b.*")
        frontier = cut(best.join(seen, "id", "left_anti"), "path")
        n = frontier.agg(F.count("*"), F.count_if(F.col("id").isin(targets))).first()
        found, left = found.unionByName(frontier.filter(F.col("id").isin(targets))), left - n[1]
        if not n[0] or not left:
            break
        seen = seen.unionByName(frontier.select("id"))
    return found.select("path", "edge_types", (F.size("path") - 1).alias("length"))


def cycles(edges: DataFrame, max_length: int | None = 8, whitelist: list[str] | None = None) -> DataFrame:
    """All elementary cycles of up to max_length nodes (of any length if None): cycle (from its least node on, closed by it again)
    and length.

    whitelist: regular expressions; edges an end of which matches one are left out first. Edges between strong components are left
    out too, as no cycle has them. Cycles grow exponentially with their length, hence the bound; cycle_nodes() has none.
    """
    e = edges.select("source_id", "target_id").distinct()
    for w in whitelist or []:
        e = e.filter(~F.col("source_id").rlike(w) & ~F.col("target_id").rlike(w))
    e = inner_edges(e, strong_components(e))
    step = e.select(F.col("source_id").alias("_near"), F.col("target_id").alias("_far"))
    paths = e.select(F.array("source_id").alias("path")).distinct()
    out = None
    for length in itertools.count(1) if max_length is None else range(1, max_length + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        ahead = paths.join(step, last == F.col("_near"))
        done = ahead.filter(F.col("_far") == first).select(F.concat("path", F.array("_far")).alias("cycle"), F.lit(length).alias("length"))
        done = cut(done, "cycles")
        out = done if out is None else out.unionByName(done)
        paths = cut(ahead.filter((F.col("_far") > first) & ~F.array_contains("path", F.col("_far"))).select(F.concat("path", F.array("_far")).alias("path")), "cycle-paths")
        if is_empty(paths):
            break
    return out


def inner_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges both ends of which are in one strong component, cut."""
    a = components.select(F.col("id").alias("source_id"), F.col("component").alias("_a"))
    b = components.select(F.col("id").alias("target_id"), F.col("component").alias("_b"))
    return cut(edges.join(a, "source_id").join(b, "target_id").filter("_a = _b").select("source_id", "target_id"), "inner-edges")


def cycle_nodes(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The nodes that lie on a cycle, and how long the shortest one through each is. Only edges within a strong component are walked."""
    e = edges.select("source_id", "target_id").distinct()
    inner = inner_edges(e, strong_components(e))
    return closure(inner, max_depth).filter(F.col("source_id") == F.col("target_id")).select(F.col("source_id").alias("id"), F.col("depth").alias("length"))


#: Edges up to which what is left of a graph is solved in one task.
ONE_TASK_EDGES = 200_000


def _trimmed(e: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(the edges left when those at nodes without edges in or out are taken away, until none is or at most `most` are left; their
    number)."""
    n = e.count()
    while n > most:
        ends = cut(e.select(F.col("source_id").alias("id")).distinct().join(e.select(F.col("target_id").alias("id")), "id", "left_semi"), "component-nodes")
        e = cut(e.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id"), "component-edges")
        left, n = n, e.count()
        if left == n:
            break
    return e, n


def _components_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """strong_components() of all edges of a small graph, by depth-first search with low links."""
    ahead: dict[str, list[str]] = {}
    for pdf in batches:
        for s, t in zip(pdf["source_id"], pdf["target_id"], strict=True):
            ahead.setdefault(s, []).append(t)
    place, low, stack, on, out = {}, {}, [], set(), []
    for root in ahead:
        if root in place:
            continue
        place[root] = low[root] = len(place)
        stack.append(root)
        on.add(root)
        walk = [(root, iter(ahead[root]))]
        while walk:
            v, left = walk[-1]
            for w in left:
                if w not in place:
                    place[w] = low[w] = len(place)
                    stack.append(w)
                    on.add(w)
                    walk.append((w, iter(ahead.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], place[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == place[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                    on.difference_update(own)
                    if len(own) > 1 or v in ahead.get(v, ()):
                        out += [(w, min(own)) for w in own]
    yield pd.DataFrame(out, columns=["id", "component"])


def _coloured(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of strong_components() over edges e: ((id, colour) of the nodes that reach the node their colour is named by from
    within it, the edges between nodes of one colour)."""
    colour = cut(e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).distinct().withColumn("colour", F.col("id")), "component-colours")
    changed, n = colour, BROADCAST_ROWS + 1
    while n:
        told = (F.broadcast(changed) if n <= BROADCAST_ROWS else changed).join(e, F.col("id") == F.col("source_id")).groupBy(F.col("target_id").alias("id")).agg(F.min("colour").alias("_new"))
        both = cut(colour.join(told, "id", "left").withColumn("_less", F.coalesce(F.col("_new") < F.col("colour"), F.lit(False))).select("id", F.when(F.col("_less"), F.col("_new")).otherwise(F.col("colour")).alias("colour"), "_less"), "component-colours")
        colour, changed = both.select("id", "colour"), both.filter("_less").select("id", "colour")
        n = rows_upto(changed)
    s, t = (colour.select(F.col("id").alias(k), F.col("colour").alias(c)) for k, c in (("source_id", "_s"), ("target_id", "_t")))
    own = cut(e.join(s, "source_id").join(t, "target_id").filter("_s = _t").select("source_id", "target_id"), "component-inner")
    found = frontier = cut(colour.filter("id = colour"), "component-found")
    for step in itertools.count(1):
        n = rows_upto(frontier)
        if not n:
            return found, own
        hit = (F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier).join(own, F.col("id") == F.col("target_id")).select(F.col("source_id").alias("id"), "colour").distinct()
        frontier = cut(hit.join(found, "id", "left_anti"), "component-found")
        found = found.unionByName(frontier)
        if step % RECUT == 0:
            found = cut(found, "component-found")


def strong_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component): nodes that reach each other share a component, named by its least node; only nodes on cycles have rows.

    By colouring: after nodes without edges in or out are trimmed, every node takes the least node that reaches it as its colour;
    what reaches the node that names the colour from within the colour is that node's component. Those nodes go, and the rest
    starts again, until at most `one_task` edges are left, which one task solves. The state is a row for each node, and the steps
    follow the graph's diameter, not its pairs.
    """
    e, n = _trimmed(cut(edges.select("source_id", "target_id").distinct(), "component-edges"), one_task)
    out = None
    while n > one_task:
        found, own = _coloured(e)
        # a node alone is a component of a cycle only by an edge to itself
        loops = own.filter("source_id = target_id").select(F.col("source_id").alias("id"))
        many = found.groupBy("colour").agg(F.count("*").alias("_n")).filter("_n > 1").select("colour")
        done = found.join(many, "colour", "left_semi").select("id", "colour").unionByName(found.join(loops, "id", "left_semi").select("id", "colour")).distinct()
        done = cut(done.withColumnRenamed("colour", "component"), "component-done")
        out = done if out is None else out.unionByName(done)
        gone = found.select("id")
        e, n = _trimmed(cut(e.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("source_id", "target_id"), "component-edges"), one_task)
    rest = cut(e.coalesce(1).mapInPandas(_components_of_task, "id string, component string"), "component-done")  # at most one_task edges
    return rest if out is None else out.unionByName(rest)


def dependency_lists(edges: DataFrame) -> DataFrame:
    """id, targets (sorted), n_targets."""
    return edges.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("targets")).withColumn("n_targets", F.size("targets"))


def call_chain(edges: DataFrame, symbol: str, direction: str = "both", depth: int = 2, fan_out: int = 10, callers: int = 5) -> DataFrame:
    """Callees to a depth of 1 to 4 (the first fan_out of each) and the first callers: direction, depth, caller, callee, cycle.

    cycle marks a callee that the chain above it already has.
    """
    if direction not in ("callers", "callees", "both"):
        raise ValueError("direction is callers, callees or both")
    depth, calls = min(max(depth, 1), 4), stored(edges.select("source_id", "target_id").distinct(), "call-edges")
    up = calls.filter(F.col("target_id") == symbol).orderBy("source_id").limit(callers).select(F.lit("callers").alias("direction"), F.lit(1).alias("depth"), F.col("source_id").alias("caller"), F.col("target_id").alias("callee"), (F.col("source_id") == symbol).alias("cycle"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("target_id"))
    frontier, down = edges.sparkSession.createDataFrame([([symbol],)], "path array<string>"), None
    for d in range(1, depth + 1):
        hit = small(frontier).join(calls, F.element_at("path", -1) == F.col("source_id")).withColumn("_r", rank).filter(F.col("_r") <= fan_out)
        hit = cut(hit.select("path", "source_id", "target_id", F.array_contains("path", F.col("target_id")).alias("cycle")), "call-chain")
        rows = hit.select(F.lit("callees").alias("direction"), F.lit(d).alias("depth"), F.col("source_id").alias("caller"), F.col("target_id").alias("callee"), "cycle").distinct()
        down = rows if down is None else down.unionByName(rows)
        frontier = hit.filter("not cycle").select(F.concat("path", F.array("target_id")).alias("path"))
    return {"callers": up, "callees": down}.get(direction) if direction != "both" else up.unionByName(down)


def last_call_path(calls: DataFrame, start: str, max_depth: int = 5) -> DataFrame:
    """Follow each body's last call: step, symbol, and how the walk ended (end, cycle or truncated).

    calls: caller, callee, position. The walk keeps one row, so that its state is a row on the driver.
    """
    max_depth = min(max(max_depth, 1), 10)
    onward = cut(calls.groupBy("caller").agg(F.max_by("callee", F.struct("position", "callee")).alias("callee")), "last-calls")
    path, end = [start], "truncated"
    for _ in range(max_depth):
        nxt = onward.filter(F.col("caller") == path[-1]).select("callee").first()
        if nxt is None or nxt[0] in path:
            end = "end" if nxt is None else "cycle"
            break
        path.append(nxt[0])
    return calls.sparkSession.createDataFrame([(i, s, end) for i, s in enumerate(path)], "step int, symbol string, outcome string")


def module_graph(nodes: DataFrame, edges: DataFrame, module=None) -> DataFrame:
    """Edges between modules (by default the first part of the path) of both ends, without those within one: source, target, n."""
    of = module or (lambda c: F.substring_index(c, "/", 1))
    s, t = (nodes.select(F.col("id").alias(k), of(F.col("file_path")).alias(m)) for k, m in (("source_id", "source_module"), ("target_id", "target_module")))
    return edges.join(s, "source_id").join(t, "target_id").filter("source_module <> target_module").groupBy("source_module", "target_module").agg(F.count("*").alias("n"))


def file_graph(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """Distinct file-to-file edges within a module: both paths start with the prefix."""
    own = nodes.filter(F.col("file_path").startswith(prefix))
    s, t = (own.select(F.col("id").alias(k), F.col("file_path").alias(m)) for k, m in (("source_id", "source_file"), ("target_id", "target_file")))
    return edges.join(s, "source_id").join(t, "target_id").filter("source_file <> target_file").select("source_file", "target_file", "edge_type").distinct()


def expand_imports(anchors: DataFrame, imports: DataFrame, most_anchors: int = 5, most: int = 10) -> DataFrame:
    """The files that the first anchors (file_path, rank) import: file_path, anchor, at most `most` for each."""
    first = anchors.orderBy("rank", "file_path").limit(most_anchors).select(F.col("file_path").alias("anchor"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy("target"))
    return imports.join(F.broadcast(first), F.col("source") == F.col("anchor")).select("anchor", "target").distinct().withColumn("_r", rank).filter(F.col("_r") <= most).select(F.col("target").alias("file_path"), "anchor")


def subgraph(candidates: DataFrame) -> DataFrame:
    """Edges from candidates' arrays callers and callees: source, target, edge_type."""
    out = candidates.select(F.col("symbol_id").alias("source"), F.explode_outer("callees").alias("target"))
    into = candidates.select(F.explode_outer("callers").alias("source"), F.col("symbol_id").alias("target"))
    return out.unionByName(into).filter("source is not null and target is not null").distinct().withColumn("edge_type", F.lit("CALLS"))


def dependency_trace(edges: DataFrame, roots: DataFrame, package: str, max_depth: int = 8) -> DataFrame:
    """All simple paths from the roots (a column `id`) down to a package: path, length."""
    step = stored(edges.select("source_id", "target_id").distinct(), "trace-edges")
    paths, out = roots.select(F.array("id").alias("path")), None
    for _ in range(max_depth):
        hit = cut(paths.join(step, F.element_at("path", -1) == F.col("source_id")).filter(~F.array_contains("path", F.col("target_id"))).select(F.concat("path", F.array("target_id")).alias("path")), "trace")
        done = hit.filter(F.element_at("path", -1) == package)
        out = done if out is None else out.unionByName(done)
        paths = hit.filter(F.element_at("path", -1) != package)
        if is_empty(paths):
            break
    return out.withColumn("length", F.size("path") - 1)


def mermaid_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def mermaid(edges: DataFrame, source: str = "source_module", target: str = "target_module") -> DataFrame:
    """One row with the edges as a Mermaid flow chart; meant for graphs that a person can look at."""
    line = F.concat(F.lit("  "), mermaid_id(F.col(source)), F.lit(" --> "), mermaid_id(F.col(target)))
    return edges.agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("diagram"))


def d3(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row with nodes and links as JSON, for graphs that a person can look at."""
    n = nodes.agg(F.array_sort(F.collect_set("id")).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_set(F.struct(F.col(source).alias("source"), F.col(target).alias("target")))).alias("links"))
    return n.join(e).select(F.to_json(F.struct("nodes", "links")).alias("json"))
