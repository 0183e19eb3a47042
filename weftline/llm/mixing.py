"""Temperature mixing of sources, in DataFrame functions only.

Weights are the sources' token shares to the power alpha, normalised. Alpha is searched on a grid of 2**-20: the largest one
whose entropy meets a target, raised if need be to the smallest one within a limit on repetition. Each source then gets its
share of the token budget as whole passes over its documents and a part of one more. A pass is a permutation of the source's
blocks (documents by hash); the last pass takes blocks in its order until the budget ends, within the block where it ends
sub-blocks, and within the sub-block documents. Three nested cuts keep every window small: BLOCKS rows a source, then a
source's documents / BLOCKS**2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.shared import cut, small

#: Blocks of a source, and sub-blocks of a block.
BLOCKS = 1024
#: Room for rounding, so that a share that is a whole number of tokens isn't taken for less, or for more.
ROOM = 1e-6
#: Steps of the exponent between 0 and 1.
GRID = 1 << 20


def hash60(*parts: Column) -> Column:
    """The first 60 bits of the md5 of the parts joined by |; a null part counts as the word null."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def search_exponent(totals: DataFrame, budget: float | None, target_entropy: float | None, max_repetition: float | None) -> int:
    """The exponent times GRID, by repeated division of the interval into 32: the largest that meets the target entropy, but no
    smaller than the least within the limit on repetition; 1 (shares as they are) if neither is given.

    totals: one row a source with its tokens n > 0. Each round is one aggregation over the sources.
    """
    n = totals.agg(F.sum("n"), F.count("*")).first()
    total, k = n[0], n[1]
    if not k:
        return GRID

    def ok(points: list[int], rule) -> dict[int, bool]:
        a = F.explode(F.array(*map(F.lit, points))).alias("a")
        rows = totals.select(a, (F.col("n") / F.lit(total)).alias("s")).withColumn("r", F.pow("s", F.col("a") / F.lit(float(GRID))))
        ratio = F.col("r") / F.col("s")
        got = rows.groupBy("a").agg(F.sum("r").alias("z"), F.sum(F.col("r") * F.log("r")).alias("e"), F.max(ratio).alias("hi"), F.min(ratio).alias("lo"))
        return {x["a"]: rule(x) for x in got.collect()}

    def last(rule) -> int:
        """The largest point with the rule, which holds from 0 up to some point; -1 if nowhere."""
        lo, step = 0, GRID // 32
        while True:
            points = sorted({min(GRID, lo + i * step) for i in range(33)})
            held = [p for p, good in ok(points, rule).items() if good]
            if not held:
                return -1
            lo = max(held)
            if step == 1 or lo == GRID:
                return lo
            step //= 32

    alpha = GRID if max_repetition is None else 0
    if target_entropy is not None:
        goal = target_entropy * math.log(k)
        alpha = max(0, last(lambda x: math.log(x["z"]) - x["e"] / x["z"] >= goal))
    if max_repetition is not None:
        size = (lambda x: x["hi"] / x["lo"]) if budget is None else (lambda x: x["hi"] / x["z"] * (budget / total))
        alpha = max(alpha, min(GRID, 1 + last(lambda x: size(x) > max_repetition)))
    return alpha


def plan_mix(totals: DataFrame, budget: int | None, target_entropy: float | None, max_repetition: float | None) -> DataFrame:
    """Add weight, budget (tokens), epochs (whole passes) and rest (tokens of the last pass) to (source, n) rows with n > 0.

    budget None: the least budget at which every source is passed over once at least.
    """
    alpha = search_exponent(totals, budget, target_entropy, max_repetition) / GRID
    total = totals.agg(F.sum("n")).first()[0] or 1
    raw = totals.withColumn("share", F.col("n") / F.lit(total)).withColumn("raw", F.pow("share", F.lit(alpha)))
    z = raw.agg(F.sum("raw"), F.min(F.col("raw") / F.col("share"))).first()
    tokens = F.ceil(F.col("n") * (F.col("raw") / F.col("share") / F.lit(z[1] or 1.0)) - ROOM) if budget is None else F.floor(F.col("raw") / F.lit(z[0] or 1.0) * F.lit(float(budget)) + ROOM)
    out = raw.withColumn("weight", F.col("raw") / F.lit(z[0] or 1.0)).withColumn("budget", tokens.cast("long"))
    return out.withColumn("epochs", F.expr("budget div n").cast("int")).withColumn("rest", F.expr("budget % n")).drop("share", "raw")


def _until(rows: DataFrame, by: list[str], order: list, tokens: str, rest: str) -> DataFrame:
    """Add _all, the tokens up to and with each row (peers together), and _before, those before it."""
    w = Window.partitionBy(*by).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow) if len(order) == 1 else Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_all", F.sum(tokens).over(w)).withColumn("_in", F.col("_all") <= F.col(rest)).withColumn("_cut", ~F.col("_in") & (F.col("_all") - F.col(tokens) <= F.col(rest)))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float | None = 1.0, target_entropy: float | None = None, max_repetition: float | None = None, seed: int = 42) -> DataFrame:
    """The mixed corpus: the rows of docs, each once for every time that it is drawn, and a column _draw.

    budget: as a multiple of the corpus' tokens (words), or None for the least one that keeps every document. target_entropy:
    as a share of the entropy of equal weights. max_repetition: the most passes over a source; it goes before the target.
    _draw is struct(n_tokens, epoch, block, block_rank, position): position orders the whole mixture, with every source spread
    evenly from 0 to 1. A null source is a source of its own. Null and empty texts have no tokens: they are drawn along with
    their block, and a source without any tokens isn't drawn. Rows with the same doc_id and source are drawn together. A
    column _draw of docs is replaced; other columns stay. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "_draw"]
    h = hash60(F.lit(seed), F.col(doc_id))
    own = F.struct(
        F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"),
        F.shiftright(h, 50).cast("int").alias("block"),
        F.shiftright(h, 40).bitwiseAND(F.lit(BLOCKS - 1)).cast("int").alias("sub"),
        h.bitwiseAND(F.lit((1 << 40) - 1)).alias("low"),
    )
    narrow = cut(docs.select(own.alias("_m")).select("_m.*"), "mix-documents")
    blocks = cut(narrow.groupBy("source", "block").agg(F.sum("n").alias("t")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("t").alias("n")).filter("n > 0")
    total = totals.agg(F.sum("n")).first()[0] or 0
    tokens = None if budget is None else math.floor(budget * total)
    plan = cut(plan_mix(totals, tokens, target_entropy, max_repetition), "mix-plan")

    def order(*parts: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in parts)))

    # every pass of every source: its blocks in their order
    passes = blocks.join(small(plan).alias("p"), blocks["source"].eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).withColumn("_o", order("source", "epoch", "block"))
    ranked = passes.withColumn("rank", F.row_number().over(Window.partitionBy("source", "epoch").orderBy("_o", "block")) - 1)
    ranked = _until(ranked, ["source", "epoch"], ["_o", "block"], "t", "rest")
    whole = F.col("epoch") < F.col("epochs")
    ranked = cut(ranked.filter(whole | F.col("_in") | F.col("_cut")).select("source", "n", "budget", "epochs", "epoch", "block", "rank", (~whole & F.col("_cut")).alias("cut"), (F.col("rest") - F.col("_all") + F.col("t")).alias("rest")), "mix-passes")
    # the block in which a source's budget ends, by sub-block, and the sub-block in which it ends, by document
    ends = ranked.filter("cut").select(F.col("source").alias("_s"), F.col("block").alias("_b"), "epoch", F.col("rest").alias("rest1"))
    inside = narrow.join(small(ends), narrow["source"].eqNullSafe(F.col("_s")) & (narrow["block"] == F.col("_b"))).drop("_s", "_b")
    subs = inside.groupBy("source", "epoch", "block", "sub", "rest1").agg(F.sum("n").alias("t")).withColumn("_o", order("source", "epoch", "block", "sub"))
    subs = _until(subs, ["source"], ["_o", "sub"], "t", "rest1").filter(F.col("_in") | F.col("_cut"))
    subs = cut(subs.select("source", "sub", F.col("_cut").alias("cut"), (F.col("rest1") - F.col("_all") + F.col("t")).alias("rest2")), "mix-subs")
    last = subs.filter("cut").select(F.col("source").alias("_s"), F.col("sub").alias("_u"), "rest2")
    lows = inside.join(small(last), inside["source"].eqNullSafe(F.col("_s")) & (inside["sub"] == F.col("_u"))).groupBy("source", "low", "rest2").agg(F.sum("n").alias("t"))
    lows = _until(lows, ["source"], ["low"], "t", "rest2").filter("_in").groupBy("source").agg(F.max("low").alias("to_low"))
    sub_ends = subs.join(small(cut(lows, "mix-ends")).alias("e"), subs["source"].eqNullSafe(F.col("e.source")) & subs["cut"], "left").select(subs["source"].alias("_us"), subs["sub"].alias("_usub"), F.when(~subs["cut"], F.lit((1 << 40) - 1)).otherwise(F.coalesce("e.to_low", F.lit(-1))).alias("to_low"))
    r = small(ranked).alias("r")
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), own.alias("_m")).join(r, F.col("_m.source").eqNullSafe(F.col("r.source")) & (F.col("_m.block") == F.col("r.block")))
    out = out.join(small(sub_ends), F.col("r.cut") & F.col("_m.source").eqNullSafe(F.col("_us")) & (F.col("_m.sub") == F.col("_usub")), "left")
    out = out.filter(~F.col("r.cut") | F.coalesce(F.col("_m.low") <= F.col("to_low"), F.lit(False)))
    position = ((F.col("r.epoch") * BLOCKS + F.col("r.rank")) * F.col("r.n")) / (F.col("r.budget") * F.lit(float(BLOCKS)))
    draw = F.struct(F.col("_m.n").alias("n_tokens"), F.col("r.epoch").cast(T.IntegerType()).alias("epoch"), F.col("_m.block").alias("block"), F.col("r.rank").alias("block_rank"), position.alias("position"))
    return out.select("_row.*", draw.alias("_draw"))
