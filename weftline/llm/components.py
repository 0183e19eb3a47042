"""Connected components of links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import cut, drop_cut

#: The rounds grow with the logarithm of the number of nodes; this is far beyond.
MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (long columns a, b): root is the least node that it reaches, itself included.

    Every round is cut to the shared folder, and the one before it deleted. Links may repeat, be given either way round, or join a node to itself; rows with a
    null end are left out. No links give no rows.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(links.filter("a is not null and b is not null").select(u.alias("u"), v.alias("v")).distinct(), "components")
    self_only = edges.filter("u = v").select("u")
    edges, seen = edges.filter("u > v"), None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        if seen is not None:
            drop_cut(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    lone = self_only.select(F.col("u").alias("node"), F.col("u").alias("root")).join(found, "node", "left_anti")
    return found.unionByName(lone)


class Forest:
    """Union-find over 0..n-1 with unions of a whole array at once; a set's root is its least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                break
            r = up
        self.parent[x] = r
        return r

    def unite(self, members: np.ndarray) -> None:
        roots = self.find(members)
        self.parent[roots] = roots.min()

    def unite_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] with b[i] for all i."""
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            np.minimum.at(self.parent, a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of all that aren't their own root."""
        root = self.find(np.arange(len(self.parent)))
        own = np.flatnonzero(root != np.arange(len(root)))
        return own, root[own]
