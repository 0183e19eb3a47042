import collections
import math
import re
import zlib

import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from weftline.llm import kneser_ney as m


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")) + [None]


def reference(train, every):
    """Scores by plain dictionaries: (score, base, known) per text."""
    c, pairs = collections.Counter(), collections.Counter()
    for t in map(tokens, train):
        c.update(t)
        pairs.update(zip([0, *t], t))
    n, v = sum(c.values()), len(c)

    def discounts(counts):
        k = collections.Counter(counts)
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        d = [1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        return [0, *(min(max(x, 0.0), i) for i, x in enumerate(d, 1))]

    d2, cont = discounts(pairs.values()), collections.Counter(w for _, w in pairs)
    d1, types = discounts(cont.values()), len(pairs)
    follow = collections.defaultdict(list)
    for (a, _), x in pairs.items():
        follow[a].append(x)

    def p(a, b):
        rest = sum(d1[min(x, 3)] for x in cont.values()) / types
        one = max(cont.get(b, 0) - d1[min(cont.get(b, 0), 3)], 0) / types + rest / (v + 1)
        if a not in follow:
            return one
        x, s = pairs.get((a, b), 0), sum(follow[a])
        return max(x - d2[min(x, 3)], 0) / s + sum(d2[min(y, 3)] for y in follow[a]) / s * one

    if not n:
        return n, [(0.0, 0.0, 0) for _ in every]
    out = []
    for t in map(tokens, every):
        out.append((sum(math.log10(p(a, b)) for a, b in zip([0, *t], t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(c[w] > 0 for w in t)))
    return n, out


def reference_of_order(order, train, every):
    """Scores of any order by plain dictionaries."""
    grams = [collections.Counter() for _ in range(order + 1)]
    for t in map(tokens, train):
        w = [0] * (order - 1) + t
        grams[order].update(tuple(w[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    discounts, follow = {}, collections.defaultdict(list)
    for k in range(1, order + 1):
        c = collections.Counter(grams[k].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = [1 - 2 * y * c[2] / c[1] if c[1] else 0.5, 2 - 3 * y * c[3] / c[2] if c[2] else 1.0, 3 - 4 * y * c[4] / c[3] if c[3] else 1.5]
        discounts[k] = [0, *(min(max(x, 0.0), i) for i, x in enumerate(d, 1))]
        for g, x in grams[k].items():
            follow[g[:-1]].append((x, discounts[k][min(x, 3)]))

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(grams[1]) + 1)
        after = follow.get(g[:-1])
        if not after:
            return lower
        x, total = grams[len(g)][g], sum(x for x, _ in after)
        return max(x - discounts[len(g)][min(x, 3)], 0) / total + sum(d for _, d in after) / total * lower

    out = []
    for t in map(tokens, every):
        w = [0] * (order - 1) + t
        out.append(sum(math.log10(p(tuple(w[i : i + order]))) for i in range(len(t))))
    return out


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("rows", [ODD, [(k, f"the cat {k % 5} sat on the Mat {k % 3}") for k in range(60)], [(1, None)]])
def test_scores(documents, rows):
    got = sorted(m.score_held_out(documents(*rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(tokens(r[1]))))
    n, want = reference([t for i, t in rows if not held(i)], [t for _, t in rows])
    assert len(got) == len(rows)
    for r, (i, t), (score, base, known) in zip(got, rows, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(tokens(t)), known, n)
        assert math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)


def test_beats_counts_on_held_out_text(spark, sf):
    got = m.score_held_out(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_empty_table_and_other_columns(documents):
    assert m.score_held_out(documents(*ODD).limit(0)).count() == 0
    assert m.score_held_out(documents(*ODD).withColumn("score", F.lit("clash"))).count() == len(ODD)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_an_order(documents, order):
    rows = [(k, f"the cat {k % 5} sat on the Mat {k % 3} " * (1 + k % 4) + f"end {k % 7}") for k in range(60)] + [(100, None), (101, "new words the cat 1 sat"), *((200 + k, "a b " * 40) for k in range(30))]
    got = {r["doc_id"]: r["score"] for r in m.score_held_out(documents(*rows), order=order).collect()}
    want = reference_of_order(order, [t for i, t in rows if not held(i)], [t for _, t in rows])
    assert len(got) == len(rows)
    for (i, _), score in zip(rows, want, strict=True):
        assert math.isclose(got[i], score, rel_tol=1e-9, abs_tol=1e-9)
