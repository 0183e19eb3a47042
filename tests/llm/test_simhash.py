import re

import numpy as np
import xxhash
from conftest_llm import ODD
from pyspark.sql import functions as F

from weftline.llm import simhash as m
from weftline.llm.components import Forest, components


def plain(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows):
    f = [(i, plain(t)) for i, t in rows]
    pairs = [(a, b) for a, x in f for b, y in f if a is not None and b is not None and (x ^ y).bit_count() <= 4]
    r = roots(pairs, {i for i, _ in f if i is not None})
    return sorted(((i, format(x, "016x"), r.get(i, next((r[j] for j, y in f if j is not None and (x ^ y).bit_count() <= 4), None))) for i, x in f), key=repr)


def test_documents(documents):
    base = [f"sentence number {k} with words a{k} b{k} c{k}" for k in range(300)]
    rows = [*ODD, *((100 + k, " ".join(base[:k % 9 + 1 + k // 9])) for k in range(60)), *((400 + k, " ".join(base[:200]) + f" tail{k}") for k in range(40))]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in m.near_duplicates(documents(*rows)).collect()), key=repr)
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_empty_and_clashes(documents):
    docs = documents(*ODD).withColumn("fp", F.lit("clash"))
    assert m.near_duplicates(docs.limit(0)).count() == 0 and m.near_duplicates(docs).count() == len(ODD)


def test_tiles_find_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    flips = base[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for _ in range(200)], np.uint64)
    values = np.unique(np.concatenate([base, flips])).view(np.int64)
    links = m.link_fingerprints(spark.createDataFrame([(int(v),) for v in values], "fp long")).collect()
    u = values.view(np.uint64)
    near = [(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 4), strict=True) if i < j]
    want = roots(near, values.tolist())
    assert roots([(r["a"], r["b"]) for r in links], values.tolist()) == want


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 300) if k % 50] + [(1000, 1000), (7, 3), (7, 3), (None, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    clean = [(a, b) for a, b in pairs if a is not None]
    assert got == roots(clean, {x for p in clean for x in p})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    f = Forest(6)
    f.unite_pairs(np.array([5, 3, 1]), np.array([3, 1, 3]))
    f.unite(np.array([0, 2]))
    member, root = f.stars()
    assert dict(zip(member.tolist(), root.tolist(), strict=True)) == {2: 0, 3: 1, 5: 1}
