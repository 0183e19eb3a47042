import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import embed_dedup as m

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = {i: 0 for i, _ in rows}
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i, _ in rows}


def actual(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in m.near_vectors(df).collect()}


@pytest.mark.parametrize("dims", [64, 9, 2])
def test_clusters(spark, dims):
    rng = np.random.default_rng(dims)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(dims)
        for k in range(12):
            rows.append((len(rows), np.float32(centre * rng.uniform(0.5, 2) + rng.standard_normal(dims) * (0.02 * k + 0.01)).tolist()))
    rows += [(len(rows) + k, rows[3][1]) for k in range(7)]  # exact copies
    assert actual(spark, rows) == expected(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-30, 0.0]), (13, [1e30, 1e28])]
    got, want = actual(spark, rows), expected([r for r in rows if r[0] not in (12, 13)])
    assert {k: v[1:] for k, v in got.items() if k not in (12, 13)} == {k: v[1:] for k, v in want.items()}
    assert got[7] == (3, 7, True) and got[12][1] == 7 and got[13][1] == 7
    df = spark.createDataFrame([(1, [1.0], 0)], SCHEMA).withColumn("n_links", F.lit("clash"))
    assert m.near_vectors(df).count() == 1 and m.near_vectors(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.1], 0)], SCHEMA)
    assert sorted((r["n_links"], r["component_id"]) for r in m.near_vectors(again).collect()) == [(2, 1)] * 3
