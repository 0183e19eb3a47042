import random
import tracemalloc

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from weftline.llm import line_dedup as m


def expected(rows):
    """(doc_id, n_lines, removed, text) by comparing every two lines."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines = [((rows[i][0] is None, rows[i][0]), k, frozenset(w)) for i in order for k, x in enumerate((rows[i][1] or "").split("\n")) if (w := x.encode().lower().split())]
    first, gone = {}, set()
    for d, k, w in lines:
        first.setdefault(w, (d, k))
    classes = list(first)
    for i, w in enumerate(classes):
        if any(5 * len(w & v) >= 4 * len(w | v) for v in classes[:i]):
            gone.add(w)
    out = []
    for d, t in rows:
        own = [(k, frozenset(x.encode().lower().split())) for k, x in enumerate((t or "").split("\n"))]
        own = [(k, w) for k, w in own if w]
        bad = [k for k, w in own if w in gone or first[w] != ((d is None, d), k)]
        kept = t if t is None or not bad else "" if len(bad) == len(own) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in bad)
        out.append((d, len(own), bad, kept))
    return sorted(out, key=repr)


def actual(docs):
    return sorted(((r["doc_id"], r["_lines"]["n_lines"], r["_lines"]["removed"], r["text"]) for r in m.dedup_lines(docs).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(documents, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["the", "of", "a"] * 3
    base = [[r.choice(words) for _ in range(r.randint(1, 25))] for _ in range(60)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w).capitalize()

    rows = [(k, "\n".join(line() for _ in range(r.randint(0, 6)))) for k in range(120)]
    assert actual(documents(*rows)) == expected(rows)


def test_near_copies_in_a_crowd(documents):
    """More near-copies share their words than are compared all at once."""
    assert m.CROWD < 1500
    words = [f"q{k}" for k in range(20)]
    rows = [(k, " ".join(words[: 19]) + f" v{k}") for k in range(1500)] + [(9000 + k, " ".join(words[:5]) + f" {k} {k + 1} {k + 2}") for k in range(30)]
    got = m.dedup_lines(documents(*rows)).select("doc_id", F.size("_lines.removed").alias("n")).collect()
    assert sum(r["n"] for r in got if r["doc_id"] < 9000) == 1499 and sum(r["n"] for r in got if r["doc_id"] >= 9000) == 0


def test_odd_rows(documents):
    rows = [*ODD, (11, "same row\nother\n\nsame row"), (12, "other")]
    clashes = ["removed", "_id", "id", "c0", "c1", "bucket", "cls"]
    docs = documents(*rows).withColumn("_lines", F.lit(1)).withColumns({c: F.concat(F.lit(c), "lang") for c in clashes})
    assert actual(docs) == expected(rows)
    assert m.dedup_lines(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", *clashes, "_lines"]
    assert all(r[c] == f"{c}en" for r in m.dedup_lines(docs).collect() for c in clashes)
    assert m.dedup_lines(docs.limit(0)).count() == 0
    assert actual(documents((1, None), (2, ""))) == expected([(1, None), (2, "")])


def test_threshold_is_exact(documents):
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "a b c x y"), (4, "b c d e f")]  # 4/5, then 3/6 and less
    assert actual(documents(*rows)) == expected(rows)
    assert [r[0] for r in expected(rows) if r[2]] == [2]


def test_empty_lines_beyond_a_step(documents):
    rows = [(1, "\n".join(f"l{k}" for k in range(70_000))), (2, "l69999\nnew")]
    got = {r[0]: r for r in actual(documents(*rows))}
    assert got[1][1] == 70_000 and got[2][2] == [0]


def test_a_line_of_a_word_each_beyond_a_file(documents, monkeypatch):
    monkeypatch.setattr(m, "ROW_BITS", 8)
    rows = [(k, f"word{k % 500}") for k in range(600)]
    files = m.SetFiles("file:///tmp/unused")
    monkeypatch.setattr(m, "put_bytes", lambda *_: 0)
    places = files.write(*(np.arange(600, dtype=np.uint64) for _ in range(3)), np.ones(600, np.int64), np.arange(600, dtype=np.uint64))
    assert len(rows) == len(set(places.tolist())) and files.written == 3


def peak(run):
    """Most MB that numpy held while run() ran."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_a_word_of_many_pairs_is_matched_in_little_memory():
    class Files:
        def heads(self, places):
            return places.astype(np.uint64), places.astype(np.int64), places.astype(np.int64)

    r, n = np.random.default_rng(1), 60_000
    token, place = np.sort(r.integers(0, 100, n)).astype(np.uint64), np.arange(n).astype(np.uint64)
    bits = [r.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2)]  # far apart: no pair passes the filters
    assert peak(lambda: m.Matcher(Files(), token, place, np.full(n, 20), np.zeros(n, np.int64), *bits).run()) < 80


def test_groups_give_their_memory_back(documents, monkeypatch):
    """Workers that wait hold nothing of the groups they were given."""
    from pyspark.sql.group import GroupedData

    own, seen = GroupedData.applyInArrow, []
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: seen.append(f.__qualname__) or own(self, f, schema))
    assert actual(documents((1, "a b"), (2, "a b"))) == expected([(1, "a b"), (2, "a b")])
    assert len(seen) == 3 and all(x.startswith("released_group") for x in seen)
