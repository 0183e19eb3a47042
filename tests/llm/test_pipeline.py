import hashlib
import math
import re

import corpus_pipeline as p
import duckdb
import pytest
import test_langid
import test_line_dedup
import test_simhash
from pyspark.sql import functions as F

from weftline.llm.langid import fold_of
from weftline.llm.mixing import BLOCKS, GRID

from weftline.llm.queries import QUERIES
from weftline.llm.sql import SQL


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 0, name
    got = p.run(spark, sf)
    assert got.filter("not round_trip").count() == 0 and got.select("doc_id").distinct().count() > 0.7 * docs.count()


def test_copies_go_and_clean_documents_stay(spark, documents):
    clean = lambda k: "\n".join(" ".join(f"word{k}x{i}y{j}" for j in range(12)) for i in range(4))
    docs = documents(*((k, clean(k), f"s{k % 3}") for k in range(30)), *((100 + k, clean(3), "s1") for k in range(5)), (200, "", "s1"), (201, None, "s2"))
    kept = p.line_dedup(spark, p.language_id(spark, docs, ""), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30))
    once = p.simhash(spark, docs.filter("text <> ''"), "")
    assert sorted(r["doc_id"] for r in once.collect()) == list(range(30))
    twice = documents(*[(1, clean(1))] * 3, (2, clean(2)), (None, clean(1)))
    assert sorted(r["doc_id"] for r in p.simhash(spark, twice, "").collect()) == [1, 2]
    mixed = p.mixing(spark, kept, "")
    assert mixed.select("doc_id").distinct().count() == 30 and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_one_row_of_each_group_stays_whatever_its_id(spark, documents):
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(48))
    kept = lambda *rows: sorted(((r["doc_id"], r["text"]) for r in p.simhash(spark, documents(*rows), "").collect()), key=repr)
    want = lambda *rows: sorted(rows, key=repr)
    assert kept((1, text(1)), (None, text(1)), (None, text(2))) == want((1, text(1)), (None, text(2)))
    assert kept((None, text(1)), (None, text(1)), (2, text(2))) == want((None, text(1)), (2, text(2)))
    assert kept((3, text(1)), (5, text(1)), (5, text(2)), (6, text(2))) == want((3, text(1)), (5, text(2)))
    assert kept((5, text(1)), (5, text(2)), (5, text(2))) == want((5, text(1)), (5, text(2)))


def test_empty_table(spark, documents):
    docs = documents((1, "x")).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, sf, name):
    n = QUERIES[name](spark, sf).count()
    table = "pages" if name in ("op8_warc", "pages_language") else "embeddings" if name.startswith("op7_") else "documents"
    rows = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert n == rows if not name.startswith("op1_") else n > 0.5 * rows


def mixed_by_loops(docs, limit=2.0):
    """doc_id to how often mixing draws it: (doc_id, text, source) rows, weights to 95 % of the entropy of equal ones, every document
    once at least, no source over `limit` times."""
    words = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in docs]
    total = {}
    for (_, _, s), n in zip(docs, words, strict=True):
        total[s] = total.get(s, 0) + n
    total = {s: n for s, n in total.items() if n}
    size = sum(total.values())

    def weights(j):
        raw = {s: (n / size) ** (j / GRID) for s, n in total.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def bisect(good, lo, hi):  # the largest point that is good; good holds up to some point
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    entropy = lambda j: -sum(w * math.log(w) for w in weights(j).values())
    ratio = lambda j: (lambda r: max(r) / min(r))([w / total[s] for s, w in weights(j).items()])
    alpha = max(0, bisect(lambda j: entropy(j) >= 0.95 * math.log(len(total)), -1, GRID + 1))
    alpha = max(alpha, min(GRID, 1 + bisect(lambda j: ratio(j) > limit, -1, GRID + 1)))
    w, out = weights(alpha), {}
    least = min(x / total[s] for s, x in w.items())
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    for s, n in total.items():
        own = [(i, k, int(md5(42, i)[:15], 16)) for (i, _, q), k in zip(docs, words, strict=True) if q == s]
        budget = math.ceil(n * (w[s] / total[s] / least) - 1e-6)
        epochs, left = divmod(budget, n)
        place = lambda h: (md5(42, s, epochs, h >> 50), h >> 50, md5(42, s, epochs, h >> 50, h >> 40 & BLOCKS - 1), h >> 40 & BLOCKS - 1, h & (1 << 40) - 1)  # noqa: E731,B023
        drawn, full = set(), False
        for i, k, h in sorted(own, key=lambda x: place(x[2])):
            full = full or k > left
            if not full:
                left -= k
                drawn.add(i)
        for i, _, _ in own:
            out[i] = epochs + (i in drawn)
    return {i: n for i, n in out.items() if n}


def test_pipeline_equals_brute_force(spark, documents, tmp_path, piece_model):
    """run() against loops: every stage's brute-force version, one after the other."""
    import random

    import sentencepiece

    r = random.Random(3)
    en, de = test_langid.EN.split(), test_langid.DE.split()
    line = lambda words, n: " ".join(r.choice(words) + (str(r.randrange(30)) if r.random() < 0.4 else "") for _ in range(n))
    rows = [(k, "\n".join(line(en if k % 3 else de, r.randint(8, 14)) for _ in range(r.randint(2, 5))), f"s{k % 7 % 3}") for k in range(60)]
    shared = rows[4][1].split("\n")[0]
    rows += [(100, rows[1][1], "s0"), (101, rows[2][1].replace(" ", "  "), "s1"), (102, shared + "\n" + line(en, 12), "s2"), (103, None, "s0"), (104, "", "s1"), (105, "12 34 !", "s1"), (106, "щщщ жжж ыыы " * 20, "s2")]
    docs = documents(*rows).withColumn("lang", F.when(F.col("doc_id") >= 103, None).otherwise(F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    own = [tuple(x) for x in docs.select("doc_id", "text", "lang", "source", fold_of(F.col("text"), 2)).collect()]
    kept = [(x[0], x[1], x[3]) for x, v in zip(own, test_langid.brute_force(own), strict=True) if v[3]]
    lines = {d: (n, bad, t) for d, n, bad, t in test_line_dedup.expected([(i, t) for i, t, _ in kept])}
    kept = [(i, lines[i][2], s) for i, _, s in kept if not lines[i][1] or len(lines[i][1]) < lines[i][0]]
    groups = {i: c for i, _, c in test_simhash.expected([(i, t) for i, t, _ in kept])}
    kept = [x for x in kept if groups[x[0]] == x[0]]
    assert 40 < len(kept) < 62
    often = mixed_by_loops(kept)
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    want = sorted((i, s, library.encode(t)) for i, t, s in kept for _ in range(often.get(i, 0)))
    assert sorted((x["doc_id"], x["source"], x["ids"]) for x in p.run(spark, str(tmp_path)).collect()) == want


def test_stages_keep_columns_of_any_name(spark, documents):
    """Extra columns come through every stage, whatever they are called; so do several rows without an id."""
    clashes = ["_lang", "_host0", "_declared", "_text", "_ll", "_prior", "_row", "_lines", "_id", "_m", "_draw", "_s", "fp", "node", "root", "tie", "position", "block"]
    text = lambda k: test_langid.EN + " ".join(f"word{k}x{j}" for j in range(40))
    docs = documents(*((k if k < 8 else None, text(k), f"s{k % 2}") for k in range(12)))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.md5("text")) for c in clashes})
    for name, stage in p.STAGES:
        replaced = {"language_id": ["_lang"], "line_dedup": ["_lines"], "simhash": [], "mixing": ["_draw"], "sentencepiece": []}[name]
        out = stage(spark, docs, "")
        rows = out.collect()
        assert len(rows) >= 12 and sum(x["doc_id"] is None for x in rows) >= 4, name
        for c in clashes:
            assert c in replaced or all(x[c].startswith(c) for x in rows), (name, c)
