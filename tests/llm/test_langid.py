import math
import re
from collections import Counter

import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from weftline.llm import langid as m

EN = "the quick brown fox jumps over the lazy dog and then they were with the others in that house "
DE = "der schnelle braune fuchs springt über den faulen hund und dann waren sie mit den anderen in jenem haus "
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def corpus(spark):
    rows = [(k, (EN if k % 2 else DE) * (k % 5 + 1), "en" if k % 2 else "de", f"h{k % 4}") for k in range(80)]
    rows += [(100, "fox", None, "h1"), (101, "", "en", "h1"), (102, None, None, None), (103, "12345 !!!", "en", "h0"), (104, "щщщ жжж ыыы " * 30, None, "h9"), (105, EN * 2000, None, "h0")]
    return spark.createDataFrame(rows, SCHEMA)


def test_accuracy_and_rejections(corpus):
    got = {r["doc_id"]: r["_lang"] for r in m.identify(corpus).collect()}
    assert all(got[k]["language"] == ("en" if k % 2 else "de") and got[k]["accepted"] for k in range(80))
    assert got[100]["language"] == "en" and got[105]["language"] == "en"
    assert [got[k]["accepted"] for k in (101, 102, 103, 104)] == [False] * 4 and got[102]["language"] == "und"


def test_evidence_moves_the_posterior(spark, corpus):
    profiles = m.fit_profiles(corpus, "text", "lang")
    assert profiles[0] == ["de", "en"]
    short = spark.createDataFrame([(k, "in", d, s) for k, (d, s) in enumerate([("de", "a"), ("en", "b"), (None, None)])] + [(10 + k, DE, "de", "a") for k in range(30)] + [(50 + k, EN, "en", "b") for k in range(30)], SCHEMA)
    got = {r["doc_id"]: r["_lang"] for r in m.identify(short, profiles=profiles).collect()}
    assert got[0]["language"] == "de" and got[1]["language"] == "en"


def test_priors_are_smoothed_by_level(spark):
    counts = spark.createDataFrame([("s1", "h1", 100.0, 0.0), ("s1", "h2", 0.0, 1.0), ("s2", "h3", 0.0, 50.0)], "a string, b string, n0 double, n1 double")
    got = {r["b"]: r["_prior"] for r in m.host_priors(counts, ["a", "b"], 2).collect()}
    assert got["h1"][0] > got["h1"][1] and got["h3"][1] > got["h3"][0]
    assert got["h2"][0] > got["h2"][1]  # one row does not outweigh its site


def test_pages(spark, corpus):
    profiles = m.fit_profiles(corpus, "text", "lang")
    page = lambda lang, text: f"<html lang='{lang}'><script>var x</script><p>{text}</p></html>"
    pages = spark.createDataFrame([(1, "http://x.example.de/a", page("de", DE)), (2, "https://y.example.com", page("en", EN)), (3, None, None), (4, "bad", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["_lang"] for r in m.identify_pages(pages, profiles).collect()}
    assert got[1]["language"] == "de" and got[2]["language"] == "en" and not got[3]["accepted"] and not got[4]["accepted"]


def test_odd_rows(spark, documents):
    docs = documents(*ODD).withColumn("_lang", F.lit("clash"))
    assert m.identify(docs).count() == len(ODD)
    assert m.identify(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert m.identify(none).filter("_lang.accepted").count() == 0


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = m.fit_profiles(docs.filter("doc_id % 2 = 0"), "text", "lang")
    got = m.identify(docs.filter("doc_id % 2 = 1"), profiles=profiles, declared=None, keep=["lang"]).filter("length(lang) > 0")
    assert got.agg(F.avg((F.col("_lang.language") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_every_label_is_fitted(spark):
    word = lambda k: f"{chr(97 + k // 10)}{chr(107 + k % 10)}q" * 3 + " "
    docs = spark.createDataFrame([(k, word(k) * 20, f"l{k:02}", "h") for k in range(70) for _ in range(1 if k == 69 else 2)], SCHEMA)
    langs, profiles = m.fit_profiles(docs, "text", "lang")
    assert langs == [f"l{k:02}" for k in range(70)] and profiles.shape == (1, 70, m.BUCKETS)


CLASHES = ["_host0", "_declared", "_suffix", "_ll", "_text", "_prior", "_p", "_row", "_h", "_post", "_l__declared", "_fold", "n0"]


def test_clashing_names_come_through(spark, corpus):
    docs = corpus.select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in CLASHES))
    got = {r["doc_id"]: r for r in m.identify(docs).collect()}
    want = {r["doc_id"]: r["_lang"] for r in m.identify(corpus).collect()}
    assert m.identify(docs).columns == [*docs.columns, "_lang"] and len(got) == corpus.count()
    assert all(got[k][c] == f"{c}{k}" for k in got for c in CLASHES) and all(got[k]["_lang"] == want[k] for k in want)


def grams(text):
    b = (" " + text + " ").lower().encode() if text else b"   "
    b = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in b)
    blank = 0x202020 * 0x9E3779B1 % 2**32 >> 16
    codes = [(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32 >> 16 for i in range(len(b) - 2)]
    return [c for c in codes if c != blank]


def text_logs(texts, counts, langs):
    """Tempered log likelihoods of texts under each language and und; counts(i, lang): the 3-grams that the i-th text is scored by."""
    out = []
    for n, text in enumerate(texts):
        g, one = grams(text), []
        for x in langs:
            c = counts(n, x)
            total = sum(c.values()) + 0.5 * m.BUCKETS
            one.append(sum(math.log((c[i] + 0.5) / total) for i in g))
        one.append(-len(g) * math.log(m.BUCKETS))
        one = [v * min(1, m.EFFECTIVE / max(len(g), 1)) for v in one]
        if not g:
            one[-1] += 50
        out.append(one)
    return out


def fused(logs, hosts, values, classes, least=0.5):
    """(language, confidence, text language, accepted) by loops, from texts' logs, hosts (tuples, the coarsest level first) and the
    values of other evidence (a list for each kind)."""
    def shares(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    soft, k, a = [shares(v) for v in logs], len(classes), m.PRIOR_ROWS

    def prior(host):
        own = [sum(p[i] for p, h in zip(soft, hosts, strict=True) if h[: len(host)] == host) for i in range(k)]
        up = prior(host[:-1]) if host else [1 / k] * k
        return [(own[i] + a * up[i]) / (sum(own) + a) for i in range(k)]

    out = []
    for n, v in enumerate(logs):
        p = prior(hosts[n])
        v = [x + math.log(y) for x, y in zip(v, p, strict=True)]
        for kind in values:
            if kind[n] is None:
                continue
            have = [j for j, x in enumerate(kind) if x is not None]
            said = [sum(soft[j][c] for j in have) for c in range(k)]
            own = [sum(soft[j][i] for j in have if kind[j] == kind[n]) for i in range(k)]
            v = [x + math.log((own[i] + a * sum(own) / sum(said)) / (said[i] + a)) for i, x in enumerate(v)]
        p = shares(v)
        best = p.index(max(p))
        out.append((classes[best], max(p), classes[logs[n].index(max(logs[n]))], classes[best] != "und" and max(p) >= least))
    return out


def brute_force(rows):
    """identify() with loops: rows of (id, text, label, host, fold)."""
    langs = sorted({r[2] for r in rows if r[2] not in (None, "und")})
    counts = {(x, f): Counter() for x in langs for f in (0, 1)}
    for _, text, label, _, fold in rows:
        if label in langs:
            counts[label, fold].update(grams(text))
    logs = text_logs([r[1] for r in rows], lambda n, x: counts[x, 1 - rows[n][4]] or counts[x, 0] + counts[x, 1], langs)
    return fused(logs, [(r[3],) for r in rows], [[r[2] for r in rows]], [*langs, "und"])


def check(got, want, row):
    assert got[0::2] == want[0::2] and got[3] == want[3], row
    assert got[1] == pytest.approx(want[1], abs=1e-4), row


def test_equals_brute_force(spark, corpus):
    docs = corpus.filter("doc_id <> 105").unionByName(spark.createDataFrame([(200 + k, t, lab, h) for k, (t, lab, h) in enumerate([("in", "de", "h0"), ("in haus und house", None, "h1"), ("und", "und", "h2"), ("le chat noir " * 9, "fr", "h2"), ("le chien noir dort " * 7, "fr", None), ("le chat", None, None)])], SCHEMA))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", m.fold_of(F.col("text"), 2)).collect()]
    got = {r["doc_id"]: tuple(r["_lang"]) for r in m.identify(docs).collect()}
    for row, want in zip(rows, brute_force(rows), strict=True):
        check(got[row[0]], want, row)


def test_pages_equal_brute_force(spark, corpus, sf):
    """pages_language over the smallest table: markup, suffix and two levels of hosts against loops."""
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet").limit(150).cache(), spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.limit(40).unionByName(spark.createDataFrame([(-1, None, None), (-2, "bad", "<HTML LANG=fr>le"), (-3, "http://u@www.x.de:80/a", "<script>x")], pages.schema)).cache()
    langs, counts = sorted({r["lang"] for r in docs.collect()} - {None, "und"}), {}
    for r in docs.collect():
        if r["lang"] in langs:
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    rows = []
    for r in pages.collect():
        html, url = r["html"] or "", r["url"] or ""
        body = re.sub("<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)", " ", html))
        markup = re.search(r"""(?i)<html[^>]*\blang=["']?([A-Za-z]+)""", html)
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url)
        host = host[1].lower() if host else None
        rows.append((r["page_id"], body, markup[1].lower() if markup else None, host and host.split(".")[-1], (host and ".".join(host.split(".")[-2:]), host)))
    logs = text_logs([r[1] for r in rows], lambda n, x: counts[x], langs)
    want = fused(logs, [r[4] for r in rows], [[r[2] for r in rows], [r[3] for r in rows]], [*langs, "und"])
    got = {r["page_id"]: tuple(r["_lang"]) for r in m.identify_pages(pages, m.fit_profiles(docs, "text", "lang", sample=10**9)).collect()}
    for row, w in zip(rows, want, strict=True):
        check(got[row[0]], w, row[0])


def test_a_label_counts_as_declared_language_only(spark):
    """A text that no other row speaks for isn't known by its own label."""
    docs = spark.createDataFrame([(k, (EN if k % 2 else DE) * 3 + f"x{k}", "en" if k % 2 else "de", "h") for k in range(60)] + [(99, "щщщ жжж ыыы " * 30, "en", "h")], SCHEMA)
    got = {r["doc_id"]: r["_lang"] for r in m.identify(docs).collect()}
    assert got[99]["text_language"] == "und" and all(got[k]["text_language"] == ("en" if k % 2 else "de") for k in range(60))


def test_unclosed_elements_take_linear_time(spark, corpus):
    profiles = m.fit_profiles(corpus, "text", "lang")
    pages = spark.createDataFrame([(1, "http://a.de", "<p>" + DE + "</p>" + "<script>" * 60_000)], "page_id long, url string, html string")
    assert m.identify_pages(pages, profiles).first()["_lang"]["language"] == "de"
