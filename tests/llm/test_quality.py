import collections
import re

from conftest_llm import ODD
from pyspark.sql import functions as F

from weftline.llm import quality as q

WORD = "[^\x20\x09-\x0d]+"


def metrics(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(win)
    rep = len({i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)


def test_metrics(documents):
    many = " ".join(f"a{k} b{k} c{k}" for k in range(40))
    rows = [*ODD, (20, "a b c d a b c\n# x\na b c d a b c\n"), (21, many + " " + many), (22, " ".join(f"u{k}" for k in range(80)) + " *|<>&%$#"), (23, "one two"), (24, "p q r p q r p q r p")]
    got = {(r["doc_id"], r["n_words"]): r for r in q.quality_rules(documents(*rows)).collect()}
    for i, t in rows:
        m = metrics(t)
        r = got[i, m[0]]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == m
    assert got[22, 81]["kept"] and not got[21, 240]["kept"] and q.quality_rules(documents(*rows)).count() == len(rows)


def test_frequent_lines_are_removed_by_host(documents):
    unique = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    menu = "Home  About Contact " + " ".join(f"m{j}" for j in range(60))
    rows = [(k, f"{unique(k)}\n{menu.upper() if k % 2 else menu}", "a") for k in range(60)] + [(100 + k, menu + f"\nshort {k}", "a") for k in range(3)] + [(200, menu + "\nshort", "b"), (300, menu, None)]
    got = {r["doc_id"]: r for r in q.quality_rules(documents(*rows)).collect()}
    assert all(got[k]["kept"] and got[k]["n_removed_words"] == 63 for k in range(60))
    assert not got[101]["kept"] and got[200]["kept"] and got[200]["n_removed_words"] == 0 and got[300]["kept"]


def test_repeated_rows_lose_each_line_once(documents):
    line = " ".join(f"m{j}" for j in range(60))
    got = q.quality_rules(documents(*[(1, f"{line}\nx y")] * 60)).collect()
    assert len(got) == 60 and {r["n_removed_words"] for r in got} == {62}


def test_empty_table_and_clashes(documents):
    docs = documents(*ODD).withColumn("n_words", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("_line", F.lit(2))
    assert q.quality_rules(docs).count() == len(ODD) and q.quality_rules(docs.limit(0)).count() == 0
    assert q.base_metrics(docs).count() == len(ODD)
