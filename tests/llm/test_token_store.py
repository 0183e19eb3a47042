import zlib

import numpy as np
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import token_store as m

_KEPT = {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700).map(sorted))
def test_elias_fano(values):
    e, size = m.EliasFano.from_buffer(m.EliasFano.of(np.array(values, np.uint64)).to_bytes() + b"rest")
    assert e.all().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert e[i] == values[i]
    with pytest.raises(IndexError):
        e[len(values)]


def test_elias_fano_space_and_gaps():
    v = np.cumsum(np.random.default_rng(0).integers(0, 2000, 50_000))
    data = m.EliasFano.of(v).to_bytes()
    assert len(data) < 50_000 * 2  # against 8 bytes a number
    e, _ = m.EliasFano.from_buffer(data)
    assert all(e[i] == v[i] for i in range(0, 50_000, 997))
    gap = np.array([*range(300), *range(10**9, 10**9 + 300)])
    e, _ = m.EliasFano.from_buffer(m.EliasFano.of(gap).to_bytes())
    assert [e[i] for i in range(600)] == gap.tolist()


def tokenizer(word_bpe):
    if not _KEPT:
        _KEPT["own"], _KEPT["library"] = m.WordEncoder(word_bpe, 1), Tokenizer.from_str(word_bpe)
    return _KEPT["own"], _KEPT["library"]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("abAB'stre.,!  \n\t\x1ćéÉßİı漢Σς1²ſ<|>$-’ ", max_size=25), st.text(max_size=20), st.sampled_from(["a<|endoftext|>b", "A<|ENDOFTEXT|>", "it's. We'LL, x", "H̱ ẖ.", "3.14, a.b. c.\n"])))
def test_words_equal_whole_texts(word_bpe, text):
    own, library = tokenizer(word_bpe)
    ids, n = own.encode([text, None])
    assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1, 1] and n.tolist() == [len(ids) - 1, 1]


def test_round_trip(spark, documents, word_bpe):
    _, library = tokenizer(word_bpe)
    rows = [*ODD, (-5, "negative id"), (1 << 40, "large id")]
    docs = documents(*rows).withColumn("start", F.lit("clash")).withColumn("tie", F.lit(1))
    got = m.encode_round_trip(docs, word_bpe).orderBy("start").collect()
    tie = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert m.encode_round_trip(documents(*rows).limit(0), word_bpe).count() == 0


def test_select_reads_one_document(spark, documents, word_bpe, tmp_path):
    own, library = tokenizer(word_bpe)
    manifest = m.write_tokens(documents(*((k, f"text number {k}") for k in range(50))).coalesce(1), f"file://{tmp_path}", word_bpe, width=2).collect()
    at = 0
    for row in manifest:
        shard = m.Shard(m.get_bytes(row["file"]))
        for i, d in enumerate(shard.doc_ids()):
            assert shard.tokens(i).tolist() == [*library.encode(f"text number {d}", add_special_tokens=False).ids, 1]
            at += 1
    assert at == 50


def test_too_narrow_ids_are_refused(documents, word_bpe, tmp_path):
    with pytest.raises(ValueError, match="can't hold"):
        m.write_tokens(documents((1, "x")), f"file://{tmp_path}", word_bpe, end_id=1 << 16, width=2)
    with pytest.raises(ValueError, match="can't hold"):
        m.write_tokens(documents((1, "x")), f"file://{tmp_path}", word_bpe, width=1)


def test_other_tokenizers_get_whole_texts(word_bpe):
    """One that merges over white space is not encoded word by word."""
    from tokenizers import models

    merging = Tokenizer(models.BPE({"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4}, [("a", " "), ("a ", "b")]))
    own = m.WordEncoder(merging.to_str(), 9)
    ids, n = own.encode(["a b", "ab", None, ""])
    assert ids.tolist() == [4, 9, 0, 2, 9, 9, 9] and n.tolist() == [2, 3, 1, 1]


def test_equal_ids_are_split(spark, documents, word_bpe, tmp_path):
    """Rows without an id, or with one, are no single partition."""
    docs = documents(*((None if k % 2 else 7, f"text {k}") for k in range(2000)))
    parts = {r["part"] for r in m.write_tokens(docs, f"file://{tmp_path}", word_bpe).collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
