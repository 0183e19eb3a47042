import sentencepiece
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import sentencepiece_fst as m

ALPHABET = "abcdest  \n.,!▁²éß漢字😀'\"()<>0x1A-_=\t\0"
_KEPT = {}


def pair(model):
    if not _KEPT:
        _KEPT["own"] = m.Transducer(model)
        _KEPT["library"] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _KEPT["own"], _KEPT["library"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(ALPHABET, max_size=60), st.text(max_size=30)))
def test_equals_the_library(piece_model, text):
    own, library = pair(piece_model)
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids) == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.text("abcdest é漢", max_size=9))
def test_neighbours_leave_one_path(piece_model, text):
    """Of all ways to cut a text into pieces, the neighbour machine of a byte-pair model accepts the one that merging gives."""
    own, _ = pair(piece_model)
    text = own.normalise(text)
    found = []

    def cut(done, rest):
        if not rest:
            found.append(done)
        for k in range(1, len(rest) + 1):
            piece = rest[:k]
            if (piece in own.score or k == 1) and own.may_follow(done[-1] if done else "", piece):
                cut([*done, piece], rest[k:])

    cut([], text)
    assert found == [own.merged(text)] == [own.path(text)]


def test_unigram_weights(piece_model):
    """Of a small unigram model the path of the best score is taken."""
    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        import struct

        t = text.encode()
        return field(1, field(1, t) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in [("▁", -5), ("a", -2), ("b", -2), ("ab", -3), ("▁a", -1), ("c", -9)]) + field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0]))
    own = m.Transducer(model)
    assert [own.pieces[i] for i in own.encode("ab")] == ["▁a", "b"] and [own.pieces[i] for i in own.encode("bab")] == ["▁", "b", "ab"]
    assert own.encode("z") == [1, 0]


def test_documents(spark, documents, piece_model):
    clashes = ["_text", "c0", "c1", "Ids_"]
    docs = documents(*ODD).withColumn("ids", F.lit("clash")).withColumns({c: F.concat(F.lit(c), "lang") for c in clashes})
    assert all(r[c] == f"{c}en" for r in m.encode_documents(docs, piece_model).collect() for c in clashes)
    rows = m.encode_documents(docs, piece_model).collect()
    _, library = pair(piece_model)
    assert len(rows) == len(ODD) and all(r["ids"] == library.encode(r["text"] or "") and r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    assert m.encode_documents(docs.limit(0), piece_model).count() == 0
    assert m.encode_documents(docs, piece_model, keep=["doc_id"]).columns == ["doc_id", "ids", "n_ids", "round_trip"]
