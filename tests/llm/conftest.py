import os

import pytest

from weftline.llm.queries import tokenizer_path


@pytest.fixture(scope="session")
def piece_model():
    path = tokenizer_path("piece_bpe_32k.model")
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="session")
def word_bpe():
    path = tokenizer_path("word_bpe_49k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    with open(path, encoding="utf-8") as f:
        return f.read()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


