"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.embed_dedup import near_vectors
from weftline.llm.kneser_ney import score_held_out
from weftline.llm.langid import fit_profiles, identify, identify_pages
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.mixing import mix_sources
from weftline.llm.quality import quality_rules
from weftline.llm.sentencepiece_fst import encode_documents
from weftline.llm.simhash import near_duplicates
from weftline.llm.token_store import encode_round_trip
from weftline.llm.warc import archive_round_trip


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file is: in the folder that WEFTLINE_TOKENIZERS names, else where the public_tokenizers package has it."""
    folder = os.environ.get("WEFTLINE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    drawn = mix_sources(docs, budget=1.0, target_entropy=0.95, max_repetition=4.0)
    return drawn.select("doc_id", "source", "_draw.*")


def piece_model() -> bytes:
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), piece_model(), keep=["doc_id"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "_lines.*", F.length("text").alias("n_chars_left"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"), order=3)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return encode_round_trip(table(spark, sf_dir, "documents"), f.read(), end_id=1, width=2)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, keep=["doc_id"]).select("doc_id", "_lang.*").withColumnRenamed("accepted", "kept")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = fit_profiles(table(spark, sf_dir, "documents"), "text", "lang")
    return identify_pages(table(spark, sf_dir, "pages"), profiles).select("page_id", "_lang.*").withColumnRenamed("accepted", "kept")


QUERIES = {"op1_mix_sources": op1, "op2_sentencepiece": op2, "op3_line_dedup": op3, "op4_kneser_ney": op4, "op5_simhash": op5, "op6_quality_rules": op6, "op7_embedding_dedup": op7, "op8_warc": op8, "op9_token_store": op9, "op10_language_id": op10, "pages_language": pages_language}
