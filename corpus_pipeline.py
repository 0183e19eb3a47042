"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.langid import identify
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.mixing import mix_sources
from weftline.llm.queries import piece_model
from weftline.llm.sentencepiece_fst import encode_documents
from weftline.llm.shared import cut
from weftline.llm.simhash import first_of_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is in one of the corpus' languages, by the posterior from text, declared language and source."""
    return identify(docs).filter("_lang.accepted").drop("_lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that match an earlier one; documents that lose all their lines go. n_chars follows the text."""
    out = dedup_lines(docs).filter((F.size("_lines.removed") == 0) | (F.size("_lines.removed") < F.col("_lines.n_lines")))
    return out.drop("_lines").withColumn("n_chars", F.length("text").cast("long"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id, null ones last) of each group of near-duplicates; doc_ids may be null or repeated."""
    return first_of_groups(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's weight asks for: all at least once, and no source over twice."""
    return mix_sources(docs, budget=None, target_entropy=0.95, max_repetition=2.0).drop("_draw")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids in place of their text."""
    return encode_documents(docs, piece_model(), keep=[c for c in docs.columns if c != "text"])


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("sentencepiece", sentencepiece)]
#: No SQL: line sets, fingerprints and pieces can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
