"""Schemas of the data model, and validation of rows against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The edge types a graph may have (fixed values).
EDGE_TYPES = ["DEFINES", "IMPORTS", "CALLS", "MODIFIES", "REFERENCES", "IMPLEMENTS", "EXTENDS", "RETURNS_TYPE", "ADR_RELATED"]

NODES = T.StructType().add("id", "string", False).add("symbol", "string", False).add("kind", "string", False).add("file_path", "string", False).add("line_start", "integer").add("line_end", "integer").add("created_at", "long")
EDGES = T.StructType().add("id", "string", False).add("source_id", "string", False).add("target_id", "string", False).add("edge_type", "string", False).add("file_path", "string").add("line", "integer").add("created_at", "long")
IMPORT_DOCUMENT = T.StructType().add("nodes", T.ArrayType(T.StructType(NODES.fields[:6]))).add("edges", T.ArrayType(T.StructType(EDGES.fields[1:6])))
SIGNALS = T.StructType().add("file_path", "string").add("signal_type", "string").add("timestamp", "long").add("weight", "double")
CANDIDATES = T.StructType().add("file_path", "string").add("symbol_id", "string").add("relevance_score", "double").add("hotspot", "double").add("distance", "integer").add("source", "string").add("tokens", "long").add("priority", "double")
RULES = T.StructType().add("name", "string").add("type", "string").add("from", "string").add("cannot_import", T.ArrayType(T.StringType())).add("severity", "string").add("whitelist", T.ArrayType(T.StringType()))
VIRTUAL_EDGES = T.StructType().add("source_repo", "string").add("source_symbol", "string").add("target_repo", "string").add("target_symbol", "string").add("edge_type", "string").add("contract_type", "string").add("exact_match", "double").add("signature_similarity", "double").add("contract_bonus", "double").add("confidence", "double").add("confidence_level", "string")


def absent(c: Column) -> Column:
    """Whether a text counts as null on import: null, empty, or the words null and NULL."""
    return c.isNull() | c.isin("", "null", "NULL")


def bad_nodes(nodes: DataFrame) -> DataFrame:
    """The rows that lack id, symbol, kind or file_path."""
    return nodes.filter(absent(F.col("id")) | absent(F.col("symbol")) | absent(F.col("kind")) | absent(F.col("file_path")))


def bad_edges(edges: DataFrame) -> DataFrame:
    """The rows that lack an end, or whose type is unknown."""
    return edges.filter(absent(F.col("source_id")) | absent(F.col("target_id")) | ~F.coalesce(F.col("edge_type").isin(EDGE_TYPES), F.lit(False)))
