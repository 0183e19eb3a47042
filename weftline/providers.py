"""Pluggable rerankers and embedders. The engine itself never calls out; a deterministic stand-in of each is built in."""

from __future__ import annotations

import hashlib
import importlib
import os
import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weftline.operators import retrieval

Reranker = Callable[[str, DataFrame], DataFrame]
RERANKERS: dict[str, Reranker] = {"mock": lambda query, candidates: retrieval.mock_scores(candidates)}
EMBEDDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_reranker(name: str, run: Reranker) -> None:
    """run(query, candidates with position) gives index, score."""
    RERANKERS[name] = run


def pick(preferred: list[str], known: dict) -> str | None:
    """The first preferred name that is registered."""
    return next((n for n in preferred if n in known), None)


def rerank(query: str, candidates: DataFrame, provider: str | None = None, limit: int = 10, tries: int = 2) -> tuple[DataFrame, str]:
    """(reranked candidates, how): by a provider, tried again if it fails, else by names, short paths and age.

    candidates: file_path, mtime, position.
    """
    reason = "disabled"
    run = RERANKERS.get(provider) if provider else None
    if provider and run is None:
        reason = "unknown provider"
    for _ in range(tries if run else 0):
        try:
            return retrieval.apply_scores(candidates, run(query, candidates), limit), provider
        except Exception as e:  # noqa: BLE001  whatever a provider raises, the query goes on without it
            reason = type(e).__name__
    return retrieval.rerank_by_name(candidates, query, limit).withColumnRenamed("rerank", "rank"), f"heuristic: {reason}"


def hashed_embedding(rows: DataFrame, dims: int = 64) -> DataFrame:
    """hash, embedding: words hashed to signed dimensions, as a stand-in for a model."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                v = np.zeros(dims)
                for w in (text or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dims] += 1 if h >> 63 else -1
                out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
            yield pd.DataFrame({"hash": pdf["hash"], "embedding": out})

    return rows.select("hash", "text").mapInPandas(run, "hash string, embedding array<double>")


EMBEDDERS["hashed"] = hashed_embedding


def semantic_search(files: DataFrame, index: DataFrame | None, query: str, provider: str | None = "hashed", k: int = 5, threshold: float = 0.3) -> DataFrame:
    """file, score, source: by vectors if there are an index and an embedder, else by keywords."""
    from pyspark.sql import functions as F

    embed = EMBEDDERS.get(provider) if provider else None
    if embed and index is not None:
        spark = files.sparkSession
        row = embed(spark.createDataFrame([("q", query)], "hash string, text string")).first()
        return retrieval.vector_topk(index, row["embedding"], k, threshold, key="file").select("file", "score", F.lit("vector").alias("source"))
    return retrieval.keyword_topk(files, query, k, key="file").select("file", "score", F.lit("keyword").alias("source"))


#: Tools by name; an environment variable may name another one for each (see runner_variable).
TOOLS: dict[str, Callable] = {"search": semantic_search, "rerank": rerank}


def runner_variable(tool: str) -> str:
    """The environment variable that replaces a tool: its name in capitals, with _ for all but letters, digits and _."""
    return "WEFTLINE_RUNNER_" + re.sub("[^A-Z0-9_]", "_", tool.upper())


def tool_runner(tool: str, env: Mapping[str, str] | None = None) -> Callable:
    """What runs a tool: the function that its variable names as module:function, else the registered one."""
    named = (os.environ if env is None else env).get(runner_variable(tool))
    if not named:
        if tool not in TOOLS:
            raise KeyError(f"no tool {tool}")
        return TOOLS[tool]
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function)
