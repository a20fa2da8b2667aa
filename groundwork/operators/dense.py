"""Vectors of chunks and exact nearest neighbours in tiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import embed
from ..settings import Embedder, VectorStore
from .ranking import DIGITS, by_score, top_k

#: Chunks and questions of one tile, about; each row is copied once for each tile that it is in, so tiles are large.
CHUNKS, QUESTIONS = 32_768, 8_192
#: Tables too small for a tile for each core are dealt into tiles of so many chunks and questions.
SMALL = 8_192, 1_024
#: Up to so many queries go to every task.
FEW = 1_024
#: Scores that a task holds at once.
SCORES = 1 << 23


def vectors(texts: DataFrame, id_cols: list[str], text_col: str, how: Embedder) -> DataFrame:
    """``id_cols, vec``."""
    if how.backend == "sentence-transformers":
        return texts.select(*id_cols, _model_embedding(how.model)(F.col(text_col)).alias("vec"))
    return texts.select(*id_cols, embed(F.col(text_col), how.dim).alias("vec"))


def _model_embedding(model: str):
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as missing:
        raise ImportError("the sentence-transformers backend needs the package sentence_transformers") from missing
    from collections.abc import Iterator

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
        for texts in parts:
            yield pd.Series(list(loaded.encode(texts.tolist(), normalize_embeddings=True).astype(np.float32)))

    return run


def store(how: VectorStore) -> None:
    """Only the in-memory kind is there."""
    if how.backend != "memory":
        raise NotImplementedError(f"vector store {how.backend} is not there; use memory")


def checked(rows: DataFrame, dim: int) -> DataFrame:
    """The rows, or an error in one whose vector has another length."""
    ok = F.size("vec") == dim
    return rows.withColumn("vec", F.when(ok, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components"))))


def blocks(n_queries: int, n_entries: int, cores: int) -> tuple[int, int]:
    """Into how many blocks queries and entries are dealt: as few as memory allows, but a tile for each core if small tiles give so many."""
    n_q, n_e = (max(1, math.ceil(n / size)) for n, size in ((n_queries, QUESTIONS), (n_entries, CHUNKS)))
    most_q, most_e = (max(1, math.ceil(n / size)) for n, size in ((n_queries, SMALL[1]), (n_entries, SMALL[0])))
    n_e = max(n_e, min(most_e, math.ceil(cores / n_q)))
    return max(n_q, min(most_q, math.ceil(cores / n_e))), n_e


def _scanned(asked: pd.DataFrame, kind: str, entries: DataFrame, k: int) -> DataFrame:
    """``question_id, chunk_id, score``: the first ``k`` that each task has read for each of a few queries."""
    if not len(asked):
        return entries.sparkSession.createDataFrame([], f"question_id {kind}, chunk_id {entries.schema['chunk_id'].dataType.simpleString()}, score double")
    left, names = np.stack(asked["vec"]).astype(np.float64), asked["question_id"].tolist()

    def run(batches):
        first: list[list] = [[] for _ in names]
        for whole in batches:
            for start in range(0, len(whole), max(1, SCORES // len(names))):
                batch = whole[start : start + max(1, SCORES // len(names))]
                ids = batch["chunk_id"].to_numpy()
                place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                products = left @ np.stack(batch["vec"]).astype(np.float64).T
                for own, row in zip(first, products):
                    score = np.round(row, DIGITS)
                    least = np.partition(score, len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf
                    at = np.flatnonzero(score >= max(least, own[-1][0] * -1 if len(own) == k else -np.inf))
                    at = at[np.lexsort((place[at], -score[at]))][:k]
                    own += zip((-score[at]).tolist(), ids[at].tolist(), row[at].tolist())
                    own[:] = sorted(own, key=lambda x: x[:2])[:k]
        if any(first):
            rows = [(name, near, score) for name, own in zip(names, first) for _, near, score in own]
            yield pd.DataFrame(rows, columns=["question_id", "chunk_id", "score"])

    rows = entries.select("chunk_id", "vec")
    return rows.mapInPandas(run, f"question_id {kind}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double")


def nearest(queries: DataFrame, entries: DataFrame, k: int, source: str = "dense") -> DataFrame:
    """``question_id, chunk_id, rank, score, source``: the largest inner products in double precision, ties by chunk id.

    ``queries`` has ``question_id, vec``, ``entries`` has ``chunk_id, vec``.
    Both are dealt in blocks; a task multiplies two blocks, some questions at a
    time, and keeps its own first ``k``, so no pair of rows is ever a row.  Up to
    ``FEW`` queries go to every task instead, and entries don't move.
    """
    if k <= 0:
        none = queries.sparkSession.createDataFrame([], "question_id string, chunk_id string, rank int, score double, source string")
        return none
    asked = queries.select("question_id", "vec").limit(FEW + 1).toPandas()
    if len(asked) <= FEW:
        near = _scanned(asked, queries.schema["question_id"].dataType.simpleString(), entries, k)
        return top_k(near, ["question_id"], by_score("chunk_id"), k).select("question_id", "chunk_id", "rank", "score", F.lit(source).alias("source"))
    n_q, n_e = blocks(queries.count(), entries.count(), queries.sparkSession.sparkContext.defaultParallelism)
    q = queries.select("question_id", "vec", F.pmod(F.xxhash64("question_id"), F.lit(n_q)).alias("qb")).withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(n_e - 1))))
    e = entries.select("chunk_id", F.col("vec").alias("evec"), F.pmod(F.xxhash64("chunk_id"), F.lit(n_e)).cast("int").alias("eb"))
    e = e.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def tile(questions: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(chunks):
            return pd.DataFrame({"question_id": [], "chunk_id": [], "score": []}, dtype=object)
        left, right = (np.stack(x).astype(np.float64) for x in (questions["vec"], chunks["evec"]))
        ids = chunks["chunk_id"].to_numpy()
        place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        asked, near, scores = [], [], []
        strip = max(1, SCORES // len(ids))
        products = (row for i in range(0, len(left), strip) for row in left[i : i + strip] @ right.T)
        for own, row in zip(questions["question_id"], products):
            score = np.round(row, DIGITS)
            at = np.arange(len(ids))
            if len(at) > k:
                at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            at = at[np.lexsort((place[at], -score[at]))][:k]
            asked += [own] * len(at)
            near += ids[at].tolist()
            scores += row[at].tolist()
        return pd.DataFrame({"question_id": asked, "chunk_id": near, "score": scores})

    q_type, e_type = queries.schema["question_id"].dataType.simpleString(), entries.schema["chunk_id"].dataType.simpleString()
    near = q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInPandas(tile, f"question_id {q_type}, chunk_id {e_type}, score double")
    return top_k(near, ["question_id"], by_score("chunk_id"), k).select("question_id", "chunk_id", "rank", "score", F.lit(source).alias("source"))
