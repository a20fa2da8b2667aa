"""Batches of questions against an index: retrieve, fuse, rerank, answer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row, functions as F

from .. import schemas
from ..operators import dense, generation, ranking, sparse
from ..settings import Settings


def query_vectors(questions: DataFrame, how: Settings) -> DataFrame:
    return dense.vectors(questions, ["question_id"], "question", how.embedder)


def oracle(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of each question's relevant documents, in corpus order, with score 1; documents that aren't there drop out."""
    wanted = questions.select("question_id", F.explode(F.array_distinct("relevant_doc_ids")).alias("doc_id"))
    rows = wanted.join(chunks.select("doc_id", "chunk_id", "doc_seq", "ordinal"), "doc_id").withColumn("score", F.lit(1.0))
    return ranking.top_k(rows, ["question_id"], [F.col("doc_seq"), F.col("ordinal")], 2**31 - 1).select("question_id", "chunk_id", "rank", "score", F.lit("oracle").alias("source"))


def retrieve(questions: DataFrame, index: dict[str, DataFrame], how: Settings, top_k: int | None = None) -> DataFrame:
    """``question_id, chunk_id, rank, score, source``, ``max(candidate_k, top_k)`` deep, before reranking."""
    r = how.retrieval
    if r.mode == "oracle":
        return oracle(questions, index["chunks"])
    k = max(r.candidate_k, top_k or r.top_k)
    found = []
    if r.bm25.enabled:
        found.append(sparse.search(questions, index, k))
    if r.dense.enabled:
        found.append(dense.nearest(query_vectors(questions, how), index["vectors"], k))
    if not found:
        return questions.sparkSession.createDataFrame([], schemas.RANKING)
    return found[0] if len(found) == 1 else ranking.reciprocal_rank_fusion(found, k, r.fusion.rrf_k)


def rerank(found: DataFrame, questions: DataFrame, index: dict[str, DataFrame], how: Settings) -> DataFrame:
    if how.retrieval.rerank.backend == "cross-encoder":
        from ..operators.cross_encoder import rerank_by_model

        return rerank_by_model(found, questions, index["chunks"], how.retrieval.rerank.model)
    return ranking.rerank(found, questions, index["chunks"])


def rank(questions: DataFrame, index: dict[str, DataFrame], how: Settings, top_k: int | None = None) -> DataFrame:
    """The ranking that metrics and contexts use."""
    found = retrieve(questions, index, how, top_k)
    return rerank(found, questions, index, how) if how.retrieval.rerank.enabled else found


def answer(questions: DataFrame, index: dict[str, DataFrame], how: Settings, top_k: int | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """``question_id, answer, citations, abstained, prompt_tokens, completion_tokens, cost_usd, contexts``, a row for every question."""
    ranked = rank(questions, index, how, top_k) if ranked is None else ranked
    found = generation.contexts(ranked, index["chunks"], top_k or how.retrieval.top_k)
    return generation.generator(how.generation)(questions.select("question_id", "question"), found, how.generation)


def local(ranked: DataFrame, depth: int) -> DataFrame:
    """A ranking of one question, as far as it can be needed, held on the driver."""
    rows = ranked.where(F.col("rank") <= depth).collect()
    return ranked.sparkSession.createDataFrame(rows, ranked.schema)


def one(question: DataFrame, index: dict[str, DataFrame], how: Settings, top_k: int | None = None) -> tuple[Row, dict[str, float]]:
    """The answer to a single question (one row) and the milliseconds of each stage, one stage after the other."""
    r = how.retrieval
    depth = max(r.candidate_k, top_k or r.top_k)
    clock = [time.perf_counter()]
    found = local(retrieve(question, index, how, top_k), depth)
    clock.append(time.perf_counter())
    if r.rerank.enabled:
        found = local(rerank(found, question, index, how), depth)
    clock.append(time.perf_counter())
    said = answer(question, index, how, top_k, found).first()
    clock.append(time.perf_counter())
    ms = [1000 * (b - a) for a, b in zip(clock, clock[1:])]
    return said, {"retrieve_ms": ms[0], "rerank_ms": ms[1], "generate_ms": ms[2], "total_ms": sum(ms)}
