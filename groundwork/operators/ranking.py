"""Ranks with explicit ties, fusion of rankings, reranking, collapsing to documents, pooling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import content_tokens, let

#: Scores that differ by less tie, so that the order of distributed sums can't change a rank.
DIGITS = 9


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with ``rank`` from 1; none for ``k`` of 0 or less."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= max(0, k))


def by_score(*ties: str) -> list[Column]:
    return [F.round("score", DIGITS).desc(), *map(F.col, ties)]


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, rrf_k: int, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """``keys, chunk_id, rank, score, source``: the sum of 1 / (rrf_k + rank) over rankings; ties by chunk id."""
    parts = [r.select(*keys, "chunk_id", "rank") for r in rankings]
    fused = reduce(DataFrame.unionByName, parts).groupBy(*keys, "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    return top_k(fused, list(keys), by_score("chunk_id"), k).select(*keys, "chunk_id", "rank", "score", F.lit("rrf").alias("source"))


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's content terms that the text has, plus 1e-4 for each occurrence; null without terms."""

    def score(q: Column, c: Column) -> Column:
        hits = F.size(F.filter(c, lambda t: F.array_contains(q, t)))
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q) + 1e-4 * hits)

    # found once for a row, not again for each token of the text
    both = F.struct(F.array_distinct(content_tokens(question)).alias("q"), content_tokens(text).alias("c"))
    return let(both, lambda x: score(x["q"], x["c"]))


def rerank(ranking: DataFrame, questions: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """A ranking in the order of lexical scores, ties by chunk id; that of a question without content terms stays as it is."""
    rows = ranking.join(questions.select("question_id", "question"), "question_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    new = rows.withColumn("lexical", lexical_score(F.col("question"), F.col("text")))
    order = Window.partitionBy(*keys).orderBy(F.round("lexical", DIGITS).desc(), F.when(F.col("lexical").isNull(), F.col("rank")), "chunk_id")
    return new.withColumn("rank", F.row_number().over(order)).select(
        *keys, "chunk_id", "rank", F.coalesce("lexical", "score").alias("score"), F.when(F.col("lexical").isNotNull(), "rerank").otherwise(F.col("source")).alias("source")
    )


def collapse(ranking: DataFrame, chunks: DataFrame, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """``keys, doc_id, rank``: documents by their best chunk, ranked anew."""
    docs = ranking.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy(*keys, "doc_id").agg(F.min("rank").alias("best"))
    return docs.select(*keys, "doc_id", F.row_number().over(Window.partitionBy(*keys).orderBy("best", "doc_id")).alias("rank"))


def pool(rankings: list[DataFrame], depth: int, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Documents that any of several document rankings has among its first ``depth``."""
    parts = [r.where(F.col("rank") <= depth).select(*keys, "doc_id") for r in rankings]
    return reduce(DataFrame.unionByName, parts).distinct()
