"""Reranking by a cross-encoder model; the package is optional."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def rerank_by_model(ranking: DataFrame, questions: DataFrame, chunks: DataFrame, model: str, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """A ranking in the order of the model's scores; equal scores keep their order."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as missing:
        raise ImportError("the cross-encoder backend needs the package sentence_transformers") from missing

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import CrossEncoder

        loaded = CrossEncoder(model)
        for question, text in parts:
            yield pd.Series(loaded.predict(list(zip(question, text))))

    rows = ranking.join(questions.select("question_id", "question"), "question_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    scored = rows.withColumn("score", score.asNondeterministic()("question", "text"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).select(*keys, "chunk_id", "rank", "score", F.lit("rerank").alias("source"))
