"""Retrieval metrics per question on documents; undefined is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _hits(k: int | None = None) -> Column:
    hit = F.col("relevant") if k is None else F.col("relevant") & (F.col("rank") <= k)
    return F.coalesce(hit, F.lit(False))


def _gain(k: int) -> Column:
    return F.aggregate(F.filter("hits", lambda r: r <= k), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))


def _ideal(n: Column, k: int) -> Column:
    gains = F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))), lambda r: 1.0 / F.log2(r + 1.0))
    return F.when(F.least(n, F.lit(k)) > 0, F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def retrieval_metrics(questions: DataFrame, documents: DataFrame, k_values: tuple[int, ...], keys: tuple[str, ...] = ("question_id",), precision: bool = False) -> DataFrame:
    """``keys`` and one column per metric, a row for every question even if nothing was retrieved.

    ``questions`` has ``keys`` and ``relevant_doc_ids``, ``documents`` a
    ranking of documents.  Without relevant documents recall, nDCG and the
    reciprocal rank are null.
    """
    want = questions.select(*keys, F.array_distinct(F.coalesce("relevant_doc_ids", F.array().cast("array<string>"))).alias("want"))
    rows = want.join(documents.select(*keys, "doc_id", "rank"), list(keys), "left").withColumn("relevant", F.array_contains("want", F.col("doc_id")))
    # summed up in the order of ranks, as sums in another order differ in their last digits, which a paired test would take for a difference
    made = [F.first(F.size("want")).alias("n"), F.array_sort(F.collect_list(F.when(_hits(max(k_values, default=0)), F.col("rank")))).alias("hits")]
    made += [F.count_if(_hits(k)).alias(f"hits@{k}") for k in k_values]
    made.append(F.min(F.when(_hits(), F.col("rank"))).alias("first"))
    got = rows.groupBy(*keys).agg(*made)
    n = F.col("n")
    out = {}
    for k in k_values:
        out[f"recall@{k}"] = F.col(f"`hits@{k}`") / F.nullif(n, F.lit(0))
        ideal = _ideal(n, k)
        out[f"ndcg@{k}"] = F.when(n > 0, F.when(ideal > 0, _gain(k) / F.nullif(ideal, F.lit(0.0))).otherwise(0.0))
        if precision:
            out[f"precision@{k}"] = F.col(f"`hits@{k}`") / F.lit(k) if k > 0 else F.lit(0.0)
    out["mrr"] = F.when(n > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    return got.select(*keys, *[c.cast("double").alias(name) for name, c in out.items()])


def generation_metrics(judged: DataFrame, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """``keys, faithfulness, answer_relevance, correctness, abstention_accuracy``; null where an abstention leaves nothing to score."""
    answered = ~F.col("abstained")
    return judged.select(
        *keys,
        F.when(answered, F.col("faithfulness")).alias("faithfulness"),
        F.when(answered & ~F.col("no_answer"), F.col("answer_relevance")).alias("answer_relevance"),
        "correctness",
        F.col("abstained").eqNullSafe(F.col("no_answer")).cast("double").alias("abstention_accuracy"),
    )


def long_form(wide: DataFrame, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """``keys, metric, value``."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])).alias("m")).select(*keys, "m.*")
