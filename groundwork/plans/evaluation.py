"""Evaluation of pipelines over gold questions, all variants in one plan."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import judging, metrics, ranking, statistics
from ..settings import Settings
from . import answering


def chosen(questions: DataFrame, split: str | None = None, first: int | None = None) -> DataFrame:
    """The questions of a split, or the first so many of them in file order."""
    rows = questions if split in (None, "all") else questions.where(F.col("split") == split)
    return rows.orderBy("question_seq").limit(first) if first is not None else rows


def records(questions: DataFrame, index: dict[str, DataFrame], how: Settings) -> DataFrame:
    """One row per question: what was answered, its sources, ranked documents, verdicts and all metrics."""
    ranked = answering.rank(questions, index, how)
    said = answering.answer(questions, index, how, ranked=ranked)
    context = F.array_join(F.transform("contexts", lambda c: c["text"]), "\n")
    rows = questions.join(said, "question_id").withColumn("context", context)
    judged = judging.judge_for(how.eval.judge)(rows)
    docs = ranking.collapse(ranked, index["chunks"])
    listed = docs.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d")).select("question_id", F.col("d.doc_id").alias("ranked_docs"))
    found = metrics.retrieval_metrics(questions, docs, how.eval.metrics.k_values)
    made = metrics.generation_metrics(judged)
    none = F.array().cast("array<string>")
    base = judged.select("question_id", "question_seq", "no_answer", "abstained", "answer", "citations", "relevant_doc_ids", "prompt_tokens", "completion_tokens", "cost_usd")
    out = base.join(found, "question_id").join(made, "question_id").join(listed, "question_id", "left").withColumn("ranked_docs", F.coalesce("ranked_docs", none))
    return out.withColumn("variant", F.lit(how.name))


@dataclass
class Evaluation:
    """Tables of one or more variants: ``records``, ``per_question``, ``estimates``, ``operational``, ``latencies``."""

    records: DataFrame
    per_question: DataFrame
    estimates: DataFrame
    operational: DataFrame
    latencies: DataFrame
    split: str
    seed: int
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back what is held in memory; the tables are computed anew if they are read again."""
        for df in self.held:
            df.unpersist()


def latencies(questions: DataFrame, index: dict[str, DataFrame], how: Settings) -> list[tuple[str, str, str, float]]:
    """``variant, question_id, stage, ms`` of the first questions, asked one by one; the settings say how many."""
    out = []
    for row in chosen(questions, first=how.eval.latency.max_questions).collect():
        asked = questions.sparkSession.createDataFrame([row], questions.schema)
        _, took = answering.one(asked, index, how)
        out += [(how.name, row["question_id"], stage, ms) for stage, ms in took.items()]
    return out


def metric_names(how: Settings) -> list[str]:
    k = how.eval.metrics.k_values
    return [f"{m}@{x}" for x in k for m in ("recall", "ndcg")] + ["mrr", "faithfulness", "answer_relevance", "correctness", "abstention_accuracy"]


def evaluate(questions: DataFrame, indexes: dict[str, dict[str, DataFrame]], variants: list[Settings], split: str | None = None, smoke: bool = False) -> Evaluation:
    """Evaluate variants; ``indexes`` holds one index per signature, so variants that differ in search alone share it.

    ``ms_per_question`` is of the batch: the time of a variant over its
    questions.  The percentiles of latency are of questions asked one by one.
    """
    parts, times, asked_alone = [], [], []
    for how in variants:
        began = time.perf_counter()
        asked = chosen(questions, split, how.eval.smoke.max_questions if smoke else None)
        rows = records(asked, indexes[how.signature()], how).persist()
        n = rows.count()
        times.append((how.name, (time.perf_counter() - began) * 1000 / max(n, 1)))
        parts.append(rows)
        asked_alone += latencies(asked, indexes[how.signature()], how)
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = list(dict.fromkeys(n for how in variants for n in metric_names(how)))
    keys = ("variant", "question_id", "question_seq")
    per_question = metrics.long_form(everything.select(*keys, *[F.col(f"`{n}`") for n in names]), keys)
    how = variants[0]
    boot = how.eval.bootstrap
    estimates = statistics.estimates(per_question, ["variant", "metric"], "question_seq", boot.iterations, boot.confidence, how.seed)
    spark = questions.sparkSession
    took = spark.createDataFrame(times, "variant string, ms_per_question double")
    means = everything.groupBy("variant").agg(
        F.count("*").alias("n_questions"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("prompt_tokens", "completion_tokens", "cost_usd")],
    )
    alone = spark.createDataFrame(asked_alone, "variant string, question_id string, stage string, ms double")
    stages = statistics.percentiles(alone, "ms", {"p50": 0.5, "p95": 0.95}, ("variant", "stage"))
    total = stages.where("stage = 'total_ms'").select("variant", F.col("p50").alias("p50_latency_ms"), F.col("p95").alias("p95_latency_ms"))
    estimates = estimates.persist()
    return Evaluation(everything, per_question, estimates, means.join(took, "variant").join(total, "variant", "left"), stages, split or "all", how.seed, [*parts, estimates])


def compare(evaluation: Evaluation, a: str, b: str, names: list[str], iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """``metric, diff_mean, p_value, n`` of variant ``a`` against ``b`` over the questions that both define."""
    values = evaluation.per_question.where(F.col("metric").isin(names))
    pairs = statistics.aligned(values.where(F.col("variant") == a), values.where(F.col("variant") == b))
    return statistics.comparisons(pairs, ["metric"], "question_id", iterations, seed)
