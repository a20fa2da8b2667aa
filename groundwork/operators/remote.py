"""Answers and verdicts of a hosted model, called once per row and kept in a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import cited
from ..settings import Generation, Judge
from .generation import ABSTAIN, prompt

RUBRIC = (
    "Score the answer from 0 to 1 on three scales and reply with one JSON object with the keys "
    "faithfulness, answer_relevance and correctness."
)


def _client() -> Callable[[str, str], tuple[str, int, int]]:
    import anthropic

    client = anthropic.Anthropic()

    def ask(model: str, text: str) -> tuple[str, int, int]:
        reply = client.messages.create(model=model, max_tokens=512, messages=[{"role": "user", "content": text}])
        said = "".join(b.text for b in reply.content if b.type == "text").strip()
        return said, reply.usage.input_tokens, reply.usage.output_tokens

    return ask


def ask_model(text: Column, model: str, client: Callable = _client) -> Column:
    """``struct<text, prompt_tokens, completion_tokens>``; the client is made once per worker and the call isn't repeated by the optimizer."""

    @F.pandas_udf("text string, prompt_tokens long, completion_tokens long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = None
        for texts in parts:
            ask = ask or client()
            yield pd.DataFrame([ask(model, t) for t in texts], columns=["text", "prompt_tokens", "completion_tokens"])

    return run.asNondeterministic()(text)


def answer_by_model(questions: DataFrame, found: DataFrame, how: Generation, keys: tuple[str, ...] = ("question_id",), client: Callable = _client) -> DataFrame:
    """The columns of ``generation.answer`` from a model's reply; it abstains where it says so."""
    none = F.array().cast("array<struct<rank:int,chunk_id:string,doc_id:string,title:string,text:string,score:double>>")
    rows = questions.join(found, list(keys), "left").withColumn("contexts", F.coalesce("contexts", none))
    rows = rows.withColumn("used", F.slice("contexts", 1, how.max_context_chunks))
    rows = rows.withColumn("reply", ask_model(prompt(F.col("question"), F.col("used")), how.model, client))
    gives_up = F.contains(F.col("reply.text"), F.lit(ABSTAIN[:40]))
    return rows.select(
        *keys,
        F.col("reply.text").alias("answer"),
        F.when(gives_up, F.array().cast("array<string>")).otherwise(cited(F.col("reply.text"), F.col("used.chunk_id"))).alias("citations"),
        gives_up.alias("abstained"),
        F.col("reply.prompt_tokens").alias("prompt_tokens"),
        F.col("reply.completion_tokens").alias("completion_tokens"),
        F.lit(0.0).alias("cost_usd"),
        "contexts",
    )


def cache_key(model: str, *parts: str) -> Column:
    """SHA-256 of the model and of the columns that a verdict depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), *[F.col(p) for p in sorted(parts)])), 256)


def parse_verdict(reply: Column) -> Column:
    """The three scores of the JSON object inside a reply."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(found, "faithfulness double, answer_relevance double, correctness double")


_SCORES = ("faithfulness", "answer_relevance", "correctness")


def _verdicts(spark: SparkSession, cache: str) -> DataFrame:
    """``key`` and the three scores, one row for a key: where runs at the same time asked for the same one, that of the first run by name."""
    try:
        rows = spark.read.schema("key string, faithfulness double, answer_relevance double, correctness double, run string").parquet(cache)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], "key string, faithfulness double, answer_relevance double, correctness double, run string")
    first = rows.groupBy("key").agg(F.min_by(F.struct(*_SCORES), "run").alias("v"))
    return first.select("key", "v.*")


def judge_by_model(answers: DataFrame, how: Judge, cache: str, client: Callable = _client) -> DataFrame:
    """``answers`` with the three scores; verdicts are looked up in the Parquet table ``cache``, and only misses are asked.

    A run writes its verdicts into a part of its own, which Spark's writer
    commits as a whole, so runs at the same time don't meet.  A reply without
    all three scores is null in this run and isn't kept, so that it is asked
    again by the next.
    """
    spark = answers.sparkSession
    parts = ("question", "reference_answer", "answer", "context", "no_answer")
    keyed = answers.withColumn("key", cache_key(how.model, *parts))
    misses = keyed.dropDuplicates(["key"]).join(_verdicts(spark, cache), "key", "left_anti")
    text = F.concat_ws("\n", F.lit(RUBRIC), *[F.concat(F.lit(f"{p}: "), F.col(p).cast("string")) for p in parts])
    said = misses.select("key", ask_model(text, how.model, client)["text"].alias("reply"))
    said = said.select("key", parse_verdict(F.col("reply")).alias("v")).select("key", "v.*").dropna()
    said.write.parquet(f"{cache}/run={uuid.uuid4().hex}")
    return keyed.join(_verdicts(spark, cache), "key", "left").drop("key")
