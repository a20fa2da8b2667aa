"""Compare ways of searching a corpus by questions whose answers stand in it.

    python -m jobs.retrieval_report --config jobs/retrieval_report.yaml --documents DOCS --questions ASKED --output REPORT

The corpus is indexed once, every variant of the configuration searches it,
and the report is written in three tables, each partitioned by variant:
``rankings``, ``per_question`` (every metric of every question) and
``summary`` (means, and the signed-rank test against the baseline).  Only the
partitions of the variants at hand are replaced, so that variants can be
measured one by one into the same report; the summary then covers all that
are there.  A second run over the same input gives the same rows.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.operators import chunking, metrics, ranking, statistics
from groundwork.plans import answering, index, relevance
from groundwork import schemas

from . import log, pipeline, read_config, session
from .index_documents import documents as corpus

PER_QUESTION = "question_id string, metric string, value double, variant string"


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(path)


def _read(spark: SparkSession, source: dict[str, Any], path: str) -> DataFrame:
    reader = spark.read.format(source["format"]).options(**source.get("options", {}))
    return (reader.schema(source["schema"]) if source.get("schema") else reader).load(path)


def summarised(values: DataFrame, baseline: str) -> DataFrame:
    """``variant, metric, mean, n, diff_mean, w, z, n_differ``; differences are to the baseline, over questions that both define (null for itself)."""
    means = values.groupBy("variant", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    base = values.where(F.col("variant") == baseline).select("metric", "question_id", F.col("value").alias("b"))
    pairs = values.where(F.col("variant") != baseline).withColumnRenamed("value", "a").join(base, ["metric", "question_id"]).where("a is not null and b is not null")
    tests = statistics.wilcoxon(pairs, ("variant", "metric")).withColumnRenamed("n", "n_differ")
    return means.join(tests, ["variant", "metric"], "left").select("metric", "mean", "n", "diff_mean", "w", "z", "n_differ", "variant")


def run(spark: SparkSession, documents: str, questions: str, output: str, config: dict[str, Any]) -> dict[str, int]:
    """Write the report of all variants of the configuration; counts of what was read and written.

    A question's relevant documents are those that hold its text.
    """
    docs = corpus(_read(spark, config["documents"], documents), config["columns"]["documents"])
    names = config["columns"]["questions"]
    asked = _read(spark, config["questions"], questions).select(F.col(names["id"]).cast("string").alias("question_id"), F.col(names["text"]).alias("question")).where("question_id is not null")
    how = pipeline(config)
    root = f"{output}/index"
    none = spark.createDataFrame([], schemas.VECTORS)
    vectors = none if not any(pipeline(config, v).retrieval.dense.enabled for v in config["variants"].values()) else how
    index.write({"chunks": chunking.chunk(docs, how.chunking), "vectors": vectors}, how, root)
    built = index.load(spark, how, root)
    for name, over in config["variants"].items():
        found = answering.rank(asked, built, pipeline(config, over))
        _write(found.select("question_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "score", "source", F.lit(name).alias("variant")), f"{output}/rankings")
    ranked = spark.read.parquet(f"{output}/rankings").where(F.col("variant").isin(*config["variants"])).withColumn("variant", F.col("variant").cast("string"))
    keys = ("variant", "question_id")
    every = relevance.containing(asked, docs).select("question_id", "relevant_doc_ids", F.explode(F.array(*map(F.lit, config["variants"]))).alias("variant"))
    found = metrics.retrieval_metrics(every, ranking.collapse(ranked, built["chunks"], keys), how.eval.metrics.k_values, keys)
    _write(metrics.long_form(found, keys), f"{output}/per_question")
    values = spark.read.schema(PER_QUESTION).parquet(f"{output}/per_question")
    _write(summarised(values, config["baseline"]), f"{output}/summary")
    sizes = {"documents": docs.count(), "questions": asked.count(), "rankings": ranked.count(), "values": values.where(F.col("variant").isin(*config["variants"])).count()}
    log.info("read %d documents of %s and %d questions of %s", sizes["documents"], documents, sizes["questions"], questions)
    log.info("wrote %d ranked chunks and %d values of %s to %s", sizes["rankings"], sizes["values"], ", ".join(config["variants"]), output)
    return sizes


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    p.add_argument("--config", default="jobs/retrieval_report.yaml")
    for name in ("documents", "questions", "output"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(args)
    spark = session("retrieval_report")
    try:
        run(spark, a.documents, a.questions, a.output, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
