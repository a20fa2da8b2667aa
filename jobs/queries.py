"""The jobs as registered queries, and the SQL that they are compared with."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.operators import sparse
from groundwork.plans import index
from groundwork.plans.index import shared_dir
from groundwork.sql import CTE, query

from . import index_documents, pipeline, read_config, retrieval_report

HERE = Path(__file__).parent


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that two runs over ``documents`` leave: every posting with its chunk and its weight by the summed statistics."""
    root, config = _folder(spark, "job1"), read_config(HERE / "index_documents.yaml")
    for _ in range(2):  # a pattern, as the table is one file or a folder of files
        index_documents.run(spark, f"{sf_dir}/documents*.parquet", f"{root}/index", f"{root}/checkpoint", config)
    built = index.load(spark, pipeline(config), f"{root}/index")
    chunks = built["chunks"].select("chunk_id", "doc_seq", "doc_id", "ordinal", "title", F.size(F.split("text", " ")).cast("long").alias("n_words"))
    rows = sparse.with_chunks(built, chunks)
    # six digits as the SQL rounds them; F.round writes every number out in decimal digits, which takes long
    weight = F.signum("weight") * F.floor(F.abs("weight") * 1e6 + 0.5) / 1e6
    return rows.select("term", "chunk_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "title", "n_words", "tf", weight.alias("weight"))


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that two runs leave: every value with its variant's mean and test."""
    root, config = _folder(spark, "job2"), read_config(HERE / "retrieval_report.yaml")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", root, config)
    values, summary = (spark.read.parquet(f"{root}/{name}").withColumn("variant", F.col("variant").cast("string")) for name in ("per_question", "summary"))
    rows = values.join(summary, ["variant", "metric"])
    rounded = [F.round(c, 6).alias(c) for c in ("value", "mean", "diff_mean", "w", "z")]
    return rows.select("variant", "question_id", "metric", *rounded, "n", "n_differ")


def _renamed(name: str, **names: str) -> str:
    """A table expression of the library's SQL over other tables."""
    import re

    out = CTE[name]
    for old, new in names.items():
        out = re.sub(rf"\b{old}\b", new, out)
    return out


_STEPS = {
    "jrc": _renamed("rc", hy="bm"),
    "jrs": _renamed("rs", rc="jrc"),
    "jrr": _renamed("rr", rs="jrs"),
    "jv": "SELECT 'bm25' AS variant, question_id, chunk_id, rank FROM bm UNION ALL SELECT 'bm25_rerank', question_id, chunk_id, rank FROM jrr",
    "jcoll": _renamed("coll", vars="jv"),
    "jhit": _renamed("hit", vars="jv", coll="jcoll"),
    "jmk": _renamed("mk", hit="jhit"),
    "jmv": f"SELECT * FROM ({_renamed('mv', mk='jmk', hit='jhit')}) WHERE metric NOT LIKE 'precision%'",
    "jd": "SELECT a.variant, a.metric, a.value - b.value AS d FROM jmv a JOIN jmv b ON b.variant = 'bm25' AND a.metric = b.metric AND a.question_id = b.question_id WHERE a.variant <> 'bm25' AND a.value IS NOT NULL AND b.value IS NOT NULL",
    "jr": "SELECT variant, metric, d, rank() OVER (PARTITION BY variant, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY variant, metric, abs(d)) - 1) / 2.0 AS r FROM jd WHERE d <> 0",
    "jw": "SELECT variant, metric, avg(d) AS diff_mean, least(sum(CASE WHEN d > 0 THEN r ELSE 0.0 END), sum(CASE WHEN d < 0 THEN r ELSE 0.0 END))::double AS w, count(*) AS k FROM jr GROUP BY ALL",
    "jt": "SELECT p.variant, p.metric, coalesce(diff_mean, 0.0) AS diff_mean, coalesce(w, 0.0) AS w, (w - k * (k + 1) / 4.0) / sqrt(k::double * (k + 1) * (2 * k + 1) / 24) AS z, coalesce(k, 0) AS n_differ FROM (SELECT DISTINCT variant, metric FROM jd) p LEFT JOIN jw USING (variant, metric)",
    "jm": "SELECT variant, metric, avg(value) AS mean, count(value) AS n FROM jmv GROUP BY ALL",
}
_NEW = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in _STEPS.items())

QUERIES = {q.__name__: q for q in (job1_index_documents, job2_retrieval_report)}

ORACLE_SQL = {
    "job1_index_documents": query(
        "SELECT term, chunk_id, chunks.doc_id, chunks.ordinal, title, len(string_split(text, ' ')) AS n_words, tf, round(weight, 6) AS weight FROM post JOIN chunks USING (chunk_id)"
    ),
    "job2_retrieval_report": query(
        f"SELECT * FROM (WITH {_NEW} SELECT variant, question_id, metric, round(value, 6) AS value, round(mean, 6) AS mean, round(diff_mean, 6) AS diff_mean, round(w, 6) AS w, round(z, 6) AS z, n, n_differ "
        "FROM jmv JOIN jm USING (variant, metric) LEFT JOIN jt USING (variant, metric))"
    ),
}
