"""Input files: corpus, questions, labels, reports, floors.  All are read by Spark, so a path may be in any store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank ones are skipped, broken ones are an error, a missing file is FileNotFoundError."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def _one(path: str, name: str) -> str:
    return path if path.endswith((".jsonl", ".json")) else f"{path.rstrip('/')}/{name}"


def _required(column: str):
    """The column, or an error in the row that lacks it."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"a row has no {column}"))).otherwise(F.col(column))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, title, text, metadata, doc_seq``; ``doc_seq`` follows the order of lines.  No documents at all is ValueError."""
    raw = _json(spark, _one(path, "corpus.jsonl"), schemas.CORPUS)
    if raw.isEmpty():
        raise ValueError(f"no documents in {path}")
    none = F.create_map().cast("map<string,string>")
    return raw.select(
        _required("id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        _required("text").alias("text"),
        F.coalesce("metadata", none).alias("metadata"),
        F.monotonically_increasing_id().alias("doc_seq"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, question, reference_answer, relevant_doc_ids, no_answer, split, question_seq``.

    A folder holds ``dev.jsonl`` and ``test.jsonl``; a file's split is its
    name.  A question without an answer names no document, any other at least
    one.
    """
    if path.endswith((".jsonl", ".json")):
        parts = [(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], path)]
    else:
        parts = [(s, f"{path.rstrip('/')}/{s}.jsonl") for s in ("dev", "test")]
    out = None
    for n, (split, file) in enumerate(parts):
        seq = F.monotonically_increasing_id() + F.lit(n).cast("long") * (1 << 40)
        rows = _json(spark, file, schemas.GOLD).select("*", F.lit(split).alias("split"), seq.alias("question_seq"))
        out = rows if out is None else out.unionByName(rows)
    none, docs = F.coalesce("no_answer", F.lit(False)), F.coalesce("relevant_doc_ids", F.array().cast("array<string>"))
    checked = (
        F.when(none & (F.size(docs) > 0), F.raise_error(F.lit("a no_answer question names relevant documents")))
        .when(~none & (F.size(docs) == 0), F.raise_error(F.lit("an answerable question names no relevant document")))
        .otherwise(docs)
    )
    return out.select(
        _required("id").alias("question_id"),
        _required("question").alias("question"),
        F.coalesce("reference_answer", F.lit("")).alias("reference_answer"),
        checked.alias("relevant_doc_ids"),
        none.alias("no_answer"),
        "split",
        "question_seq",
    )


def read_judge_labels(spark: SparkSession, path: str) -> DataFrame:
    """Answers with human verdicts; missing references and contexts are empty."""
    raw = _json(spark, path, schemas.JUDGE_LABELS)
    optional = {"reference_answer", "context"}
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) if c in optional else _required(c).alias(c) for c in raw.columns])


def read_floors(spark: SparkSession, path: str) -> DataFrame:
    """``metric, floor`` from one flat JSON object."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return text.select(F.explode("m").alias("metric", "floor"))


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A saved report as tables: ``estimates``, ``per_question``, ``operational``; null is undefined."""
    kind = (
        "config_name string, split string, seed long, n_questions long,"
        " metrics map<string,struct<mean:double,ci_low:double,ci_high:double,n:long>>,"
        " operational map<string,double>, per_question map<string,map<string,double>>"
    )
    try:
        row = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("r")).select("r.*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    head = ["config_name", "split", "seed", "n_questions"]
    return {
        "estimates": row.select(*head, F.explode("metrics").alias("metric", "e")).select(*head, "metric", "e.*"),
        "per_question": row.select(*head, F.explode("per_question").alias("metric", "m")).select(*head, "metric", F.explode("m").alias("question_id", "value")),
        "operational": row.select(*head, F.explode("operational").alias("name", "value")),
    }
