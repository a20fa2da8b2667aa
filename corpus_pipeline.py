"""From raw documents to packed sequences: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.llm.decontam import decontaminate
from groundwork.llm.ngram_join import jaccard_components
from groundwork.llm.packing import pack_documents
from groundwork.llm.rows import ODD, keyed
from groundwork.llm.scratch import Scratch
from groundwork.llm.sizes import sized
from groundwork.llm.substring_dedup import remove_repeats, repeated_passages
from groundwork.llm.toxicity import drop_toxic, fit


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, scores below 0.5.

    Every row is judged by its own whole text (null: empty), so equal rows go
    or stay together and a null id makes no difference; extra columns stay.
    """
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 of five-word shingles: the one with the smallest doc_id.

    Null and empty texts are linked with nothing and stay.  Rows without an id
    come after all others, and rows that share one are told apart by their
    texts; of equal rows with a text one stays.  Extra columns stay as they are.
    """
    rows, key = keyed(docs)
    groups = jaccard_components(rows, k=5, num=8, den=10, id_col=key)
    gone = groups.where("component <> id").select(F.col("id").alias("__gone")).distinct()
    kept = rows.join(sized(gone), rows[key] == F.col("__gone"), "left_anti")
    odd = (F.col(key) >= ODD) & (F.length(F.trim("text")) > 0)
    once = kept.where(F.coalesce(odd, F.lit(False))).dropDuplicates([key])
    return kept.where(~F.coalesce(odd, F.lit(False))).unionByName(once).select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 50 words or more that a smaller doc_id has; ``n_chars`` follows the text.

    Null, empty and short texts stay as they are.  Rows without an id come
    after all others; rows that share an id are told apart by their texts;
    equal rows are one text.  Extra columns stay.
    """
    out = remove_repeats(docs, repeated_passages(docs))
    kind = docs.schema["n_chars"].dataType
    same = out.withColumn("n_chars", F.length("text").cast(kind))
    return same.select(docs.columns)


def drop_leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of an item of ``benchmark``, each row judged by its own text; null and empty texts stay, as do extra columns."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 4096 tokens; every row is packed, null texts as empty, other columns left out."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaked_benchmarks),
    ("packing", pack),
]

#: Trained classifiers, components and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
