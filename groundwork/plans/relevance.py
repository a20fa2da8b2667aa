"""Which documents answer a question, where no one has said so: those that hold its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def containing(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """``question_id, question, relevant_doc_ids``: a row for every question.

    A question may begin and end inside a word of a document; the words
    between stand in it as they are, so questions and documents meet on the
    hash of up to four of them.  Questions of fewer than three words meet all
    documents.
    """
    q = questions.select("question_id", "question").withColumn("w", T.words("question"))
    n = F.least(F.size("w") - 2, F.lit(4))
    long_ = q.where(F.size("w") > 2).select("question_id", "question", n.alias("n"), F.xxhash64(F.slice("w", F.lit(2), n)).alias("h"))
    docs = docs.select("doc_id", "text")
    sizes = [r["n"] for r in long_.select("n").distinct().collect()]  # four at most
    words = docs.select("doc_id", T.words("text").alias("w"))

    def hashes(n: int):
        at = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return F.when(F.size("w") >= n, F.transform(at, lambda i: F.xxhash64(F.slice("w", i, F.lit(n)))))

    held = questions.sparkSession.createDataFrame([], "question_id string, doc_id string")
    if sizes:
        # numbers, as array_distinct compares every two structs of an array; explode_outer, as for explode the
        # optimizer puts a filter on the runs below it, which finds the words anew for each of them
        runs = F.array_distinct(F.flatten(F.array_compact(F.array(*map(hashes, sizes)))))
        met = long_.join(words.select("doc_id", F.explode_outer(runs).alias("h")), "h").select("question_id", "question", "doc_id").distinct()
        held = met.join(docs, "doc_id").where(F.contains("text", "question")).select("question_id", "doc_id")
    short = q.where(F.size("w") <= 2).select("question_id", "question")
    if not short.isEmpty():
        held = held.unionByName(docs.join(short, F.contains("text", "question")).select("question_id", "doc_id"))
    found = held.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant_doc_ids"))
    return q.drop("w").join(found, "question_id", "left").withColumn("relevant_doc_ids", F.coalesce("relevant_doc_ids", F.array().cast("array<string>")))
