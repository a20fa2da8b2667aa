"""Grounded answers: the sentence that shares most content terms with the question, cited, or an abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_tokens, sentences, tokens
from ..settings import Generation

# The texts that answers and prompts must have.
ABSTAIN = "I don't have enough information in the provided context to answer that."
INSTRUCTIONS = (
    "Answer the question using ONLY the numbered context below. "
    "Cite the sources you use with bracketed numbers like [1] or [2]. "
    "If the context does not contain the answer, reply exactly: "
    f'"{ABSTAIN}"'
)
NO_CONTEXT = "(no context retrieved)"


def context_block(contexts: Column) -> Column:
    """``[1] title: text`` lines of an array of ``struct<title, text, ...>``; no title, no colon."""

    def line(c: Column, i: Column) -> Column:
        title = F.when(F.coalesce(c["title"], F.lit("")) != "", F.concat(c["title"], F.lit(": "))).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), title, c["text"])

    return F.array_join(F.transform(contexts, line), "\n")


def prompt(question: Column, contexts: Column) -> Column:
    block = F.when(F.size(contexts) > 0, context_block(contexts)).otherwise(NO_CONTEXT)
    return F.concat(F.lit(f"{INSTRUCTIONS}\n\nContext:\n"), block, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def contexts(ranking: DataFrame, chunks: DataFrame, k: int, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """``keys, contexts array<struct<rank, chunk_id, doc_id, title, text, score>>``: the first ``k`` chunks of each question."""
    rows = ranking.where(F.col("rank") <= k).join(chunks.select("chunk_id", "doc_id", "title", "text"), "chunk_id")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "title", "text", "score"))).alias("contexts"))


def answer(questions: DataFrame, found: DataFrame, how: Generation, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """``keys, answer, citations, abstained, prompt_tokens, completion_tokens, cost_usd, contexts``.

    Of the first ``max_context_chunks`` contexts, the first sentence with the
    largest overlap of content terms answers.  A question abstains without
    contexts or content terms, without any overlap, or if the overlap is a
    smaller share of its terms than ``abstain_threshold``.
    """
    none = F.array().cast("array<struct<rank:int,chunk_id:string,doc_id:string,title:string,text:string,score:double>>")
    rows = questions.join(found, list(keys), "left").withColumn("contexts", F.coalesce("contexts", none))
    rows = rows.withColumn("used", F.slice("contexts", 1, how.max_context_chunks)).withColumn("terms", F.array_distinct(content_tokens("question")))

    def pick(c: Column, i: Column) -> Column:
        def score(s: Column, j: Column) -> Column:
            return F.struct((-F.size(F.array_intersect(F.col("terms"), content_tokens(s)))).alias("less"), i.alias("i"), j.alias("j"), s.alias("sentence"))

        return F.transform(sentences(c["text"]), score)

    # the smallest of (-overlap, context, sentence): first of the best
    best = rows.withColumn("best", F.array_min(F.flatten(F.transform("used", pick))))
    n = -F.col("best.less")
    gives_up = (F.size("used") == 0) | (F.size("terms") == 0) | F.coalesce(n <= 0, F.lit(True)) | F.coalesce(n / F.nullif(F.size("terms"), F.lit(0)) < how.abstain_threshold, F.lit(True))
    said = best.withColumn("abstained", gives_up).withColumn(
        "answer", F.when(F.col("abstained"), ABSTAIN).otherwise(F.concat("best.sentence", F.lit(" ["), (F.col("best.i") + 1).cast("string"), F.lit("]")))
    )
    cite = F.when(F.col("abstained"), F.array().cast("array<string>")).otherwise(F.array(F.get(F.col("used"), F.col("best.i"))["chunk_id"]))
    return said.select(
        *keys,
        "answer",
        cite.alias("citations"),
        "abstained",
        F.size(tokens(prompt(F.col("question"), F.col("used")))).cast("long").alias("prompt_tokens"),
        F.size(tokens("answer")).cast("long").alias("completion_tokens"),
        F.lit(0.0).alias("cost_usd"),
        "contexts",
    )


def generator(how: Generation):
    """The function that answers; model providers need a network and their own package."""
    if how.provider == "offline":
        return answer
    if how.provider == "anthropic":
        try:
            import anthropic  # noqa: F401
        except ImportError as missing:
            raise ImportError("the anthropic provider needs the package anthropic") from missing
        from .remote import answer_by_model

        return answer_by_model
    raise NotImplementedError(f"generation provider {how.provider} is not there; use offline or anthropic")
