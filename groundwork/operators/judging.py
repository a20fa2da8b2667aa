"""Lexical verdicts on answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_tokens, grounding, strip_citations, token_f1
from ..settings import Judge


def judge(answers: DataFrame) -> DataFrame:
    """Adds ``faithfulness, answer_relevance, correctness`` to rows with ``question, reference_answer, answer, context, abstained, no_answer``.

    Abstaining claims nothing, so it is faithful and irrelevant, and correct
    exactly where there is no answer.
    """
    said = content_tokens(strip_citations("answer"))
    return answers.withColumns(
        {
            "faithfulness": F.when(F.col("abstained"), 1.0).otherwise(grounding("answer", "context")),
            "answer_relevance": F.when(F.col("abstained"), 0.0).otherwise(token_f1(said, content_tokens("question"))),
            "correctness": F.when(F.col("no_answer"), F.col("abstained").cast("double"))
            .when(F.col("abstained"), 0.0)
            .otherwise(token_f1(said, content_tokens("reference_answer"))),
        }
    )


def judge_for(how: Judge, cache: str | None = None):
    if how.provider == "offline":
        return judge
    if how.provider == "anthropic":
        try:
            import anthropic  # noqa: F401
        except ImportError as missing:
            raise ImportError("the anthropic provider needs the package anthropic") from missing
        from .remote import judge_by_model

        return lambda answers: judge_by_model(answers, how, cache or "artifacts/judge_cache")
    raise NotImplementedError(f"judge provider {how.provider} is not there; use offline or anthropic")
