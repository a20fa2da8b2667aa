import json

import pytest
from pyspark.sql import functions as F

from groundwork.operators import generation, judging, remote
from groundwork.settings import Generation, Judge

HOW = Generation("offline", "none", 2, 0.2)


def run(spark, question, contexts, how=HOW):
    q = spark.createDataFrame([("q", question)], "question_id string, question string")
    rows = [("q", i + 1, f"{d}#0", d, t, x, 1.0) for i, (d, t, x) in enumerate(contexts)]
    found = spark.createDataFrame(rows, "question_id string, rank int, chunk_id string, doc_id string, title string, text string, score double")
    found = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "title", "text", "score"))).alias("contexts"))
    return generation.answer(q, found, how).first()


PLANTS = ("doc-x", "Plants", "Photosynthesis turns light into sugar. Leaves are green.")
ROME = ("doc-y", "", "Rome was the capital of an empire.")


def test_answer_is_the_first_best_sentence(spark):
    r = run(spark, "What does photosynthesis turn light into?", [PLANTS, ROME])
    assert r["answer"] == "Photosynthesis turns light into sugar. [1]" and r["citations"] == ["doc-x#0"] and not r["abstained"]
    assert r["completion_tokens"] == 6
    r = run(spark, "rome empire", [ROME, ("z", "", "Rome empire. Empire Rome.")])
    assert r["answer"].endswith("[1]")
    assert run(spark, "light", [ROME, ROME, PLANTS])["abstained"]  # only two contexts are used


def test_abstentions(spark):
    for question, contexts in (("anything", []), ("what is quantum chromodynamics", [ROME]), ("the of", [ROME])):
        r = run(spark, question, contexts)
        assert r["abstained"] and r["answer"] == generation.ABSTAIN and r["citations"] == [] and r["completion_tokens"] == 13
    assert run(spark, "rome aa bb cc dd ee", [ROME])["abstained"]
    assert not run(spark, "rome aa bb cc", [ROME])["abstained"]


def test_prompt(spark):
    c = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(x).alias("text")) for t, x in (("T", "one"), ("", "two"))])
    p = spark.range(1).select(generation.prompt(F.lit("why?"), c).alias("p"), generation.prompt(F.lit("why?"), F.array().cast("array<struct<title:string,text:string>>")).alias("e")).first()
    assert "Context:\n[1] T: one\n[2] two\n\nQuestion: why?\n\nAnswer:" in p["p"] and generation.NO_CONTEXT in p["e"]


def test_providers():
    with pytest.raises(NotImplementedError):
        generation.generator(Generation("openai", "m", 1, 0.0))
    with pytest.raises(ImportError):
        generation.generator(Generation("anthropic", "m", 1, 0.0))
    with pytest.raises(NotImplementedError):
        judging.judge_for(Judge("openai", "m"))
    with pytest.raises(ImportError):
        judging.judge_for(Judge("anthropic", "m"))


ROWS = "question string, reference_answer string, answer string, context string, abstained boolean, no_answer boolean"


def test_offline_verdicts(spark):
    context = "Mars has two moons named Phobos and Deimos."
    rows = [
        ("moons of Mars?", "Phobos and Deimos", "Two moons: Phobos, Deimos [1]", context, False, False),
        ("moons of Mars?", "Phobos and Deimos", "Rome [1]", context, False, False),
        ("x?", "", generation.ABSTAIN, "", True, True),
        ("x?", "y", generation.ABSTAIN, "", True, False),
        ("x?", "", "y", "", False, True),
    ]
    got = judging.judge(spark.createDataFrame(rows, ROWS)).collect()
    assert got[0]["correctness"] > 0.5 and got[0]["faithfulness"] == 1 and got[1]["correctness"] == 0 and got[1]["faithfulness"] == 0
    assert [(r["faithfulness"], r["answer_relevance"], r["correctness"]) for r in got[2:]] == [(1, 0, 1), (1, 0, 0), (0, 0, 0)]


def fake():
    return lambda model, text: (json.dumps({"faithfulness": 0.5, "answer_relevance": 0.25, "correctness": 1}) + f" for {model}", 3, 4)


def refusing():
    raise AssertionError("every verdict should come from the cache")


def test_model_verdicts_are_cached(spark, tmp_path):
    rows = spark.createDataFrame([("q", "r", "a", "c", False, False)] * 2, ROWS)
    cache = str(tmp_path / "cache")
    for client in (fake, refusing):
        got = remote.judge_by_model(rows, Judge("anthropic", "m"), cache, client).collect()
        assert [(r["faithfulness"], r["answer_relevance"], r["correctness"]) for r in got] == [(0.5, 0.25, 1.0)] * 2
    assert spark.read.parquet(cache).count() == 1


def test_model_answers_are_parsed(spark):
    q = spark.createDataFrame([("q", "why")], "question_id string, question string")
    found = spark.createDataFrame([("q", [(1, "c1", "d", "t", "x", 1.0), (2, "c2", "d", "t", "y", 1.0)])], "question_id string, contexts array<struct<rank:int,chunk_id:string,doc_id:string,title:string,text:string,score:double>>")
    r = remote.answer_by_model(q, found, HOW, client=lambda: lambda m, t: ("because [2] [1] [7]", 5, 6)).first()
    assert r["citations"] == ["c2", "c1"] and not r["abstained"] and r["prompt_tokens"] == 5


def _half(model, text):
    """Replies without a verdict for some answers."""
    return ("no idea", 1, 1) if "odd" in text else ('{"faithfulness": 1, "answer_relevance": 0.5, "correctness": 0.25}', 1, 1)


def test_failed_verdicts_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([("q", "", a, "c", False) for a in ("odd", "even", "even")], "question string, reference_answer string, answer string, context string, no_answer boolean")
    cache, how = str(tmp_path / "cache"), Judge("anthropic", "m")
    got = {r["answer"]: r["correctness"] for r in remote.judge_by_model(rows, how, cache, lambda: _half).collect()}
    assert got == {"odd": None, "even": 0.25} and spark.read.parquet(cache).count() == 1
    all_right = lambda: lambda model, text: ('{"faithfulness": 1, "answer_relevance": 1, "correctness": 1}', 1, 1)
    got = {r["answer"]: r["correctness"] for r in remote.judge_by_model(rows, how, cache, all_right).collect()}
    assert got == {"odd": 1.0, "even": 0.25}


def test_verdicts_of_runs_at_the_same_time(spark, tmp_path):
    """Both ask, as neither sees the other; a key then has one verdict for every reader."""
    from concurrent.futures import ThreadPoolExecutor

    rows = spark.createDataFrame([("q", "", str(i % 7), "c", False) for i in range(20)], "question string, reference_answer string, answer string, context string, no_answer boolean")
    cache, how = str(tmp_path / "cache"), Judge("anthropic", "m")
    says = lambda x: lambda: lambda model, text: (f'{{"faithfulness": {x}, "answer_relevance": {x}, "correctness": {x}}}', 1, 1)
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(lambda x=x: remote.judge_by_model(rows, how, cache, says(x)).collect()) for x in (0.25, 0.75)]:
            assert len(done.result()) == 20
    readers = [sorted((r["answer"], r["correctness"]) for r in remote.judge_by_model(rows, how, cache, says(0)).collect()) for _ in range(2)]
    assert readers[0] == readers[1] and len(readers[0]) == 20 and {c for _, c in readers[0]} <= {0.25, 0.75}
