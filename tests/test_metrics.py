import math
import random

from groundwork.operators.metrics import generation_metrics, long_form, retrieval_metrics
from jobs.retrieval_report import summarised


def brute(ranked, relevant, k):
    rel, top = set(relevant), ranked[:k]
    if not rel:
        return None, None
    gain = sum(1 / math.log2(i + 2) for i, d in enumerate(top) if d in rel)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(len(rel), k)))
    return sum(d in rel for d in top) / len(rel), gain / ideal


def test_against_brute_force(spark):
    rng = random.Random(1)
    cases = [(["a", "b", "c", "d"], ["a", "c", "e"]), (["b", "a"], ["a"]), ([], ["a"]), (["a"], []), ([], [])]
    cases += [(rng.sample("abcdefghijkl", rng.randrange(12)), rng.sample("abcdefghijkl", rng.randrange(5))) for _ in range(40)]
    q = spark.createDataFrame([(str(i), rel) for i, (_, rel) in enumerate(cases)], "question_id string, relevant_doc_ids array<string>")
    d = spark.createDataFrame([(str(i), x, n + 1) for i, (r, _) in enumerate(cases) for n, x in enumerate(r)], "question_id string, doc_id string, rank int")
    got = {int(r["question_id"]): r for r in retrieval_metrics(q, d, (1, 3, 10), precision=True).collect()}
    assert len(got) == len(cases)
    for i, (ranked, rel) in enumerate(cases):
        for k in (1, 3, 10):
            recall, ndcg = brute(ranked, rel, k)
            for name, want in (("recall", recall), ("ndcg", ndcg)):
                x = got[i][f"{name}@{k}"]
                assert x is None if want is None else abs(x - want) < 1e-12
            assert abs(got[i][f"precision@{k}"] - sum(x in rel for x in ranked[:k]) / k) < 1e-12
        first = next((n + 1 for n, x in enumerate(ranked) if x in rel), None)
        assert got[i]["mrr"] == (None if not rel else 1 / first if first else 0.0)
    assert long_form(retrieval_metrics(q, d, (1,))).count() == 3 * len(cases)


def test_order_of_rows_brings_no_difference(spark):
    """The same hits give the same bits, in whatever order they come, and a paired test of them has no differences."""
    rng = random.Random(2)
    docs = list(enumerate("abcdefghij"))
    cases = {f"v{i}": rng.sample(docs, len(docs)) for i in range(12)}
    q = spark.createDataFrame([(v, "q", list("abcdefghijk")) for v in cases], "variant string, question_id string, relevant_doc_ids array<string>")
    d = spark.createDataFrame([(v, "q", x, n + 1) for v, order in cases.items() for n, x in order], "variant string, question_id string, doc_id string, rank int").coalesce(1)
    values = long_form(retrieval_metrics(q, d, (5, 10), ("variant", "question_id")), ("variant", "question_id"))
    assert {r["n_differ"] for r in summarised(values, "v0").where("variant <> 'v0'").collect()} == {0}
    assert {r["value"] for r in values.where("metric = 'ndcg@10'").collect()} == {1.0}


def test_gating(spark):
    rows = [("a", 1.0, 0.0, 1.0, True, True), ("b", 0.5, 0.25, 0.75, False, False), ("c", 0.5, 0.25, 0.0, False, True)]
    df = spark.createDataFrame(rows, "question_id string, faithfulness double, answer_relevance double, correctness double, abstained boolean, no_answer boolean")
    got = {r["question_id"]: tuple(r)[1:] for r in generation_metrics(df).collect()}
    assert got == {"a": (None, None, 1.0, 1.0), "b": (0.5, 0.25, 0.75, 1.0), "c": (0.5, None, 0.0, 0.0)}
