"""Relevant documents are found in time that grows with the text."""

from groundwork.plans.relevance import containing


def _tables(spark):
    words = [f"w{i}" for i in range(12_000)]
    docs = spark.createDataFrame([("long", " ".join(words)), ("short", "w1 w2 w3"), ("null", None), ("blank", " ")], "doc_id string, text string")
    asked = spark.createDataFrame([("deep", "9000 w9001 w9002 w9003 w9004 w900"), ("three", "w1 w2 w3"), ("one", "w3"), ("absent", "w5 w4 w3 w2")], "question_id string, question string")
    return asked, docs


def test_long_documents_are_found(spark):
    found = {r["question_id"]: r["relevant_doc_ids"] for r in containing(*_tables(spark)).collect()}
    assert found == {"deep": ["long"], "three": ["long", "short"], "one": ["long", "short"], "absent": []}


def test_runs_of_words_are_hashed_once_and_told_apart_as_numbers(spark):
    plan = containing(*_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "xxhash64" in line and "lambdafunction" in line]
    assert made and not [line for line in made if "Filter" in line]  # a filter below the explosion finds the words of a text once for each word
    assert not [line for line in made if "array_distinct" in line and "struct" in line]  # two structs of an array are compared one by one
