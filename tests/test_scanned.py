"""Searches that need no stored index: chunks are scored where they are read."""

import pytest
from pyspark.sql import functions as F

from groundwork import queries as Q
from groundwork.functions.text import coded_tokens, tokens
from groundwork.operators import dense, sparse

WORDS = "ash bay cob dew elm fir gum hay ivy jet kit log mud nut oak".split()
SCHEMA = "chunk_id string, doc_id string, ordinal int, title string, text string, metadata map<string,string>, doc_seq long"


def table(spark, n):
    texts = [" ".join(WORDS[(i * j * j + j) % len(WORDS)] for j in range(i % 23)) for i in range(n)]
    return spark.createDataFrame([(f"{i}#0", f"{i}", 0, "", t, None, i) for i, t in enumerate(texts)], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coded_tokens(spark):
    texts = [None, "", "A b-b 9x", "é ß", "K İstanbul x\n\0y", "?", "z"]
    want = [r["t"] or [] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(tokens("x").alias("t")).collect()]
    text, code, known = coded_tokens(texts)
    got = [[known[c].as_py() for t, c in zip(text, code) if t == i] for i in range(len(texts))]
    assert got == want


@pytest.mark.parametrize("size", [1, 1024])
def test_bm25_while_chunks_are_read(spark, monkeypatch, size):
    """The same rankings as from frequencies, with several parts of questions too; postings don't move."""
    monkeypatch.setattr(sparse, "QUESTIONS", size)
    monkeypatch.setattr(sparse, "BLOCK", 32)
    c = table(spark, 300).persist()
    asked = spark.createDataFrame([("a", "oak nut oak"), ("b", "zzz"), ("c", "ash bay cob"), ("d", "")], "question_id string, question string")
    own = sparse.counted(sparse.tallies(c))
    full = sparse.build(c)
    assert sorted(map(tuple, own["term_stats"].select("term", "df", F.round("idf", 9)).collect())) == sorted(map(tuple, full["term_stats"].select("term", "df", F.round("idf", 9)).collect()))
    columns = ["question_id", "rank", "chunk_id", F.round("score", 9)]
    want = sorted(map(tuple, sparse.search(asked, {"chunks": c, **full}, 7).select(*columns).collect()))
    found = sparse.search(asked, {"chunks": c, **own}, 7)
    assert sorted(map(tuple, found.select(*columns).collect())) == want and len(want) == 28
    near = sparse._nearest(asked, {"chunks": c, **own}, own["corpus_stats"].first()["avgdl"], 7)
    assert "part#" not in "".join(line for line in plan(near).split("\n") if "hashpartitioning(" in line and "block" in line)


def test_few_queries_go_to_entries(spark, monkeypatch):
    """The same neighbours as by tiles, with ties; entries don't move."""
    rows = [(f"{i:03}", [float(i % 7), float(i % 3), 1.0]) for i in range(200)]
    entries = spark.createDataFrame(rows, "chunk_id string, vec array<double>").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 0.0, 0.0]), ("c", [-1.0, 2.0, 1.0])], "question_id string, vec array<double>")
    monkeypatch.setattr(dense, "SCORES", 60)
    few = dense.nearest(asked, entries, 12)
    assert "CoGroup" not in plan(few)
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(dense, "FEW", 0)
    many = dense.nearest(asked, entries, 12)
    assert "CoGroup" in plan(many) and got == sorted(map(tuple, many.collect())) and len(got) == 36


def test_queries_write_no_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q.index_plan, "write", lambda *a: pytest.fail("an index is written"))
    docs = [(i, f"{WORDS[i % 15]} {WORDS[i % 4]} moss. " * (i % 90), "s") for i in range(60)] + [(99, None, "s"), (98, " ", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "oak ash"), (2, "gum and nut")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    chunks = {r["chunk_id"]: r["text"] for r in Q._chunks(spark, str(tmp_path)).collect()}
    for query in (Q.bm25_topk, Q.dense_md5_topk, Q.hybrid_topk, Q.rerank_lexical):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == 2 * Q.K and {r["chunk_id"] for r in rows} <= set(chunks)
    kept = Q._Kept(spark)
    ids = {r["chunk_id"] for r in Q._bm25(spark, str(tmp_path), kept).collect()}
    assert {r["chunk_id"]: r["text"] for r in Q._ranked_chunks(spark, str(tmp_path), kept).collect()} == {i: chunks[i] for i in ids}
    assert Q.collapse_documents(spark, str(tmp_path)).count() and Q.pool_candidates(spark, str(tmp_path)).count() and Q.answer_extractive(spark, str(tmp_path)).count() == 2


def test_postings_move_as_strips(spark, monkeypatch):
    """The same postings as from frequencies; what moves has a row for each term of a strip, and isn't sorted."""
    monkeypatch.setattr(sparse, "TALLIED", 50)
    c = table(spark, 130).persist()
    found, columns = sparse.postings(c, sparse.tallies(c)), ["term", "chunk_id", "tf", F.round("weight", 9)]
    want = sorted(map(tuple, sparse.build(c)["postings"].select(*columns).collect()))
    assert sorted(map(tuple, found.select(*columns).collect())) == want and len(want) > 500
    assert "SortMergeJoin" not in plan(found)
