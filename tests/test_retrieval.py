import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from groundwork.functions.hashing import embed, embed_one, matrix
from groundwork.operators import dense, ranking, sparse
from groundwork.settings import Embedder, VectorStore

DOCS = [("a", "a relational database query plan"), ("b", "the red planet has two small moons"), ("c", "bread rises with yeast and time and yeast"), ("d", "query the database of moons"), ("e", "")]


def chunks(spark, docs=DOCS):
    rows = [(f"{i}#0", i, 0, "", t, None, n) for n, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, ordinal int, title string, text string, metadata map<string,string>, doc_seq long")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "question_id string, question string")


def bm25(query, docs):
    t = [re.findall("[a-z0-9]+", x.lower()) for _, x in docs]
    n, avg = len(t), sum(map(len, t)) / len(t)
    df = Counter(w for x in t for w in set(x))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    out = []
    for x in t:
        tf = Counter(x)
        out.append(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in re.findall("[a-z0-9]+", query.lower())))
    return out


@pytest.mark.parametrize("docs", [DOCS, [("a", "hello world")], [("a", "x y"), ("b", "x z")]])
def test_bm25_ranks_every_chunk(spark, docs):
    c = chunks(spark, docs).persist()
    queries = ["relational database query query", "zzz", "moons of the red planet", ""]
    found = sparse.search(asked(spark, *queries), {"chunks": c, **sparse.build(c)}, 4).collect()
    for i, q in enumerate(queries):
        scores = bm25(q, docs)
        want = sorted(range(len(docs)), key=lambda j: (-round(scores[j], 9), j))[:4]
        got = sorted((r["rank"], r["chunk_id"], r["score"]) for r in found if r["question_id"] == f"q{i}")
        assert [x[1] for x in got] == [f"{docs[j][0]}#0" for j in want]
        assert np.allclose([x[2] for x in got], [scores[j] for j in want])


def test_hashing_embedder():
    text = "Mars moons, mars!"
    want = np.zeros(64)
    for t in ("mars", "moons", "mars"):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        want[h % 64] += 1 if h >> 63 else -1
    assert np.allclose(embed_one(text, 64), want / np.linalg.norm(want))
    assert not embed_one("", 32).any() and embed_one(None, 32).shape == (32,)


def test_embedding_many_texts_at_once(spark, monkeypatch):
    """The same vectors as one text at a time, to the last bit."""
    monkeypatch.setattr("groundwork.functions.hashing.SUMS", 64)
    words = [f"w{i * i % 41}" for i in range(300)]
    texts = [None, "", "İa ß é 7", "the " * 9000, *(" ".join(words[i : i + 3 * i]) for i in range(60))]
    for dim in (1, 7, 32):
        want = np.stack([embed_one(t, dim) for t in texts])
        assert np.array_equal(matrix(texts, dim), want)
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", embed("t", dim).alias("v")).collect()
        assert np.array_equal(np.array([r["v"] for r in sorted(rows)], np.float32), want)


def test_dense_search(spark, monkeypatch):
    monkeypatch.setattr(dense, "CHUNKS", 2)
    how = Embedder("hashing", "", 64)
    entries = dense.vectors(chunks(spark), ["chunk_id", "doc_id"], "text", how)
    found = dense.nearest(dense.vectors(asked(spark, "planet moons", "zzz"), ["question_id"], "question", how), entries, 3).collect()
    by = {(r["question_id"], r["rank"]): r["chunk_id"] for r in found}
    assert by["q0", 1] == "b#0" and len(found) == 6
    q, e = embed_one("planet moons", 64).astype(float), {i: embed_one(t, 64).astype(float) for i, t in DOCS}
    want = sorted(e, key=lambda i: (-round(float(q @ e[i]), 9), i))[:3]
    assert [by["q0", r] for r in (1, 2, 3)] == [f"{i}#0" for i in want]
    assert dense.nearest(entries, entries, 0).collect() == []
    with pytest.raises(NotImplementedError):
        dense.store(VectorStore("qdrant"))
    with pytest.raises(ImportError):
        dense.vectors(chunks(spark), ["chunk_id"], "text", Embedder("sentence-transformers", "m", 4))
    with pytest.raises(Exception, match="components"):
        dense.checked(entries, 32).collect()


def ranked(spark, *lists):
    return [spark.createDataFrame([("q", c, i + 1, 1.0, "x") for i, c in enumerate(x)], "question_id string, chunk_id string, rank int, score double, source string") for x in lists]


def test_fusion(spark):
    got = ranking.reciprocal_rank_fusion(ranked(spark, "AB", "AC", "B"), 10, 60).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["A", "B", "C"]
    got = ranking.reciprocal_rank_fusion(ranked(spark, "AB"), 10, 10).orderBy("rank").collect()
    assert [r["score"] for r in got] == [1 / 11, 1 / 12]
    assert ranking.reciprocal_rank_fusion(ranked(spark, "ABC"), 2, 60).count() == 2
    assert ranking.reciprocal_rank_fusion(ranked(spark, ""), 2, 60).count() == 0


def test_rerank(spark):
    c = chunks(spark, [("A", "the sun is hot"), ("B", "mars the red planet has moons moons")])
    r = ranked(spark, ["A#0", "B#0"])[0]
    got = ranking.rerank(r, asked(spark, "mars red planet moons").replace("q0", "q"), c).orderBy("rank").collect()
    assert [(x["chunk_id"], x["source"]) for x in got] == [("B#0", "rerank"), ("A#0", "rerank")]
    assert abs(got[0]["score"] - (1 + 5e-4)) < 1e-12
    same = ranking.rerank(r, asked(spark, "the of and").replace("q0", "q"), c).orderBy("rank").collect()
    assert [(x["chunk_id"], x["score"], x["source"]) for x in same] == [("A#0", 1.0, "x"), ("B#0", 1.0, "x")]


def test_collapse_and_pool(spark):
    c = spark.createDataFrame([("a#0", "a"), ("a#1", "a"), ("b#0", "b")], "chunk_id string, doc_id string")
    docs = ranking.collapse(ranked(spark, ["a#1", "a#0", "b#0"])[0], c)
    assert sorted((r["rank"], r["doc_id"]) for r in docs.collect()) == [(1, "a"), (2, "b")]
    lists = [spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(x)], "question_id string, doc_id string, rank int") for x in (["d1", "d2", "d3"], ["d4", "d1", "d9"])]
    assert sorted(r["doc_id"] for r in ranking.pool(lists, 2).collect()) == ["d1", "d2", "d4"]


def test_few_copies_of_large_tables():
    # 600,000 vectors against each other: a row is copied once for each block of the other side
    n_q, n_e = dense.blocks(600_000, 600_000, 12)
    assert n_q + n_e <= 100
    assert dense.blocks(200, 1_000_000, 12)[0] == 1 and dense.blocks(50_000, 50_000, 12) >= (4, 2) and dense.blocks(0, 0, 8) == (1, 1)


def test_strips_of_a_tile(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    monkeypatch.setattr(dense, "SCORES", 90)
    found = dense.nearest(rows.withColumnRenamed("id", "question_id"), rows.withColumnRenamed("id", "chunk_id"), 4).collect()
    got = {(r["question_id"], r["rank"]): r["chunk_id"] for r in found}
    want = np.argsort(-(x @ x.T), axis=1, kind="stable")[:, :4]
    assert got == {(i, j + 1): want[i, j] for i in range(40) for j in range(4)}
