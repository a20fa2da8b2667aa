import numpy as np
from pyspark.sql import functions as F

from groundwork.llm import ann
from groundwork.llm.ann import search, traverse

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k, every):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            scores = sorted(((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def run(spark, rows, every=5, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in search(df, F.col("vec_id") % every == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def vectors(n, dim=32, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]


def test_exact_where_all_entries_are_visited(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENTRIES", 150)
    monkeypatch.setattr(ann, "QUERIES", 40)
    rows = vectors(900, 16) + [(1000 + i, [0.5] * 16) for i in range(60)]
    got, want = run(spark, rows, k=7, share=1.0), brute(rows, 7, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_recall(spark):
    for n, every in ((500, 5), (6000, 40)):
        rows = vectors(n, 64)
        got, want = run(spark, rows, every=every, k=20), brute(rows, 20, every)
        hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert 0.9 <= hit / (20 * len(want)) < 1


def test_queries_that_share_an_id(spark):
    rows = vectors(80, 8) + [(5, [1.0] + [0.0] * 7), (5, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = search(df, F.col("vec_id") == 5, k=3, share=1.0).collect()
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3] and all(r["vec_id"] != 5 for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, [1.0, None, 1.0]), (6, []), (7, [1.0, 2.0])]
    rows += [(10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (11, [-1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    assert run(spark, rows, k=20, every=7)[0] == [(10, 14.0), (10, 14.0), (11, -1.0)]
    assert run(spark, [r for r in rows if r[0] != 10], k=20) == {0: [(11, -1.0)]}
    assert run(spark, [], k=3) == {} and run(spark, [(1, None)], k=3) == {}
    assert run(spark, [(0, [2.0]), (1, [3.0])], k=3) == {0: [(1, 6.0)]}


def test_cells_come_in_order_until_enough():
    first, second = np.array([3.0, 1.0, 2.0]), np.array([0.0, 5.0])
    counts = [[4, 1], [2, 2], [0, 3]]
    cells = traverse(first, second, counts, 100)
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums, reverse=True) and len(cells) == 5
    assert traverse(first, second, counts, 4) == cells[:2]
