import hashlib
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from groundwork.functions import resampling as R
from groundwork.functions.resampling import mean_interval, paired_test
from groundwork.operators import statistics as S


def test_intervals(spark):
    assert mean_interval([0, 1, 0, 1], 1000, 0.95, 0)[0] == 0.5
    assert mean_interval([0.7] * 3, 100, 0.95, 0)[:3] == pytest.approx((0.7, 0.7, 0.7))
    assert mean_interval([], 10, 0.95, 0) == (None, None, None, 0)
    assert mean_interval([0.42], 10, 0.95, 0) == (0.42, 0.42, 0.42, 1)
    assert mean_interval([1, math.nan, 1], 10, 0.95, 0)[3] == 2
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.0, 1.0, None, 1.0])] + [("n", 0, None)], "metric string, slot int, value double")
    got = {r["metric"]: r for r in S.estimates(df, ["metric"], "slot", 200, 0.9, 7).collect()}
    assert tuple(got["m"])[1:] == mean_interval([0.0, 1.0, math.nan, 1.0], 200, 0.9, 7) and got["n"]["n"] == 0 and got["n"]["mean"] is None


def test_hashed_interval(spark):
    values = [0.1, 0.9, 0.4, -0.2, 0.3]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)] + [("m", 9, None)], "metric string, slot int, value double")
    r = S.hashed_interval(df, ["metric"], 60, 0.9, "s").first()
    boot = [np.mean([values[int(hashlib.md5(f"s:{b}:{d}".encode()).hexdigest()[:15], 16) % 5] for d in range(5)]) for b in range(60)]
    assert r["n"] == 5 and r["mean"] == pytest.approx(0.3)
    assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(boot, [0.05, 0.95])))
    assert r["p_value"] == pytest.approx(min(1, 2 * min(np.mean(np.array(boot) <= 0), np.mean(np.array(boot) >= 0))))


def test_md5_of_many_messages_at_once():
    from groundwork.functions.resampling import md5_draws

    for length in (0, 1, 54, 55, 56, 63, 64, 65, 130):
        rows = np.random.default_rng(length).integers(0, 256, (5, length), np.uint8)
        assert md5_draws(rows).tolist() == [int(hashlib.md5(r.tobytes()).hexdigest()[:15], 16) for r in rows]


def test_hashed_interval_draws_inside_tasks(spark):
    rng = np.random.default_rng(1)
    values = {"m": rng.normal(size=1003).tolist(), "n": rng.normal(size=7).tolist()}
    rows = [(k, f"{i:05d}", v) for k, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "metric string, slot string, value double").repartition(5)
    made = S.hashed_interval(df, ["metric"], 103, 0.9, "salt")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # draws that are rows of a join count as a small table, and are broadcast through the driver
    for r in made.collect():
        x = values[r["metric"]]
        boot = [np.mean([x[int(hashlib.md5(f"salt:{b}:{d}".encode()).hexdigest()[:15], 16) % len(x)] for d in range(len(x))]) for b in range(103)]
        assert (r["n"], r["mean"], r["ci_low"], r["ci_high"]) == pytest.approx((len(x), np.mean(x), *np.quantile(boot, [0.05, 0.95])))


def test_paired(spark):
    assert paired_test(np.full(6, 0.2))[1] < 0.05
    mean, p, n = paired_test(np.zeros(4))
    assert mean == 0 and p > 0.05 and n == 4 and paired_test([]) == (None, None, 0)
    a, b = (spark.createDataFrame([("m", f"q{i}", v) for i, v in enumerate(x)], "metric string, question_id string, value double") for x in ([1.0, 0.5, None, 1.0], [0.5, 0.5, 1.0, math.nan]))
    pairs = S.aligned(a, b)
    assert pairs.count() == 2
    assert S.comparisons(pairs, ["metric"], "question_id", 50, 0).first()["n"] == 2


def test_wilcoxon(spark):
    a, b = [5.1, 4.0, 6.2, 7.3, 5.5, 6.6, 8.0], [4.0, 3.5, 5.0, 6.0, 5.0, 5.0, 7.0]
    df = spark.createDataFrame([("m", x, y) for x, y in zip(a, b)] + [("zero", 1.0, 1.0)], "metric string, a double, b double")
    got = {r["metric"]: r for r in S.with_p_value(S.wilcoxon(df)).collect()}
    n = 7
    z = (0 - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got["m"]["w"] == 0 and got["m"]["z"] == pytest.approx(z) and got["m"]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2))) and got["m"]["p_value"] < 0.05
    assert got["zero"]["p_value"] == 1 and got["zero"]["n"] == 0


def test_kappa_and_spearman(spark):
    def kappa(pairs):
        return S.cohen_kappa(spark.createDataFrame(pairs, "a boolean, b boolean"), "a", "b").first()["kappa"]

    assert kappa([(True, True), (False, False)]) == 1 and kappa([(True, False), (False, True)]) < 0
    assert kappa([(True, True)] * 3) == 1 and kappa([]) is None

    def rho(pairs):
        return S.spearman(spark.createDataFrame(pairs, "x double, y double"), "x", "y").first()["rho"]

    assert rho([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)]) == pytest.approx(1) and rho([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)]) == pytest.approx(-1)
    assert rho([(1.0, 1.0)]) is None and rho([(1.0, 2.0), (1.0, 3.0)]) is None
    assert rho([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 3.0)]) == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1])


def test_gate_and_percentiles(spark):
    floors = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5), ("d", 0.5)], "metric string, floor double")
    found = spark.createDataFrame([("a", 0.5 - 1e-7), ("b", 0.49), ("d", None)], "metric string, mean double")
    assert {r["metric"]: r["passed"] for r in S.gate(floors, found).collect()} == {"a": True, "b": False, "c": False, "d": False}
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    assert S.percentiles(df, "v", {"p95": 0.95}).first()["p95"] == pytest.approx(8.95)


def one_generator(x, iterations, seed):
    """All resamples at once, as numpy draws them."""
    return x[np.random.default_rng(seed).integers(0, len(x), size=(iterations, len(x)))].mean(axis=1)


@pytest.mark.parametrize("n", [2, 3, 1000, 99_991, 2_863_311_531, 3_000_000_000])
def test_draws_can_begin_anywhere(n):
    """Of the two largest sizes a third of all words is thrown away."""
    words, draws = 1 << 10, 20_000
    want = np.random.default_rng(5).integers(0, n, size=draws)
    before = [0]
    while before[-1] < draws:
        before.append(before[-1] + R.kept_words(5, n, len(before) - 1, words))
    for first in (0, 1, 1023, 1024, 7777, 19_999):
        assert (R.generator_at(5, first, n, before, words).integers(0, n, size=draws - first) == want[first:]).all()
    assert (R.generator_at(5, 3000, n, before[:3], words).integers(0, n, size=10) == want[3000:3010]).all()


@pytest.mark.parametrize("iterations", [1, 10, 1000, 10_000])
def test_parts_are_bit_equal(spark, monkeypatch, iterations):
    monkeypatch.setattr(R, "WORDS", 1 << 12)
    rng = np.random.default_rng(8)
    groups = {"a": rng.random(37), "b": rng.normal(size=211), "one": np.array([0.5]), "c": rng.random(211)}
    rows = [(k, i, float(v), float(v) - 0.4) for k, x in groups.items() for i, v in enumerate(x)] + [("a", 99, math.nan, 1.0), ("none", 0, None, None)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "metric string, slot int, value double, a double").repartition(3)
    got = {r["metric"]: tuple(r)[1:] for r in S.estimates(df, ["metric"], "slot", iterations, 0.95, 42).collect()}
    assert got["none"] == (None, None, None, 0) and got["one"] == (0.5, 0.5, 0.5, 1)
    for k in "abc":
        tail = (1.0 - 0.95) / 2.0
        low, high = np.quantile(one_generator(groups[k], iterations, 42), [tail, 1.0 - tail])
        assert got[k] == (groups[k].mean(), pytest.approx(low, abs=0), pytest.approx(high, abs=0), len(groups[k]))
    pairs = df.where("metric in ('a', 'b', 'c', 'one') and not isnan(value)").withColumn("b", F.lit(0.0))
    for r in S.comparisons(pairs, ["metric"], "slot", iterations, 3).collect():
        means = one_generator(groups[r["metric"]] - 0.4, iterations, 3)
        assert r["p_value"] == min(1.0, 2.0 * min((means <= 0).mean(), (means >= 0).mean())) and r["n"] == len(groups[r["metric"]])


def test_ranks_of_a_whole_table(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 300, 3000).astype(float), rng.normal(size=3000).round(2)
    df = spark.createDataFrame([(a, b) for a, b in zip(x.tolist(), y.tolist())] + [(None, 1.0)], "x double, y double")
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = S.average_ranks(df.where("x is not null"), "x", "r").select("x", "r").collect()
    assert sorted(map(tuple, got)) == sorted(zip(x, ranks(x)))
    found = S.spearman(df.where("x is not null"), "x", "y")
    assert found.first()["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert "SinglePartition" not in S.average_ranks(df, "x", "r")._jdf.queryExecution().executedPlan().toString()
    assert S.average_ranks(df, "x", "r").where("x is null").first()["r"] == 1.0
    assert S.average_ranks(df.limit(0), "x", "r").collect() == []
