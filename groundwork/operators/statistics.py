"""Intervals, paired tests and rank statistics over per-question values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import resampling as R

#: Resamples of one group are dealt in so many parts at most.
PARTS = 64


def _packed(values: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """``keys, x``: each group's defined values in the order of ``order``; empty for a group without any."""
    defined = value.isNotNull() & ~F.isnan(value)
    listed = F.array_sort(F.collect_list(F.when(defined, F.struct(F.col(order).alias("o"), value.alias("v")))))
    return values.groupBy(*keys).agg(listed.alias("s")).select(*keys, F.transform("s", lambda r: r["v"]).alias("x"))


def _kept_before(spark: SparkSession, sizes: list[int], iterations: int, seed: int) -> dict[int, list[int]]:
    """For each size whose draws fill more than one block of the generator's stream: the draws before each block."""
    blocks = {n: -(-iterations * n // R.WORDS) for n in sizes}
    wanted = [(n, b) for n, count in blocks.items() for b in range(count) if count > 1]  # one for 4 million draws
    if not wanted:
        return {}
    words = R.WORDS

    def count(batches):
        for batch in batches:
            yield batch.assign(kept=[R.kept_words(seed, int(n), int(b), words) for n, b in zip(batch["n"], batch["b"])])

    rows = spark.createDataFrame(wanted, "n long, b long").repartition(min(len(wanted), 1000)).mapInPandas(count, "n long, b long, kept long").collect()
    found: dict[int, list[int]] = {}
    for n, b, kept in sorted(tuple(r) for r in rows):
        before = found.setdefault(n, [0])
        before.append(before[-1] + kept)
    return found


def _resampled(packed: DataFrame, keys: list[str], iterations: int, seed: int, finish, fields: str, single: bool) -> DataFrame:
    """``keys`` and what ``finish(x mean, n, means)`` returns for each group, its resamples drawn in parts and put in order again.

    A group's values travel to the tasks that draw its parts; no group is
    drawn in one worker.  ``single`` leaves groups of one value alone.
    """
    spark = packed.sparkSession
    sizes = [r["n"] for r in packed.select(F.size("x").alias("n")).where(f"n > {1 if single else 0}").distinct().collect()]
    before, words = _kept_before(spark, sizes, iterations, seed), R.WORDS
    # parts of a few million draws, 64 at most, the last one shorter
    each = F.greatest(F.ceil(F.lit(iterations) / PARTS), F.floor(F.lit(words) / F.greatest(F.size("x"), F.lit(1)))).cast("int")
    first = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.least(F.lit(max(iterations, 1)), each)))
    parts = packed.select(*keys, "x", F.least(F.lit(iterations), each).alias("each"), first.alias("first")).repartition(*keys, "first")

    def draw(batches):
        for frame in batches:
            out = frame[keys].copy()
            xs = [np.asarray(x, float) for x in frame["x"]]
            many = [len(x) > (1 if single else 0) for x in xs]
            counts = [min(int(e), iterations - int(f)) for e, f in zip(frame["each"], frame["first"])]
            out["first"], out["n"] = frame["first"], [len(x) for x in xs]
            out["mean"] = [float(x.mean()) if len(x) else None for x in xs]
            out["means"] = [R.resampled_means(x, int(f), c, seed, before.get(len(x), []), words) if m else np.zeros(0) for x, f, c, m in zip(xs, frame["first"], counts, many)]
            yield out

    types = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)
    drawn = parts.mapInPandas(draw, f"{types}, first int, n long, mean double, means array<double>")

    def put_together(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:  # one number for each iteration
        frame = frame.sort_values("first")
        n, mean = int(frame["n"].iloc[0]), frame["mean"].iloc[0]
        return pd.DataFrame([(*key, *finish(mean if n else None, n, np.concatenate([np.asarray(m, float) for m in frame["means"]])))])

    return drawn.groupBy(*keys).applyInPandas(put_together, f"{types}, {fields}")


def estimates(values: DataFrame, keys: list[str], order: str, iterations: int, confidence: float, seed: int) -> DataFrame:
    """``keys, mean, ci_low, ci_high, n`` by numpy's generator; values are resampled in the order of column ``order``.

    The figures are those of one generator that draws all iterations of a
    group, to the last bit, though tasks draw them in parts.  A group's values
    are one row of its own.
    """

    def finish(mean, n, means):
        return (mean, *(R.interval(means, confidence) if n > 1 else (mean, mean)), n)

    return _resampled(_packed(values, keys, order, F.col("value")), keys, iterations, seed, finish, "mean double, ci_low double, ci_high double, n long", single=True)


def _in_order(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys, x``: each group's values in the order of ``order``.

    The table is sorted by ranges, so no task sorts a group; only numbers, in
    pieces, meet in a group's row.
    """
    types = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for _, rows in batch.groupby(keys, sort=False, dropna=False):
                piece = rows[keys].head(1).assign(part=part, number=number)
                piece["x"] = [rows["value"].to_numpy(float)]
                number += 1
                yield piece

    pieces = values.orderBy(*keys, order).select(*keys, F.col("value").cast("double").alias("value")).mapInPandas(pack, f"{types}, part int, number int, x array<double>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "x"))), lambda p: p["x"]))
    return pieces.groupBy(*keys).agg(whole.alias("x"))


def hashed_interval(values: DataFrame, keys: list[str], iterations: int, confidence: float, salt: str = "") -> DataFrame:
    """The same figures with draws that SQL can repeat: draw i of iteration b is the value numbered md5(salt, b, i) mod n.

    ``values`` has ``keys`` and ``value``, numbered by ``slot`` from 0 in each group.
    Tasks draw iterations in parts and give a mean for each, so no draw is ever
    a row; a group's values (8 bytes each) travel to the tasks that draw from them.
    """
    packed = _in_order(values.where("value is not null"), keys, "slot")
    each = max(1, -(-iterations // PARTS))
    parts = packed.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(each))).alias("first")).repartition(2 * PARTS, *keys, "first")
    types = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)

    def draw(frame: pd.DataFrame) -> pd.DataFrame:  # one part
        x, first = np.asarray(frame["x"].iloc[0], float), int(frame["first"].iloc[0])
        out = frame[keys].assign(n=len(x), mean=float(x.mean()))
        out["means"] = [R.hashed_means(x, first, min(each, iterations - first), salt)]
        return out

    drawn = parts.groupBy(*keys, "first").applyInPandas(draw, f"{types}, n long, mean double, means array<double>")
    means = drawn.select(*keys, "n", "mean", F.explode("means").alias("boot"))
    tail = (1 - confidence) / 2
    bounds = means.groupBy(*keys).agg(
        F.first("mean").alias("mean"), F.percentile("boot", tail).alias("ci_low"), F.percentile("boot", 1 - tail).alias("ci_high"), F.first("n").alias("n"),
        F.avg((F.col("boot") <= 0).cast("double")).alias("p_low"), F.avg((F.col("boot") >= 0).cast("double")).alias("p_high"),
    )
    return bounds.select(*keys, "mean", "ci_low", "ci_high", "n", F.least(F.lit(1.0), 2 * F.least("p_low", "p_high")).alias("p_value"))


def aligned(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("metric", "question_id")) -> DataFrame:
    """``keys, a, b`` where both sides are defined."""
    left, right = (x.select(*keys, F.col("value").alias(n)) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, list(keys)).where("a is not null and b is not null and not isnan(a) and not isnan(b)")


def comparisons(pairs: DataFrame, keys: list[str], order: str, iterations: int = 10_000, seed: int = 0) -> DataFrame:
    """``keys, diff_mean, p_value, n`` of the paired bootstrap, drawn as in ``estimates``."""

    def finish(mean, n, means):
        return (mean, R.two_sided(means) if n else None, n)

    return _resampled(_packed(pairs, keys, order, F.col("a") - F.col("b")), keys, iterations, seed, finish, "diff_mean double, p_value double, n long", single=False)


#: Distinct values are dealt in so many ranges to be counted.
RANGES = 64


def _counted_below(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` (``value, __n``) with ``__before``, the sum of ``__n`` over smaller values, null ones first.

    Values are dealt by ranges and summed up within each; what stands before
    a range is a sum of at most 64 numbers.
    """
    found = counts.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("p")).first()["p"] or []
    edges = sorted({x for x in found if x is not None})
    at = sum((F.when(F.col(value) > x, 1).otherwise(0) for x in edges), F.lit(0)) if edges else F.lit(0)
    dealt = counts.withColumn("__range", at)
    sums = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.sum("__n")).collect()}  # 64 at most
    before = [sum(n for i, n in sums.items() if i < j) for j in range(len(edges) + 1)]
    inside = Window.partitionBy("__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    start = F.get(F.array(*map(F.lit, before)), F.col("__range"))
    return dealt.withColumn("__before", start + F.coalesce(F.sum("__n").over(inside), F.lit(0))).drop("__range")


def average_ranks(df: DataFrame, value: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1, equal values share their mean rank; counted per distinct value, so no group of ties is gathered.

    Without ``keys``, ranks are of the whole table (numbers only), and no task
    sees more than a range of its distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    else:
        counts = _counted_below(counts, value)
    ranks = counts.withColumn(name, F.col("__before") + (F.col("__n") + 1) / 2.0).drop("__n", "__before")
    if keys:
        return df.join(ranks, [*keys, value])
    other = ranks.select(F.col(value).alias("__v"), name)
    return df.join(other, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def wilcoxon(pairs: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """``keys, diff_mean, w, z, n``: signed ranks of non-zero differences, normal approximation without corrections."""
    d = pairs.withColumn("d", F.col("a") - F.col("b")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = average_ranks(d, "size", "r", keys)
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    sums = ranked.groupBy(*keys).agg(F.least(plus, minus).alias("w"), F.count("*").alias("n"), F.avg("d").alias("diff_mean"))
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return pairs.select(*keys).distinct().join(sums, list(keys), "left").select(
        *keys, F.coalesce("diff_mean", F.lit(0.0)).alias("diff_mean"), F.coalesce("w", F.lit(0.0)).alias("w"), F.when(F.col("n") > 0, z).alias("z"), F.coalesce("n", F.lit(0)).alias("n")
    )


def with_p_value(tests: DataFrame) -> DataFrame:
    """Adds ``p_value`` to Wilcoxon rows: twice the normal tail beyond z, 1 without differences."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 1.0 if x is None or np.isnan(x) else min(1.0, 2.0 * R.normal_tail(abs(x))))

    return tests.withColumn("p_value", tail("z"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, n, kappa`` of two yes/no raters; 1 or 0 where chance agreement is certain, null without rows."""
    share = lambda c: F.avg(c.cast("double"))
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col(a) == F.col(b)).alias("po"), share(F.col(a)).alias("pa"), share(F.col(b)).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(F.col("n") == 0, None).when(pe >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return sums.select(*keys, "n", kappa.alias("kappa"))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, rho``: Pearson's correlation of average ranks; null below two rows or without variance."""
    ranked = average_ranks(average_ranks(pairs.select(x, y), x, "__rx"), y, "__ry")
    spread = F.nullif(F.sqrt(F.var_pop("__rx") * F.var_pop("__ry")), F.lit(0.0))
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.covar_pop("__rx", "__ry") / spread).alias("rho"))


def percentiles(df: DataFrame, value: str, at: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Linear-interpolated percentiles."""
    return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(name) for name, p in at.items()])


def gate(floors: DataFrame, estimates: DataFrame) -> DataFrame:
    """``metric, value, floor, passed``: at least the floor but for 1e-6; a missing or undefined value fails."""
    return floors.join(estimates.select("metric", F.col("mean").alias("value")), "metric", "left").select(
        "metric", "value", "floor", F.coalesce((F.col("value") >= F.col("floor") - 1e-6) & ~F.isnan("value"), F.lit(False)).alias("passed")
    )


def agreement(judged: DataFrame, threshold: float = 0.5) -> dict[str, float | int | None]:
    """Kappa of correctness and faithfulness at ``threshold`` and Spearman's correlation of correctness with human verdicts."""
    rows = judged.withColumns({"said_correct": F.col("correctness") >= threshold, "said_faithful": F.col("faithfulness") >= threshold, "human": F.col("human_correct").cast("double")})
    correct, faithful = (cohen_kappa(rows, a, b).first() for a, b in (("said_correct", "human_correct"), ("said_faithful", "human_faithful")))
    return {
        "n": correct["n"],
        "threshold": threshold,
        "kappa_correctness": correct["kappa"],
        "kappa_faithfulness": faithful["kappa"],
        "spearman_correctness": spearman(rows, "correctness", "human").first()["rho"],
    }
