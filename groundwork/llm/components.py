"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)``: each id that has an edge to another id, with the smallest id it can reach.

    Edges may repeat, point either way or join an id to itself (ignored);
    rows with a null end are ignored.  Each step is a join and two
    aggregations over the edges; nothing is gathered on the driver but two
    numbers that tell whether a step changed anything.
    """
    tables = Scratch(edges.sparkSession, "components")
    e = tables.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain tables and a hot id's edges can be split
        low = lows = tables.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.*")
            .where("u <> v")
            .distinct()
        )
        new = tables.save(small)
        tables.drop(e, lows)
        e, last, seen = new, seen, _mark(new)
        if last == seen:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
