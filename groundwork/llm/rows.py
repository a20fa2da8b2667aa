"""Keys that tell rows apart where ids don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .sizes import sized

#: Keys of rows without an id of their own begin here; ids are below.
ODD = 1 << 62


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key column, and its name.

    A row whose ``doc_id`` no other row has keeps it as its key.  Rows that
    share an id, and rows without one, get a key for each text, larger than
    all ids, in the order of id (null last) and text; equal rows have equal
    keys.  Only the ids are counted; texts move only where there are such rows.
    """
    key = "__key"
    while key in map(str.lower, docs.columns):
        key += "_"
    id_ = docs["doc_id"].cast("long")
    odd = docs.select(id_.alias("i")).groupBy("i").agg(F.count("*").alias("n")).where("i is null or n > 1")
    if odd.isEmpty():
        return docs.withColumn(key, id_), key
    tables = Scratch(docs.sparkSession, "rows")
    odd = tables.save(odd.select("i"))
    h = F.xxhash64(docs["text"])
    rows = docs.join(sized(odd), id_.eqNullSafe(F.col("i"))).select("i", h.alias("h")).distinct()
    # dense numbers: a partition's rows after those of the partitions before it
    placed = tables.save(rows.orderBy(F.col("i").asc_nulls_last(), "h").select("i", "h", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    before = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = before.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each partition
    numbers = placed.join(F.broadcast(before), part == F.col("p")).select(F.col("i").alias("__i"), F.col("h").alias("__h"), (F.col("m").bitwiseAND((1 << 33) - 1) + F.col("base") + ODD).cast("long").alias(key))
    numbers = tables.save(numbers)
    out = docs.join(sized(numbers), id_.eqNullSafe(F.col("__i")) & (h == F.col("__h")), "left").withColumn(key, F.coalesce(key, id_))
    return out.select(*(docs[c] for c in docs.columns), key), key
