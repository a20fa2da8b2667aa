"""Sharding by longest-processing-time scheduling: groups by size, each to the least-loaded shard through a heap.

Groups of equal size are interchangeable, so the driver sees sizes with their
numbers of groups: 13 significant bits of a size make a class, of which there
are fewer than 2^18 whatever the corpus.  Groups of a class go in the order of
their keys to the places that the schedule has for it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

#: Rows numbered in one task, about.
NUMBERED = 2_000


def schedule(classes: list[tuple[int, int, int]], shards: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Rows ``(class, first rank, shard)`` and loads, from ``(class, groups, bytes)``.

    The largest class first, each of its groups to the least-loaded shard, the
    lowest number of equals; a row holds from its first rank up to the next.
    """
    heap = [(0.0, s) for s in range(shards)]
    out: list[tuple[int, int, int]] = []
    for size, n, total in sorted(classes, reverse=True):
        weight, rank = total / n, 0
        while n:
            if n >= 2 * shards and max(heap)[0] - heap[0][0] <= weight:
                # level: all shards take as many, and the rest go one by one
                each = n // shards - 1
                for i, (load, s) in enumerate(heap):
                    out.append((size, rank, s))
                    rank += each
                    heap[i] = (load + each * weight, s)
                n -= each * shards
            load, s = heap[0]
            next_ = min(heap[1:3], default=(math.inf, 0))[0]
            took = n if next_ == math.inf else min(n, max(1, math.ceil((next_ - load) / weight)))
            out.append((size, rank, s))
            heapq.heapreplace(heap, (load + took * weight, s))
            rank, n = rank + took, n - took
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, shard, start = table.value
        for batch in batches:
            own, at = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            # ranks as places in the whole schedule, where classes follow each other
            first = start[np.searchsorted(size, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard[np.searchsorted(rank, first + at, "right") - 1])], ["key", "shard"])

    return run


def _numbered(rows: DataFrame, by: str, order: list[str], parts: int, spread, name: str) -> DataFrame:
    """``name``: places from 0 in the order of parts, then of the columns, within each value of ``by``; ``spread`` deals a value's rows into parts, so it may have any share of them."""
    rows = rows.withColumn("part", F.pmod(spread, F.lit(parts)).cast("int"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(by, "part").agg(F.count("*").alias("n")).select(by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(by, "part").orderBy(*order)
    rows = rows.withColumn("at", F.row_number().over(inside) - 1).join(base, [by, "part"])
    return rows.withColumn(name, (F.col("at") + F.col("base")).cast("long")).drop("at", "base", "part")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: equal texts together, bytes near equal, slots gapless in each shard.

    ``size`` is the UTF-8 bytes of the text plus 16.  A null text counts as the
    empty one and shares its group.  Repeated rows and null ids are rows like
    any other; very long texts are groups like any other; other columns are
    ignored; an empty table gives no rows.  A group larger than a shard's share
    has a shard to itself.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = tables.save(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    )
    shift = F.expr("cast(greatest(0, floor(log2(weight)) - 12) as int)")
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    groups = tables.save(groups.select("key", "weight", "n", F.call_function("shiftleft", F.call_function("shiftright", F.col("weight"), shift), shift).alias("class")))
    classes = [(r["class"], r["n"], r["weight"], r["rows"]) for r in groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("n").alias("rows")).collect()]
    if not classes:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long")
    plan, _ = schedule([c[:3] for c in classes], shards)
    size, n = (np.array(x, np.int64) for x in zip(*sorted(c[:2] for c in classes)))
    start = np.cumsum(n) - n
    first = start[np.searchsorted(size, [c for c, _, _ in plan])] + np.array([r for _, r, _ in plan])
    order = np.argsort(first, kind="stable")
    # rows of no group have the first rank of the next; the last of equals holds
    table = spark.sparkContext.broadcast((size, first[order], np.array([s for _, _, s in plan], np.int32)[order], start))
    ranked = _numbered(groups.select("key", "class"), "class", ["key"], math.ceil(int(n.max()) / NUMBERED), F.xxhash64("key"), "rank")
    where = tables.save(ranked.select("key", "class", "rank").mapInArrow(_place(table), "key binary, shard int"))
    placed = rows.join(where, "key").select("doc_id", "size", "text_crc32", "shard")
    parts = max(1, math.ceil(sum(c[3] for c in classes) / shards / NUMBERED))
    out = _numbered(placed, "shard", ["doc_id", "text_crc32"], parts, F.xxhash64("doc_id", "text_crc32"), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
