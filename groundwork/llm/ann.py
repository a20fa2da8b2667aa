"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012).

Both halves of a vector are quantised by codebooks of their own; a pair of
centroids is a cell.  A query visits cells in the order of their summed
scores, taken from a heap, until they hold enough entries; the entries are
then ranked by the exact inner product of the original vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

#: Centroids of each half, at most; no more than a quarter of the entries.
CENTROIDS = 128
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 16_384
ROUNDS = 12
#: First-half centroids whose cells share a tile.
TOGETHER = 8
#: Queries whose cells one task finds, about.
TRAVERSED = 128
#: Entries and queries of one task, about.
ENTRIES, QUERIES = 8_192, 2_048


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centroids, from evenly spaced rows of the sorted sample on."""
    if not x.shape[1]:  # vectors of one component have no second half
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Non-empty cells in the order of first[i] + second[j], largest first, until they hold ``enough`` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, seen, got, out = [(-(fa[0] + sb[0]), 0, 0)], {(0, 0)}, 0, []
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        n = counts[a[i]][b[j]]
        if n:
            out.append((a[i], b[j]))
            got += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(fa[x] + sb[y]), x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _assign(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            half = one.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(x[:, :half], one).astype(np.int32)), pa.array(nearest(x[:, half:], two).astype(np.int32))], [*batch.schema.names, "c1", "c2"])

    return run


def _visits(shared, enough: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), counts = shared.value
        counts = counts.tolist()
        half = one.shape[1]
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            row, tile, mask = [], [], []
            for r, (f, s) in enumerate(zip(x[:, :half] @ one.T, x[:, half:] @ two.T)):
                bits = np.zeros((len(one), len(two)), bool)
                for i, j in traverse(f, s, counts, enough):
                    bits[i, j] = True
                for t in range(0, len(one), TOGETHER):
                    if bits[t : t + TOGETHER].any():
                        row.append(r)
                        tile.append(t // TOGETHER)
                        mask.append(np.packbits(bits[t : t + TOGETHER]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row, pa.int64())) for i in range(3)), pa.array(tile, pa.int32()), pa.array(mask, pa.binary())], ["query_id", "query", "twin", "tile", "mask"])

    return run


def _rank(k: int, n_two: int):
    def run(key, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(entries):
            return pd.DataFrame({"query_id": [], "twin": [], "vec_id": [], "score": []})
        q, e = np.stack(queries["query"]).astype(np.float64), np.stack(entries["embedding"]).astype(np.float64)
        ids = entries["vec_id"].to_numpy()
        cell = (entries["c1"].to_numpy() % TOGETHER) * n_two + entries["c2"].to_numpy()
        scores = q @ e.T
        # rounding of a product is far below this share of the norms
        slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((e * e).sum(1).max())
        out = []
        for i, (own, twin, mask) in enumerate(zip(queries["query_id"], queries["twin"], queries["mask"])):
            seen = np.unpackbits(np.frombuffer(mask, np.uint8))[cell].astype(bool) & (ids != own)
            at = np.flatnonzero(seen)
            if len(at) > k:
                s = scores[i, at]
                limit = np.partition(s, len(s) - k)[len(s) - k]
                at = at[s >= limit - slack[i]]
            exact = (q[i] * e[at]).sum(1)  # the same sum wherever a vector stands
            best = np.lexsort((ids[at], -exact))[:k]
            out.append(pd.DataFrame({"query_id": own, "twin": twin, "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out)

    return run


def search(vectors: DataFrame, queries, k: int = 20, share: float = 0.4, least: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` found nearest of every row that the condition ``queries`` picks.

    Nearness is the inner product in double precision, ties go to the smaller
    id, and a query isn't its own neighbour.  A query visits cells until they
    hold ``share`` of all entries and at least ``least`` of them; with no more
    entries than that the search is exact.  Vectors that are null, zero or of
    another length than most (the longer of equals), or that hold null or
    non-finite components, take no part, nor do null ids.  Every other row is indexed;
    rows that repeat an id are entries of their own, and queries of their own
    where their vectors differ.  Ties beyond the k-th go by id; an empty table
    gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    tables = Scratch(spark, "ann")
    v, ok = F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, ok) & F.exists(v, lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    n = common["n"]
    rows = rows.where(F.size(v) == n)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    x = np.stack(sample).astype(np.float64)
    k_means = max(1, min(CENTROIDS, len(x) // 4))
    books = kmeans(x[:, : (n + 1) // 2], k_means), kmeans(x[:, (n + 1) // 2 :], k_means)
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    index = tables.save(rows.mapInArrow(_assign(spark.sparkContext.broadcast(books)), f"vec_id long, embedding array<{kind}>, c1 int, c2 int"))
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # one row per cell
        counts[r["c1"], r["c2"]] = r["count"]
    enough = max(least, math.ceil(share * int(counts.sum())))
    asked = index.where(queries).select("vec_id", "embedding").withColumnRenamed("vec_id", "query_id").withColumnRenamed("embedding", "query")
    asked = tables.save(asked.withColumn("twin", F.xxhash64("query")).dropDuplicates(["query_id", "twin"]))
    n_asked = asked.count()
    asked = asked.repartition(max(1, math.ceil(n_asked / TRAVERSED)))
    visits = asked.mapInArrow(_visits(spark.sparkContext.broadcast((books, counts)), enough), f"query_id long, query array<{kind}>, twin long, tile int, mask binary")

    # Each tile of cells is dealt in blocks of entries and of queries, and every pair of blocks is a task's work.
    tiles = math.ceil(len(books[0]) / TOGETHER)
    per_tile = [max(1, math.ceil(int(counts[t * TOGETHER : (t + 1) * TOGETHER].sum()) / ENTRIES)) for t in range(tiles)]
    q_blocks = max(1, math.ceil(n_asked / QUERIES))
    e_blocks = F.element_at(F.array(*map(F.lit, per_tile)), F.col("tile") + 1)
    left = visits.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("eb", F.explode(F.sequence(F.lit(0), e_blocks - 1)))
    entries = index.withColumn("tile", F.floor(F.col("c1") / TOGETHER).cast("int"))
    entries = entries.withColumn("eb", F.pmod(F.xxhash64("vec_id"), e_blocks).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    near = left.groupBy("tile", "qb", "eb").cogroup(entries.groupBy("tile", "qb", "eb")).applyInPandas(_rank(k, len(books[1])), "query_id long, twin long, vec_id long, score double")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
