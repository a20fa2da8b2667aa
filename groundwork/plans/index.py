"""An index as tables: chunks, postings, statistics, vectors."""

from __future__ import annotations

import json
import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..operators import chunking, dense, sparse
from ..settings import Settings

#: Tables of a saved index; each is a folder with one part for each time that documents were added.
TABLES = ("chunks", "lists", "terms", "sizes", "vectors")
#: Bytes of files that a task reads when an index is written, and bytes of chunks, before they are compressed, that lie together in a file and aren't parted.
READ = GROUP = 8 << 20
#: Up to so many ids are broadcast to leave their documents out.
NAMED = 1_000_000


def build(docs: DataFrame, how: Settings) -> dict[str, DataFrame]:
    """Lazy tables of an index over ``doc_id, title, text, metadata, doc_seq``."""
    dense.store(how.vector_store)
    chunks = chunking.chunk(docs, how.chunking)
    vecs = dense.vectors(chunks, ["chunk_id", "doc_id"], "text", how.embedder)
    return {"chunks": chunks, **sparse.build(chunks), "vectors": vecs}


def held(index: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables persisted, for several searches in one session; an index without chunks is ValueError."""
    out = {name: df.persist() for name, df in index.items()}
    if out["chunks"].isEmpty():
        raise ValueError("the corpus gave no chunks; check the chunking settings")
    return out


def folder(root: str, how: Settings) -> str:
    return f"{root.rstrip('/')}/{how.signature()}"


def write(index: dict[str, DataFrame], how: Settings, root: str) -> int:
    """Write the tables of an index, in place of what is there, and count its chunks.

    Chunks are written once; postings and statistics are made from the written
    rows.  ``index`` must not be read from the same folder.  ``vectors`` may be
    settings, by which they are made.
    """
    out = folder(root, how)
    spark = index["chunks"].sparkSession
    _part(spark, out, 0, index["chunks"], index["vectors"], fresh=True)
    n = _read(spark, out, "sizes").agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("the corpus gave no chunks; check the chunking settings")
    return n


def save(index: dict[str, DataFrame], how: Settings, root: str) -> str:
    """The tables and ``meta.json`` in a folder named by the settings' signature."""
    n, out = write(index, how, root), folder(root, how)
    meta = {"signature": how.signature(), "config_name": how.name, "num_chunks": n, "embedder": how.embedder.backend, "vector_store": how.vector_store.backend}
    _write(index["chunks"].sparkSession, f"{out}/meta.json", json.dumps(meta, indent=2))
    return out


def _part(spark: SparkSession, out: str, number: int, chunks: DataFrame, vectors: DataFrame | Settings, fresh: bool = False) -> DataFrame:
    """Write one part of every table and return its chunks; a part that is written again replaces itself, a ``fresh`` one replaces all."""

    def write(df: DataFrame, name: str, *order: str) -> DataFrame:
        rows = df.select(*[f.name for f in schemas.STORED[name]], F.lit(number).alias("delta"))
        rows = rows.sortWithinPartitions("delta", *order) if order else rows
        how = rows.write.mode("overwrite").partitionBy("delta").option("compression", "zstd").option("parquet.block.size", GROUP if name == "chunks" else 16 * GROUP).option("partitionOverwriteMode", "static" if fresh else "dynamic")
        how.parquet(f"{out}/{name}")
        return _read(spark, out, name).where(F.col("delta") == number)

    with _small_tasks(spark):
        rows = write(chunks, "chunks")
        # written where they are made; each file is sorted by term, so that a search for terms reads few row groups
        found = write(sparse.lists(rows, by_term=True), "lists", "term", "block")
        write(found.groupBy("term").agg(F.sum("n").alias("df")), "terms")
        words = found.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        write(rows.agg(F.count("*").alias("n")).crossJoin(words), "sizes")  # a row each
        write(dense.vectors(rows, ["chunk_id", "doc_id"], "text", vectors.embedder) if isinstance(vectors, Settings) else vectors, "vectors")
    return rows


@contextmanager
def _small_tasks(spark: SparkSession):
    """Files are read in pieces of READ bytes at most meanwhile, so that a task's lists are sorted in memory: they take some 20 times as much there as their texts do in a file."""
    name = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(name)
    spark.conf.set(name, str(min(READ, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(had))))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def _read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A stored table with ``delta``; FileNotFoundError where there is none."""
    schema = T.StructType([*schemas.STORED[name], T.StructField("delta", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{out}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no index at {out}") from error
        raise


def add(docs: DataFrame, how: Settings, root: str, number: int | None = None) -> dict[str, int]:
    """Add documents to a saved index, or begin one; ``number, documents, chunks`` of what was added.

    Documents whose id the index has stay as they are there.  Only the part
    ``number`` (by default one more than the last) is written; statistics of
    all parts are summed when the index is read.  A part that is written
    again, after a failure, replaces itself and holds the same rows.
    ``doc_seq`` must place new documents among the old ones; a rebuild with
    ``save`` joins all parts into one.
    """
    out, spark = folder(root, how), docs.sparkSession
    try:
        last = _read(spark, out, "sizes").agg(F.max("delta")).first()[0]
        old = _read(spark, out, "chunks")
    except FileNotFoundError:
        last = old = None
    if number is None:
        number = 0 if last is None else last + 1
    if old is not None:
        known = old.where(F.col("delta") != number).select("doc_id").distinct()
        ids = docs.select("doc_id").distinct().join(known, "doc_id", "left_semi")
        docs = docs.join(F.broadcast(ids) if _few(ids) else known, "doc_id", "left_anti")
    rows = _part(spark, out, number, chunking.chunk(_once(docs), how.chunking), how)
    found = rows.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks")).first()
    return {"number": number, **found.asDict()}


def _few(ids: DataFrame) -> bool:
    return ids.limit(NAMED + 1).count() <= NAMED


def _once(docs: DataFrame) -> DataFrame:
    """One row of each id; texts don't move, but for those of ids that are there twice."""
    twice = docs.groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice")
    if not _few(twice):
        return docs.dropDuplicates(["doc_id"])
    same = F.col("doc_id").eqNullSafe(F.col("twice"))
    one, more = (docs.join(F.broadcast(twice), same, kind) for kind in ("left_anti", "left_semi"))
    return one.unionByName(more.dropDuplicates(["doc_id"]))


def load(spark: SparkSession, how: Settings, root: str) -> dict[str, DataFrame]:
    """The saved tables, statistics summed over parts; FileNotFoundError where there is no index."""
    dense.store(how.vector_store)
    out = folder(root, how)
    found = {name: _read(spark, out, name) for name in TABLES}
    own = sparse.stored(found["lists"], found["terms"], found["sizes"])
    return {"chunks": found["chunks"].drop("delta"), **own, "vectors": found["vectors"].drop("delta")}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own if the session runs on one machine only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "groundwork-shared")


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small text file by Hadoop's file system, so that any store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def add_vectors(vectors: DataFrame, more: DataFrame, dim: int) -> DataFrame:
    """Both tables' vectors; one of another length is an error when it is read."""
    return vectors.unionByName(dense.checked(more, dim))


def counts(index: dict[str, DataFrame]) -> DataFrame:
    return index["chunks"].agg(F.count("*").alias("num_chunks"))
