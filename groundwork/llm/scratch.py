"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own if the session runs on one machine only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "groundwork-shared")


class Scratch:
    """Written tables that cut lineage and survive a lost executor.

    ``save`` writes a Parquet table and reads it back; ``drop`` removes one
    that is no longer needed.  Tables that a returned DataFrame still reads
    stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, batch: int | None = None, by: str | None = None) -> DataFrame:
        """Write and read back; ``batch`` bounds the rows that are handed to Python at once, for rows that hold long arrays or texts.

        A table written ``by`` a column is dealt into buckets, so that joins on the column move only the other side.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}  # a table's shuffle files go when it is written
        if batch:
            rows = int(self.spark.conf.get(ROWS))
            own[ROWS] = str(min(batch, rows) if rows > 0 else batch)
        before = {name: self.spark.conf.get(name, None) for name in own}
        for name, value in own.items():
            self.spark.conf.set(name, value)
        try:
            if by:
                parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                table = f"groundwork_{uuid.uuid4().hex}"
                df.repartition(parts, by).write.option("path", path).bucketBy(parts, by).sortBy(by).format("parquet").saveAsTable(table)
                out = self.spark.table(table)
                self.spark.sql(f"DROP TABLE {table}")  # the plan knows the files and their buckets by now; the catalog need not
            else:
                df.write.mode("overwrite").parquet(path)
                out = self.spark.read.schema(df.schema).parquet(path)
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
