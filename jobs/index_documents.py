"""Keep a search index of a folder of documents that grows.

    python -m jobs.index_documents --config jobs/index_documents.yaml --input DOCS --output INDEX --checkpoint STATE

Files that came since the last run are read as a stream, in batches; a batch
adds its documents to the index as one part of every table (``delta=N``), and
nothing that was written before is written again.  The checkpoint knows the
files that were taken.  A batch that failed is run again and replaces its own
part; a run without new files changes nothing.  ``groundwork.plans.index.load``
reads the index, with the statistics of all parts summed.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundwork.plans import index

from . import log, pipeline, read_config, session


def documents(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``doc_id, title, text, metadata, doc_seq`` from the columns that the configuration names; rows without an id are left out."""
    title = F.coalesce(F.col(columns["title"]).cast("string"), F.lit("")) if columns.get("title") else F.lit("")
    out = rows.select(
        F.col(columns["id"]).cast("string").alias("doc_id"),
        title.alias("title"),
        F.col(columns["text"]).alias("text"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col(columns["order"]).cast("long").alias("doc_seq"),
    )
    return out.where("doc_id is not null")


def run(spark: SparkSession, input_path: str, output: str, checkpoint: str, config: dict[str, Any]) -> list[dict[str, int]]:
    """Index what is new; a line for each batch: ``batch, read, documents, chunks``.

    A document whose id the index has already is not taken again.  Null and
    blank texts give no chunks.
    """
    how, source = pipeline(config), config["input"]
    stream = spark.readStream.format(source["format"]).schema(source["schema"]).options(**source.get("options", {}))
    found = stream.option("maxFilesPerTrigger", source.get("files_per_batch", 1000)).load(input_path)
    batches: list[dict[str, int]] = []

    def add(rows: DataFrame, number: int) -> None:
        read = rows.count()
        done = index.add(documents(rows, config["columns"]), how, output, number)
        batches.append({"batch": number, "read": read, "documents": done["documents"], "chunks": done["chunks"]})
        log.info("batch %d: read %d rows of %s, wrote %d documents as %d chunks to %s", number, read, input_path, done["documents"], done["chunks"], output)

    query = found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = {k: sum(b[k] for b in batches) for k in ("read", "documents", "chunks")}
    log.info("read %(read)d rows, added %(documents)d documents and %(chunks)d chunks in this run", total)
    return batches


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    p.add_argument("--config", default="jobs/index_documents.yaml")
    for name in ("input", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    a = p.parse_args(args)
    spark = session("index_documents")
    try:
        run(spark, a.input, a.output, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
