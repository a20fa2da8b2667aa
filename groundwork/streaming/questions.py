"""Questions that arrive as a stream, answered in micro-batches against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import answering
from ..settings import Settings

SCHEMA = "question_id string, question string, asked_at timestamp"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that are put into a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def answer_stream(questions: DataFrame, index: dict[str, DataFrame], how: Settings, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Answers appended to the Parquet table ``out``; a question id is answered once within ``late``.

    Each micro-batch is one batch plan.  Its rows are written under the
    batch's number, so a batch that is run again replaces its own rows.
    """
    asked = questions.withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["question_id"])

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        answering.answer(batch, index, how).drop("contexts").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return asked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asked_per_window(questions: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Questions per time window, late ones within the watermark counted."""
    return questions.withWatermark("asked_at", late).groupBy(F.window("asked_at", width)).agg(F.count("*").alias("n"))
