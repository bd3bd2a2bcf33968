"""Accentuation of streams. Each micro-batch goes through the batch plan; no state is kept between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def accentuate_stream(stream: DataFrame, engine: Engine, output: str, checkpoint: str, column: str = "text", notation: str = "combining_acute", **trigger) -> StreamingQuery:
    """Writes the accentuated rows of a stream to Parquet, one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folder, so each row is there once. ``trigger``
    is what ``DataStreamWriter.trigger`` takes, by default ``availableNow=True``.
    """

    def write(batch: DataFrame, number: int) -> None:
        engine.accentuate(batch, column, notation=notation).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_text_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
