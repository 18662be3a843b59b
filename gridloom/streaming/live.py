"""Live front end: watched folders, continuous saves and running statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, fmt: str = "csv", files_per_trigger: int = 16, **options: str) -> DataFrame:
    """New files of a folder as a stream; at most ``files_per_trigger`` at a time, which bounds what is in flight."""
    return spark.readStream.format(fmt).schema(schema).options(maxFilesPerTrigger=str(files_per_trigger), **options).load(folder)


def continuous_save(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False) -> StreamingQuery:
    """Append every new batch to ``path``; a batch that is repeated after a failure replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_windows(stream: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of event-time windows; rows later than the watermark allows are left out."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width), by)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("window.start").alias("start"), by, "n", "total", "low", "high")


def parse_lines(lines: DataFrame, schema: str, sep: str = ",") -> DataFrame:
    """Separated values in the text column ``value`` as columns; lines that do not fit give nulls."""
    return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("_r")).select("_r.*")


def lookback_text(step: str = "step", unit: float = 0.5) -> Column:
    """A time step as text."""
    return F.format_string("t = %.1f", F.col(step) * unit)
