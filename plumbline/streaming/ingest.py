"""Prediction rows as a stream: repeats dropped within a watermark, running accuracy kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["benchmark_id", "model_id", "prompt_variant", "item_id"]


def running_accuracy(rows: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 hour", key: list[str] | None = None) -> DataFrame:
    """window_start, model_id, n, accuracy of a stream (or a batch) of rows with ``score``. A key counts once."""
    key = key or KEY
    kept = rows.withWatermark(time, late)
    kept = kept.dropDuplicatesWithinWatermark(key) if rows.isStreaming else kept.dropDuplicates(key)
    out = kept.groupBy(F.window(time, window).alias("w"), "model_id").agg(F.count("*").alias("n"), F.avg("score").alias("accuracy"))
    return out.select(F.col("w.start").alias("window_start"), "model_id", "n", "accuracy")


def start(rows: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet; a restart goes on from the checkpoint, each row counted once."""
    return running_accuracy(rows).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(path)
