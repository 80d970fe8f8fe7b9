"""Streams scored against a static library by the batch functions, and windowed decision counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import neighbours


def score_stream(stream: DataFrame, library: DataFrame, sink, checkpoint: str, identity: str = "id", features: str = "f", label: str = "y"):
    """Starts a query that matches each micro-batch; sink(batch, epoch) must be idempotent by epoch."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(neighbours.class_margin(batch, library, identity, features, label), epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_confusion(stream: DataFrame, time: str = "ts", size: str = "1 day", late: str = "1 hour", label: str = "y", prediction: str = "p") -> DataFrame:
    """Confusion counts by event-time window; rows later than the watermark are dropped by the engine."""
    y, p = F.col(label), F.col(prediction)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(~y & ~p).alias("tn"), n(y & ~p).alias("fn"))
