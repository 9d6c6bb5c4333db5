"""Status ticks from a stream of scan events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.status import tick_counts


def status_tick_stream(events: DataFrame, every: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """Counts per tick, each written once the watermark has passed it; later rows are dropped.

    The running count over written ticks is ``operators.status.running_ticks``.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return tick_counts(timed.withWatermark("ts", watermark), every)
