"""Scan reports and status ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan_report(parsed: DataFrame, books: DataFrame) -> DataFrame:
    """Counts of scanned, parsed and failed files, their bytes, and the size of the catalogue.

    The messages themselves are a table of their own, see ``scan_errors``: there may be very many.
    """
    report = parsed.agg(
        F.count("*").alias("scan_count"), F.count_if(F.col("error").isNull()).alias("epub_count"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("disk_usage"))
    return report.withColumn("total", books.agg(F.count("*")).scalar())


def scan_errors(parsed: DataFrame) -> DataFrame:
    """Error messages of a scan, one row per failed file."""
    return parsed.filter(F.col("error").isNotNull()).select(
        "path", F.concat(F.lit("文件："), "path", F.lit(" 解析失败："), "error").alias("message"))


def tick_counts(events: DataFrame, every: str = "1 second") -> DataFrame:
    """Events and new errors per tick of events(ts, ok), for tables and streams."""
    return events.groupBy(F.window("ts", every).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("new_errors")
    ).select(F.col("w.start").alias("tick_start"), F.col("w.end").alias("tick"), "n", "new_errors")


def running_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks with the running count of events.

    The running count is summed inside each day and the days' totals are summed apart, so no task
    sees every tick.
    """
    ticks = ticks.withColumn("day", F.to_date("tick_start"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # one row per calendar day
    days = ticks.groupBy("day").agg(F.sum("n").alias("n")).select(
        "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    in_day = Window.partitionBy("day").orderBy("tick_start")
    return ticks.join(days, "day").select(
        "tick", "n", (F.col("earlier") + F.sum("n").over(in_day)).alias("scan_count"), "new_errors")


def status_ticks(events: DataFrame, every: str = "1 second") -> DataFrame:
    """Running count of events and the new errors, per tick with events."""
    return running_ticks(tick_counts(events, every))


def tick_errors(events: DataFrame, every: str = "1 second") -> DataFrame:
    """Error messages with the tick that reports them: those since the tick before."""
    return events.filter(~F.col("ok")).select(
        F.window("ts", every)["end"].alias("tick"), "path", "error")
