"""Deep pages by an order-statistic table.

Rows are written in ranges of their sort key, with their place in the range, beside a small table that says
how many rows of each group a range holds and how many lie before it. A page finds the ranges that hold its
positions and reads only those, so the millionth page costs what the first one does.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS, RANGES, SCHEMA = "rows", "ranges", "schema"
_AT, _RANGE = "_at", "_range"


def build_rank_index(df: DataFrame, path: str, order: Sequence[str | Column], group: Sequence[str] = ()) -> None:
    """Writes the rows of ``df`` below ``path`` in the order of ``order`` within each ``group``.

    Each task writes its range of (group, order) as a folder of its own. Large groups spread over ranges,
    small ones share one. An index that is built again replaces itself.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    taken = {_AT, _RANGE, "_n", "_before"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the index's own")
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        _AT, F.monotonically_increasing_id()).withColumn(_RANGE, F.shiftright(_AT, 33)).withColumn(
        _AT, F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.mode("overwrite").partitionBy(_RANGE).parquet(f"{path}/{ROWS}")
    spark.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/{SCHEMA}")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/{ROWS}")
    runs = stored.groupBy(*group, _RANGE).agg(F.min(_AT).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).orderBy(*group, _RANGE).write.mode(
        "overwrite").parquet(f"{path}/{RANGES}")


def page(spark: SparkSession, path: str, limit: int, offset: int = 0, **group: object) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a group, in order, with the columns that were indexed.

    As ``orderBy(...).offset(offset).limit(limit)`` of the group's rows where the order leaves no ties.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    mine = F.lit(True)
    for name, value in group.items():
        mine = mine & F.col(name).eqNullSafe(F.lit(value))
    # at most one range more than the page has rows
    ranges = spark.read.parquet(f"{path}/{RANGES}").filter(
        mine & (F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).collect()
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/{SCHEMA}").first()[0]))
    stored = spark.read.schema(schema).parquet(f"{path}/{ROWS}")
    columns = [c for c in stored.columns if c not in (_AT, _RANGE)]
    wanted = F.lit(False)
    for r in ranges:
        low = r["_first"] + max(0, offset - r["_before"])
        high = r["_first"] + min(r["_n"], offset + limit - r["_before"])
        wanted = wanted | ((F.col(_RANGE) == r[_RANGE]) & (F.col(_AT) >= low) & (F.col(_AT) < high))
    return stored.filter(F.col(_RANGE).isin([r[_RANGE] for r in ranges])).filter(wanted & mine).orderBy(
        _RANGE, _AT).select(*columns)


def group_size(spark: SparkSession, path: str, **group: object) -> DataFrame:
    """Number of rows of a group, from the small table alone."""
    mine = F.lit(True)
    for name, value in group.items():
        mine = mine & F.col(name).eqNullSafe(F.lit(value))
    return spark.read.parquet(f"{path}/{RANGES}").filter(mine).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total"))
