"""Cover images, stored by the first character of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_NAMES = r"\.(png|jpeg|jpg)$"


def write_covers(covers: DataFrame, path: str) -> None:
    """Append covers(bucket, key, size, last_modified, data), one per key.

    On reading, the newest of a key replaces those written before.
    """
    covers.write.mode("append").partitionBy("bucket").parquet(path)


def image_keys(df: DataFrame) -> DataFrame:
    """Keys that name a servable image, with their bucket."""
    return df.filter(F.col("key").rlike(IMAGE_NAMES)).select(
        "key", F.substring("key", 1, 1).alias("bucket"))


def read_covers(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Stored covers, or those of the given keys; only their buckets are then read.

    Which row of a key is the newest is found without the images; these are fetched by the place of the
    row in the files.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    covers = spark.read.parquet(path).select("*", *place).withColumn("bucket", F.col("bucket").cast("string"))
    narrow = covers.select("bucket", "key", "last_modified", "_file", "_row")
    if keys is not None:
        wanted = image_keys(keys).distinct()
        narrow = narrow.join(wanted, ["bucket", "key"], "left_semi")
        covers = covers.join(wanted.select("bucket").distinct(), "bucket", "left_semi")
    newest = narrow.groupBy("bucket", "key").agg(
        F.max(F.struct("last_modified", "_file", "_row")).alias("at")).select("at._file", "at._row")
    columns = [c for c in covers.columns if c not in ("bucket", "key", "_file", "_row")]
    return covers.join(newest, ["_file", "_row"], "left_semi").select("bucket", "key", *columns)


def list_buckets(covers: DataFrame) -> DataFrame:
    return covers.select("bucket").distinct()
