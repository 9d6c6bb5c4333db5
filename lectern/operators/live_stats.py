"""Catalogue statistics kept current from batches, by sketches that can be merged.

Each batch of books leaves one row: its number of books and a sketch of its authors, publishers and tags.
Reading unites the rows, so no batch is looked at again, and books that come twice count once in the
distinct numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Registers of a sketch as a power of two: 2^12 give a standard error of 1.6 %.
PRECISION = 12
SKETCHED = ("author", "publisher")


def batch_stats(books: DataFrame, tags: DataFrame | None = None, precision: int = PRECISION) -> DataFrame:
    """One row: total, and a sketch of the author, publisher and tag of books and tags(book_id, tag)."""
    if tags is None:
        tags = books.sparkSession.createDataFrame([], "tag string")
    return books.agg(
        F.count("*").alias("total"), *[F.hll_sketch_agg(c, precision).alias(c) for c in SKETCHED]).withColumn(
        "tag", tags.agg(F.hll_sketch_agg("tag", precision)).scalar())


def add_batch(books: DataFrame, tags: DataFrame | None, path: str, batch: int, precision: int = PRECISION) -> None:
    """Writes the row of a batch; a batch that runs again replaces it."""
    batch_stats(books, tags, precision).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def united(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches as one: total, and the united sketches."""
    return spark.read.parquet(path).agg(
        F.sum("total").alias("total"), *[F.hll_union_agg(c).alias(c) for c in (*SKETCHED, "tag")])


def live_stats(spark: SparkSession, path: str) -> DataFrame:
    """Totals of books, and estimates of different authors, publishers and tags, over all batches."""
    return united(spark, path).select(
        "total", *[F.hll_sketch_estimate(c).alias(c) for c in (*SKETCHED, "tag")])
