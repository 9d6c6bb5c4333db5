"""The progress table kept current from a stream of events.

Each micro-batch is reduced to one row per key and written as a change of its own; a batch that is
run again replaces its change. Readers merge the last base with the changes after it, and compaction
folds the changes into a new base, so no batch rewrites the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.progress import merge_changes, upsert_progress


def write_change(events: DataFrame, path: str, batch: int) -> None:
    upsert_progress(None, events).write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def progress_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of all arrived events below ``path``; one checkpoint belongs to one path."""
    return (
        events.writeStream.foreachBatch(lambda df, batch: write_change(df, path, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _last_base(spark: SparkSession, path: str) -> int:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bases")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1
    done = [str(s.getPath().getName()) for s in fs.listStatus(root)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(name.split("=")[1]) for name in done), default=-1)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The progress table as of the last written change."""
    base = _last_base(spark, path)
    changes = spark.read.parquet(f"{path}/changes").filter(F.col("batch") > base)
    if base >= 0:
        whole = spark.read.parquet(f"{path}/bases/upto={base}").withColumn("batch", F.lit(base))
        changes = whole.unionByName(changes)
    return merge_changes(changes, "batch")


def compact_progress(spark: SparkSession, path: str) -> None:
    """Fold all written changes into a new base."""
    last = spark.read.parquet(f"{path}/changes").agg(F.max("batch")).first()[0]
    read_progress(spark, path).write.mode("overwrite").parquet(
        f"{path}/bases/upto={last}")
