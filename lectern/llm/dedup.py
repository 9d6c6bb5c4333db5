"""Exact duplicates by stateful streaming.

Arriving documents are read once: a first stream appends the digest of each normalised text, its doc_id
and its locator (file and row) to a log. A second stream keeps keyed state on that log, without expiry and
on disk: for every digest the number of texts and the identifier and locator of the one that stays. No text
goes through the state. Where a digest is hit more than once, the full bytes of its texts are compared with
the content at the locator; texts that only share the digest are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import limited, small, written
from lectern.session import shared_folder
from lectern.streaming.runs import set_stream_settings

# Bytes of the digest that key the state.
KEY_BYTES = 32
# Files of a micro-batch.
FILES = 10_000
ROW = "doc_id bigint, file string, row bigint, sha binary"
PLACE = ["doc_id", "file", "row"]


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row) of documents read from files, by a stream or not."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def table_stream(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """The rows of a parquet table, a folder or one file, as a stream of its files, so many in a micro-batch."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    # a pattern that only the table fits: a stream takes a plain path for a folder
    return located(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(
        f"{path[:-1]}[{path[-1]}]"))


def digests(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, file, row, sha) of (doc_id, text, file, row): SHA-256 of the text, A-Z in lower case.

    With ``with_text`` also ``normal``, the normalised text in UTF-8. Null texts are empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in limited(batch):
                # of bytes: only A-Z change
                normal = [x.as_buffer().to_pybytes().lower() if x.is_valid else b"" for x in rows.column(3)]
                columns = [*rows.columns[:3], pa.array([hashlib.sha256(x).digest() for x in normal], pa.binary())]
                names = [*PLACE, "sha"]
                if with_text:
                    columns, names = [*columns, pa.array(normal, pa.binary())], [*names, "normal"]
                yield pa.record_batch(columns, names=names)

    return docs.select(*PLACE, "text").mapInArrow(run, ROW + ", normal binary" * with_text)


def observe(arriving: DataFrame, path: str, key_bytes: int = KEY_BYTES) -> None:
    """Takes in all documents (doc_id, text, file, row) that have arrived on a stream since the last time.

    Rows are logged below ``path``, which also holds the checkpoints, so state goes on from run to run. A
    batch that is run again replaces what it wrote.
    """
    spark = arriving.sparkSession
    set_stream_settings(spark)
    # state stores may be many and small: none sets disk aside before it needs it
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    (digests(arriving).writeStream.format("parquet").option("path", f"{path}/rows")
     .option("checkpointLocation", f"{path}/checkpoint-rows").trigger(availableNow=True).start().awaitTermination())
    key = F.substring("sha", 1, key_bytes)
    groups = spark.readStream.schema(ROW).parquet(f"{path}/rows").groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(*PLACE)).alias("keep"))

    def change(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/groups/batch={batch}")

    (groups.writeStream.outputMode("update").foreachBatch(change)
     .option("checkpointLocation", f"{path}/checkpoint-groups").trigger(availableNow=True).start().awaitTermination())


def read_rows(spark: SparkSession, path: str, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, file, row, sha, key) of every document that was taken in."""
    return spark.read.schema(ROW).parquet(f"{path}/rows").withColumn("key", F.substring("sha", 1, key_bytes))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(key, n, keep) of every key: the last state that was written of it. Both only grow."""
    schema = "key binary, n bigint, keep struct<doc_id:bigint,file:string,row:bigint>, batch bigint"
    return spark.read.schema(schema).parquet(f"{path}/groups").groupBy("key").agg(
        F.max("n").alias("n"), F.max("keep").alias("keep"))


def false_hits(stored: DataFrame, hits: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(key, normal): texts that share the key of a hit (key, keep), but not the bytes at its locator.

    Copies are reduced to one row per task before any text moves.
    """
    texts = digests(stored, with_text=True).withColumn("key", F.substring("sha", 1, key_bytes))
    here = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return texts.join(hits, "key").groupBy("key", "normal").agg(F.max(here).alias("kept_content")).filter(
        ~F.col("kept_content")).select("key", "normal")


def resolved(stored: DataFrame, rows: DataFrame, groups: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of all rows, after the check of full bytes.

    ``stored`` (doc_id, text, file, row) has the texts that locators point to.
    """
    groups = written(groups, "dedup-groups")
    hits = written(groups.filter(F.col("n") > 1).select("key", "keep"), "dedup-hits")
    false = written(false_hits(stored, small(hits, hits.count()), key_bytes), "dedup-false-hits")
    met = rows.join(groups, "key")
    if not false.isEmpty():
        clash = written(false.select("key").distinct(), "dedup-clashes")
        clash = small(clash, clash.count())
        texts = written(digests(stored, with_text=True).withColumn("key", F.substring("sha", 1, key_bytes)).join(
            clash, "key", "left_semi"), "dedup-clash-texts")
        same = texts.groupBy("key", "normal").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct(*PLACE)).alias("keep"))
        met = met.join(clash, "key", "left_anti").unionByName(
            texts.join(same, ["key", "normal"]).drop("normal").select(*met.columns))
    kept = F.struct(*PLACE).eqNullSafe(F.col("keep"))
    return met.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                      kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_duplicates(arriving: DataFrame, stored: DataFrame, path: str | None = None,
                     key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document (doc_id, text, file, row).

    ``arriving`` streams the documents, ``stored`` reads all that have arrived so far; ``path`` keeps state
    and log for a later run on more documents. Texts are equal if they are after A-Z became a-z; null
    counts as empty. Of equal texts the row with the largest doc_id stays; a null id is smaller than all,
    and of rows that repeat the id the last by (file, row) stays, so that one row of each group does.
    Texts of any length are read whole; other columns are not read; no documents: no rows.
    """
    spark = arriving.sparkSession
    path = path or shared_folder(spark, "dedup")
    observe(arriving, path, key_bytes)
    return resolved(stored, read_rows(spark, path, key_bytes), read_groups(spark, path), key_bytes)


def table_duplicates(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """``exact_duplicates`` of a parquet table, taken in as a stream of its files."""
    return exact_duplicates(table_stream(spark, path, files), located(spark.read.parquet(path)))
