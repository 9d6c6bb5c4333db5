"""Catalogue kept current from a stream of arriving book files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lectern.operators.ingest import catalogue_rows, new_rows, newest_covers, unpack_packages
from lectern.operators.status import scan_errors
from lectern.sources.epub_source import read_package
from lectern.sources.library import FILES_SCHEMA, PACKAGES_SCHEMA, read_files, read_packages
from lectern.streaming.runs import check_state_on_disk

# Seconds that a file that failed waits for the first retry; every further one takes twice as long.
FIRST_WAIT = 60
LONGEST_WAIT = 24 * 3600
# Tries after which a file is left alone until it changes.
TRIES = 12
# Seconds that a loaded path is remembered.
REMEMBERED = 7 * 24 * 3600


def ingest_batch(files: DataFrame, sink: str, batch: int) -> None:
    """Add one batch of files(path, modificationTime, length, content) to the catalogue at ``sink``."""
    add_packages(read_packages(files), sink, batch)


def add_packages(packages: DataFrame, sink: str, batch: int) -> None:
    """Add one batch of opened packages to the catalogue at ``sink``.

    The packages are written first, so that each file is opened once, and then the rows made from them,
    so that each document is parsed once. Every output is a folder of the batch, replaced when the batch
    is run again. Batches below 0 are retries; every other batch knows their books.
    """
    spark = packages.sparkSession

    def folder(name: str) -> str:
        return f"{sink}/{name}/batch={batch}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(folder(name))
        return spark.read.schema(df.schema).parquet(folder(name))

    packages = written(packages, "packages")
    books = written(catalogue_rows(unpack_packages(packages), keep=["cover_bytes"]), "candidates")
    rows = books.drop("cover_bytes")
    known = rows.select("identifier").limit(0)
    if batch != 0:
        earlier = F.col("batch") < batch if batch > 0 else (F.col("batch") >= 0) | (F.col("batch") > batch)
        # of a large catalogue only the identifiers of this batch take part in the insert
        known = spark.read.parquet(f"{sink}/books").filter(earlier).select(
            "identifier").join(rows.select("identifier"), "identifier", "left_semi")
    written(new_rows(known, rows, order=["ctime", "path"]), "books")
    newest_covers(books).write.mode("overwrite").partitionBy("bucket").parquet(folder("covers"))
    written(scan_errors(packages), "errors")


def retry_failed(spark: SparkSession, root: str, sink: str, number: int, glob: str = "*.epub") -> bool:
    """Takes in the files that failed so far and have changed since; False if there are none.

    The stream's checkpoint marks a file whether it could be read or not, so failed files come back
    through here, as the retry of this ``number``, 1 for the first. Run it while no stream writes to the
    sink. ``retrying_stream`` does the same by itself.
    """
    tried = spark.read.parquet(f"{sink}/packages").groupBy("path").agg(
        F.bool_or(F.col("error").isNull()).alias("loaded"), F.max("ctime").alias("tried_at"))
    failed = tried.filter(~F.col("loaded")).withColumnRenamed("path", "_path")
    files = read_files(spark, root, glob)
    changed = files.join(failed, (F.col("path") == F.col("_path")) & (
        F.col("modificationTime") > F.col("tried_at")), "left_semi")
    if changed.select("path").isEmpty():
        return False
    ingest_batch(changed, sink, -number)
    return True


def _arriving(spark: SparkSession, root: str, glob: str, files_per_batch: int) -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema(FILES_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(root))


def ingest_stream(
    spark: SparkSession, root: str, sink: str, checkpoint: str, glob: str = "*.epub",
    files_per_batch: int = 100_000,
) -> StreamingQuery:
    """Ingest the files that have arrived below ``root``; the checkpoint remembers them.

    One checkpoint belongs to one sink. A batch takes at most ``files_per_batch`` files. Files that could
    not be read are taken up by ``retry_failed``.
    """
    return (
        _arriving(spark, root, glob, files_per_batch).writeStream.foreachBatch(
            lambda df, batch: ingest_batch(df, sink, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


class Retries(StatefulProcessor):
    """Opens files by path; one that fails waits, twice as long each time, and is opened again.

    State of a path: the tries so far, and the size and time of what was tried. It goes when the file has
    been left alone or, once loaded, when ``remembered`` seconds have passed.
    """

    def __init__(self, first_wait: float, longest_wait: float, tries: int, remembered: float) -> None:
        self.first_wait, self.longest_wait, self.tries = first_wait, longest_wait, tries
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", "n int, size bigint, ctime timestamp", None)
        self.loaded = handle.getValueState("loaded", "ctime timestamp", int(self.remembered * 1000))

    def _try(self, path: str, size: int, ctime: pd.Timestamp, n: int, now: int) -> pd.DataFrame:
        found = read_package(path)
        if found["error"] is None:
            self.tried.clear()
            self.loaded.update((ctime.to_pydatetime(),))
        elif n < self.tries:
            self.tried.update((n, size, ctime.to_pydatetime()))
            wait = min(self.first_wait * 2 ** (n - 1), self.longest_wait)
            self.handle.registerTimer(now + int(wait * 1000))
        else:
            self.tried.clear()
        return pd.DataFrame([{"path": path, "size": size, "ctime": ctime, **found}])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.ctime)
        known = self.loaded.get()
        if known is None or pd.Timestamp(known[0]) < latest.ctime:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            yield self._try(key[0], latest.size, latest.ctime, 1, timerValues.getCurrentProcessingTimeInMs())
        else:
            yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self.tried.get()
        if waiting is None:
            yield pd.DataFrame()
            return
        n, size, ctime = waiting
        yield self._try(key[0], size, pd.Timestamp(ctime), n + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def opened_stream(
    files: DataFrame, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT, tries: int = TRIES,
    remembered: float = REMEMBERED,
) -> DataFrame:
    """Packages from a stream of files(path, length, modificationTime), opened by path in keyed state.

    Every try of a file is a row, with an error if it failed. A file that changes under its name is tried
    at its next turn as it is then; size and time are those of its listing.
    """
    check_state_on_disk(files.sparkSession)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("ctime"))
    return listed.groupBy("path").transformWithStateInPandas(
        Retries(first_wait, longest_wait, tries, remembered), PACKAGES_SCHEMA, "Append", "ProcessingTime")


def retrying_stream(
    spark: SparkSession, root: str, sink: str, checkpoint: str, glob: str = "*.epub", every: str = "10 seconds",
    files_per_batch: int = 100_000, **waits: float,
) -> StreamingQuery:
    """Ingest files as they arrive below ``root``, and those that failed when they can be read.

    Runs until it is stopped. The files are listed by Spark and opened in the tasks, with what is needed of
    each; ``waits`` are those of ``opened_stream``.
    """
    packages = opened_stream(_arriving(spark, root, glob, files_per_batch), **waits)
    return (
        packages.writeStream.foreachBatch(lambda df, batch: add_packages(df, sink, batch))
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())
