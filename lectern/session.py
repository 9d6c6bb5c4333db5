"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    # no call site for every column built on the driver
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join input even where that costs one more exchange above
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows that go to Python at once, however long their texts are
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # sessions are merged inside each task before the shuffle, so a busy user moves few rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # keyed streaming state that spills to disk instead of the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "lectern", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Gives a session that was started elsewhere the bound on the bytes of a batch sent to Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, SETTINGS[name])


_local_base: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A machine-local folder, removed at the end of the program, is used only where that setting is absent
    and the session is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_base:
            _local_base.append(tempfile.TemporaryDirectory(prefix="lectern-"))
        base = _local_base[0].name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
