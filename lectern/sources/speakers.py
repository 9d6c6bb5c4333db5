"""The speaker registry file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.model import SPEAKERS
from lectern.operators.speech import latest_speakers


def load_speakers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Speakers of JSON array files; of entries with one audio_id the last counts.

    The order is that of the file paths, then of the places in a file. A file of several lines is read
    by one task, which suits a registry; with ``multi_line`` off each line holds one array, so that
    large files can be split.
    """
    rows = spark.read.schema(SPEAKERS).json(path, multiLine=multi_line)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return latest_speakers(rows.withColumn("_place", place), "_place")


def save_speakers(speakers: DataFrame, path: str) -> None:
    """Writes the registry in the form that ``load_speakers`` reads without ``multi_line``."""
    speakers.select(F.to_json(F.array(F.struct(*speakers.columns))).alias("value")).write.mode(
        "overwrite").text(path)
