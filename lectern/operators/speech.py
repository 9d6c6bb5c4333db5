"""Speech jobs: text segments and the voices that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import segments

# Fixed values of the speech service.
DEFAULT_VOICE_PATH = "female-0-100.wav"
DEFAULT_LANG = "zh-cn"


def segment_text(df: DataFrame, col: str = "text", key: str = "id") -> DataFrame:
    """Segments (seg_idx, segment) of each text."""
    return df.select(key, F.posexplode(segments(F.col(col))).alias("seg_idx", "segment"))


def assign_speaker(requests: DataFrame, speakers: DataFrame) -> DataFrame:
    """Requests with the voice path of their speaker or the default one, and a language.

    A registry that repeats an id gives the greatest of its paths, so every request stays one row. The
    registry is joined without a hint: Spark broadcasts it when its measured size allows.
    """
    voices = speakers.groupBy("audio_id").agg(F.max("path").alias("voice_path"))
    joined = requests.join(voices, "audio_id", "left")
    columns = [F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit(DEFAULT_LANG)).alias("lang")
               if c == "lang" else F.col(c) for c in requests.columns]
    return joined.select(*columns, F.coalesce("voice_path", F.lit(DEFAULT_VOICE_PATH)).alias("voice_path"))


def speech_jobs(texts: DataFrame, speakers: DataFrame) -> DataFrame:
    """One job per segment of texts(id, text, lang, audio_id) with its voice."""
    return assign_speaker(texts, speakers).select(
        "id", "lang", "audio_id", "voice_path",
        F.posexplode(segments(F.col("text"))).alias("seg_idx", "segment"))


def latest_speakers(speakers: DataFrame, order: str) -> DataFrame:
    """One row per audio_id, the last by ``order``, which no two rows of an id share.

    The last place of each id is found on narrow columns; only the rows that hold it are then joined.
    """
    last = speakers.groupBy("audio_id").agg(F.max(order).alias(order))
    return speakers.join(last, ["audio_id", order], "left_semi").drop(order)


def add_speakers(existing: DataFrame, added: DataFrame, order: str | None = None) -> DataFrame:
    """Registry with the added speakers; an added one replaces an older one of the same id.

    Of several added rows with one id the last by ``order`` counts; without an order, the one whose
    columns are greatest from left to right.
    """
    if order:
        added = latest_speakers(added, order)
    else:
        columns = [c for c in added.columns if c != "audio_id"]
        added = added.groupBy("audio_id").agg(F.max(F.struct(*columns)).alias("s")).select(
            "audio_id", "s.*").select(*added.columns)
    return existing.join(added.select("audio_id"), "audio_id", "left_anti").unionByName(added)


def drop_speakers(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("audio_id"), "audio_id", "left_anti")
