"""Column types of the domain tables and messages."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_TS, _F = T.TimestampType(), T.FloatType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


BOOKS = _table(
    ("id", _L), ("size", _L), ("path", _S), ("ctime", _TS), ("utime", _TS), ("title", _S),
    ("sub_title", _S), ("language", _S), ("cover_url", _S), ("uuid", _S), ("isbn", _S),
    ("asin", _S), ("identifier", _S), ("category", _S), ("author", _S), ("author_url", _S),
    ("author_sort", _S), ("publisher", _S), ("description", _S), ("tags", T.ArrayType(_S)),
    ("series", _S), ("series_index", _S), ("publish_date", _S), ("rating", _F),
    ("publisher_url", _S), ("count_visit", _L), ("count_download", _L),
)
PROGRESS = _table(
    ("book_id", _L), ("user_id", _L), ("start_date", _TS), ("updated_at", _TS),
    ("expt_end_date", _TS), ("end_date", _TS), ("progress_index", _L), ("progress", T.DoubleType()),
    ("para_position", _L),
)
PROGRESS_EVENTS = _table(
    ("event_id", _L), ("ts", _TS), ("book_id", _L), ("user_id", _L), ("progress", T.DoubleType()),
    ("progress_index", _L), ("para_position", _L),
)
SPEAKERS = _table(
    ("audio_id", _S), ("gender", _I), ("default_type", _I), ("display_name", _S),
    ("description", _S), ("avatar_url", _S), ("path", _S),
)

MESSAGE = _table(("role", _S), ("content", _S))
USAGE = _table(("prompt_tokens", _L), ("completion_tokens", _L), ("total_tokens", _L))
CHOICE = _table(
    ("index", _I), ("finish_reason", _S), ("message", MESSAGE), ("delta", MESSAGE), ("text", _S),
)
RESPONSE = _table(
    ("id", _S), ("object", _S), ("created", _L), ("choices", T.ArrayType(CHOICE)), ("usage", USAGE),
)
WORKER_FRAME = _table(("text", _S), ("error_code", _I), ("usage", USAGE), ("finish_reason", _S))

_ELEMENTS = T.ArrayType(_table(("_VALUE", _S), ("_id", _S), ("_scheme", _S)))
PACKAGE = _table(
    ("metadata", T.StructType(
        [T.StructField(n, _ELEMENTS) for n in (
            "identifier", "title", "creator", "subject", "language", "publisher", "description",
            "date")]
        + [T.StructField("meta", T.ArrayType(_table(("_name", _S), ("_content", _S))))])),
    ("manifest", _table(
        ("item", T.ArrayType(_table(("_id", _S), ("_properties", _S), ("_href", _S)))))),
)
