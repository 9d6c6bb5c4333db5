"""Column helpers on text."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the segmentation rule.
WHOLE_BELOW = 50
SPLIT_ABOVE = 50
MERGE_UP_TO = 20
COMMA, WIDE_COMMA = ",", "，"
SENTENCE_ENDS = "。！？!?.…；;"

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def sentences(text: Column) -> Column:
    """Text cut after every run of sentence ends; joined again the parts give the text."""
    return F.split(text, f"(?<=[{SENTENCE_ENDS}])(?=[^{SENTENCE_ENDS}])", -1)


def _halve(piece: Column) -> Column:
    middle = F.floor(F.length(piece) / 2).cast("int")
    return F.when(
        F.length(piece) > SPLIT_ABOVE,
        F.array(F.substring(piece, F.lit(1), middle),
                F.substring(piece, middle + 1, F.length(piece))),
    ).otherwise(F.array(piece))


def split_long(pieces: Column) -> Column:
    """Cut long pieces at commas, then halve once whatever is still long."""
    def commas(s: Column) -> Column:
        # one comma form lets the split run without a pattern
        plain = F.when(F.contains(s, F.lit(WIDE_COMMA)), F.translate(s, WIDE_COMMA, COMMA)).otherwise(s)
        return F.split(plain, COMMA, -1)

    return F.flatten(F.transform(pieces, lambda s: F.when(
        F.length(s) > SPLIT_ABOVE, F.flatten(F.transform(commas(s), _halve)),
    ).otherwise(F.array(s))))


def merge_short(pieces: Column) -> Column:
    """Join neighbours with a comma while the joined length stays within the limit.

    Only lengths are folded from the left: each piece either goes on with the run before it or starts
    one of its own. The runs are then cut out of the array, so texts may hold any character.
    """
    def step(acc: Column, piece: Column) -> Column:
        joined = acc["length"] + 1 + F.length(piece)
        fits = joined <= MERGE_UP_TO
        return F.struct(
            F.when(fits, joined).otherwise(F.length(piece)).alias("length"),
            F.concat(acc["marks"], F.when(fits, "0").otherwise("1")).alias("marks"))

    start = F.struct(F.lit(MERGE_UP_TO).alias("length"), F.lit("").alias("marks"))
    marks = F.aggregate(pieces, start, step, lambda acc: F.split(acc["marks"], ""))
    starts = F.array_compact(F.transform(marks, lambda m, i: F.when(m == "1", i)))

    def run(found: Column) -> Column:
        return F.transform(found, lambda at, j: F.array_join(F.slice(
            pieces, at + 1, F.coalesce(F.get(found, j + 1), F.size(pieces)) - at), COMMA))

    return F.flatten(F.transform(F.array(starts), run))


def segments(text: Column) -> Column:
    """Speech segments of a text."""
    return F.when(F.length(text) < WHOLE_BELOW, F.array(text)).otherwise(
        F.flatten(F.transform(F.array(split_long(sentences(text))), merge_short)))


def token_count(text: Column, pattern: str = r"\S+") -> Column:
    """Number of pattern matches, without building them."""
    return F.regexp_count(text, F.lit(pattern))


def last_position(text: Column, needle: str) -> Column:
    """Zero-based start of the last occurrence, -1 when there is none."""
    back = F.locate(needle[::-1], F.reverse(text))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(text) - back - len(needle) + 1)


def ends_with_part(text: Column, stop: str) -> Column:
    """True when some beginning of ``stop`` ends the text."""
    found = F.lit(False)
    for size in range(1, len(stop) + 1):
        found = found | text.endswith(stop[:size])
    return found


def stop_cut(text: Column, stops: Sequence[str]) -> Column:
    """struct(text, stopped, partial) after looking at the stops in list order.

    The first stop that occurs cuts the text at its last occurrence; a stop that only begins at the
    end of the text ends the search and sets ``partial``.
    """
    if any(not s for s in stops):
        raise ValueError("empty stop sequence")

    def outcome(value: Column, stopped: bool, partial: bool) -> Column:
        return F.struct(value.alias("text"), F.lit(stopped).alias("stopped"),
                        F.lit(partial).alias("partial"))

    result = outcome(text, False, False)
    for stop in reversed(stops):
        result = (
            F.when(F.contains(text, F.lit(stop)),
                   outcome(F.substring(text, F.lit(1), last_position(text, stop)), True, False))
            .when(ends_with_part(text, stop), outcome(text, False, True))
            .otherwise(result))
    return result


def file_stem(path: Column) -> Column:
    """File name without folder and without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def contains_text(col: Column, query: str, ci: bool = True, wildcards: bool = False) -> Column:
    """Substring test; with ``wildcards`` the characters % and _ match as in LIKE.

    ``ci`` ignores the case of ASCII letters only.
    """
    if ci:
        col, query = F.translate(col, _UPPER, _LOWER), query.translate(_TO_LOWER)
    if not wildcards:
        return F.contains(col, F.lit(query))
    # a backslash stands for itself
    return col.like("%" + query.replace("\\", "\\\\") + "%")
