"""Column helpers on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_match(arr: Column, predicate: Callable[[Column], Column]) -> Column:
    """Last element that satisfies the predicate, NULL when none does."""
    return F.get(F.reverse(F.filter(arr, predicate)), F.lit(0))


def first_or_empty(arr: Column) -> Column:
    return F.coalesce(F.get(arr, F.lit(0)), F.lit(""))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(
        vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(vec: Column, eps: float = 1e-12) -> Column:
    """Vector divided by its length, or by ``eps`` when the length is smaller.

    The length sits in a one-element array so that it is worked out once per row.
    """
    length = F.array(F.greatest(l2_norm(vec), F.lit(eps)))
    return F.flatten(F.transform(
        length, lambda n: F.transform(vec, lambda x: x.cast("double") / n)))


def to_int16(vec: Column) -> Column:
    """Samples in [-1, 1] as 16-bit integers, truncated toward zero.

    Larger samples wrap around as in a cast of arrays; one that is no finite number becomes 0.
    """
    def wrapped(x: Column) -> Column:
        whole = F.coalesce((x * F.lit(32767).cast("float")).try_cast("bigint"), F.lit(0))
        return (F.pmod(whole + 32768, F.lit(65536)) - 32768).cast("smallint")

    return F.transform(vec, wrapped)


def keep_tail(arr: Column, n: int) -> Column:
    """The last ``n`` elements."""
    if n <= 0:
        raise ValueError("nothing would be left: the context is smaller than the reply limit")
    return F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, F.lit(n))
