"""Pooling, normalising and quantising of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.arrays import to_int16, unit_vector

# Numbers that a task holds of its keys' sums.
_HELD = 1 << 23


def mean_pool(
    df: DataFrame, key: str, vec: str, mask: str | None = None, dim: int | None = None,
) -> DataFrame:
    """Mean vector per key over rows whose mask is not 0, with the number of such rows.

    With ``dim``, the size of every vector, each position is an average of its own, so a group of any
    size is reduced before the shuffle to one row of sums per task and nothing is exploded; a vector of
    another size fails the job. Without it vectors may be of any length, and each position is averaged over
    those that have it: a task adds up the vectors of each key, and one row per key and task is shuffled.
    """
    if mask is not None:
        df = df.filter(F.col(mask) != 0)
    if dim is not None:
        checked = F.when(F.size(vec) == dim, F.col(vec)).otherwise(
            F.raise_error(F.lit(f"a vector is not of size {dim}")))
        averages = [F.avg(F.get("_vec", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)]
        pooled = df.select(key, checked.alias("_vec")).groupBy(key).agg(F.count("*").alias("token_num"), *averages)
        return pooled.select(key, "token_num", F.array(*[f"_{i}" for i in range(dim)]).alias("mean"))
    return _pool_any_length(df.select(key, F.col(vec).cast("array<double>").alias("_vec")), key)


class _Sums:
    """Sums of vectors by position, with the vectors that have the position, and those with a value there."""

    def __init__(self, parts: np.ndarray) -> None:
        self.parts = parts  # three rows

    def add(self, parts: np.ndarray) -> None:
        wide, narrow = (self.parts, parts) if self.parts.shape[1] >= parts.shape[1] else (parts, self.parts)
        wide = wide.copy()
        wide[:, :narrow.shape[1]] += narrow
        self.parts = wide


def _pool_any_length(rows: DataFrame, key: str) -> DataFrame:
    """(key, token_num, mean) of rows (key, _vec); null and empty vectors count for nothing."""
    kind = rows.schema[key].dataType
    names, arrow = ["key", "sums", "seen", "valid"], to_arrow_type(kind)
    partial = f"key {kind.simpleString()}, sums array<double>, seen array<double>, valid array<double>"

    def emit(held: list[tuple[object, _Sums]]) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in held], arrow)] + [
            pa.array([s.parts[i] for _, s in held], pa.list_(pa.float64())) for i in range(3)]
        return pa.record_batch(columns, names=names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, _Sums] = {}
        size = 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0))
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            flat = batch.column(1).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            values = np.where(there, flat.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            ends = np.cumsum(sizes)
            width = int(sizes.max())
            at = np.repeat(code, sizes) * width + np.arange(len(values)) - np.repeat(ends - sizes, sizes)
            many = len(codes.dictionary)
            found = np.stack([np.bincount(at, w, many * width).reshape(many, width)
                              for w in (values, np.ones(len(values)), there)])
            longest = np.zeros(many, np.int64)
            np.maximum.at(longest, code, sizes)
            for i, k in enumerate(codes.dictionary.to_pylist()):
                own = found[:, i, :longest[i]]
                if k in held:
                    size -= held[k].parts.size
                    held[k].add(own)
                else:
                    held[k] = _Sums(own.copy())
                size += held[k].parts.size
            if size > _HELD:
                yield emit(list(held.items()))
                held, size = {}, 0
        if held:
            yield emit(list(held.items()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[object, _Sums] | None = None

        def row() -> pa.RecordBatch:
            sums, seen, valid = current[1].parts
            mean = pa.array(np.where(valid > 0, sums / np.maximum(valid, 1), 0.0), mask=valid == 0)
            return pa.record_batch([
                pa.array([current[0]], arrow), pa.array([int(seen.max())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(mean)], pa.int32()), mean)], names=[key, "token_num", "mean"])

        for batch in batches:
            for k, *parts in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                parts = np.stack([p.values.to_numpy(zero_copy_only=False) for p in parts])
                if current is not None and current[0] == k:
                    current[1].add(parts)
                    continue
                if current is not None:
                    yield row()
                current = (k, _Sums(parts))
        if current is not None:
            yield row()

    sums = rows.select(key, "_vec").mapInArrow(add_up, partial)
    return sums.repartition("key").sortWithinPartitions("key").mapInArrow(
        merge, f"{key} {kind.simpleString()}, token_num bigint, mean array<double>")


def l2_normalize(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(vec, unit_vector(F.col(vec)))


def quantize_int16(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(vec, to_int16(F.col(vec)))
