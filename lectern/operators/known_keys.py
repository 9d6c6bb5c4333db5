"""Insert-if-absent with a persisted Bloom filter.

Beside a table lies a filter of its keys: bitmaps, each for the keys of one part by hash, one row per part
and batch. Incoming keys meet the bitmap of their part; what it does not know is new for sure. Only the rest,
known keys and a few false alarms, has to meet the table, whose rows are first checked against a filter of
just these keys, so hardly any of them move. Every batch adds its own keys, and nothing is rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ingest import new_rows

# With ten bits a key and seven hashes one key in a hundred is a false alarm: 50 million keys.
PARTS, BITS, HASHES = 64, 1 << 23, 7
# Bits of the filter that is sent to the table's tasks: 8 MB, whatever the number of keys.
SENT_BITS = 1 << 26
FILTER = "part int, parts int, bits bigint, bitmap binary"


def places(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit hash, a row per hash function."""
    h = hashed.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)])


class Bitmap:
    def __init__(self, bits: int, data: bytes | None = None) -> None:
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def add(self, hashed: np.ndarray) -> None:
        at = places(hashed, self.bits).ravel()
        np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, hashed: np.ndarray) -> np.ndarray:
        at = places(hashed, self.bits)
        set_ = (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return set_.all(axis=0)


def add_keys(rows: DataFrame, path: str, batch: int, key: str = "identifier", parts: int = PARTS,
             bits: int = BITS) -> None:
    """Writes the filter of the keys of a batch; a batch that runs again replaces it.

    Hashes are dealt by part and set bit by bit as they come, so a task holds one bitmap. Parts and bits
    stay those of the first batch.
    """
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bitmap = None, None

        def row() -> pa.RecordBatch:
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([parts], pa.int32()), pa.array([bits], pa.int64()),
                pa.array([bitmap.bytes.tobytes()], pa.binary())], names=["part", "parts", "bits", "bitmap"])

        for batch in batches:
            own, hashed = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, end in _runs(own):
                if part != own[begin]:
                    if bitmap is not None:
                        yield row()
                    part, bitmap = int(own[begin]), Bitmap(bits)
                bitmap.add(hashed[begin:end])
        if bitmap is not None:
            yield row()

    hashed = rows.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("hashed"))
    hashed.select(_part(parts), "hashed").repartition("part").sortWithinPartitions("part").mapInArrow(
        fill, FILTER).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _part(parts: int):
    # other bits than those that the bitmap's places come from first
    return F.pmod(F.shiftrightunsigned("hashed", 17), F.lit(parts)).cast("int").alias("part")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        yield from zip(cuts, cuts[1:])


def maybe_known(keys: DataFrame, path: str, key: str = "identifier") -> DataFrame:
    """The keys that the filter at ``path`` may hold: all that it does, and one in a hundred others."""
    spark = keys.sparkSession
    kind = keys.schema[key].dataType.simpleString()
    stored = spark.read.schema(FILTER).parquet(path)
    sizes = stored.select("parts", "bits").first()
    if sizes is None:
        return keys.select(key).limit(0)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bitmap = None, None
        for batch in batches:
            own, hashed = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            told = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            keep = np.zeros(len(own), bool)
            for begin, end in _runs(own):
                if part != own[begin]:
                    part, bitmap = own[begin], Bitmap(sizes["bits"])
                for at in begin + np.flatnonzero(told[begin:end]):
                    bitmap.bytes |= np.frombuffer(batch.column(1)[int(at)].as_buffer(), np.uint8)
                asked = begin + np.flatnonzero(~told[begin:end])
                keep[asked] = bitmap.may_hold(hashed[asked].astype(np.int64))
            yield pa.record_batch([batch.column(3).filter(pa.array(keep))], names=[key])

    asked = keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("hashed"), key).select(
        _part(sizes["parts"]), F.lit(None).cast("binary").alias("bitmap"), "hashed", key)
    bitmaps = stored.select("part", "bitmap", F.lit(0).cast("bigint").alias("hashed"), F.lit(None).cast(kind).alias(key))
    return asked.unionByName(bitmaps).repartition("part").sortWithinPartitions(
        "part", F.col("bitmap").isNull()).mapInArrow(probe, f"{key} {kind}")


def may_meet(rows: DataFrame, keys: DataFrame, key: str = "identifier", bits: int = SENT_BITS) -> DataFrame:
    """The rows whose key may be among ``keys``, without a shuffle: a filter of bounded size is sent to them."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(bits)
        for batch in batches:
            bitmap.add(batch.column(0).to_numpy())
        yield pa.record_batch([pa.array([bitmap.bytes.tobytes()], pa.binary())], names=["bitmap"])

    whole = Bitmap(bits)
    for row in keys.select(F.xxhash64(key).alias("hashed")).coalesce(32).mapInArrow(
            fill, "bitmap binary").toLocalIterator():
        whole.bytes |= np.frombuffer(row["bitmap"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(whole)
    columns = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(len(columns)).to_numpy()
            yield batch.select(columns).filter(pa.array(sent.value.may_hold(hashed)))

    return rows.filter(F.col(key).isNotNull()).withColumn("_hashed", F.xxhash64(key)).mapInArrow(keep, rows.schema)


def new_rows_filtered(existing: DataFrame, incoming: DataFrame, path: str, key: str = "identifier",
                      order: Sequence[str] = ("ctime",)) -> DataFrame:
    """The rows that ``new_rows`` gives, with the filter of the existing keys at ``path``.

    The filter must hold every key of ``existing``: each batch that is inserted is added to it as well.
    """
    maybe = maybe_known(incoming.select(key).distinct(), path, key)
    return new_rows(may_meet(existing.select(key), maybe, key), incoming, key, order)


def insert_new_filtered(existing: DataFrame, incoming: DataFrame, path: str, key: str = "identifier",
                        order: Sequence[str] = ("ctime",)) -> DataFrame:
    """The rows that ``insert_new`` gives, with the filter of the existing keys at ``path``."""
    return existing.unionByName(new_rows_filtered(existing, incoming, path, key, order))
