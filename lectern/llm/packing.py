"""Packing: documents concatenated and cut into windows of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import limited, prefix_sums, small, tokenizer_file, word_encoder, written

LENGTH = 4096
END = 2
ENCODED = pa.schema([
    ("part", pa.int64()), ("base", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
    ("ids", pa.binary())])


def encode_parts(docs: DataFrame, tokenizer_path: str | None = None, end: int = END) -> DataFrame:
    """First pass: ids of each document with the end id, and its place within its partition.

    (part, base, doc_id, n_tokens, ids): ``ids`` are little-endian unsigned 32-bit integers, ``base``
    counts the ids of the documents before it in the partition. Text null or empty: the end id alone.
    """
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, base = word_encoder(json.value), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for rows in limited(batch):
                ids = [x + last for x in encoder.encode(rows.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                starts = base + np.cumsum(sizes) - sizes
                base += int(sizes.sum())
                yield pa.record_batch([
                    np.full(len(ids), part, np.int64), starts, rows.column(0), sizes,
                    pa.array(ids, pa.binary())], schema=ENCODED)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        encode, "part bigint, base bigint, doc_id bigint, n_tokens bigint, ids binary")


def cut_windows(encoded: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second pass: totals of the partitions are summed up to global offsets, then windows are cut.

    One boundary record per piece of a document in a window; see ``pack``.
    """
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = written(prefix_sums(totals, "part", ["n"]), "packing-offsets")
    at = encoded.join(small(totals.select("part", "n_before", "n_total"), totals.count()), "part")
    place, size = F.col("place"), F.col("n_tokens")

    def piece(window):
        begin = F.greatest(window * length - place, F.lit(0))
        many = F.least((window + 1) * length - place, size) - begin
        there = F.least(F.lit(length), F.col("n_total") - window * length)
        return F.struct(
            begin.alias("start"), many.alias("length"),
            F.crc32(F.substring("ids", (begin * 4 + 1).cast("int"), (many * 4).cast("int")))
            .alias("ids_crc32"), size.alias("doc_tokens"), window.alias("sequence_id"),
            F.greatest(place - window * length, F.lit(0)).alias("offset"),
            # a window is padded unless its length is a power of two
            F.when(F.bit_count(there) == 1, there).otherwise(length).alias("padded_to"))

    placed = at.withColumn("place", F.col("n_before") + F.col("base"))
    windows = F.sequence(F.floor(place / length), F.floor((place + size - 1) / length))
    return placed.select("doc_id", F.inline(F.transform(windows, piece)))


def pack(docs: DataFrame, length: int = LENGTH, tokenizer_path: str | None = None,
         end: int = END) -> DataFrame:
    """Documents (doc_id, text) as pieces of sequences of ``length`` tokens.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to). Every id lies in
    one piece, every sequence but the last is full. The order is that of the written first pass, which
    is kept, so a repeated task cuts the same pieces. Null texts count as empty and pack their end id;
    a null doc_id is kept; repeated rows are documents of their own; a text of any length is encoded whole
    and lies in as many pieces as it takes; no documents: no rows; other
    columns are not read.
    """
    return cut_windows(written(encode_parts(docs, tokenizer_path, end), "packing"), length)
