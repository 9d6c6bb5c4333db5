"""Binary token files: blocks of ids as compressed byte or bit planes, with a chunk index.

A file, all numbers little-endian:

    header    magic, planes in a block (4 byte planes or 32 bit planes), ids in a full block
    blocks    for each block its planes, each a zstandard frame
    documents a zstandard frame: per document its id (int64), whether it has one (uint8), its ids (int64)
    index     per block: ids in it (uint32), then the length of each of its planes (uint32)
    trailer   lengths of documents and index, ids, documents, task and place of the file, magic

The planes of one block follow each other, so the index gives every chunk's place by summing lengths.
Spark's text writer puts one file image per file and a line feed behind it. So files go to any store
Spark can write to, and the files of a failed task never appear.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import limited, prefix_sums, small, tokenizer_file, word_encoder, written
from lectern.session import shared_folder

MAGIC = b"LTPLANE1"
HEADER, TRAILER = "<8sII", "<qqqqqq8s"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
LEVEL = 3
END = 2


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """A block of uint32 ids as rows of bytes: row k holds byte k, or packed bit k, of every id."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(by_byte.T)
    bits = np.unpackbits(by_byte, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, count: int) -> np.ndarray:
    """The ids of a block; four rows are byte planes, 32 rows are bit planes."""
    if len(planes) == 4:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, bitorder="little", count=count)
    by_byte = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return by_byte.view("<u4").reshape(-1)


def pack_file(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, task: int, place: int,
              kind: str = "byte", block_ids: int = BLOCK_IDS) -> bytes:
    """A file image of whole documents, given all their ids one after the other."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    blocks, index, rows = [], [], 4 if kind == "byte" else 32
    for start in range(0, len(ids), block_ids):
        block = ids[start:start + block_ids]
        planes = [squeeze(plane.tobytes()) for plane in to_planes(block, kind)]
        blocks += planes
        index.append([len(block), *map(len, planes)])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    documents = squeeze(names.tobytes() + known.tobytes() + np.asarray(sizes, "<i8").tobytes())
    listed = np.array(index, "<u4").tobytes()
    return b"".join([
        struct.pack(HEADER, MAGIC, rows, block_ids), *blocks, documents, listed,
        struct.pack(TRAILER, len(documents), len(listed), len(ids), len(doc_ids), task, place, MAGIC)])


def trailer(image: bytes) -> tuple[int, int, int, int, int, int]:
    """(length of documents, length of index, ids, documents, task, place) of a file image."""
    *found, magic = struct.unpack_from(TRAILER, image, len(image) - struct.calcsize(TRAILER))
    if magic != MAGIC or image[:8] != MAGIC:
        raise ValueError("not a token file")
    return tuple(found)


def read_block(image: bytes, number: int) -> np.ndarray:
    """The ids of one block alone, found through the index."""
    _, listed, *_ = trailer(image)
    _, rows, _ = struct.unpack_from(HEADER, image)
    end = len(image) - struct.calcsize(TRAILER)
    index = np.frombuffer(image[end - listed:end], "<u4").reshape(-1, rows + 1).astype(np.int64)
    place = struct.calcsize(HEADER) + int(index[:number, 1:].sum())
    count, planes = int(index[number, 0]), []
    for size in index[number, 1:].tolist():
        planes.append(np.frombuffer(
            zstandard.ZstdDecompressor().decompress(image[place:place + size]), np.uint8))
        place += size
    return from_planes(np.stack(planes), count)


def read_file(image: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, document ids, ids of each document) of a file image."""
    documents, listed, n_ids, n_docs, _, _ = trailer(image)
    _, rows, block_ids = struct.unpack_from(HEADER, image)
    ids = np.empty(n_ids, "<u4")
    unpack = zstandard.ZstdDecompressor().decompress
    end = len(image) - struct.calcsize(TRAILER)
    index = np.frombuffer(image[end - listed:end], "<u4").reshape(-1, rows + 1).tolist()
    place, start = struct.calcsize(HEADER), 0
    for count, *sizes in index:
        planes = []
        for size in sizes:
            planes.append(np.frombuffer(unpack(image[place:place + size]), np.uint8))
            place += size
        ids[start:start + count] = from_planes(np.stack(planes), count)
        start += count
    raw = unpack(image[end - listed - documents:end - listed])
    names = np.frombuffer(raw, "<i8", n_docs).tolist()
    known = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
    return ids, [n if k else None for n, k in zip(names, known)], sizes


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end: int = END,
                      kind: str = "byte", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> None:
    """Writes the documents (doc_id, text) as token files in ascending doc_id order, nulls first.

    Every document is its ids and the end id; a null or empty text is the end id alone. Rows of one
    doc_id go by the hash of their text, equal rows are all written. A file holds whole documents and
    is closed at ``file_ids`` ids, so it is larger only by a part of one document. Texts of any length are
    encoded whole; no documents: no file with documents.
    """
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer_path))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, place = word_encoder(json.value), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def image() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes = np.array([len(x) // 4 for x in parts], np.int64)
            return pa.record_batch(
                [pa.array([pack_file(ids, names, sizes, task, place, kind, block_ids)], pa.binary())],
                names=["image"])

        for batch in batches:
            for rows in limited(batch):
                found = encoder.encode(rows.column(1).to_pylist())
                for name, ids in zip(rows.column(0).to_pylist(), found):
                    names.append(name)
                    parts.append(ids + last)
                    held += len(ids) // 4 + 1
                    if held >= file_ids:
                        yield image()
                        names, parts, held, place = [], [], 0, place + 1
        if names:
            yield image()

    ordered = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"))
    images = ordered.mapInArrow(run, "image binary")
    images.select(F.col("image").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder of token files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it over all files. Files are independent and read
    once each; the ids of their documents are summed up in file order. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    images = files.filter(F.col("length") > 0).select("content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column(0):
                content = image.as_buffer().to_pybytes()[:-1]
                task, place = trailer(content)[4:]
                ids, names, sizes = read_file(content)
                ends = np.cumsum(sizes)
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * (e - s):4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
                yield pa.record_batch([
                    np.full(len(sizes), task), np.full(len(sizes), place), pa.array(names, pa.int64()),
                    ends - sizes, sizes, pa.array(sums, pa.int64())],
                    names=["task", "place", "doc_id", "base", "n_tokens", "ids_crc32"])

    # file numbers without gaps are not needed, only their order
    rows = written(images.mapInArrow(
        documents, "task bigint, place bigint, doc_id bigint, base bigint, n_tokens bigint, "
        "ids_crc32 bigint").withColumn("file", F.col("task") * (1 << 31) + F.col("place")), "token-rows")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = written(prefix_sums(totals, "file", ["n"], 1 << 31), "token-starts")
    return rows.join(small(starts.select("file", "n_before"), starts.count()), "file").select(
        "doc_id", (F.col("n_before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str | None = None, folder: str | None = None,
                **options) -> DataFrame:
    """Writes token files and reads them back; see the two functions above. Other columns are unread."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    write_token_files(docs, folder, tokenizer_path, **options)
    return read_token_files(spark, folder)
