"""Token counts by a separator scan over flat, unindexed token files.

A flat file is nothing but ids of one fixed width, with a line feed behind them. Documents end at the
end-of-document id and may run over file ends. Files are cut into blocks; the ends in a block are found
by one vectorised search; a prefix scan over the blocks then tells each block how many ids, documents
and open ids lie before it, which stitches the documents that cross a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import limited, prefix_sums, small, tokenizer_file, word_encoder, written
from lectern.session import shared_folder

END = 49407
DTYPE = "<u2"
FILE_IDS = 1 << 22
BLOCK_IDS = 1 << 18
NAMES = 1 << 16


def write_flat(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end: int = END,
               dtype: str = DTYPE, file_ids: int = FILE_IDS) -> None:
    """Writes ``kind=ids``, flat files cut every ``file_ids`` ids, and ``kind=names``, the doc_ids.

    The order is that of the rows as Spark reads them, so no text is moved. A part is one task's
    stream. Names are lines in the order of the documents, empty for a null doc_id; only the report
    uses them, the scan never opens them. Texts of any length are encoded whole; no documents: files
    without ids or none.
    """
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer_path))
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(json.value, dtype, specials_are_text=True)
        last, part = np.array([end], dtype).tobytes(), TaskContext.get().partitionId()
        held, names, place = bytearray(), [], 0

        def row(kind: str, value: bytes) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([kind]), pa.array([place], pa.int64()), pa.array([value], pa.binary())],
                names=["kind", "place", "value"])

        for batch in batches:
            for rows in limited(batch):
                names += rows.column(0).to_pylist()
                for ids in encoder.encode(rows.column(1).to_pylist()):
                    held += ids
                    held += last
                while len(held) >= file_ids * width:
                    yield row("ids", bytes(held[:file_ids * width]))
                    place += 1
                    del held[:file_ids * width]
                if len(names) >= NAMES:
                    yield row("names", "\n".join("" if x is None else str(x) for x in names).encode())
                    place, names = place + 1, []
        if held:
            yield row("ids", bytes(held))
            place += 1
        if names:
            yield row("names", "\n".join("" if x is None else str(x) for x in names).encode())

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "kind string, place bigint, value binary")
    rows.sortWithinPartitions("kind", "place").select(
        "kind", F.col("value").cast("string").alias("value"),
    ).write.partitionBy("kind").option("maxRecordsPerFile", 1).text(folder)


def read_flat(spark: SparkSession, folder: str, kind: str = "ids") -> DataFrame:
    """(part, file, content) of the written files, numbered as their names are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    # no documents: no files and no column for their kind
    files = files.filter(F.col("kind") == kind) if "kind" in files.columns else files.limit(0)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint").alias("part"),
        F.regexp_extract(name, r"c(\d+)\.\w+$", 1).cast("bigint").alias("file"), "content")


def find_ends(files: DataFrame, end: int = END, dtype: str = DTYPE, block_ids: int = BLOCK_IDS,
              ) -> DataFrame:
    """Per block of the files (part, file, content): (part, file, block, n, ends).

    ``n`` counts its ids, ``ends`` lists the places of the end id in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for part, file, content in zip(*(batch.column(i) for i in range(3))):
                raw = content.as_buffer()
                ids = np.frombuffer(raw, dtype, (raw.size - 1) // width)
                starts = range(0, len(ids), block_ids)
                blocks = [ids[s:s + block_ids] for s in starts]
                yield pa.record_batch([
                    pa.array([part.as_py()] * len(blocks), pa.int64()),
                    pa.array([file.as_py()] * len(blocks), pa.int64()),
                    pa.array(range(len(blocks)), pa.int64()),
                    pa.array([len(b) for b in blocks], pa.int64()),
                    pa.array([np.flatnonzero(b == end).astype(np.int32) for b in blocks],
                             pa.list_(pa.int32()))], names=["part", "file", "block", "n", "ends"])

    return files.mapInArrow(
        run, "part bigint, file bigint, block bigint, n bigint, ends array<int>")


def count_documents(blocks: DataFrame) -> DataFrame:
    """Per document of the blocks, in stream order: (part, ordinal, start, n_tokens, closed).

    ``ordinal`` counts the documents that end in the part before it, ``start`` the ids of the whole
    stream before it, ``n_tokens`` its ids without the end id. What follows the last end of the stream
    is one more document with ``closed`` false and no part. No ids: no rows.
    """
    ordered = Window.partitionBy("part").orderBy("file", "block")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # one row per block: the scan inside a part
    found = F.size("ends")
    scanned = blocks.select(
        "part", "file", "block", "n", "ends",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ids_before"),
        F.coalesce(F.sum(found).over(earlier), F.lit(0)).alias("ends_before"))
    last = F.when(found > 0, F.col("ids_before") + F.element_at("ends", -1) + 1)
    scanned = scanned.withColumn("open_from", F.max(last).over(earlier))
    # one row per part: the scan over parts
    parts = scanned.groupBy("part").agg(
        F.sum("n").alias("n"), F.max(last).alias("after_last"))
    parts = prefix_sums(parts, "part", ["n"])
    # a part without an end keeps the document open that began before it
    run = F.floor(F.col("part") / 4096)
    after = F.col("n_before") + F.col("after_last")
    heads = parts.groupBy(run.alias("run")).agg(F.max(after).alias("m"))
    heads = heads.select("run", F.max("m").over(
        Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy(run).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("run", run).withColumn("near", F.max(after).over(inside)).join(heads, "run")
    parts = written(parts.select(
        "part", "n_before", "n_total", after.alias("after"),
        F.coalesce("near", "carried", F.lit(0)).alias("open_before")), "separator-parts")
    joined = scanned.join(small(parts.select("part", "n_before", "open_before"), parts.count()), "part")
    begin = F.col("n_before") + F.col("ids_before")
    first = F.coalesce(F.col("n_before") + F.col("open_from"), F.col("open_before"))

    def document(place, i):
        start = F.when(i == 0, first).otherwise(begin + F.element_at("ends", i) + 1)
        return F.struct((F.col("ends_before") + i).alias("ordinal"), start.alias("start"),
                        (begin + place - start).alias("n_tokens"), F.lit(True).alias("closed"))

    closed = joined.filter(found > 0).select("part", F.inline(F.transform("ends", document)))
    tail = parts.agg(F.max("n_total").alias("n"), F.coalesce(F.max("after"), F.lit(0)).alias("start"))
    return closed.unionByName(tail.filter(F.col("n") > F.col("start")).select(
        F.lit(None).cast("bigint").alias("part"), F.lit(None).cast("bigint").alias("ordinal"), "start",
        (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, end: int = END,
                 dtype: str = DTYPE, folder: str | None = None, file_ids: int = FILE_IDS,
                 block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token counts of the documents (doc_id, text): doc_id, n_tokens, start.

    Texts are encoded into flat files, which are then scanned for ``end``; control strings inside texts
    are encoded as text, so the end id only ends documents. Null and empty texts have 0 tokens; a null
    doc_id stays null; repeated rows are counted each; no documents: no rows; other columns are unread.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "flat-tokens")
    write_flat(docs, folder, tokenizer_path, end, dtype, file_ids)
    blocks = written(find_ends(read_flat(spark, folder), end, dtype, block_ids), "separator-blocks")
    lines = F.split(F.col("content").cast("string"), "\n", -1)
    # the writer's line feed leaves one empty line behind the names of each file
    names = read_flat(spark, folder, "names").select(
        "part", "file", F.slice(lines, F.lit(1), F.size(lines) - 1).alias("names"))
    earlier = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    names = names.withColumn("first", F.coalesce(F.sum(F.size("names")).over(earlier), F.lit(0)))
    names = names.select("part", "first", F.posexplode("names").alias("i", "name")).select(
        "part", (F.col("first") + F.col("i")).alias("ordinal"),
        F.expr("try_cast(name AS BIGINT)").alias("doc_id"))
    return count_documents(blocks).filter("closed").join(names, ["part", "ordinal"]).select(
        "doc_id", "n_tokens", "start")
