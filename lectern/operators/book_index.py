"""Substring search by an inverted index of trigrams.

Every run of three characters of a title or author, without regard to the case of ASCII letters, has a
posting list: the ids of the books that hold it, in blocks of bounded size, as differences in as few bytes
as the block needs. Blocks lie in folders by a hash of the trigram, sorted by trigram, so a search opens only
the folders of the trigrams it asks for. A search intersects the shortest lists and verifies what is left on
the books themselves, so entries of books that have changed or gone do no harm: new and changed books are
added as a batch of their own, and nothing is rebuilt.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import _LOWER, _TO_LOWER, _UPPER
from lectern.operators.catalog import search_books

GRAM = 3
FOLDERS = 64
# Ids of a block at most.
BLOCK = 4096
# Full blocks of neighbouring ids that are joined at once.
JOINED = 16
# Posting lists that a search intersects: the shortest ones.
LISTS = 3
POSTINGS = "gram string, first_id bigint, n bigint, width int, gaps binary"
READ = POSTINGS + ", batch bigint, folder int"


def grams_of(text: Column) -> Column:
    """The different trigrams of a text, ASCII letters in lower case; none for null and short texts."""
    low = F.translate(text, _UPPER, _LOWER)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(
        F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def query_grams(q: str, wildcards: bool = False) -> list[str]:
    """The trigrams that every match of ``q`` holds; none where the index cannot help."""
    parts = re.split("[%_]", q) if wildcards else [q]
    low = [p.translate(_TO_LOWER) for p in parts]
    return sorted({p[i:i + GRAM] for p in low for i in range(len(p) - GRAM + 1)})


def packed(ids: np.ndarray) -> tuple[int, bytes]:
    """Differences of rising ids in as few bytes each as the largest needs."""
    gaps = np.diff(ids).astype(np.uint64)
    largest = int(gaps.max()) if len(gaps) else 0
    width = next(w for w in (1, 2, 4, 8) if largest < 1 << 8 * w)
    return width, gaps.astype(f"<u{width}").tobytes()


def unpacked(first: int, width: int, gaps: bytes) -> np.ndarray:
    # a sum that wraps around comes out right
    steps = np.frombuffer(gaps, f"<u{width}").astype(np.uint64).view(np.int64)
    return np.concatenate([[first], steps]).cumsum()


def _blocks(folder: object, gram: object, ids: np.ndarray) -> Iterator[tuple]:
    """Rows of POSTINGS, behind the folder, of the rising ids of one trigram."""
    for at in range(0, len(ids), BLOCK):
        part = ids[at:at + BLOCK]
        yield folder, gram, int(part[0]), len(part), *packed(part)


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                           names=["folder", "gram", "first_id", "n", "width", "gaps"])


def postings(books: DataFrame) -> DataFrame:
    """(folder, gram, first_id, n, width, gaps) of books (id, title, author): blocks of posting lists.

    The books of a batch are turned into short blocks where they lie, so no entry of a single book is
    shuffled or held. Blocks are dealt and sorted by ranges of (folder, trigram, first id), so the list of a
    frequent trigram spreads over tasks, and neighbours are joined. An id that comes several times may be in
    several blocks of a list.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pc.list_flatten(batch.column(1)).dictionary_encode()
            if not len(grams):
                continue
            number = grams.indices.to_numpy()
            ids = batch.column(0).to_numpy()[pc.list_parent_indices(batch.column(1)).to_numpy()]
            order = np.lexsort((ids, number))
            number, ids = number[order], ids[order]
            once = np.append(True, (number[1:] != number[:-1]) | (ids[1:] != ids[:-1]))
            number, ids = number[once], ids[once]
            begins = np.append(0, np.flatnonzero(np.diff(number)) + 1)
            names = grams.dictionary.take(pa.array(number[begins])).to_pylist()
            yield _block_rows([
                row for name, part in zip(names, np.split(ids, begins[1:]))
                for row in _blocks(zlib.crc32(name.encode()) % FOLDERS, name, part)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, n = None, [], 0

        def joined() -> list[tuple]:
            return list(_blocks(*of, np.unique(np.concatenate(held)))) if held else []

        for batch in batches:
            rows = []
            for folder, gram, first, many, width, gaps in zip(*(c.to_pylist() for c in batch.columns)):
                if (folder, gram) != of or n >= JOINED * BLOCK:
                    rows += joined()
                    of, held, n = (folder, gram), [], 0
                held.append(unpacked(first, width, gaps))
                n += many
            if rows:
                yield _block_rows(rows)
        if held:
            yield _block_rows(joined())

    grams = F.array_union(grams_of(F.col("title")), grams_of(F.col("author")))
    kinds, order = f"folder int, {POSTINGS}", ["folder", "gram", "first_id"]
    blocks = books.filter(F.col("id").isNotNull()).select(
        F.col("id").cast("bigint").alias("id"), grams.alias("grams")).mapInArrow(pack, kinds)
    return blocks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, kinds)


def add_books(books: DataFrame, path: str, batch: int = 0) -> None:
    """Writes the postings of new or changed books; a batch that is written again replaces itself."""
    postings(books).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/batch={batch}")


def posting_lists(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """The blocks of the asked trigrams; only their folders are opened."""
    folders = sorted({zlib.crc32(g.encode()) % FOLDERS for g in grams})
    return spark.read.schema(READ).parquet(path).filter(
        F.col("folder").isin(folders) & F.col("gram").isin(grams))


def candidates(spark: SparkSession, path: str, grams: list[str], lists: int = LISTS) -> DataFrame:
    """(id): the books that may hold all of the trigrams, each once.

    The lengths of the lists are summed up first; a trigram without a list leaves no candidates.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, first, width, gaps in zip(*(batch.column(i) for i in range(4))):
                ids = unpacked(first.as_py(), width.as_py(), gaps.as_py())
                yield pa.record_batch([pa.array([gram.as_py()] * len(ids), pa.string()), ids], names=["gram", "id"])

    found = posting_lists(spark, path, grams)
    sizes = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < len(grams):
        return spark.createDataFrame([], "id bigint")
    rare = sorted(grams, key=lambda g: (sizes[g], g))[:lists]
    ids = posting_lists(spark, path, rare).select("gram", "first_id", "width", "gaps").mapInArrow(
        unpack, "gram string, id bigint")
    # a changed book is listed by several batches
    bits = sum((F.when(F.col("gram") == g, 1 << i).otherwise(0) for i, g in enumerate(rare)), F.lit(0))
    return ids.groupBy("id").agg(F.bit_or(bits).alias("seen")).filter(
        F.col("seen") == (1 << len(rare)) - 1).select("id")


def search_indexed(
    books: DataFrame, path: str, q: str = "", category: str = "", author: str = "", page_size: int = 20,
    page_num: int = 0, ci: bool = True, wildcards: bool = False, after_id: int | None = None,
) -> DataFrame:
    """``search_books`` by the index at ``path``: the same rows, of books whose ids are in the index.

    What is asked with fewer than three characters in a row is searched without it. Books that were
    added or changed after their last batch are found by what the index knows of them.
    """
    grams = query_grams(q, wildcards)
    if grams:
        books = books.join(candidates(books.sparkSession, path, grams), "id", "left_semi").select(*books.columns)
    return search_books(books, q, category, author, page_size, page_num, ci, wildcards, after_id)
