"""SimHash near-duplicates, found on a grid of per-segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits. The counts of set bits of two
fingerprints differ, summed over segments (Manhattan distance), by no more than their bits do. Of two
fingerprints with at most four differing bits, one half, 16 segments, differs by at most two. On the
grid of a half's counts, two such points lie within one step of a common cell. So every fingerprint is
put into its own and the neighbouring cells of both halves (50 in the mean), and only fingerprints that
meet in a cell are compared: first counts, then bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import small, written
from lectern.llm.components import components

BITS = 4
WORDS = 4
SEED = 42
# The largest run of a cell that one task handles at once.
RUN = 4096
# Up to this size all pairs of a run are compared at once, beyond it a search spreads over the run.
PAIRS = 48
HALF = np.uint64(0xFFFFFFFF)
LOW = np.uint64(0x5555555555555555)


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text as an unsigned number; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z only, white space 0x20 and 0x09-0x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    hashed, digest = [], xxhash.xxh64_intdigest
    for start, end in zip(starts, ends[min(len(words), WORDS) - 1:].tolist()):
        hashed.append(digest(joined[start:end], SEED))
    counts, total = np.zeros(64, np.int64), len(hashed)
    for at in range(0, total, 1 << 14):
        some = np.array(hashed[at:at + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document (doc_id, text); ``fp`` holds the bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), np.array(found, np.uint64).view(np.int64)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, fp bigint")


def bit_counts(prints: np.ndarray) -> np.ndarray:
    """The counts of set bits in the 32 segments, as 32 fields of two bits."""
    return prints - ((prints >> np.uint64(1)) & LOW)


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) for the cells of both halves within one step of each fingerprint."""
    counts, keys, owners = bit_counts(prints), [], []
    for half in (0, 1):
        own = (counts >> np.uint64(32 * half)) & HALF
        mark = np.uint64(half << 32)
        keys.append(own | mark)
        owners.append(prints)
        for field in range(16):
            step = np.uint64(1 << 2 * field)
            value = (own >> np.uint64(2 * field)) & np.uint64(3)
            for inside, moved in ((value < 2, own + step), (value > 0, own - step)):
                keys.append((moved | mark)[inside])
                owners.append(prints[inside])
    return np.concatenate(keys), np.concatenate(owners)


def close(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Where pairs are linked: the Manhattan distance of the counts rules out, the bits decide."""
    x, y = bit_counts(a), bit_counts(b)
    near = np.zeros(len(x), bool)
    differ = x ^ y
    unequal = (differ | (differ >> np.uint64(1))) & LOW
    by_two = (differ >> np.uint64(1)) & ~differ & LOW  # counts 0 and 2
    maybe = np.bitwise_count(unequal) + np.bitwise_count(by_two) <= bits
    near[maybe] = np.bitwise_count(a[maybe] ^ b[maybe]) <= bits
    return near


def forest(prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Links that connect whatever the links among these fingerprints connect, one less than a group.

    Each fingerprint is compared once with those not yet reached, so a dense group costs little.
    """
    left, found, queue = prints, [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        node = queue.pop()
        hit = np.bitwise_count(left ^ node) <= bits
        if hit.any():
            reached = left[hit]
            found.append(np.stack([np.full(len(reached), node), reached], axis=1))
            queue += list(reached)
            left = left[~hit]
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def run_links(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Links within runs of ``values`` that begin at ``starts``."""
    found = [np.empty((0, 2), np.uint64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRS)]).tolist():
        rows = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        some = max(1, (1 << 20) // len(i))
        for at in range(0, len(rows), some):
            base = rows[at:at + some, None]
            a, b = values[base + i].ravel(), values[base + j].ravel()
            hit = close(a, b)
            found.append(np.stack([a[hit], b[hit]], axis=1))
    for start, size in zip(starts[sizes > PAIRS].tolist(), sizes[sizes > PAIRS].tolist()):
        found.append(forest(values[start:start + size]))
    return np.unique(np.concatenate(found), axis=0)


OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64()), ("block", pa.int64()),
                 ("members", pa.binary())])


def _link_rows(links: np.ndarray) -> pa.RecordBatch:
    signed, none = links.astype(np.uint64).view(np.int64), [None] * len(links)
    return pa.record_batch([
        np.ascontiguousarray(signed[:, 0]), np.ascontiguousarray(signed[:, 1]),
        pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], schema=OUT)


def find_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints (fp, no repeats) with at most four differing bits.

    Cells are dealt by ranges of (cell, fingerprint), so a crowded cell spreads over tasks, each of which
    streams its sorted rows and holds one run. What one task cannot settle, the runs at its ends and
    runs above ``RUN``, it hands on as blocks of bounded size; the blocks of a cell then meet in pairs.
    Distinct fingerprints within few bits of one text are bounded in number, so such cells are few.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for at in range(0, len(found), 20_000):
                keys, owners = cells(found[at:at + 20_000])
                yield pa.record_batch([keys.view(np.int64), owners.view(np.int64)], names=["cell", "fp"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        first, cell_left, left = True, None, np.empty(0, np.uint64)

        def block(cell: int, members: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.record_batch([
                pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([cell], pa.int64()),
                pa.array([part + number], pa.int64()), pa.array([members.tobytes()], pa.binary())],
                schema=OUT)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            value = batch.column(1).to_numpy().view(np.uint64)
            if len(left):
                key = np.concatenate([np.full(len(left), cell_left), key])
                value = np.concatenate([left, value])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            # the last run may go on in the next batch
            cell_left, left = int(key[-1]), value[starts[-1]:]
            starts, sizes = starts[:-1], sizes[:-1]
            if first and len(starts):
                yield block(int(key[0]), value[:sizes[0]])
                starts, sizes, first = starts[1:], sizes[1:], False
            links = run_links(value, starts, sizes)
            if len(links):
                yield _link_rows(links)
            while len(left) > RUN:
                first = True  # what remains of this cell is a block too
                yield block(cell_left, left[:RUN])
                left = left[RUN:]
        if len(left):
            yield block(cell_left, left)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1)):
                a = np.frombuffer(one.as_py(), np.uint64)
                b = np.frombuffer(other.as_py(), np.uint64)
                links = forest(a if one.equals(other) else np.concatenate([a, b]))
                if len(links):
                    yield _link_rows(links)

    kinds = "a bigint, b bigint, cell bigint, block bigint, members binary"
    placed = prints.select("fp").mapInArrow(emit, "cell bigint, fp bigint")
    order = ["cell", "fp"]
    settled = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        settle, kinds), "simhash-links")
    blocks = settled.filter(F.col("cell").isNotNull()).select("cell", "block", "members")
    pairs = blocks.join(blocks.select(
        "cell", F.col("block").alias("other"), F.col("members").alias("others")), "cell").filter(
        F.col("block") <= F.col("other")).select("members", "others")
    return settled.filter(F.col("cell").isNull()).select("a", "b").unionByName(
        pairs.mapInArrow(meet, kinds).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document (doc_id, text).

    ``component_id`` is the smallest doc_id that links of at most four differing bits reach. Copies
    share a fingerprint, so links are searched among distinct fingerprints. Null and empty texts have
    fingerprint zero and are linked like any other; rows with a null doc_id are kept and never name a
    component, which is null where no member has an id; repeated rows are kept; texts of any length are
    read whole; other columns are not read; no documents: no rows.
    """
    return grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document (doc_id, text)."""
    marked = written(fingerprints(docs), "fingerprints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = components(find_links(prints))
    rooted = prints.join(roots, prints["fp"] == roots["vertex"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _with_print(docs: DataFrame) -> DataFrame:
    """The documents with a last column ``_fp``."""
    place, names = docs.columns.index("text"), [*docs.columns, "_fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            found = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in texts]
            yield pa.record_batch([*batch.columns, np.array(found, np.uint64).view(np.int64)], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_fp", LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all columns.

    Where rows repeat that id, one of those in the group stays, with the smallest fingerprint. Rows
    without an id cannot stand for a group: of those with one text one stays.
    """
    ids = written(grouped(docs).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("component_id") == F.col("doc_id"), F.col("fp"))).alias("print")), "kept")
    ids = ids.filter(F.col("print").isNotNull())
    # one plan at every size: texts meet the kept ids by a shuffle, never by a broadcast
    once = docs.join(ids.filter(F.col("n") == 1).select("doc_id").hint("merge"), "doc_id", "left_semi")
    several = written(ids.filter(F.col("n") > 1).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")), "several")
    several = small(several, several.count())
    again = _with_print(docs.join(several, F.col("doc_id") == F.col("_id"), "left_semi")).join(
        several, (F.col("doc_id") == F.col("_id")) & (F.col("_fp") == F.col("_print")), "left_semi")
    nobody = docs.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return once.select(*docs.columns).unionByName(
        again.dropDuplicates(["doc_id"]).select(*docs.columns)).unionByName(nobody)
