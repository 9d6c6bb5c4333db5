"""Nearest neighbours by cosine through a few stable projections.

Unit vectors are projected onto a few random directions. The squared distance of two projections,
divided by that of the vectors, follows a chi-square law with as many degrees of freedom. So a query
takes its neighbours in the order of projected distance, verifies each on the vectors, and stops once
a neighbour nearer than its fifth best would with high probability have come by now.

The projections of a bounded sample are split into cells by a kd-tree; every row is indexed in its cell,
in blocks of bounded size. The sample also gives each query a first bound, and with it the cells it must
see. Blocks of queries and blocks of rows meet by cell; within a block a kd-tree hands out the projected
neighbours in order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

NEIGHBOURS = 5
DIMENSIONS = 8
SEED = 20
# Rows that the cells and first bounds are taken from: at most so many.
SAMPLE = 4096
# Rows of a cell in the mean; cells are at most 4096.
CELL_ROWS = 8192
MAX_DEPTH = 12
BLOCK = 4096
QUERY_BLOCK = 512
LEAF = 256
CONFIDENCE = 0.95
EVERY = 50
SLACK = 1e-9


def chi_square(x: float, freedom: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(freedom // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_limit(confidence: float, freedom: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < confidence else (low, middle)
    return high


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact to the order of operations: equal vectors get equal scores wherever they lie."""
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * math.sqrt((query * query).sum()))


class Cells:
    """A kd-tree over projections whose leaves, numbered from 0, are the cells."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth, self.splits = depth, np.zeros((1 << depth) - 1)
        self.axes = np.zeros((1 << depth) - 1, np.int64)
        groups = {0: points}
        for node in range(len(self.splits)):
            group = groups.pop(node, points[:0])
            if len(group):
                axis = int(np.argmax(group.max(axis=0) - group.min(axis=0)))
                self.axes[node], self.splits[node] = axis, np.median(group[:, axis])
                right = group[:, axis] > self.splits[node]
                groups[2 * node + 1], groups[2 * node + 2] = group[~right], group[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axes[node]] > self.splits[node]
            node = 2 * node + 1 + right
        return node - len(self.splits)

    def within(self, point: np.ndarray, limit: float) -> list[int]:
        """The cells whose boxes come as near to the point, in squared distance."""
        found, stack = [], [(0, {})]
        while stack:
            node, gaps = stack.pop()
            if node >= len(self.splits):
                found.append(node - len(self.splits))
                continue
            axis = int(self.axes[node])
            gap = float(point[axis] - self.splits[node])
            near, far = (2, 1) if gap > 0 else (1, 2)
            stack.append((2 * node + near, gaps))
            behind = {**gaps, axis: max(gaps.get(axis, 0.0), gap * gap)}
            if sum(behind.values()) <= limit:
                stack.append((2 * node + far, behind))
        return found


class Tree:
    """A kd-tree over the projections of a block; hands out its leaves by distance."""

    def __init__(self, points: np.ndarray) -> None:
        self.nodes, todo = [], [np.arange(len(points))]
        # (low corner, high corner, rows of a leaf or None, first child)
        for rows in todo:
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            if len(rows) <= LEAF or (high == low).all():
                self.nodes.append((low, high, rows, 0))
                continue
            axis, half = int(np.argmax(high - low)), len(rows) // 2
            rows = rows[np.argpartition(points[rows, axis], half)]
            self.nodes.append((low, high, None, len(todo)))
            todo += [rows[:half], rows[half:]]
        self.low = np.array([n[0] for n in self.nodes])
        self.high = np.array([n[1] for n in self.nodes])

    def leaves(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance from the point, rows) of the leaves, nearest first."""
        outside = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (outside * outside).sum(axis=1)
        heap = [(float(far[0]), 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            *_, rows, child = self.nodes[node]
            if rows is not None:
                yield distance, rows
            else:
                for below in (child, child + 1):
                    heapq.heappush(heap, (float(far[below]), below))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(tree: Tree, points: np.ndarray, ids: np.ndarray, vectors: np.ndarray, unit: np.ndarray,
                 query_id: int, query: np.ndarray, point: np.ndarray, bound: float, k: int, limit: float,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """The query's best of a block. ``bound``: a cosine that the k-th best surely reaches."""
    found, scores = ids[:0], np.empty(0)
    whole = query / math.sqrt((query * query).sum())
    for distance, rows in tree.leaves(point):
        if distance > limit * (2 - 2 * bound) + SLACK:
            break
        gaps = points[rows] - point
        rows = rows[((gaps * gaps).sum(axis=1) <= limit * (2 - 2 * bound) + SLACK) & (ids[rows] != query_id)]
        rows = rows[unit[rows] @ whole >= bound - SLACK]
        if len(rows):
            found, scores = best(np.concatenate([found, ids[rows]]),
                                 np.concatenate([scores, cosines(query, vectors[rows])]), k)
            if len(scores) == k:
                bound = max(bound, float(scores[-1]))
    return found, scores


class Index:
    """Everything the tasks need besides the rows: directions, cells, and the sample for first bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int, k: int) -> None:
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIMENSIONS))
        self.ids, self.vectors, self.unit, self.k = ids, vectors, units(vectors), k
        depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows) / CELL_ROWS))))
        self.cells = Cells(self.unit @ self.directions, depth)
        self.limit = chi_square_limit(CONFIDENCE, DIMENSIONS)

    def bounds(self, ids: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """A cosine that the k-th best of each query surely reaches; -1 where the sample is too small."""
        near = unit @ self.unit.T
        near[ids[:, None] == self.ids[None, :]] = -2
        if near.shape[1] < self.k:
            return np.full(len(ids), -1.0)
        return np.maximum(np.partition(near, -self.k, axis=1)[:, -self.k] - SLACK, -1.0)

    def own_best(self, query_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The query's best rows of the sample, scored exactly."""
        near = self.unit @ (query / math.sqrt((query * query).sum()))
        others = np.flatnonzero(self.ids != query_id)
        first = others[np.argsort(-near[others], kind="stable")[:self.k]]
        if len(first):
            first = others[near[others] >= near[first[-1]] - SLACK]
        return best(self.ids[first], cosines(query, self.vectors[first]), self.k)

    def holds(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Which rows are in the sample."""
        if not len(self.ids):
            return np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return (self.ids[at] == ids) & (self.vectors[at] == vectors).all(axis=1)


def usable(rows: DataFrame, size: int) -> DataFrame:
    """The rows (vec_id, embedding) that take part; embeddings as doubles."""
    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(F.col("vec_id").isNotNull() & (F.size("embedding") == size)).filter(
        ~F.exists("embedding", bad)).filter(F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(rows: DataFrame, block: int, size: int) -> DataFrame:
    """Rows (cell, vec_id, embedding, bound) as blocks (cell, ids, vectors, bounds) of bounded size.

    Dealt by ranges of (cell, hash), so a crowded cell spreads over tasks. A repeated row is dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, float]] = []
        current, last = None, None

        def block_of() -> pa.RecordBatch:
            ids, vectors, bounds = zip(*held)
            return pa.record_batch([
                pa.array([current], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([np.stack(vectors).tobytes()], pa.binary()),
                pa.array([np.array(bounds).tobytes()], pa.binary())], names=names)

        names = ["cell", "ids", "vectors", "bounds"]
        for batch in batches:
            vectors = _matrix(batch.column(2), size).copy()
            for cell, vec, vector, bound in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                vectors, batch.column(3).to_pylist()):
                if held and (cell != current or len(held) >= block):
                    yield block_of()
                    held = []
                if (cell, vec) == (current, last and last[0]) and (vector == last[1]).all():
                    continue
                current, last = cell, (vec, vector)
                held.append((vec, vector, bound))
        if held:
            yield block_of()

    order = ["cell", F.xxhash64("vec_id"), "vec_id", "embedding"]
    return rows.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions(*order).select(
        "cell", "vec_id", "embedding", "bound").mapInArrow(
        run, "cell bigint, ids binary, vectors binary, bounds binary")


def nearest(rows: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of each row whose id ``every`` divides.

    Of (vec_id, embedding). Scores are cosines of the given vectors in doubles, ties go to the smaller
    vec_id, fewer than k other rows are all returned. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components, and rows without an id take no part. A row that is
    repeated counts once; rows of one id with different vectors count each, and never for the query of
    that id. Other columns are not read; no rows: no rows.
    """
    spark = rows.sparkSession
    sizes = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count().orderBy(
        F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 1
    good = usable(rows, size)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    # rows of one id may not bound their own query, so each id is in the sample once
    ids, first = np.unique(sample.column("vec_id").to_numpy(), return_index=True)
    vectors = _matrix(sample.column("embedding").combine_chunks(), size)[first]
    index = spark.sparkContext.broadcast(Index(ids, vectors, sizes["count"] if sizes else 0, k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = units(_matrix(batch.column(1), size))
            cell = index.value.cells.of(unit @ index.value.directions)
            yield pa.record_batch([cell, batch.column(0), batch.column(1), np.zeros(len(cell))],
                                  names=["cell", "vec_id", "embedding", "bound"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                unit = units(_matrix(batch.column(1), size))
                bounds = index.value.bounds(batch.column(0).to_numpy(), unit)
                points = unit @ index.value.directions
                cells = [index.value.cells.within(p, index.value.limit * (2 - 2 * b) + SLACK)
                         for p, b in zip(points, bounds)]
                rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
                yield pa.record_batch([
                    pa.array([c for found in cells for c in found], pa.int64()),
                    batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), bounds[rows]],
                    names=["cell", "vec_id", "embedding", "bound"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, asked, queries, bounds in zip(*(batch.column(i) for i in range(5))):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                vectors = np.frombuffer(vectors.as_buffer()).reshape(-1, size)
                rest = ~index.value.holds(ids, vectors)
                if not rest.any():
                    continue
                ids, vectors = ids[rest], vectors[rest]
                unit = units(vectors)
                points = unit @ index.value.directions
                tree = Tree(points)
                asked = np.frombuffer(asked.as_buffer(), np.int64)
                queries = np.frombuffer(queries.as_buffer()).reshape(-1, size)
                projected = units(queries) @ index.value.directions
                out = []
                for query_id, query, point, bound in zip(
                        asked.tolist(), queries, projected, np.frombuffer(bounds.as_buffer()).tolist()):
                    found, scores = search_block(
                        tree, points, ids, vectors, unit, query_id, query, point, bound, k,
                        index.value.limit)
                    out.append((np.full(len(found), query_id), found, scores))
                yield pa.record_batch([np.concatenate(c) for c in zip(*out)],
                                      names=["query_id", "vec_id", "score"])

    def first_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [(np.full(len(found), query_id), found, scores) for query_id, query in zip(
                    batch.column(0).to_pylist(), _matrix(batch.column(1), size))
                    for found, scores in [index.value.own_best(query_id, query)]]
                yield pa.record_batch([np.concatenate(c) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    asked = good.filter(F.col("vec_id") % every == 0)
    kinds = "cell bigint, vec_id bigint, embedding array<double>, bound double"
    blocks = _packed(good.mapInArrow(place, kinds), BLOCK, size)
    queries = written(_packed(asked.mapInArrow(ask, kinds), QUERY_BLOCK, size), "query-blocks")
    pairs = blocks.select("cell", "ids", "vectors").join(queries.select(
        "cell", F.col("ids").alias("asked"), F.col("vectors").alias("queries"), "bounds"), "cell")
    found = pairs.select("ids", "vectors", "asked", "queries", "bounds").mapInArrow(
        meet, "query_id bigint, vec_id bigint, score double")
    # the sample's rows are looked at for every query, so that each gets its k rows
    found = found.unionByName(asked.dropDuplicates(["vec_id", "embedding"]).mapInArrow(
        first_best, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
