"""Quality by an interpolated modified Kneser-Ney model of trusted text.

Texts are read as sub-words of an open vocabulary: a short word is taken whole, of a longer one its last
letters count, both with the form of their letters; runs of digits and of signs are sub-words too, and a
word that repeats the one before it is a sub-word that tells how often it did so far.

The model is a table of n-grams that grows with the trusted text. The logarithm of a probability is
written as a sum of what each order adds to the one below, so a text is scored by adding up values of
its n-grams, each found by a count join on its own: the n-grams of many texts are summed up in a task, sent
as blocks to the shards of the table, and the sums of a block's texts come back. Only the most frequent
n-grams, a bounded number, are known to all tasks and are not sent.

Limits come from trusted documents scored by models that never saw them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import limited, small, worker_store, written
from lectern.session import bound_batches

WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
# Words up to this length are taken whole; of longer ones so many last letters.
WHOLE, ENDING = 4, 3
REPEATS = 4
FOLDS = 4
MODELS = FOLDS + 1
LEAST_DISCOUNT = 0.1
# Share of the trusted documents of a language that a threshold accepts.
QUANTILE = 0.999
# A language with fewer trusted documents has no limit below that of all together.
OWN_LIMIT = 1000
# A text counts as if so many sub-words of mean surprisal came with it.
PRIOR = 10
# Surprisals are compared in steps of this size.
STEP = 1e-4
# Values of n-grams are kept in steps of this size, as 16-bit numbers.
GRAIN = 1e-3
# N-grams that all tasks know: at most so many.
FREQUENT = 1 << 18
SHARDS, SHARD_KEYS = 64, 1 << 18
# Sub-words and texts of a block.
BLOCK_WORDS, BLOCK_TEXTS = 1 << 21, (1 << 14) - 256
# Pairs that are counted, and so sorted, at once.
COUNTED = 1 << 20
FOLD_AT = 14
PIECE = 1 << 20
KNOWN_WORDS = 300_000

EDGE = np.uint64(0x9E3779B97F4A7C15)
# What makes keys of another kind of the same sub-word.
INNER, LAST = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def subword(word: str) -> str:
    low = word.lower()
    if word[0].isalpha():
        form = "l" if word == low else "A" if len(word) > 1 and word == word.upper() else "C"
        return form + (low if len(low) <= WHOLE else "~" + low[-ENDING:])
    return "0" if word[0].isdigit() else word[:ENDING]


class Words(dict):
    """Numbers of words in this worker, with the hash of each one's sub-word, and whether it is of letters."""

    def __init__(self) -> None:
        super().__init__()
        self.hashed, self.letters = np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashed):
            self.hashed, self.letters = np.resize(self.hashed, 2 * at), np.resize(self.letters, 2 * at)
        self.hashed[at] = xxhash.xxh64_intdigest(subword(word).encode("utf-8", "replace"))
        self.letters[at] = word[0].isalpha()
        self[word] = at
        return at


def _words(text: str) -> Iterator[str]:
    """The words of a text; long texts in pieces that end at white space."""
    if len(text) <= PIECE:
        yield from WORD.findall(text)
        return
    at, gap = 0, re.compile(r"\s")
    while at < len(text):
        found = gap.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield from WORD.findall(text, at, end)
        at = end


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sub-words of the texts one after the other, and how many each text has."""
    store = worker_store()
    if len(store.get("subwords", ())) > KNOWN_WORDS:
        del store["subwords"]
    known = store.setdefault("subwords", Words())
    number = known.__getitem__
    found = [np.fromiter(map(number, _words(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    ids = np.concatenate([np.empty(0, np.int32), *found])
    hashed = known.hashed[ids]
    places = np.flatnonzero(known.letters[ids])
    if len(places) > 1:
        text_of = np.repeat(np.arange(len(sizes)), sizes)[places]
        same = np.concatenate([[False], (ids[places][1:] == ids[places][:-1]) & (text_of[1:] == text_of[:-1])])
        # how long the run of repeats is at each word
        last = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        times = np.minimum(np.arange(len(same)) - last, REPEATS)
        repeats = np.array([xxhash.xxh64_intdigest(b"=" * k) for k in range(REPEATS + 1)], np.uint64)
        hashed[places] = np.where(times > 0, repeats[times], hashed[places])
    return hashed, sizes


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a pair of hashes."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def befores(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sub-word before each one; an edge before the first of a text."""
    out = np.concatenate([[EDGE], hashed[:-1]])[:len(hashed)].astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    out[begins[sizes > 0]] = EDGE
    return out


def fold_of(texts: list[str | None]) -> np.ndarray:
    """Copies of a text are in one fold."""
    return np.array([xxhash.xxh32_intdigest((t or "").encode("utf-8", "replace")) % FOLDS for t in texts], np.int64)


COUNTS = [f"n{k}" for k in range(FOLDS)]


def count_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, n0, ...): how often a sub-word follows another in the texts of each fold."""
    names = ["a", "b", *COUNTS]

    def summed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, fold = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        key = mixed(a, b)
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(at * FOLDS + fold, minlength=len(first) * FOLDS).reshape(-1, FOLDS)
        return pa.record_batch([a[first].view(np.int64), b[first].view(np.int64),
                                *[np.ascontiguousarray(x) for x in n.T]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for rows in limited(batch):
                texts = rows.column(0).to_pylist()
                hashed, sizes = subwords(texts)
                parts.append((befores(hashed, sizes), hashed, np.repeat(fold_of(texts).astype(np.int8), sizes)))
                held += len(hashed)
                if held > COUNTED:
                    yield summed(parts)
                    parts, held = [], 0
        if held:
            yield summed(parts)

    kinds = "a bigint, b bigint, " + ", ".join(f"{n} bigint" for n in COUNTS)
    return docs.select(F.col("text").cast("string")).mapInArrow(run, kinds).groupBy("a", "b").agg(
        *[F.sum(n).alias(n) for n in COUNTS])


def discounts(n: list[int]) -> list[float]:
    """The three discounts of an order from how many n-grams were seen 1, 2, 3 and 4 times.

    Where one of these numbers is 0 the estimate is undefined and fixed discounts stand in; none is
    less than ``LEAST_DISCOUNT``, so that something is left for n-grams that were never seen.
    """
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], LEAST_DISCOUNT), float(k)) for k in (1, 2, 3)]


def _less(count: Column, cut: list[float]) -> Column:
    return F.when(count == 0, 0.0).when(count == 1, cut[0]).when(count == 2, cut[1]).otherwise(cut[2])


def _seen(rows: DataFrame, counts: list[Column]) -> list[list[float]]:
    """The discounts of each model from its counts."""
    found = rows.agg(*[F.count_if(c == k) for c in counts for k in (1, 2, 3, 4)]).first()
    return [discounts(list(found[4 * m:4 * m + 4])) for m in range(len(counts))]


def values_of(pairs: DataFrame) -> tuple[DataFrame, list[float]]:
    """(key, n, v0, ...) of all n-grams of the counted pairs, and the surprisal of an unseen sub-word.

    One value for each model, the last of which has seen all folds: what the n-gram adds to the logarithm
    of the probability. A pair adds its own over what a lower order gives it; a sub-word inside a text adds
    its probability over that of an unseen one, and the weight it gives to lower orders as a context.
    """
    every = sum((F.col(n) for n in COUNTS), F.lit(0))
    counts = [every - F.col(n) for n in COUNTS] + [every]
    pairs = written(pairs.select("a", "b", *[c.alias(f"c{m}") for m, c in enumerate(counts)]), "pairs")
    c = [F.col(f"c{m}") for m in range(MODELS)]
    cut = _seen(pairs, c)
    contexts = written(pairs.groupBy("a").agg(
        *[F.sum(x).alias(f"t{m}") for m, x in enumerate(c)],
        *[F.try_divide(F.sum(_less(x, cut[m])), F.sum(x)).alias(f"g{m}") for m, x in enumerate(c)]), "contexts")
    ends = written(pairs.groupBy("b").agg(F.sum(c[-1]).alias("n"), *[
        F.count_if(x > 0).alias(f"e{m}") for m, x in enumerate(c)]), "endings")
    e = [F.col(f"e{m}") for m in range(MODELS)]
    low = _seen(ends, e)
    totals = ends.agg(*[F.sum(x) for x in e], *[F.sum(_less(x, low[m])) for m, x in enumerate(e)],
                      *[F.count_if(x > 0) for x in e]).first()
    unseen, floor = [], []
    for m in range(MODELS):
        total, taken, kinds = (totals[m + MODELS * k] or 0 for k in range(3))
        floor.append(taken / total / (kinds + 1) if total else 1.0)
        unseen.append(-float(np.log(floor[-1])))
    chance = [F.when(x > 0, (x - _less(x, low[m])) / F.lit(float(totals[m] or 1))).otherwise(0.0) + floor[m]
              for m, x in enumerate(e)]
    weights = contexts.select("a", *[F.coalesce(F.log(f"g{m}"), F.lit(0.0)).alias(f"w{m}") for m in range(MODELS)],
                              *[f"t{m}" for m in range(MODELS)], *[f"g{m}" for m in range(MODELS)])
    lower = written(ends.select("b", "n", *[x.alias(f"p{m}") for m, x in enumerate(chance)]), "chances")
    single = lower.join(weights.withColumnRenamed("a", "b"), "b", "full").select(
        F.col("b").alias("a"), F.lit(0).cast("bigint").alias("b"), F.coalesce("n", F.lit(1 << 40)).alias("n"),
        # an edge is a context and never predicted
        *[F.coalesce(F.log(f"p{m}") + unseen[m], F.lit(0.0)).alias(f"u{m}") for m in range(MODELS)],
        *[F.coalesce(f"w{m}", F.lit(0.0)).alias(f"w{m}") for m in range(MODELS)])
    size, sizes = contexts.count(), ends.count()
    joined = pairs.join(small(weights, size), "a").join(small(lower.drop("n"), sizes), "b")
    own = [F.when(x > 0, F.log1p((x - _less(x, cut[m])) / F.col(f"t{m}") / (F.col(f"g{m}") * F.col(f"p{m}"))))
           .otherwise(0.0) for m, x in enumerate(c)]
    rows = joined.select("a", "b", c[-1].alias("n"), *[x.alias(f"u{m}") for m, x in enumerate(own)],
                         *[F.lit(0.0).alias(f"w{m}") for m in range(MODELS)], F.lit(True).alias("pair"))
    rows = rows.unionByName(single.withColumn("pair", F.lit(False)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            n, pair = batch.column(2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            u, w = (np.stack([batch.column(3 + at + m).to_numpy() for m in range(MODELS)]) for at in (0, MODELS))
            parts = [(mixed(a, b)[pair], n[pair], u[:, pair]),
                     (mixed(a, INNER)[~pair], n[~pair], (u + w)[:, ~pair]), (mixed(a, LAST)[~pair], n[~pair], u[:, ~pair])]
            key, n, v = (np.concatenate(x, axis=-1) for x in zip(*parts))
            v = np.clip(np.rint(v / GRAIN), -32767, 32767).astype(np.int16)
            yield pa.record_batch([key.view(np.int64), n, *v], names=["key", "n", *[f"v{m}" for m in range(MODELS)]])

    kinds = "key bigint, n bigint, " + ", ".join(f"v{m} smallint" for m in range(MODELS))
    return written(rows.mapInArrow(keyed, kinds), "gram-values"), unseen


class Table:
    """Sorted keys with the values of each model."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is there, its place)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def frequent(values: DataFrame, most: int = FREQUENT) -> tuple[Table, int]:
    """The most frequent n-grams, at most ``most``, and the count from which they are taken."""
    bars = values.groupBy(F.floor(F.log2("n") * 4).alias("bar")).count().collect()
    least, taken = 1 << 62, 0
    for bar, n in sorted(((r["bar"], r["count"]) for r in bars), reverse=True):
        if taken + n > most:
            break
        least, taken = bar, taken + n
    found = values.filter(F.floor(F.log2("n") * 4) >= least).drop("n").toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    return Table(keys, np.stack([found.column(1 + m).to_numpy() for m in range(MODELS)], axis=1)), least


BLOCK = "shard bigint, tag int, block bigint, keys binary, places binary"
HEAD = [("doc_id", pa.int64()), ("mark", pa.int64()), ("lang", pa.string()), ("empty", pa.bool_()),
        ("n", pa.int64()), ("full", pa.float64()), ("fold", pa.float64()), ("model", pa.int64())]


def _known(table: Table, keys: np.ndarray, owners: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which n-grams the table knows, and their sums for each text, by the model of all folds and by that of its own."""
    known, at = table.find(keys)
    values, owners = table.values[at[known]], owners[known]
    return known, [np.bincount(owners, values[np.arange(len(values)), m], len(folds)) * GRAIN
                   for m in (np.full(len(values), FOLDS), folds[owners])]


def _packed(columns: list) -> bytes:
    batch = pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, HEAD)], names=[n for n, _ in HEAD])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def blocks(docs: DataFrame, table, shards: int) -> DataFrame:
    """Texts (doc_id, lang, text) of many documents as blocks: their n-grams by shard, and a head.

    What the table of frequent n-grams knows is added up where a few texts were read and not held; the rest
    is sent, a key once for a block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, words, texts = TaskContext.get().partitionId() << 32, 0, [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal number
            name, number = part + number, number + 1
            ids, marks, langs, empty, sizes, full, fold, folds, keys, owners = (
                [x for part in column for x in part] if isinstance(column[0], list) else np.concatenate(column)
                for column in zip(*held))
            held.clear()
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            shard = (keys >> np.uint64(40)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            keys, owners, shard = keys[order], owners[order], shard[order]
            begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
            rows = [(name % shards, 1, name, None, _packed([ids, marks, langs, empty, sizes, full, fold, folds]))]
            for i, j in zip(begins, [*begins[1:], len(shard)]):
                first = np.flatnonzero(np.concatenate([[True], keys[i + 1:j] != keys[i:j - 1]]))
                times = np.diff(np.append(first, j - i)).astype("<u4")
                rows.append((int(shard[i]), 2, name, keys[i:j][first].tobytes() + times.tobytes(), owners[i:j].tobytes()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (
                pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "tag", "block", "keys", "places"])

        for batch in batches:
            for rows in limited(batch):
                some = rows.column(3).to_pylist()
                hashed, sizes = subwords(some)
                before = befores(hashed, sizes)
                owner = np.repeat(np.arange(len(some)), sizes)
                last = np.zeros(len(hashed), bool)
                last[np.cumsum(sizes)[sizes > 0] - 1] = True
                begins = np.flatnonzero(sizes > 0)
                keys = np.concatenate([
                    mixed(before, hashed), mixed(hashed, np.where(last, LAST, INNER)),
                    mixed(np.full(len(begins), EDGE), np.full(len(begins), INNER))])
                owners, folds = np.concatenate([owner, owner, begins]), fold_of(some)
                known, local = _known(table.value, keys, owners, folds)
                keys, owners = keys[~known], owners[~known]
                # a text's place in the block, and its fold above it
                held.append((rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(),
                             [not t for t in some], sizes, *local, folds, keys,
                             (owners + texts | folds[owners] << FOLD_AT).astype("<u2")))
                words, texts = words + len(hashed), texts + len(some)
                if words > BLOCK_WORDS or texts > BLOCK_TEXTS:
                    yield block()
                    words, texts = 0, 0
        if held:
            yield block()

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")),
                       F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def shard_rows(values: DataFrame, shards: int) -> DataFrame:
    """The values as blocks of the shards: keys, and the values of all models."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            found = np.stack([batch.column(1 + m).to_numpy() for m in range(MODELS)], axis=1)
            shard = ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))[:len(keys)]
            groups = np.split(order, begins[1:])
            yield pa.record_batch([
                pa.array([int(shard[g[0]]) for g in groups if len(g)], pa.int64()),
                pa.array([0 for g in groups if len(g)], pa.int32()), pa.array([0 for g in groups if len(g)], pa.int64()),
                pa.array([keys[g].tobytes() for g in groups if len(g)], pa.binary()),
                pa.array([found[g].tobytes() for g in groups if len(g)], pa.binary())],
                names=["shard", "tag", "block", "keys", "places"])

    return values.drop("n").mapInArrow(run, BLOCK)


def scores(docs: DataFrame, values: DataFrame, unseen: list[float]) -> DataFrame:
    """(doc_id, mark, lang, empty, n, full, fold) of every text: the surprisals of its n sub-words, summed up.

    ``full`` by the model of all folds, ``fold`` by the one that has not seen the text's own.
    """
    table, least = frequent(values)
    rest = values.filter(F.floor(F.log2("n") * 4) < least)
    shards = max(SHARDS, -(-rest.count() // SHARD_KEYS))
    table = docs.sparkSession.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one shard after its values, which are held: the sums of each block's texts."""
        current, parts, shard = None, [], None
        for batch in batches:
            out = []
            for name, tag, block, keys, places in zip(*(batch.column(i) for i in range(5))):
                if name.as_py() != current:
                    current, parts, shard = name.as_py(), [], None
                if tag.as_py() == 0:
                    parts.append((np.frombuffer(keys.as_buffer(), np.uint64),
                                  np.frombuffer(places.as_buffer(), np.int16).reshape(-1, MODELS)))
                elif tag.as_py() == 1:
                    out.append((block.as_py(), 0, places.as_py()))
                else:
                    if shard is None:
                        none = (np.empty(0, np.uint64), np.empty((0, MODELS), np.int16))
                        shard, parts = Table(*(np.concatenate(x) for x in zip(none, *parts))), []
                    data = keys.as_buffer().to_pybytes()
                    size = len(data) // 12
                    found, at = shard.find(np.frombuffer(data, np.uint64, size))
                    times = np.frombuffer(data, "<u4", size, 8 * size)
                    owners = np.frombuffer(places.as_buffer(), "<u2")[np.repeat(found, times)]
                    if len(owners):
                        place, model = owners & ((1 << FOLD_AT) - 1), owners >> FOLD_AT
                        values = np.repeat(at[found], times[found])
                        sums = np.stack([np.bincount(place, shard.values[values, m]) for m in (FOLDS, model)], axis=1)
                        texts = np.flatnonzero(np.bincount(place)).astype("<u2")
                        out.append((block.as_py(), 1, texts.tobytes() + sums[texts].astype("<i4").tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.binary()))], names=["block", "tag", "data"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The head of a block, then what the shards found for it."""
        head, current, sums = None, None, None

        def result() -> pa.RecordBatch:
            sizes, model = head.column(4).to_numpy(), head.column(7).to_numpy()
            off = np.array(unseen)
            full = sizes * off[FOLDS] - head.column(5).to_numpy() - sums[:, 0] * GRAIN
            fold = sizes * off[model] - head.column(6).to_numpy() - sums[:, 1] * GRAIN
            return pa.record_batch([*head.columns[:5], full, fold],
                                   names=["doc_id", "mark", "lang", "empty", "n", "full", "fold"])

        for batch in batches:
            for block, tag, data in zip(*(batch.column(i) for i in range(3))):
                if block.as_py() != current:
                    if head is not None:
                        yield result()
                    current = block.as_py()
                data = data.as_buffer().to_pybytes()
                if tag.as_py() == 0:
                    head = _unpacked(data)
                    sums = np.zeros((head.num_rows, 2))
                else:
                    size = len(data) // 10
                    sums[np.frombuffer(data, "<u2", size)] += np.frombuffer(
                        data, "<i4", 2 * size, 2 * size).reshape(-1, 2)
        if head is not None:
            yield result()

    sent = blocks(docs, table, shards).unionByName(shard_rows(rest, shards))
    found = sent.repartition("shard").sortWithinPartitions("shard", "tag").mapInArrow(
        look_up, "block bigint, tag int, data binary")
    return written(found.repartition("block").sortWithinPartitions("block", "tag").mapInArrow(
        add_up, "doc_id bigint, mark bigint, lang string, empty boolean, n bigint, full double, fold double"), "scores")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids whose labels (doc_id, quality) all say 1, each once."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q")).filter(
        F.col("q") == 1).select("doc_id")


def _limits(known: DataFrame, quantile: float) -> tuple[dict[str, int], int | None]:
    """The limit of each language of (lang, step), and that over all languages.

    Exact: a histogram by steps is counted, then summed up within the language. Where a language has
    fewer than ``OWN_LIMIT`` documents its limit is the higher one of its own and that of all.
    """
    bars = known.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))

    def at_quantile(bars: DataFrame, keys: list[str]) -> DataFrame:
        whole = Window.partitionBy(*keys)
        return bars.withColumn("before", F.sum("n").over(whole.orderBy("step"))).withColumn(
            "all", F.sum("n").over(whole)).filter(
            F.col("before") >= F.ceil(F.col("all") * quantile)).groupBy(*keys).agg(
            F.min("step").alias("step"), F.max("all").alias("all"))

    every = bars.groupBy("step").agg(F.sum("n").alias("n")).withColumn("everything", F.lit(1))
    rest = at_quantile(every, ["everything"]).collect()
    other = rest[0]["step"] if rest else None
    return {r["lang"]: r["step"] if r["all"] >= OWN_LIMIT else max(r["step"], other) for r in at_quantile(
        bars.filter(F.col("lang").isNotNull()), ["lang"]).collect()}, other


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, mark, lang, step, limit) of every document; ``mark`` is the hash of its text."""
    bound_batches(docs.sparkSession)
    trusted = written(trusted_ids(labels), "trusted")
    trusted = small(trusted, trusted.count())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    values, unseen = values_of(count_pairs(texts.join(trusted, "doc_id", "left_semi")))
    found = scores(docs, values, unseen).join(
        trusted.withColumn("is_trusted", F.lit(True)), "doc_id", "left")
    # trusted documents by the model that has not seen them
    sums = found.agg(F.sum(F.when(F.col("is_trusted"), F.col("fold"))), F.sum(F.when(F.col("is_trusted"), F.col("n")))).first()
    mean = sums[0] / sums[1] if sums[1] else 0.0
    own = F.when(F.col("is_trusted"), F.col("fold")).otherwise(F.col("full"))
    step = F.when(~F.col("empty"), F.floor((own + PRIOR * mean) / (F.col("n") + PRIOR) / STEP).cast("bigint"))
    found = written(found.select("doc_id", "mark", "lang", step.alias("step"), "is_trusted"), "judged")
    limits, other = _limits(found.filter(F.col("is_trusted") & F.col("step").isNotNull()), quantile)
    pairs = [F.lit(x) for pair in limits.items() for x in pair]
    limit = F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None)
    return found.select("doc_id", "mark", "lang", "step", F.coalesce(
        limit.cast("bigint"), F.lit(other).cast("bigint")).alias("limit"))


def _rejected() -> Column:
    return F.coalesce(F.col("step") > F.col("limit"), F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, rejected) of every document (doc_id, text, lang).

    Trusted are the documents whose labels (doc_id, quality) say 1. Perplexities are per sub-word, and
    those of short texts drawn to the mean of the trusted ones. Rejected is what is above the limit of its
    language, the quantile of the perplexities of its trusted documents, each by a model of other folds; a
    language of few trusted documents has at least the limit of all, a null or unknown one has that.
    Without trusted documents nothing is rejected. Null and empty texts have no perplexity and are kept;
    texts of any length are read whole; ties have equal perplexities, and one at the limit stays.
    Repeated rows are scored each; documents with a null id are scored and never trusted; other columns
    are not read; no documents: no rows.
    """
    return judged(docs, labels, quantile).select(
        "doc_id", "lang", F.exp(F.col("step") * STEP).alias("perplexity"),
        F.exp(F.col("limit") * STEP).alias("threshold"), _rejected().alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that ``quality`` does not reject, with all their columns.

    Those rejected are named by id and hash of the text, and left out where the texts lie.
    """
    bad = written(judged(docs, labels, quantile).filter(_rejected()).select(
        F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct(), "rejected")
    return docs.join(small(bad, bad.count()), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_bad_id")) & (
        F.xxhash64(F.col("text").cast("string")) == F.col("_bad_mark")), "left_anti")
