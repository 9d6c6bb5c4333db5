"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of a category sees the words of a text and the
probabilities of the categories before it. So that it learns how far those can be trusted, it is trained
on out-of-fold predictions: those of models that never saw the document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import limited

# Labelled documents that are fitted on: at most so many of each pair of labels.
PER_LABELS = 2000
# Letters that are kept of a longer word.
STEMS = (4, 5)
# Words that a model weighs: at most so many.
VOCABULARY = 384
# A word counts where it is in so many documents of the sample.
LEAST_DOCUMENTS = 4
FOLDS = 4
RIDGE = 0.3
ROUNDS = 12
# A toxic document with so many different words of the toxic model is severe.
SEVERE_WORDS = 4
CATEGORIES = ("junk", "toxic", "severe")
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")


def words(text: str | None) -> set[str]:
    """The different runs of letters, and of signs, of a text without regard to case.

    Longer words also give their first letters, marked by a tilde, for languages that put endings on.
    """
    found = set(WORD.findall(text.lower())) if text else set()
    for size in STEMS:
        found.update([w[:size] + "~" for w in found if len(w) > size and w[-1] != "~"])
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, per_labels: int = PER_LABELS) -> DataFrame:
    """(doc_id, quality, toxic, weight, words): a bounded sample of the labelled documents, always the same.

    Of each pair of labels the documents with the smallest hashes of their ids; a document with
    different labels counts as bad, and as toxic. The weight is how many labelled documents of its pair
    a document stands for. Of rows that repeat an id one counts, that with the smallest hash of its text.
    So the sample has at most four times ``per_labels`` rows, whatever the documents, and may be broadcast
    to them and collected.
    """
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sizes = {(r["quality"], r["toxic"]): r["count"] for r in said.filter(
        F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).groupBy("quality", "toxic").count().collect()}
    taken = None
    for quality in (0, 1):
        for toxic in (0, 1):
            some = said.filter((F.col("quality") == quality) & (F.col("toxic") == toxic)).orderBy(
                F.xxhash64("doc_id"), "doc_id").limit(per_labels).withColumn(
                "weight", F.lit(max(1.0, sizes.get((quality, toxic), 0) / per_labels)))
            taken = some if taken is None else taken.unionByName(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in limited(batch):
                yield pa.record_batch([
                    *rows.columns[:4],
                    pa.array([sorted(words(x)) for x in rows.column(4).to_pylist()], pa.list_(pa.string()))],
                    names=["doc_id", "quality", "toxic", "weight", "words"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    # the first row of each id is found without the texts
    first = texts.select("doc_id", F.xxhash64("text").alias("mark")).join(
        F.broadcast(taken.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("mark").alias("first"))
    taken = taken.join(first, "doc_id")
    found = texts.withColumn("mark", F.xxhash64("text")).join(F.broadcast(taken), "doc_id").filter(
        F.col("mark") == F.col("first")).groupBy("doc_id").agg(
        F.first("quality").alias("quality"), F.first("toxic").alias("toxic"), F.first("weight").alias("weight"),
        F.first("text").alias("text"))
    return found.select(
        "doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"), "weight", "text").mapInArrow(
        run, "doc_id bigint, quality int, toxic int, weight double, words array<string>")


class Linear:
    """Logistic regression on the presence of the words that tell most, and on given columns.

    ``stands``: how many documents each one stands for.
    """

    def __init__(self, lists: list[np.ndarray], more: np.ndarray, target: np.ndarray, size: int,
                 stands: np.ndarray | None = None) -> None:
        rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
        stands = np.ones(len(target)) if stands is None else stands
        n, share = len(target), float(np.average(target, weights=stands)) if len(target) else 0.0
        self.vocabulary, self.weights = np.empty(0, np.int64), np.zeros(more.shape[1])
        if share in (0.0, 1.0):
            self.bias = -30.0 if share == 0 else 30.0
            return
        with_word = np.bincount(flat, weights=stands[rows], minlength=size)
        hits = np.bincount(flat, weights=(target * stands)[rows], minlength=size)
        # how far the share of the category among documents with the word is from the overall share
        score = np.abs(hits - with_word * share) / np.sqrt(np.maximum(with_word, 1) * share * (1 - share))
        score[np.bincount(flat, minlength=size) < LEAST_DOCUMENTS] = 0
        best = np.lexsort((np.arange(size), -score))[:VOCABULARY]
        self.vocabulary = np.sort(best[score[best] > 0])
        place = np.full(size, -1)
        place[self.vocabulary] = np.arange(len(self.vocabulary))
        x = np.zeros((n, len(self.vocabulary) + more.shape[1] + 1), np.float32)
        known = place[flat] >= 0
        x[rows[known], place[flat[known]]] = 1
        x[:, len(self.vocabulary):-1] = more
        x[:, -1] = 1
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-4
        for _ in range(ROUNDS):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            v = (stands * np.maximum(p * (1 - p), 1e-5)).astype(np.float32)
            step = np.linalg.solve(
                (x.T @ (x * v[:, None])).astype(np.float64) + np.diag(ridge),
                x.T.astype(np.float64) @ (stands * (target - p)) - ridge * w)
            w += step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-3:
                break
        self.weights, self.bias = w[:-1], float(w[-1])

    def predict(self, lists: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        own = dict(zip(self.vocabulary.tolist(), self.weights.tolist()))
        z = [sum(own.get(i, 0.0) for i in x.tolist()) for x in lists]
        z = np.array(z) + more @ self.weights[len(self.vocabulary):] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(lists: list[np.ndarray], targets: dict[str, np.ndarray], folds: np.ndarray, size: int,
              stands: np.ndarray | None = None) -> list[Linear]:
    """One model per category, each trained on the out-of-fold probabilities of those before it."""
    before, models = np.empty((len(lists), 0)), []
    stands = np.ones(len(lists)) if stands is None else stands
    for target in targets.values():
        models.append(Linear(lists, before, target, size, stands))
        unseen = np.zeros(len(lists))
        for fold in range(FOLDS):
            out = np.flatnonzero(folds == fold)
            rest = np.flatnonzero(folds != fold)
            if len(out):
                part = Linear([lists[i] for i in rest], before[rest], target[rest], size, stands[rest])
                unseen[out] = part.predict([lists[i] for i in out], before[out])
        before = np.column_stack([before, unseen])
    return models


class Chain:
    """The fitted chain: a few hundred words with a weight for each category."""

    def __init__(self, sample: pa.Table) -> None:
        """``sample``: (doc_id, quality, toxic, words), and weight where documents do not count alike.

        Only words of several documents leave Arrow. Weights are 1 in the mean, so that the ridge does not
        depend on the size of the table.
        """
        found = sample.column("words").combine_chunks()
        sizes = found.value_lengths().to_numpy()
        coded = found.flatten().dictionary_encode()
        common = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) >= LEAST_DOCUMENTS
        names = coded.dictionary.filter(pa.array(common)).to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        names = [names[i] for i in order]
        number = np.full(len(common), -1, np.int32)
        number[np.flatnonzero(common)[order]] = np.arange(len(names), dtype=np.int32)
        numbers = np.split(number[coded.indices.to_numpy()], np.cumsum(sizes)[:-1])
        lists = [np.sort(x[x >= 0]) for x in numbers[:len(sizes)]]
        # rows in an order of their own, copies of a text in one fold
        marks = [zlib.crc32(x.tobytes()) for x in lists]
        ids = sample.column("doc_id").to_pylist()
        order = sorted(range(len(lists)), key=lambda i: (ids[i], marks[i]))
        lists = [lists[i] for i in order]
        folds = np.array([marks[i] % FOLDS for i in order], np.int64)
        quality = sample.column("quality").to_numpy()[order]
        toxic = (sample.column("toxic").to_numpy()[order] == 1).astype(float)
        stands = np.ones(len(lists))
        if "weight" in sample.column_names:
            stands = sample.column("weight").to_numpy()[order]
        stands = stands / stands.mean() if len(stands) else stands
        telling = Linear(lists, np.empty((len(lists), 0)), toxic, len(names), stands)
        heavy = {int(i) for i, w in zip(telling.vocabulary, telling.weights) if w > 1}
        severe = np.array([len(heavy.intersection(x.tolist())) >= SEVERE_WORDS for x in lists], float)
        targets = {"junk": (quality == 0).astype(float), "toxic": toxic, "severe": severe * toxic}
        self.weights: dict[str, np.ndarray] = {}
        models = fit_chain(lists, targets, folds, len(names), stands)
        self.bias = [m.bias for m in models]
        self.earlier = [m.weights[len(m.vocabulary):].tolist() for m in models]
        for k, model in enumerate(models):
            for i, w in zip(model.vocabulary.tolist(), model.weights.tolist()):
                self.weights.setdefault(names[i], np.zeros(len(models)))[k] = w

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A row of probabilities, one per category, for each text; without words they are 0."""
        z, known = np.tile(self.bias, (len(texts), 1)), self.weights.keys()
        none = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            found = words(text)
            none[i] = not found
            for word in found & known:
                z[i] += self.weights[word]
        p = np.zeros_like(z)
        for k, weights in enumerate(self.earlier):
            p[:, k] = 1 / (1 + np.exp(-np.clip(z[:, k] + p[:, :k] @ np.array(weights), -30, 30)))
        p[none] = 0
        return p


def fit(docs: DataFrame, labels: DataFrame, per_labels: int = PER_LABELS) -> Chain:
    return Chain(labelled_sample(docs, labels, per_labels).toArrow())


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, junk, toxic, severe, rejected) of every document (doc_id, text).

    Probabilities of the categories, and whether that of toxic reaches the threshold. Junk are the
    documents that labels (doc_id, quality, toxic) call bad, severe the toxic ones with many of the words
    that tell. Null labels and labels without an id are left out; without any toxic label nothing is
    toxic. Texts that are null or without words have probabilities 0. Repeated rows are scored each;
    null ids are kept; texts of any length are read whole; one at the threshold is rejected; other columns
    are not read; no documents: no rows.
    """
    chain = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in limited(batch):
                p = chain.value.predict(rows.column(1).to_pylist())
                yield pa.record_batch(
                    [rows.column(0), *[np.ascontiguousarray(x) for x in p.T],
                     p[:, CATEGORIES.index("toxic")] >= threshold],
                    names=["doc_id", *CATEGORIES, "rejected"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, junk double, toxic double, severe double, rejected boolean")


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that ``toxicity`` does not reject, with all their columns."""
    chain = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in limited(batch):
                p = chain.value.predict(rows.column(place).cast(pa.string()).to_pylist())
                yield rows.filter(pa.array(p[:, CATEGORIES.index("toxic")] < threshold))

    return docs.mapInArrow(run, docs.schema)
