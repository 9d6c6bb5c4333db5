"""Spelling variants of words, found through pivotal grams.

Two words within one edit are found without comparing all words. The bigrams of a word are ordered from
rare to frequent over all words; the first three are its prefix, and of these two disjoint ones, the
cheapest by dynamic programming, are its pivots. One edit spoils at most one of two disjoint grams. So of
two words with one edit, the one whose prefix ends earlier has a pivot in the prefix of the other. The
positions of that gram tell on which side of it the edit lies: the other side is the same in both words,
and where the side with the edit is long, one half of it is, too. A pivot is looked up with what must be
the same; what meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import limited, shuffled, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
# A near word is the form of a word if it is so many times as frequent.
TIMES = 5
# One in so many runs of a document, by the checksum, loses a letter.
SPOILED = 199
EDITS = 1
GRAM = 2
# A side up to this length is not halved.
SHORT = 3
# Words that a task holds while it counts.
HELD = 300_000
LETTERS = "A-Za-zÀ-ÿ"


def count_words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): how often each word of at least ``least`` letters occurs, each task's sums first.

    Words are runs of letters with A-Z in lower case; where the checksum of document and run says so, a
    letter is left out.
    """
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def found(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                               names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for rows in limited(batch, 64):
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                    if not text.is_valid:
                        continue
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    low = text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")
                    for word, n in Counter(runs.findall(low)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % SPOILED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield found(counts)
                    counts = {}
        yield found(counts)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of every bigram in the order from rare to frequent, by the words that hold it.

    Letters are 90 at most (A-Z do not occur), so bigrams are 8100 at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update({word[i:i + GRAM] for i in range(len(word) - GRAM + 1)})
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                              names=["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(
        F.sum("n").alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def prefix(word: str, ranks: dict[str, int]) -> list[int]:
    """Places of the rarest grams of a word: as many as edits can spoil and one more.

    A gram that occurs again has all its places in the prefix.
    """
    order = sorted((ranks[word[i:i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = order[GRAM * EDITS][0]
    return [i for rank, i in order if rank <= last]


def pivots(places: list[int], costs: list[int], count: int = EDITS + 1) -> tuple[int, ...]:
    """The ``count`` disjoint grams of the least total cost, by dynamic programming over their places."""
    order = sorted(zip(places, costs))
    # best[k][i]: of the first i grams, the cheapest choice of k
    best = [[(0, ())] * (len(order) + 1)]
    for k in range(1, count + 1):
        row: list[tuple[int, tuple[int, ...]] | None] = [None] * (len(order) + 1)
        for i, (place, cost) in enumerate(order, 1):
            before = sum(p + GRAM <= place for p, _ in order[:i])
            rest = best[k - 1][before]
            taken = rest and (rest[0] + cost, (*rest[1], place))
            row[i] = min((x for x in (row[i - 1], taken) if x), default=None)
        best.append(row)
    return best[count][-1][1]


def known_parts(word: str, place: int, length: int) -> Iterator[str]:
    """What a word shares with a word of ``length`` letters that has the gram at ``place`` as a pivot.

    One part for each side the edit can lie on, or for each half of that side. ``length`` differs from
    the word's own by one at most; what a pivot looks up is the same with its own word and length.
    """
    more = len(word) - length
    behind, before = length - place - GRAM, place - more
    if behind >= 0:
        same = word[:place + GRAM]
        if behind <= SHORT:
            yield f"a{length} {same}"
        else:
            half = behind // 2
            yield f"b{length} {word[:place + GRAM + half]}"
            yield f"c{length} {same} {word[len(word) - (behind - half):]}"
    if before >= 0:
        same = word[place:]
        if before <= SHORT:
            yield f"d{length} {same}"
        else:
            half = before // 2
            yield f"e{length} {word[:half]} {same}"
            yield f"f{length} {word[place - (before - half):]}"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of the words (word, n) that differ by one edit, a before b, each pair once.

    Pivots and prefixes meet by a hash of what they share, in an inner join that adaptive execution can
    split; the edit distance decides in the join. A word has some thirty entries, which Spark takes for one.
    """
    ranks = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def entries(whole: bool):
        """``whole``: the entries of prefixes, for words of each length; else those of pivots."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, key_of = ranks.value, xxhash.xxh64_intdigest
            for batch in batches:
                for rows in limited(batch, 4096):
                    keys, owners = [], []
                    for at, word in enumerate(rows.column(0).to_pylist()):
                        places = prefix(word, order)
                        size = len(word)
                        lengths = range(size - EDITS, size + EDITS + 1) if whole else (size,)
                        if not whole:
                            places = pivots(places, [order[word[i:i + GRAM]] for i in places])
                        mine = {part for i in places for length in lengths for part in known_parts(word, i, length)}
                        keys += [key_of(part) - (1 << 63) for part in mine]
                        owners += [at] * len(mine)
                    taken = rows.take(pa.array(owners, pa.int32()))
                    yield pa.record_batch([pa.array(keys, pa.int64()), *taken.columns], names=["key", "word", "n"])

        return run

    kinds = "key bigint, word string, n bigint"
    asked = words.select("word", "n").mapInArrow(entries(False), kinds)
    listed = words.select(F.col("word"), "n").mapInArrow(entries(True), kinds).select(
        "key", F.col("word").alias("other"), F.col("n").alias("n_other"))
    pairs = asked.join(shuffled(listed), (asked["key"] == listed["key"]) & (
        F.levenshtein("word", "other", EDITS) == EDITS))
    first = F.col("word") < F.col("other")
    return pairs.select(
        F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("n_other")).alias("n_a"),
        F.when(first, F.col("n_other")).otherwise(F.col("n")).alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every (word, form): where following the forms ends, by pointer doubling.

    A form is at least ``TIMES`` as frequent as its word, so chains are short and never closed.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        beyond = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(found.join(shuffled(beyond), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots")
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word of the texts (doc_id, text).

    ``n_near`` words differ from a word by one letter put in, left out or replaced; its form is the most
    frequent of them, ties to the first in code-point order, if that is at least ``times`` as frequent
    as the word, and its root is where forms end. Null and empty texts have no words; a null doc_id
    counts as an empty one in the checksum; repeated rows count each; words of any length are taken
    whole; other columns are not read; no documents: no rows.
    """
    if least_length < GRAM * (EDITS + 1):
        raise ValueError("words are too short for two pivots")
    words = written(count_words(docs, least_length).filter(F.col("n") >= least_count), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near")))
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), "near")).alias("first"))
    takes = -F.col("first.less") >= F.col("n") * times
    formed = written(words.join(shuffled(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("first.near")).alias("form"), F.when(takes, -F.col("first.less")).alias("form_n")),
        "spelling-forms")
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(shuffled(ends), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
