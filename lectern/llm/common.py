"""What the operators of this package share: tables, written intermediates, prefix sums, encoding."""

from __future__ import annotations

import hashlib
import sys
import types
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import shared_folder

# Rows of a table that is broadcast: at most some ten megabytes. Larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Words whose ids a Python worker keeps: about 75 MB in each of two generations.
CACHED_WORDS = 350_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows, written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join with a known number of rows: broadcast while that number is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the texts: met by a shuffle, never sent to the driver.

    Spark takes a written table to be as large as its compressed files, and a function to give a row for
    a row, so it would broadcast what is many times as large as it expects.
    """
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(parts: DataFrame, key: str, values: list[str], group: int = 4096) -> DataFrame:
    """Exclusive prefix sums ``<value>_before`` and ``<value>_total`` over one row per ``key``.

    The key is a non-negative long without repeats. Two passes: sums of runs of ``group`` keys are
    scanned in one task, which thus sees a 4096th of the rows, then each run is scanned by itself.
    """
    runs = parts.withColumn("_run", F.floor(F.col(key) / group))
    heads = runs.groupBy("_run").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_run").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "_run", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_run") for v in values],
        *[F.sum(f"_{v}").over(everything).alias(f"{v}_total") for v in values])
    inside = Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return runs.join(heads, "_run").select(
        *parts.columns, *[f"{v}_total" for v in values],
        *[(F.col(f"_{v}_run") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before")
          for v in values])


def worker_store() -> dict:
    """A dictionary that lives as long as the Python process, across the tasks it runs."""
    name = "_lectern_worker_store"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    return module.__dict__.setdefault("kept", {})


class WordEncoder(dict):
    """Token ids of whole texts, with each distinct word encoded once.

    For tokenizers that split at white space before anything else, so that the ids of a text are the
    ids of its words one after the other. Words are what lies between spaces and line feeds; they map to
    their ids as bytes. Where letter case is dropped and a word of Latin-1 letters is one piece for the
    model, such words and the stops behind them share entries and go to the model at once; ``whole``
    is set where a probe shows that this does not hold. Two generations of bounded size are kept.
    """

    STOPS = ".,!?;:"
    # the characters that stand for the UTF-8 bytes of letters beyond ASCII in byte-level models
    BYTES = {x: "".join(chr(b + 256 - 94 if 0x7F <= b <= 0xA0 else 323 if b == 0xAD else b)
                        for b in chr(x).encode()) for x in range(0x80, 0x100)}

    def __init__(self, tokenizer, dtype: str) -> None:
        super().__init__()
        self.tokenizer, self.code, self.old = tokenizer, {"<u4": "I", "<u2": "H"}[dtype], {}
        probe = ["".join(chr(x) for x in range(lo, lo + 8) if chr(x).isalpha()).lower()
                 for lo in range(0x40, 0x100, 8)]
        probe = [x for x in probe if x]
        self.whole = any(self._word(x) != self._text(x) for x in probe) or any(
            self._word(x.lower()) + self._text("!?") != self._text(x + "!?") for x in ("Abc", "\xc9T\xc9"))

    def _text(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.translate(self.BYTES)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(self.STOPS)
            if self.whole or not stem.isalpha() or not (stem.isascii() or max(stem) <= "\xff"):
                ids = self._text(word)
            else:
                low = stem.lower()
                ids = self._word(low) if low == word else self[low] + (
                    self[word[len(stem):]] if len(stem) < len(word) else b"")
        self[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of the dtype; null: empty."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        known = self.__getitem__
        return [b"".join(map(known, text.replace("\n", " ").split(" "))) if text else b""
                for text in texts]


def word_encoder(json: str, dtype: str = "<u4", specials_are_text: bool = False) -> WordEncoder:
    """The worker's encoder for this tokenizer file content."""
    key = (hashlib.sha256(json.encode()).hexdigest(), dtype, specials_are_text)
    store = worker_store()
    if key not in store:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(json)
        tokenizer.encode_special_tokens = specials_are_text
        tokenizer.no_truncation()
        store[key] = WordEncoder(tokenizer, dtype)
    return store[key]


def tokenizer_file(path: str | None = None) -> str:
    """Content of a tokenizer file; by default the public word-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def limited(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of few rows, so that very long texts never meet in great number."""
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)
