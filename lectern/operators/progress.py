"""Reading state: progress and favourites kept current, lookups, shelves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.rank_index import build_rank_index, page

KEYS = ["book_id", "user_id"]
EXPECTED_DAYS = 15
SHELF_SIZE = 20
DEFAULT_LIMIT = 10

_STATE = ["progress", "progress_index", "para_position"]


def _has_keys() -> Column:
    # written so that NULL keys count as missing
    return (F.coalesce(F.col("book_id"), F.lit(0)) != 0) & (F.coalesce(F.col("user_id"), F.lit(0)) != 0)


def valid_progress(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with both keys set, and the rejected rest."""
    return df.filter(_has_keys()), df.filter(~_has_keys()).withColumn(
        "reason", F.lit("book_id or user_id not set"))


def _from_events(events: DataFrame) -> DataFrame:
    """Events reduced to one row per key: first event time and the state of the last event.

    The reduction runs before the shuffle, so a key with very many events moves few rows. Time and event
    id make one number, so that all it keeps is of fixed width and no event is sorted. At one time a null
    event id comes before all others; an event without a time never gives the state.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(17,0)")
    number = F.coalesce(F.col("event_id").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    order = (micros * F.lit("1" + "0" * 20).cast("decimal(21,0)")).cast("decimal(38,0)") + number
    placed = events.withColumn("_order", order.cast("decimal(38,0)"))
    return placed.groupBy(*KEYS).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.max_by(c, "_order").alias(c) for c in _STATE])


def upsert_progress(existing: DataFrame | None, events: DataFrame) -> DataFrame:
    """Progress table after the events.

    A new key takes its start and expected end from its first event. A known key keeps both and takes
    progress, position and update time from its last event.
    """
    new = _from_events(valid_progress(events)[0])
    fresh = new.select(
        *KEYS, F.col("first_ts").alias("start_date"), F.col("last_ts").alias("updated_at"),
        (F.col("first_ts") + F.expr(f"INTERVAL {EXPECTED_DAYS} DAYS")).alias("expt_end_date"),
        F.nullif(F.col("first_ts"), F.col("first_ts")).alias("end_date"), *_STATE)
    if existing is None:
        return fresh
    return merge_progress(existing, fresh)


def merge_progress(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two progress tables, each with one row per key, as one; ``fresh`` is the later one."""
    columns = [*KEYS, "start_date", "updated_at", "expt_end_date", "end_date", *_STATE]
    kept_from_old = {"start_date", "expt_end_date", "end_date"}
    old = existing.select(*KEYS, F.struct(*columns[2:]).alias("old"))
    now = fresh.select(*KEYS, F.struct(*columns[2:]).alias("now"))

    def pick(name: str) -> Column:
        first, second = ("old", "now") if name in kept_from_old else ("now", "old")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{name}")).otherwise(
            F.col(f"{second}.{name}")).alias(name)

    return old.join(now, KEYS, "full").select(*KEYS, *[pick(c) for c in columns[2:]])


def merge_changes(changes: DataFrame, order: str) -> DataFrame:
    """Progress table from changes(progress columns, ``order``), applied in order.

    The first change of a key gives its start and expected end, the last one its state.
    """
    first, last = ["start_date", "expt_end_date", "end_date"], ["updated_at", *_STATE]
    return changes.groupBy(*KEYS).agg(
        *[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last],
    ).select(*KEYS, "start_date", "updated_at", "expt_end_date", "end_date", *_STATE)


def update_progress(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Existing rows with the state of their last event; events of unknown keys have no effect."""
    new = _from_events(events).select(
        *KEYS, F.struct(F.col("last_ts").alias("updated_at"), *_STATE).alias("now"))
    changed = ["updated_at", *_STATE]
    return existing.join(new, KEYS, "left").select(*[
        F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)).alias(c)
        if c in changed else F.col(c) for c in existing.columns])


def upsert_favs(events: DataFrame) -> DataFrame:
    """One favourite per (book, user): created at the first event, updated at the last."""
    return events.groupBy(*KEYS).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def lookup_progress(requests: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress of each requested (user, book), ``found`` false where reading has not begun."""
    columns = [c for c in progress.columns if c not in KEYS]
    side = progress.select(*KEYS, *columns, F.lit(True).alias("_hit"))
    return requests.join(side, KEYS, "left").select(
        *requests.columns, *columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def reading_books(
    books: DataFrame, progress: DataFrame, user_id: int, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """Books a user read last.

    The page is taken from the progress rows before books are joined, so a missing book makes the
    page shorter.
    """
    mine = progress.filter(F.col("user_id") == user_id).select("book_id", "updated_at", *_STATE)
    shown = mine.orderBy(F.desc("updated_at"), "book_id").offset(offset).limit(limit or DEFAULT_LIMIT)
    return (
        books.join(shown, books["id"] == shown["book_id"], "inner")
        .drop("book_id").orderBy(F.desc("updated_at"), "id"))


def write_reading_pages(progress: DataFrame, path: str) -> None:
    """The rank index behind ``reading_page``: the progress rows of each user, last read first."""
    build_rank_index(progress.select("user_id", "book_id", "updated_at", *_STATE), path,
                     [F.desc("updated_at"), "book_id"], ["user_id"])


def reading_page(
    books: DataFrame, path: str, user_id: int, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """``reading_books`` from the index at ``path``; a page far back costs what the first one does."""
    mine = page(books.sparkSession, path, limit or DEFAULT_LIMIT, offset, user_id=user_id)
    return books.join(mine.drop("user_id"), books["id"] == mine["book_id"], "inner").drop(
        "book_id").orderBy(F.desc("updated_at"), "id")


def write_liked_pages(books: DataFrame, favs: DataFrame, path: str) -> None:
    """The rank index behind ``liked_page``: the favourites of each user that have a book, newest first."""
    liked = favs.select("user_id", F.col("book_id").alias("id"), F.col("updated_at").alias("liked_at"))
    build_rank_index(liked.join(books.select("id"), "id", "left_semi"), path,
                     [F.desc("liked_at"), "id"], ["user_id"])


def liked_page(
    books: DataFrame, path: str, progress: DataFrame, user_id: int, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """``liked_books`` from the index at ``path``; a page far back costs what the first one does."""
    mine = page(books.sparkSession, path, limit or DEFAULT_LIMIT, offset, user_id=user_id).drop("user_id")
    state = progress.filter(F.col("user_id") == user_id).select(F.col("book_id").alias("id"), *_STATE)
    return books.join(mine, "id", "inner").join(state, "id", "left").orderBy(F.desc("liked_at"), "id")


def liked_books(
    books: DataFrame, favs: DataFrame, progress: DataFrame, user_id: int,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    """A user's favourites, newest first, with the user's own progress where there is some."""
    mine = favs.filter(F.col("user_id") == user_id).select(
        F.col("book_id").alias("id"), F.col("updated_at").alias("liked_at"))
    order = [F.desc("liked_at"), "id"]
    # only favourites whose book exists count toward the page
    shown = books.join(mine, "id", "inner").orderBy(*order).offset(offset).limit(limit or DEFAULT_LIMIT)
    state = progress.filter(F.col("user_id") == user_id).select(F.col("book_id").alias("id"), *_STATE)
    return shown.join(state, "id", "left").orderBy(*order)


def _newest(df: DataFrame, ts: str, k: int) -> DataFrame:
    # a rank filter right above the window lets Spark cut each user's rows before the shuffle
    newest = Window.partitionBy("user_id").orderBy(F.desc(ts), "book_id")
    return df.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= k)


def all_shelves(
    books: DataFrame, favs: DataFrame, progress: DataFrame, k: int = SHELF_SIZE,
) -> DataFrame:
    """The reading and the liked shelf of every user, at most ``k`` books each."""
    shown = books.select(F.col("id").alias("book_id"), "title", "author")
    columns = ["user_id", "shelf", "position", "book_id", "title", "author", "shelved_at", *_STATE]
    # both shelves need the same rows and columns, so Spark works the progress table out once
    read = progress.select(*KEYS, "updated_at", *_STATE).filter(
        F.col("book_id").isNotNull() & F.col("user_id").isNotNull())
    reading = _newest(read.withColumnRenamed("updated_at", "shelved_at"), "shelved_at", k).join(shown, "book_id", "inner").withColumn(
        "shelf", F.lit("reading"))
    # a favourite without a book takes no place on the shelf
    present = favs.select(*KEYS, F.col("updated_at").alias("shelved_at")).join(shown, "book_id", "inner")
    liked = _newest(present, "shelved_at", k).join(read, KEYS, "left").withColumn(
        "shelf", F.lit("liked")).withColumns({
            c: F.when(F.col("updated_at").isNotNull(), F.col(c)) for c in _STATE})
    return reading.select(*columns).unionByName(liked.select(*columns))
