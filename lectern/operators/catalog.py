"""Catalogue queries: search, lookup, statistics, recent and random books, public views, feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import contains_text

# Fixed values of the catalogue feed and of the reply envelope.
DIR_MIME = "application/atom+xml;profile=opds-catalog;kind=navigation"
FEED_SPACES = {
    "xmlns": "http://www.w3.org/2005/Atom",
    "xmlns:dc": "http://purl.org/dc/terms/",
    "xmlns:opds": "http://opds-spec.org/2010/catalog",
}
FILE_REL = "http://opds-spec.org/acquisition"
COVER_REL = "http://opds-spec.org/cover"
EPUB_MIME = "application/epub+zip"
COVER_MIME = "image/jpeg"
ATOM_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SUCCESS_CODE, SUCCESS_MESSAGE = 200, "sucesss"

DEFAULT_LIMIT = 10
FEED_RANDOM, FEED_RECENT, FEED_BELOW = 10, 12, 30


def _matches(q: str, category: str, author: str, ci: bool, wildcards: bool) -> Column:
    condition = F.lit(True)
    if q:
        condition = condition & (
            contains_text(F.col("title"), q, ci, wildcards)
            | contains_text(F.col("author"), q, ci, wildcards))
    if category:
        condition = condition & (F.col("category") == category)
    if author:
        condition = condition & (F.col("author") == author)
    return condition


def search_books(
    books: DataFrame, q: str = "", category: str = "", author: str = "", page_size: int = 20,
    page_num: int = 0, ci: bool = True, wildcards: bool = False, after_id: int | None = None,
) -> DataFrame:
    """One page of matching books in id order; empty arguments do not filter.

    A page far back makes one task go through all pages before it. With ``after_id``, the last id of
    the page before, only books beyond it are read, so every page costs the same.
    """
    if page_size < 0 or page_num < 0:
        raise ValueError("page_size and page_num must not be negative")
    found = books.filter(_matches(q, category, author, ci, wildcards))
    if after_id is not None:
        found = found.filter(F.col("id") > after_id)
    return found.orderBy("id").offset(page_size * page_num).limit(page_size)


def search_total(
    books: DataFrame, q: str = "", category: str = "", author: str = "", ci: bool = True,
    wildcards: bool = False,
) -> DataFrame:
    """Number of books over all pages of the same search."""
    return books.filter(_matches(q, category, author, ci, wildcards)).agg(
        F.count("*").alias("total"))


def lookup_books(requests: DataFrame, books: DataFrame) -> DataFrame:
    """Each request (request_id, book_id) with its book, ``found`` false when there is none."""
    columns = [c for c in books.columns if c != "id"]
    side = books.select(F.col("id").alias("book_id"), *columns, F.lit(True).alias("_hit"))
    return requests.join(side, "book_id", "left").select(
        *requests.columns, *columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def count_books(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("total"))


def book_stats(books: DataFrame, tags: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """Totals of books, authors and publishers, and of tags when ``tags(book_id, tag)`` is given."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    stats = books.agg(
        F.count("*").alias("total"),
        distinct(F.col("author")).alias("author"),
        distinct(F.col("publisher")).alias("publisher"))
    if tags is None:
        return stats.withColumn("tag", F.lit(0).cast("bigint"))
    return stats.withColumn("tag", tags.agg(distinct(F.col("tag")).alias("tag")).scalar())


def _without(books: DataFrame, omit: DataFrame | Sequence[int] | None) -> DataFrame:
    if omit is None:
        return books
    if not isinstance(omit, DataFrame):
        omit = books.sparkSession.createDataFrame([(x,) for x in omit], "id bigint")
    return books.join(omit.select(F.col(omit.columns[0]).alias("id")), "id", "left_anti")


def recent_books(
    books: DataFrame, limit: int = DEFAULT_LIMIT, omit: DataFrame | Sequence[int] | None = None,
) -> DataFrame:
    """Newest books nobody has opened; a limit of 0 means the default."""
    fresh = _without(books, omit).filter(F.col("count_visit") == 0)
    return fresh.orderBy(F.desc("ctime"), "id").limit(limit or DEFAULT_LIMIT)


def random_books(
    books: DataFrame, limit: int = DEFAULT_LIMIT, omit: DataFrame | Sequence[int] | None = None,
    seed: int | str | None = None,
) -> DataFrame:
    """Exactly ``limit`` books at random, the same ones for the same seed."""
    order = F.rand() if seed is None else F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    return _without(books, omit).orderBy(order, "id").limit(limit or DEFAULT_LIMIT)


def home_feed(
    books: DataFrame, random: int = FEED_RANDOM, recent: int = FEED_RECENT,
    seed: int | str | None = None,
) -> DataFrame:
    """Random and recent books, labelled by ``section``."""
    for name, value in (("random", random), ("recent", recent)):
        if not 0 <= value < FEED_BELOW:
            raise ValueError(f"{name} must be at least 0 and below {FEED_BELOW}")
    return random_books(books, random, seed=seed).withColumn("section", F.lit("random")).unionByName(
        recent_books(books, recent).withColumn("section", F.lit("recent")))


def public_view(books: DataFrame) -> DataFrame:
    """Books as shown outside: no path, ``pubdate``, and NULL where an empty text is left out."""
    view = books.drop("path")
    optional = {c for c in ("sub_title", "description", "series", "series_index") if c in view.columns}
    view = view.select(*[
        F.nullif(F.col(c), F.lit("")).alias(c) if c in optional else F.col(c) for c in view.columns])
    return view.withColumnRenamed("publish_date", "pubdate")


def to_envelope(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """One JSON reply per row: code, message and the row as data, NULL fields left out."""
    return df.select(*key, F.to_json(F.struct(
        F.lit(SUCCESS_CODE).alias("code"), F.lit(SUCCESS_MESSAGE).alias("message"),
        F.struct(*df.columns).alias("data"))).alias("body"))


def feed_entries(books: DataFrame, base_href: str) -> DataFrame:
    """Catalogue feed entries; links are the book file and, if there is one, its cover."""
    href = base_href.rstrip("/")

    def link(target: Column, kind: str, rel: str) -> Column:
        return F.struct(target.alias("_href"), F.lit(kind).alias("_type"), F.lit(rel).alias("_rel"))

    book = link(F.concat(F.lit(f"{href}/books/"), F.col("id"), F.lit("/download")), EPUB_MIME, FILE_REL)
    cover = link(F.concat(F.lit(f"{href}/covers/"), F.col("cover_url")), COVER_MIME, COVER_REL)
    return books.select(
        F.col("id").cast("string").alias("id"),
        F.date_format("utime", ATOM_TIME).alias("updated"),
        "title",
        F.struct(F.col("author").alias("name")).alias("author"),
        F.struct(F.lit("text").alias("_type"), F.col("description").alias("_VALUE")).alias("summary"),
        F.when(F.col("cover_url") != "", F.array(book, cover)).otherwise(F.array(book)).alias("link"))
