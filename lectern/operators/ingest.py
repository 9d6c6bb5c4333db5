"""From package documents to catalogue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import first_or_empty, last_match
from lectern.functions.text import file_stem
from lectern.model import PACKAGE
from lectern.session import shared_folder

# Fixed values of the package rules.
BOOK_ID, UUID_PREFIX = "bookid", "urn:uuid:"
SERIES, SERIES_INDEX = "calibre:series", "calibre:series_index"
COVER_MARK = "cover-image"
DEFAULT_PUBLISH_DATE = "1970-01-01"

_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


# Entities of markup, the ampersand behind those that could come out of it.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\xa0"), ("&amp;", "&"))


def new_files(files: DataFrame, seen: DataFrame, refresh: bool = False) -> DataFrame:
    """Files whose path has not been loaded, or all of them on refresh."""
    return files if refresh else files.join(seen.select("path"), "path", "left_anti")


def unpack_packages(packages: DataFrame) -> DataFrame:
    """Package documents as arrays; rows with an error are left out.

    Adds identifiers, metas and items as arrays of structs, and titles, creators, subjects,
    languages, publishers, descriptions and dates as arrays of strings.
    """
    def values(name: str) -> Column:
        return F.transform(F.col(f"opf.metadata.{name}"), lambda e: F.coalesce(e["_VALUE"], F.lit("")))

    none = F.array().cast("array<string>")
    keep = [c for c in packages.columns if c not in ("opf_xml", "error")]
    return (
        packages.filter(F.col("error").isNull())
        .withColumn("opf", F.from_xml("opf_xml", PACKAGE.simpleString(), _XML))
        .select(
            *keep,
            F.coalesce(F.transform("opf.metadata.identifier", lambda e: F.struct(
                e["_id"].alias("id"), e["_scheme"].alias("scheme"),
                F.coalesce(e["_VALUE"], F.lit("")).alias("value"))),
                F.array().cast("array<struct<id:string,scheme:string,value:string>>"),
            ).alias("identifiers"),
            F.transform("opf.metadata.meta", lambda m: F.struct(
                m["_name"].alias("name"), m["_content"].alias("content"))).alias("metas"),
            F.transform("opf.manifest.item", lambda i: F.struct(
                i["_id"].alias("id"), i["_properties"].alias("properties"), i["_href"].alias("href"),
            )).alias("items"),
            *[F.coalesce(values(n), none).alias(f"{n}s") for n in (
                "title", "creator", "subject", "language", "publisher", "description", "date")]))


def content_identifier(df: DataFrame, ids_col: str = "identifiers") -> DataFrame:
    """Adds ``identifier``, the md5 over all identifier values in order."""
    return df.withColumn("identifier", F.md5(F.array_join(
        F.transform(F.col(ids_col), lambda i: i["value"]), "")))


def route_identifiers(df: DataFrame, ids_col: str = "identifiers") -> DataFrame:
    """Adds uuid, asin and isbn; an identifier named bookid is only ever the uuid, the last one wins."""
    ids = F.col(ids_col)

    def is_book(i: Column) -> Column:
        return F.coalesce(i["id"] == BOOK_ID, F.lit(False))

    def by_scheme(scheme: str) -> Column:
        found = last_match(ids, lambda i: ~is_book(i) & F.coalesce(i["scheme"] == scheme, F.lit(False)))
        return F.coalesce(found["value"], F.lit(""))

    uuid = F.regexp_replace(last_match(ids, is_book)["value"], f"^{UUID_PREFIX}", "")
    return df.withColumn("uuid", F.coalesce(uuid, F.lit(""))).withColumn(
        "asin", by_scheme("ASIN")).withColumn("isbn", by_scheme("ISBN"))


def pivot_meta(df: DataFrame, metas_col: str = "metas") -> DataFrame:
    """Adds series and series_index from the last meta of each name."""
    def named(name: str) -> Column:
        return F.coalesce(
            last_match(F.col(metas_col), lambda m: m["name"] == name)["content"], F.lit(""))

    return df.withColumn("series", named(SERIES)).withColumn("series_index", named(SERIES_INDEX))


def select_cover(df: DataFrame, items_col: str = "items") -> DataFrame:
    """Adds cover_url, the last item marked as cover, with its storage key and bucket."""
    href = last_match(F.col(items_col), lambda i: F.coalesce(i["id"] == COVER_MARK, F.lit(False))
                      | F.coalesce(i["properties"] == COVER_MARK, F.lit(False)))["href"]
    return (
        df.withColumn("cover_url", F.coalesce(href, F.lit("")))
        .withColumn("cover_key", F.concat("identifier", F.translate("cover_url", "/", "-")))
        .withColumn("bucket", F.substring("identifier", 1, 1)))


def book_title(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Adds ``title``: the package's first title, else the file name without extension.

    ``legacy`` uses the package's title only where the package names an author.
    """
    has_title = F.size("creators" if legacy else "titles") > 0
    return df.withColumn("title", F.when(has_title, F.get("titles", F.lit(0))).otherwise(
        file_stem(F.col("path"))))


def book_metadata(packages: DataFrame, legacy: bool = False) -> DataFrame:
    """Catalogue rows from packages(path, size, ctime, opf_xml, cover_bytes, error)."""
    return catalogue_rows(unpack_packages(packages), legacy)


def catalogue_rows(unpacked: DataFrame, legacy: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Catalogue rows from unpacked packages, with the columns to ``keep``."""
    df = select_cover(pivot_meta(route_identifiers(content_identifier(unpacked))))
    df = book_title(df, legacy)
    return df.select(
        "path", "size", "ctime", F.col("ctime").alias("utime"), "title",
        first_or_empty(F.col("languages")).alias("language"), "cover_url", "uuid", "isbn", "asin",
        "identifier", first_or_empty(F.col("creators")).alias("author"),
        first_or_empty(F.col("publishers")).alias("publisher"),
        first_or_empty(F.col("descriptions")).alias("description"), F.col("subjects").alias("tags"),
        "series", "series_index",
        F.coalesce(F.get("dates", F.lit(0)), F.lit(DEFAULT_PUBLISH_DATE)).alias("publish_date"),
        F.lit(0.0).cast("float").alias("rating"), F.lit(0).cast("bigint").alias("count_visit"),
        F.lit(0).cast("bigint").alias("count_download"), "cover_key", "bucket", *keep)


def book_tags(books: DataFrame, key: str = "identifier") -> DataFrame:
    return books.select(key, F.explode("tags").alias("tag"))


def covers_of(packages: DataFrame, path: str | None = None) -> DataFrame:
    """Covers(bucket, key, size, last_modified, data) of the packages that have one.

    Copies of a book share a key; the newest file counts. What covers need of the books (path, ctime, bucket,
    cover_key, cover_url, cover_bytes) is written to ``path``, a folder of its own, so that each document is
    parsed once, however often these rows are read.
    """
    spark = packages.sparkSession
    path = path or shared_folder(spark, "cover-books")
    books = select_cover(content_identifier(unpack_packages(packages))).select(
        "path", "ctime", "bucket", "cover_key", "cover_url", "cover_bytes")
    books.write.mode("overwrite").parquet(path)
    return newest_covers(spark.read.schema(books.schema).parquet(path))


def newest_covers(books: DataFrame) -> DataFrame:
    """Covers of books(bucket, cover_key, cover_url, ctime, path, cover_bytes), one per key.

    The newest file of each key is found without the images; only its image moves. Paths are those of a
    listing, each once.
    """
    found = books.filter((F.col("cover_url") != "") & F.col("cover_bytes").isNotNull())
    newest = found.groupBy(F.col("bucket").alias("_bucket"), F.col("cover_key").alias("_key")).agg(
        F.max(F.struct("ctime", "path")).alias("_newest"))
    here = (F.col("bucket") == F.col("_bucket")) & (F.col("cover_key") == F.col("_key")) & F.struct(
        "ctime", "path").eqNullSafe(F.col("_newest"))
    return found.join(newest, here, "left_semi").select(
        "bucket", F.col("cover_key").alias("key"), F.octet_length("cover_bytes").cast("bigint").alias("size"),
        F.col("ctime").alias("last_modified"), F.col("cover_bytes").alias("data"))


def insert_new(
    existing: DataFrame, incoming: DataFrame, key: str = "identifier",
    order: Sequence[str] = ("ctime",),
) -> DataFrame:
    """Existing rows plus the incoming ones whose key is new; the first by ``order`` wins.

    Copies are reduced before the shuffle, so a key with very many copies moves few rows.
    """
    return existing.unionByName(new_rows(existing, incoming, key, order))


def new_rows(
    existing: DataFrame, incoming: DataFrame, key: str = "identifier",
    order: Sequence[str] = ("ctime",),
) -> DataFrame:
    """The incoming rows that ``insert_new`` adds.

    The least first order of each key is found on two narrow columns; only rows that have it, and whose
    key is new, are compared whole.
    """
    columns = [c for c in incoming.columns if c != key]
    least = incoming.groupBy(F.col(key).alias("_key")).agg(F.min(order[0]).alias("_least"))
    least = least.join(existing.select(F.col(key).alias("_key")), "_key", "left_anti")
    incoming = incoming.join(least, F.col(key).eqNullSafe(F.col("_key")) & F.col(order[0]).eqNullSafe(
        F.col("_least")), "left_semi")
    first = incoming.groupBy(key).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("row")).select(key, "row.*")
    return first.select(*incoming.columns)


def unescaped(text: Column) -> Column:
    """Text with the common named entities replaced, the ampersand last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def markup_metadata(pages: DataFrame) -> DataFrame:
    """Title, language and counts of links and headings from page markup."""
    html = F.col("html")

    def found(pattern: str, group: int = 1) -> Column:
        return F.coalesce(F.regexp_extract(html, pattern, group), F.lit(""))

    # in double quotes, in single ones, or bare
    lang = r"""(?i)<html\s(?:[^>]*?\s)?lang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return pages.select(
        "page_id", "url", unescaped(found("(?is)<title[^>]*>([^<]*)</title>")).alias("title"),
        F.concat(*[found(lang, group) for group in (1, 2, 3)]).alias("language"),
        F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")).cast("bigint").alias("links"),
        F.regexp_count(html, F.lit(r"(?i)<h[1-6][\s>]")).cast("bigint").alias("headings"))
