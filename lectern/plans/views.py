"""Domain tables seen in the given tables.

A view joins only what a query asks for: the joins of unused columns would not change any row, but
Spark cannot know that they are one-to-one and would run them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.requests import apply_request_defaults
from lectern.plans.containers import pack
from lectern.session import bound_batches
from lectern.sources.library import FILES_SCHEMA

EPOCH = "TIMESTAMP_NTZ'2020-01-01 00:00:00'"


# Times made from keys stay within this many steps of the epoch, however large the keys are.
SPAN = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as the session shuffles to, for work on a row that costs more than moving it.

    A file is read by as many tasks as it has row groups, and these may be few and large.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def after_epoch(unit: str, key: str) -> Column:
    """A time as many units after the epoch as the key says, modulo ``SPAN``."""
    return F.expr(f"timestampadd({unit}, CAST(pmod({key}, {SPAN}) AS INT), {EPOCH})")


def event_items(
    spark: SparkSession, sf_dir: str, *types: str, events: DataFrame | None = None,
) -> DataFrame:
    """Events of the given types with the item ``k`` they name; ``events`` may be a stream of them."""
    events = table(spark, sf_dir, "events") if events is None else events
    if types:
        events = events.filter(F.col("event_type").isin(*types))
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def books(spark: SparkSession, sf_dir: str, details: bool = False, counts: bool = False) -> DataFrame:
    out = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.col("p_type").alias("category"),
        after_epoch("HOUR", "p_partkey").alias("ctime"),
        F.concat(F.lit("/library/"), "p_type", F.lit("/"), "p_partkey", F.lit(".epub")).alias("path"))
    if details:
        text = table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("id"), "lang", "source", "n_chars")
        out = out.join(text, "id", "left").select(
            *out.columns, F.coalesce("lang", F.lit("")).alias("language"),
            F.coalesce("source", F.lit("")).alias("publisher"),
            F.coalesce("n_chars", F.lit(0)).alias("size"))
    if counts:
        seen = event_items(spark, sf_dir, "view", "purchase").groupBy(F.col("k").alias("id")).agg(
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.count_if(F.col("event_type") == "purchase").alias("sales"))
        out = out.join(seen, "id", "left").select(
            *out.columns, F.coalesce("views", F.lit(0)).alias("count_visit"),
            F.coalesce("sales", F.lit(0)).alias("count_download"))
    return out


def book_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("book_id"), F.explode(F.array("lang", "source")).alias("tag"))


def progress_events(
    spark: SparkSession, sf_dir: str, *types: str, events: DataFrame | None = None,
) -> DataFrame:
    return event_items(spark, sf_dir, *(types or ("view", "click")), events=events).select(
        "event_id", "ts", F.col("k").alias("book_id"), "user_id",
        (F.col("value") / 500).alias("progress"), (F.col("event_id") % 30).alias("progress_index"),
        (F.col("event_id") % 100).alias("para_position"))


def fav_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items(spark, sf_dir, "purchase").select(F.col("k").alias("book_id"), "user_id", "ts")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("user_name"),
        F.concat("c_name", F.lit("@x.org")).alias("email"),
        F.concat(F.lit("555"), "c_nationkey").alias("mobile"),
        F.when(F.col("c_custkey") % 100 == 1, 1).otherwise(2).cast("bigint").alias("role_id"),
        F.md5("c_name").alias("credential"), F.col("c_mktsegment").alias("segment"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.md5(F.col("o_orderkey").cast("string")).alias("api_key"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("Bearer "), F.md5((F.col("event_id") * 2).cast("string")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "signup", F.lit("")).otherwise(key).alias("authorization"),
        (F.col("event_type") == "error").alias("admin_route"))


def scanned_files(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as a scan log: (ts, path, size, ok, error)."""
    failed = F.col("event_type") == "error"
    return (table(spark, sf_dir, "events") if events is None else events).select(
        "event_id", "ts", F.concat(F.lit("/library/"), "event_id", F.lit(".epub")).alias("path"),
        F.floor("value").alias("size"), (~failed).alias("ok"),
        F.when(failed, F.concat(F.lit("bad item "), F.get_json_object("props", "$.k"))).alias("error"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def request_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of the conversations with the defaults filled in; every seventh has none."""
    conv = F.col("conv_id")
    asked = table(spark, sf_dir, "conversations").select("conv_id").distinct().filter(conv % 7 > 0).select(
        "conv_id", ((conv % 10) / 10).alias("temperature"),
        F.when(conv % 3 > 0, 1.0).otherwise(0.0).alias("top_p"), (conv % 4).alias("n"),
        (conv % 2 == 0).alias("stream"),
        F.when(conv % 5 == 0, F.array(F.lit("</s>"), F.lit("USER:"))).alias("stop"),
        (conv % 4 * 100).alias("max_tokens"),
        F.when(conv % 6 > 0, F.concat(F.lit("user-"), conv)).otherwise(F.lit("")).alias("user"))
    return apply_request_defaults(asked)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as response documents, one choice per line of text."""
    lines = F.split("text", "\n", -1)
    choices = F.transform(lines, lambda s, i: F.struct(
        i.alias("index"), F.lit("stop").alias("finish_reason"),
        F.struct(F.lit("assistant").alias("role"), s.alias("content")).alias("message")))
    words = F.size(F.split("text", " ", -1)).cast("bigint")
    usage = F.struct((F.col("turn") * 10).alias("prompt_tokens"), words.alias("completion_tokens"),
                     (F.col("turn") * 10 + words).alias("total_tokens"))
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.to_json(F.struct(
            F.concat("conv_id", F.lit("-"), "turn").alias("id"),
            F.lit("chat.completion").alias("object"), F.col("turn").alias("created"),
            choices.alias("choices"), usage.alias("usage"))).alias("body"))


def frames(spark: SparkSession, sf_dir: str, conversations: DataFrame | None = None) -> DataFrame:
    """Replies as stream frames (request_id, seq, ts, raw).

    Even conversations use NUL frames, odd ones data lines. Every reply has one frame per line of
    text and a closing frame; replies of turn 3 break off with an error (NUL) or a malformed line
    before it. Frames that follow the end must be ignored by readers.
    """
    said = table(spark, sf_dir, "conversations") if conversations is None else conversations
    said = said.filter(F.col("role") == "assistant")
    lines = F.split("text", "\n", -1)
    count = F.size(lines)
    nul = F.col("conv_id") % 2 == 0
    broken = F.col("turn") == 3
    zero = F.lit("\x00")
    usage = F.struct((F.col("turn") * 10).alias("prompt_tokens"), count.alias("completion_tokens"),
                     (F.col("turn") * 10 + count).alias("total_tokens"))

    def worker(text, code, *more):
        return F.concat(F.to_json(F.struct(text.alias("text"), F.lit(code).alias("error_code"), *more)), zero)

    def line(text, *more):
        delta = F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("delta")
        return F.concat(F.lit("data: "), F.to_json(F.struct(
            F.array(F.struct(F.lit(0).alias("index"), *more, delta)).alias("choices"),
            usage.alias("usage"))), F.lit("\n\n"))

    finished = F.lit("stop").alias("finish_reason")
    deltas = F.transform(lines, lambda s: F.when(nul, worker(s, 0)).otherwise(line(s)))
    failure = F.when(nul, worker(F.lit("out of memory"), 50002)).otherwise(F.lit("data: {oops\n\n"))
    closing = F.when(nul, worker(F.col("text"), 0, usage.alias("usage"), finished)).otherwise(
        F.concat(line(F.lit(""), finished), F.lit("data: [DONE]\n\n")))
    raws = F.when(broken, F.concat(deltas, F.array(failure, closing))).otherwise(
        F.concat(deltas, F.array(closing)))
    rows = said.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.posexplode(raws).alias("seq", "raw"))
    return rows.select(
        "request_id", F.col("seq").cast("bigint").alias("seq"),
        F.timestamp_add("SECOND", F.col("seq").cast("int"), after_epoch("MINUTE", "request_id")).alias("ts"),
        "raw")


def cut_frames(spark: SparkSession, sf_dir: str, size: int = 23) -> DataFrame:
    """The frames of each reply as one stream, cut into pieces of ``size`` characters."""
    whole = frames(spark, sf_dir).groupBy("request_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda f: f["raw"]), "").alias("raw"))
    starts = F.sequence(F.lit(1), F.length("raw"), F.lit(size))
    return whole.select("request_id", F.posexplode(F.transform(
        starts, lambda at: F.substring("raw", at, F.lit(size)))).alias("seq", "raw")).withColumn(
        "seq", F.col("seq").cast("bigint"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as package documents (path, size, ctime, opf_xml, cover_bytes, error).

    The text is the description.
    """
    def element(name, value, attributes=""):
        return F.concat(F.lit(f"<dc:{name}{attributes}>"), value, F.lit(f"</dc:{name}>"))

    digest = F.md5(F.col("doc_id").cast("string"))
    lang, source, none = F.col("lang"), F.col("source"), F.lit("")
    # characters that XML does not allow are left out, the three that need it are escaped
    text = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    described = element("description", text)
    opf = F.concat(
        F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata '
              'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">'),
        element("identifier", F.concat(F.lit("urn:uuid:"), digest), ' id="bookid"'),
        F.when(lang == "en", element("identifier", F.concat(F.lit("978"), "doc_id"), ' opf:scheme="ISBN"'))
        .when(lang == "de", element("identifier", F.concat(F.lit("B"), "doc_id"), ' opf:scheme="ASIN"'))
        .when(lang == "fr", element("identifier", F.lit("second"), ' id="bookid" opf:scheme="ISBN"'))
        .otherwise(none),
        F.when(source == "src1", none).otherwise(element("title", F.concat(F.lit("Title "), "doc_id"))),
        F.when(source == "src2", none).otherwise(element("creator", F.concat(F.lit("Author "), source))),
        element("subject", lang), element("subject", source), element("language", lang),
        element("publisher", source), described,
        F.when(source == "src3", none).otherwise(element("date", F.concat(F.lit("2001-"), lang))),
        F.lit('<meta name="calibre:series" content="first"/><meta name="calibre:series" content="'),
        source, F.lit('"/><meta name="calibre:series_index" content="'), "doc_id",
        F.lit('"/></metadata><manifest><item id="cover-image" href="old.png"/>'
              '<item id="c" properties="cover-image" href="img/'), lang,
        F.lit('.png"/><item id="text" href="text.xhtml"/></manifest></package>'))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select(
        F.concat(F.lit("/library/"), source, F.lit("/book."), "doc_id", F.lit(".epub")).alias("path"),
        F.col("n_chars").alias("size"),
        after_epoch("HOUR", "doc_id").cast("timestamp").alias("ctime"),
        opf.alias("opf_xml"), F.encode(digest, "UTF-8").alias("cover_bytes"),
        F.lit(None).cast("string").alias("error"))


def epub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages inside container files (path, modificationTime, length, content).

    Those of one source are cut off and cannot be opened.
    """
    bound_batches(spark)
    return packages(spark, sf_dir).select(
        "path", "ctime", "opf_xml", "cover_bytes", F.contains("path", F.lit("/src7/")).alias("broken")).mapInArrow(
            pack, FILES_SCHEMA)


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("voice_"), "s_suppkey").alias("audio_id"),
        F.col("s_nationkey").cast("int").alias("gender"), F.lit(1).alias("default_type"),
        F.col("s_name").alias("display_name"), F.lit("").alias("description"),
        F.lit("").alias("avatar_url"), F.concat("s_name", F.lit(".wav")).alias("path"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as speech requests; English ones leave the language to the default.

    Their texts hold a noncharacter, which is text like any other.
    """
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit("th"), F.lit("\ufdd0")).alias("text"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("lang"),
        F.concat(F.lit("voice_"), F.col("doc_id") % 200).alias("audio_id"))
