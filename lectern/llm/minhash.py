"""Document fingerprints by one-permutation MinHash, in built-in functions only.

Every shingle of five words is hashed once. The first bits of the hash name a bin, the rest is a value,
and a bin keeps its smallest value. An empty bin takes the value of another one: the first that is not
empty on a walk of its own, drawn at random once for all documents (optimal densification). Of each bin
the eight low-order bits are kept, packed into longs. Two unlike values agree in these bits once in 256
times, which the likeness corrects for.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let, small, written

WORDS = 5
BINS = 256
BIN_BITS = 8
LANE_BITS = 8
LANES = 64 // LANE_BITS
# Probes that are written out; the rare walks beyond them run through the remaining bins.
PROBES = 12
# Documents of a run of neighbouring ids, in the mean, and quantiles of the ids that runs are cut from.
RUN_ROWS = 2000
BUCKETS = 512
POSITIVE = (1 << 63) - 1
LOW_BITS = 0x0101010101010101


def shingle_hashes(text: Column) -> Column:
    """Hashes, 63 bits, of the runs of five words; of the whole text if it has fewer; none if none."""
    words = F.array_remove(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), "")

    def shingles(hashed: Column) -> Column:
        run = F.transform(F.slice(hashed, F.lit(1), F.size(hashed) - (WORDS - 1)), lambda h, i: F.xxhash64(
            h, *[hashed[i + k] for k in range(1, WORDS)]).bitwiseAND(F.lit(POSITIVE)))
        whole = F.array(F.xxhash64(hashed).bitwiseAND(F.lit(POSITIVE)))
        return F.when(F.size(hashed) >= WORDS, run).when(F.size(hashed) > 0, whole).otherwise(
            F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _bin(value: Column) -> Column:
    return F.shiftright(value, 63 - BIN_BITS)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of every bin in the order of bins; null for empty ones."""
    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(ordered, i - 1))))

    def spread(found: Column) -> Column:
        def gap(x: Column, j: Column) -> Column:
            before = F.when(j == 0, 0).otherwise(_bin(F.get(found, j - 1)) + 1)
            return F.concat(F.array_repeat(F.lit(None).cast("bigint"), (_bin(x) - before).cast("int")),
                            F.array(x))

        rest = BINS - 1 - F.coalesce(_bin(F.try_element_at(found, F.lit(-1))), F.lit(-1))
        return F.concat(F.flatten(F.transform(found, gap)),
                        F.array_repeat(F.lit(None).cast("bigint"), rest.cast("int")))

    return let(let(F.sort_array(hashes), firsts), spread)


def densified(minima: Column) -> Column:
    """Every empty bin filled from the first full one on its walk, which visits every bin once."""
    draw = random.Random(11)
    starts = F.array(*[F.lit(draw.randrange(BINS)) for _ in range(BINS)])
    strides = F.array(*[F.lit(draw.randrange(1, BINS, 2)) for _ in range(BINS)])

    def fill(bins: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            def at(t) -> Column:
                return F.get(bins, (F.get(starts, i) + F.get(strides, i) * t).bitwiseAND(F.lit(BINS - 1)))

            walk = F.aggregate(F.sequence(F.lit(PROBES), F.lit(BINS - 1)), F.lit(None).cast("bigint"),
                               lambda found, t: F.coalesce(found, at(t)))
            return F.coalesce(x, *[at(t) for t in range(PROBES)], walk, F.lit(0))

        return F.transform(bins, value)

    return let(minima, fill)


def fingerprint(text: Column) -> Column:
    """The low-order bits of the filled bins, packed: an array of longs. No words: all zero."""
    def pack(bins: Column) -> Column:
        def lanes(j: Column) -> Column:
            out = None
            for k in range(LANES):
                lane = F.shiftleft(F.get(bins, j * LANES + k).bitwiseAND(F.lit((1 << LANE_BITS) - 1)),
                                   64 - LANE_BITS * (k + 1))
                out = lane if out is None else out.bitwiseOR(lane)
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lanes)

    return let(densified(bin_minima(shingle_hashes(text))), pack)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, of two packed fingerprints."""
    def unlike(x: Column, y: Column) -> Column:
        def folded(z: Column) -> Column:
            # each byte's bits are gathered in its lowest one
            z = z.bitwiseOR(F.shiftrightunsigned(z, 4))
            z = let(z, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2)))
            return let(z, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)))

        return F.bit_count(let(x.bitwiseXOR(y), folded).bitwiseAND(F.lit(LOW_BITS)))

    wrong = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda total, n: total + n)
    by_chance = 2.0 ** -LANE_BITS
    return F.greatest(F.lit(0.0), ((1 - wrong / BINS) - by_chance) / (1 - by_chance))


def run_of(ids: DataFrame) -> Column:
    """The run of each row (doc_id): neighbouring ids, about ``RUN_ROWS`` rows in each; null ids: -1.

    Quantiles of the ids cut them into buckets of equally many rows, whatever gaps lie between, and each
    bucket is cut evenly into runs. Both steps only ever rise with the id.
    """
    found, rows = ids.agg(F.percentile_approx(
        "doc_id", [k / BUCKETS for k in range(BUCKETS + 1)], 100 * BUCKETS), F.count("doc_id")).first()
    bounds = sorted(set(found or []))
    if len(bounds) < 2:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("bigint")
    share = rows / (len(bounds) - 1) / RUN_ROWS
    widths = [max(1.0, (high - low) / max(1.0, share)) for low, high in zip(bounds, bounds[1:])]
    lows = F.array(*[F.lit(x) for x in bounds[:-1]])

    def place(values: list[int]) -> Column:
        """How many of the rising values the id reaches: first among every 32nd, then among 32."""
        coarse = F.size(F.filter(F.array(*[F.lit(x) for x in values[::32]]), lambda x: x <= F.col("doc_id")))
        return F.when(coarse == 0, 0).otherwise((coarse - 1) * 32 + F.size(F.filter(F.slice(
            F.array(*[F.lit(x) for x in values]), F.greatest((coarse - 1) * 32 + 1, F.lit(1)), F.lit(32)),
            lambda x: x <= F.col("doc_id"))))

    # as doubles, since the difference of two longs need not be one
    bucket = F.greatest(place(bounds[:-1]) - 1, F.lit(0))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(let(bucket, lambda b: b.cast("bigint") * (1 << 40) + F.least(
        F.greatest(F.floor((F.col("doc_id").cast("double") - F.get(lows, b).cast("double")) / F.get(
            F.array(*[F.lit(x) for x in widths]), b)), F.lit(0)), F.lit((1 << 40) - 1))))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, packed, next_text, next_packed): each document beside the next smaller doc_id.

    After the smallest comes the largest. Rows are dealt by runs of neighbouring ids and follow each other
    inside; the first of a run finds the last one of the run before it through a small table with one row
    per run. Rows of one id go by their text. Documents with a null id follow each other in a ring of
    their own.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = ids.withColumn("run", run_of(ids))
    tops = written(placed.filter(F.col("run") >= 0).groupBy("run").agg(F.max("doc_id").alias("top")), "tops")
    high = tops.agg(F.max("top")).first()[0]
    # the last run before each one: among those of its bucket, else of the buckets before
    bucket = F.shiftright("run", 40)
    ends = tops.groupBy(bucket.alias("bucket")).agg(F.max("top").alias("end"))
    ends = ends.select("bucket", F.lag("end").over(Window.orderBy("bucket")).alias("end"))
    before = F.lag("top").over(Window.partitionBy("bucket").orderBy("run"))
    tops = written(tops.withColumn("bucket", bucket).withColumn("before", before).join(F.broadcast(ends), "bucket").select(
        "run", F.coalesce("before", "end", F.lit(high)).alias("doc_id")), "runs")
    last = ids.join(small(tops, tops.count()), "doc_id").groupBy("run").agg(F.max("text").alias("last"))
    nobody = placed.filter(F.col("run") == -1).groupBy("run").agg(F.max("text").alias("last"))
    last = last.unionByName(nobody).withColumn("last_packed", fingerprint(F.col("last")))
    packed = placed.withColumn("packed", fingerprint(F.col("text")))
    order = Window.partitionBy("run").orderBy("doc_id", "text")
    follows = packed.select("*", F.lag("text").over(order).alias("t"), F.lag("packed").over(order).alias("p"))
    return follows.join(last, "run").select(
        "doc_id", "text", "packed", F.coalesce("t", "last").alias("next_text"),
        F.coalesce("p", "last_packed").alias("next_packed"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (doc_id, text) and of its edited text.

    The edit replaces the last third of the code points, rounded down, by the first as many of the next
    document. (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next):
    the last two are the likeness to the edited text and to the next document. Null texts are empty;
    empty ones are alike, and unlike all others; texts of any length are read whole; ids may be any longs,
    clustered or far apart; repeated rows are fingerprinted each; other columns are not read; no
    documents: no rows.
    """
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs).select(
        "doc_id", size.cast("bigint").alias("n_chars"), "packed", "next_packed", edited.alias("edited"))
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_packed"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("packed")).alias("fingerprint"),
        as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
