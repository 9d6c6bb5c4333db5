"""A Merkle manifest of documents: a tree for each source, and a tree over the sources.

Within a source leaves are ranked by doc_id. The rank in digits of base 3 tells a leaf's place in its
runs: level by level the lowest digit is grouped away, the nodes of a run become the children of a struct
that carries their digest, up to blocks of 3^6 leaves. The digests of blocks are rolled up in the same
way, until one is left for each source. On the way back every block meets the proof of its own node in
one more grouping, and a transform over the nested structs with an explode gives a proof to each node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

BRANCH = 3
# Levels of a block, which thus has at most 729 leaves.
LEVELS = 6
TAMPERED = 2
STEPS = "array<struct<left:string,right:string>>"


def field(column: Column, text: Column | None = None) -> Column:
    """A value with its length in UTF-8 bytes before it; null: a dash."""
    text = column.cast("string") if text is None else text
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The digest of a document (doc_id, source, lang, n_chars) with this text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, other): each document's digest, and that of its tampered form where it has one.

    ``tree`` names the source: empty for null, else the source behind a sign, so it sorts null first.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"),
                       F.col("n_chars").cast("bigint"), F.col("text").cast("string"))
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.contains(
        "text", F.lit("\n"))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", leaf(F.col("text")).alias("digest"),
        F.when(changed, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("other"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows (tree, ...) with their ``rank`` by ``order`` in their tree and the ``total`` of the tree.

    Rows are dealt by ranges of (tree, order), so a large tree spreads over tasks, and numbered in each
    task; a small table with a row per task and tree holds the numbers to start from.
    """
    placed = written(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn(
        "at", F.monotonically_increasing_id()), "merkle-ranked").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("n").over(tree).alias("total"))
    return placed.join(runs, ["tree", "part"]).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "total")


def nested_blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, total, digest, kids): the nodes (tree, rank, total, digest, item) rolled up in blocks.

    Rows move once, by (tree, block); all groupings after that stay in place. A level at which the whole
    tree is one node already adds no digest.
    """
    digits = [F.floor(F.col("rank") / BRANCH ** k).cast("bigint") % BRANCH for k in range(LEVELS)]
    block = F.floor(F.col("rank") / BRANCH ** LEVELS).cast("bigint")
    rows = nodes.select(
        "tree", block.alias("block"), "total", *[d.cast("tinyint").alias(f"d{k}") for k, d in enumerate(digits)],
        "digest", "item").repartition("tree", "block")
    inner = "item"
    for k in range(LEVELS):
        rows = rows.groupBy("tree", "block", "total", *[f"d{j}" for j in range(k + 1, LEVELS)]).agg(
            F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("place"), "digest", inner))).alias("kids"))
        several = F.col("total") > BRANCH ** k
        rows = rows.withColumn("digest", F.when(several, F.sha2(F.array_join("kids.digest", ""), 256)).otherwise(
            F.col("kids")[0]["digest"]))
        inner = "kids"
    return rows


def proofs(kids: Column, total: Column, path: Column, level: int) -> Column:
    """(item, digest, path) of all nodes at the bottom of a block: the siblings on each level above them."""
    def each(kid: Column, i: Column) -> Column:
        beside = kids["digest"]
        step = F.struct(F.array_join(F.slice(beside, F.lit(1), i), "").alias("left"),
                        F.array_join(F.slice(beside, i + 2, F.lit(BRANCH)), "").alias("right"))
        here = F.concat(F.when(total > BRANCH ** level, F.array(step)).otherwise(F.array().cast(STEPS)), path)
        if level == 0:
            return F.array(F.struct(kid["item"].alias("item"), kid["digest"].alias("digest"), here.alias("path")))
        return proofs(kid["kids"], total, here, level - 1)

    return F.flatten(F.transform(kids, each))


def met(rows: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and the one row of ``above`` with their keys, both unique, brought together by a grouping."""
    own = [c for c in rows.columns if c not in keys]
    more = [c for c in above.columns if c not in keys]
    kinds = {x.name: x.dataType for x in [*rows.schema, *above.schema]}
    both = rows.select(*keys, *own, *[F.lit(None).cast(kinds[c]).alias(c) for c in more]).unionByName(
        above.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in own], *more))
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in own + more])


def roll_up(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tree, item, digest, path, and what ``finish`` adds) of all nodes (tree, rank, total, digest, item).

    Blocks are rolled up as nodes of their own until every tree is one node; ``finish`` gives these
    (tree, item, digest) their path above.
    """
    if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
        return finish(nodes.select("tree", "item", "digest"))
    blocks = written(nested_blocks(nodes), "merkle-blocks")
    above = roll_up(blocks.select(
        "tree", F.col("block").alias("rank"), F.ceil(F.col("total") / BRANCH ** LEVELS).cast("bigint").alias("total"),
        "digest", F.col("block").alias("item")), finish).drop("digest").withColumnRenamed("item", "block")
    found = met(blocks.drop("digest"), above, ["tree", "block"])
    more = [c for c in above.columns if c not in ("tree", "block", "path")]
    return found.select("tree", *more, F.inline(proofs(F.col("kids"), F.col("total"), F.col("path"), LEVELS - 1)))


def over_sources(subroots: DataFrame) -> DataFrame:
    """The subroots (tree, item, digest) with their path to the root over all of them."""
    def finish(top: DataFrame) -> DataFrame:
        return top.withColumn("path", F.array().cast(STEPS)).withColumn("root", F.col("digest"))

    subroots = written(subroots, "merkle-subroots")
    order = ranked(subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("item"), F.col("digest")), ["item"])
    paths = roll_up(order, finish).select(F.col("item").alias("tree"), "path", "root")
    return met(subroots.withColumn("subroot", F.col("digest")), paths, ["tree"])


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    Of (doc_id, source, lang, n_chars, text), each of which may be null. Every row is a leaf; null ids
    come first in their source, rows with one id go by their digests, and equal rows have equal leaves
    and proofs of their own. A null id is not tampered. Texts of any length are hashed whole; other
    columns are not read; one row is its own root with the proof of no siblings; no documents: no rows.
    """
    nodes = ranked(written(leaves(docs), "merkle-leaves"), ["doc_id", "digest"]).select(
        "tree", "rank", "total", "digest", F.struct("doc_id", "other").alias("item"))
    found = roll_up(nodes, over_sources)
    folded = F.aggregate(
        "path", F.coalesce(F.col("item.other"), F.col("digest")),
        lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return found.select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
