"""The manifest against a tree built by plain loops, and against SQL."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from compare import connect, differences  # noqa: E402

from lectern.llm import merkle  # noqa: E402
from lectern.llm.queries import QUERIES  # noqa: E402

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """(root, steps of each node: siblings to the left and to the right)."""
    steps, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for j in range(len(run)):
                for i in owners[at + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h(*run))
            up_owners.append([i for o in owners[at:at + 3] for i in o])
        nodes, owners = up, up_owners
    return nodes[0], steps


def plain_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        docs = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[s] = (docs, *plain_tree([plain_leaf(*r) for r in docs]))
    root, above = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, upper in zip(sources, above):
        docs, subroot, steps = trees[s]
        for r, own in zip(docs, steps):
            path, node = own + upper, plain_leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = plain_leaf(*r[:4], r[4].replace("\n", ""))
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], plain_leaf(*r), subroot, root, h(*[x for step in path for x in step]), node, node == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_loops(spark, data, docs_table):
    import duckdb

    rows = duckdb.connect().execute(
        f"SELECT doc_id, source, lang, n_chars, text FROM read_parquet('{data}/documents.parquet')").fetchall()
    got = QUERIES["op12_merkle"].run(spark, data).select(*COLUMNS).collect()
    assert sorted_rows(got) == sorted_rows(plain_manifest(rows))
    assert {r.verified for r in got} == {True, False}


def test_query_against_sql(spark, data):
    query = QUERIES["op12_merkle"]
    assert differences(query.run(spark, data), connect(data), query.sql) is None


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (4, 9, 10), (27, 28, 1, 82)])
def test_trees_of_many_heights(spark, many_partitions, monkeypatch, sizes):
    """Blocks of nine leaves, so that trees have up to two rounds of blocks."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(k * 1000 + i, f"s{k}", "en", i, f"line {i}\nof {k}") for k, n in enumerate(sizes) for i in range(n)]
    got = merkle.manifest(documents(spark, rows[::-1]).repartition(3)).collect()
    assert sorted_rows(got) == sorted_rows(plain_manifest(rows))


def test_hard_rows(spark):
    rows = [(1, None, None, None, None), (2, None, "de", 0, ""), (None, "a", "en", 3, "x\n"), (None, "a", "en", 3, "x\n"),
            (7, "a", "en", 1, "é\n\n日本"), (7, "a", "en", 1, "é\n\n日本"), (7, "a", "fr", 1, "other"), (8, "", None, -5, "\n"),
            (9, "é", "en", 1, "a\nb" * 100_000), (10, "Z", "en", 1, "\n"), (-3, "~", "en", 1, "a\n")]
    rows += [(i, "hot", "en", 1, f"{i}\n") for i in range(100, 160)]
    docs = documents(spark, rows).selectExpr("*", "1 AS tree", "2 AS rank", "'x' AS digest", "3 AS path", "4 AS block")
    got = merkle.manifest(docs.repartition(4)).collect()
    assert sorted_rows(got) == sorted_rows(plain_manifest(rows))
    assert merkle.manifest(docs.limit(0)).collect() == []
