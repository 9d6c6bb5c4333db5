"""Streaming deduplication against plain grouping by full texts, and against SQL."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from compare import connect, differences  # noqa: E402

from lectern.llm import dedup  # noqa: E402
from lectern.llm.queries import QUERIES  # noqa: E402

HARD = [(1, "Same Text"), (2, "same tEXT"), (3, "same text "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "SAME TEXT"),
        (None, "alone"), (8, "x" * 300_000), (9, "X" * 300_000), (9, "again"), (9, "again"), (9, "AGAIN"), (10, "İ"), (11, "i̇")]


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(normal(text), []).append(doc)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, keep[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t)).hexdigest())
                   for d, t in rows), key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({normal(t) for _, t in rows})


def stored_table(spark, rows, path, files, mode="overwrite"):
    spark.createDataFrame([(*r, "f", 1, b"k") for r in rows],
                          "doc_id bigint, text string, file string, n int, key binary").repartition(files).write.mode(
        mode).parquet(path)


def test_query_against_sql(spark, data):
    query = QUERIES["op13_dedup"]
    assert differences(query.run(spark, data), connect(data), query.sql) is None


def test_hard_rows_in_many_batches(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = HARD + [(100 + i, "hot COPY" if i % 2 else "Hot copy") for i in range(60)]
    stored_table(spark, rows, path, 5)
    check(dedup.table_duplicates(spark, path, files=2), rows)


@pytest.mark.parametrize("key_bytes", [0, 1])
def test_texts_that_share_a_digest(spark, tmp_path, key_bytes):
    """Keys of no and of one byte: full bytes decide."""
    path = str(tmp_path / "docs")
    rows = HARD + [(100 + i, f"text {i % 300}") for i in range(600)]
    stored_table(spark, rows, path, 3)
    check(dedup.exact_duplicates(
        dedup.table_stream(spark, path, 1), dedup.located(spark.read.parquet(path)), key_bytes=key_bytes), rows)


def test_state_goes_on_from_run_to_run(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    first = [(i, f"text {i % 7}") for i in range(20)]
    more = [(i, f"TEXT {i % 9}") for i in range(20, 40)] + [(3, None)]
    stored_table(spark, first, path, 2)
    for rows in (first, first + more):
        if rows is not first:
            stored_table(spark, more, path, 2, "append")
        check(dedup.exact_duplicates(
            dedup.table_stream(spark, path), dedup.located(spark.read.parquet(path)), state), rows)
    # nothing new: nothing changes
    check(dedup.exact_duplicates(
        dedup.table_stream(spark, path), dedup.located(spark.read.parquet(path)), state), first + more)


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    stored_table(spark, [], path, 1)
    assert dedup.table_duplicates(spark, path).collect() == []
