"""The trigram index against the scan, for any question."""

import random

import numpy as np
import pytest

from lectern.operators import book_index as bi
from lectern.operators.catalog import search_books

WORDS = ["Ring", "ring", "RINGS", "a_b%c", "Müller", "日本語の本", "e\\f", "x", "", "\U0001f600 smile\U0001f600"]


@pytest.fixture(scope="module")
def books(spark):
    draw = random.Random(1)
    rows = [(i * 7 - 300 if i % 3 else i << 40, " ".join(draw.choices(WORDS, k=draw.randint(1, 4))),
             draw.choice([None, "", "Ann Ring", "bo", "Müller, Eva"]), draw.choice("ab")) for i in range(400)]
    rows += [(900_001, None, None, "a"), (900_002, "common title", "Z", "b")]
    rows += [(1_000_000 + i, "a common title", "C. D.", "a") for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, title string, author string, category string").cache()


@pytest.fixture(scope="module")
def index(spark, books, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    bi.add_books(books, path)
    return path


@pytest.mark.parametrize("q", ["RING", "Ring ri", "üll", "の本 ", "mon tit", "b%c", "e\\f", "\U0001f600 sm", "not there", "in", ""])
@pytest.mark.parametrize("ci", [True, False])
def test_same_rows_as_the_scan(books, index, q, ci):
    args = {"q": q, "ci": ci, "page_size": 500}
    assert bi.search_indexed(books, index, **args).collect() == search_books(books, **args).collect()


@pytest.mark.parametrize("more", [{"category": "b"}, {"author": "Ann Ring"}, {"page_num": 1, "after_id": 5}])
def test_filters_and_pages(books, index, more):
    args = {"q": "ring", "page_size": 30} | more
    assert bi.search_indexed(books, index, **args).collect() == search_books(books, **args).collect()


@pytest.mark.parametrize("q", ["r_ng", "%ring%mül", "ri%gs", "_%_", "com%title", "日%語の", "%"])
def test_wildcards(books, index, q):
    got = bi.search_indexed(books, index, q=q, wildcards=True, page_size=500).collect()
    assert got == search_books(books, q=q, wildcards=True, page_size=500).collect()


def test_long_lists_lie_in_blocks(spark, books, tmp_path, monkeypatch):
    monkeypatch.setattr(bi, "BLOCK", 16)
    path = str(tmp_path / "index")
    bi.add_books(books, path)
    rows = bi.posting_lists(spark, path, ["com"]).collect()
    assert max(r.n for r in rows) <= 16 and sum(r.n for r in rows) == 301
    got = bi.search_indexed(books, path, q="common title", page_size=500).collect()
    assert got == search_books(books, q="common title", page_size=500).collect() and len(got) == 301


def test_only_the_folders_of_the_trigrams_are_read(spark, index):
    """By the plan's partitions, and by the files of the scan."""
    everything = spark.read.parquet(index).inputFiles()
    lists = bi.posting_lists(spark, index, bi.query_grams("ring"))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(gram, [ing,rin])" in plan
    scan = lists._jdf.queryExecution().executedPlan()
    read = lists.select("folder").distinct().collect()
    assert len(read) <= 2
    assert "folder" in plan and len(everything) > 20
    files = lists.selectExpr("input_file_name() AS f").distinct().count()
    assert files <= 2 and scan is not None


def test_an_update_adds_a_batch(spark, books, tmp_path):
    path = str(tmp_path / "index")
    bi.add_books(books, path, 0)
    before = {f for f in spark.read.parquet(path).inputFiles()}
    changed = spark.createDataFrame(
        [(900_002, "uncommon heading", "Z", "b"), (2_000_000, "new Ring", None, "a")], books.schema)
    now = books.join(changed, "id", "left_anti").filter("id <> 1000000").unionByName(changed)
    for _ in range(2):  # a batch that runs again changes nothing
        bi.add_books(changed, path, 1)
        for q in ("common title", "heading", "new r", "uncommon", "ring"):
            assert bi.search_indexed(now, path, q=q, page_size=900).collect() == search_books(
                now, q=q, page_size=900).collect()
    assert before < {f for f in spark.read.parquet(path).inputFiles()}


def test_gaps_come_back(spark):
    draw = np.random.default_rng(2)
    for ids in ([5], [-(1 << 63), 0, (1 << 63) - 1], [1, 2, 3], [0, 255, 511], [0, 256], [-7, 1 << 33]):
        ids = np.array(ids, np.int64)
        assert bi.unpacked(int(ids[0]), *bi.packed(ids)).tolist() == ids.tolist()
    ids = np.unique(draw.integers(-10**12, 10**12, 5000))
    assert bi.unpacked(int(ids[0]), *bi.packed(ids)).tolist() == ids.tolist()


def test_no_books(spark, books, tmp_path):
    path = str(tmp_path / "index")
    bi.add_books(books.limit(0), path)
    bi.add_books(books.limit(3), path, 1)
    assert bi.search_indexed(books.limit(0), path, q="ring").collect() == []


def test_entries_are_not_shuffled(spark, tmp_path):
    """Of 40,000 books with some 30 trigrams each, in no order and with copies, only blocks move."""
    books = spark.range(40_000, numPartitions=4).selectExpr(
        "id * 7919 % 40000 - 100 AS id", "concat('a common title of book ', id % 10) AS title", "'Ann Author' AS author")
    books = books.unionByName(books.limit(100))
    lists = bi.postings(books)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "HashAggregate" not in plan
    rows = lists.filter("gram = 'com'").collect()
    ids = np.concatenate([bi.unpacked(r.first_id, r.width, bytes(r.gaps)) for r in rows])
    assert sorted(set(ids.tolist())) == list(range(-100, 39_900)) and len(ids) <= 40_100
    assert max(r.n for r in rows) <= bi.BLOCK and len(rows) < 40 and sum(r.n for r in rows) == len(ids)
    bi.add_books(books, str(tmp_path / "index"))
    args = {"q": "ook 7", "page_size": 9000}
    assert bi.search_indexed(books, str(tmp_path / "index"), **args).collect() == search_books(books, **args).collect()
