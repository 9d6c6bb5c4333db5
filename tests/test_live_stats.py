"""Statistics from sketches of batches."""

import pytest

from lectern.operators import catalog, live_stats as ls


@pytest.fixture
def books(spark):
    return spark.range(6000).selectExpr(
        "id", "IF(id % 50 = 0, NULL, CAST(id % 2500 AS STRING)) AS author", "CAST(id % 7 AS STRING) AS publisher")


def tags(books):
    return books.selectExpr("id AS book_id", "CONCAT('t', id % 900) AS tag")


def test_batches_give_what_one_pass_gives(spark, books, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    ls.add_batch(books, tags(books), whole, 0)
    for _ in range(2):  # a batch that runs again counts once
        for batch, low in enumerate((0, 100, 3000)):
            some = books.filter(f"id >= {low} AND id < {(100, 3000, 6000)[batch]}")
            ls.add_batch(some, tags(some), parts, batch)
    got, want = ls.live_stats(spark, parts).first(), ls.live_stats(spark, whole).first()
    assert got == want
    # the sketches themselves, bit for bit
    assert [bytes(x) for x in ls.united(spark, parts).first()[1:]] == [bytes(x) for x in ls.united(spark, whole).first()[1:]]


def test_estimates_are_near(spark, books, tmp_path):
    path = str(tmp_path / "stats")
    ls.add_batch(books, tags(books), path, 0)
    ls.add_batch(books, tags(books), path, 1)  # the same books again
    got, want = ls.live_stats(spark, path).first(), catalog.book_stats(books, tags(books)).first()
    assert got.total == 2 * want.total
    for name in ("author", "publisher", "tag"):
        assert abs(got[name] - want[name]) <= max(1, 3 * 1.04 / 64 * want[name])


def test_no_books(spark, books, tmp_path):
    path = str(tmp_path / "stats")
    ls.add_batch(books.limit(0), None, path, 0)
    assert tuple(ls.live_stats(spark, path).first()) == (0, 0, 0, 0)
