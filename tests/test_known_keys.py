"""The filtered insert against the plain one, and what it spares."""

import random

import numpy as np
import pytest

from lectern.operators import ingest, known_keys as kk

KINDS = "identifier string, id bigint, v string"


@pytest.fixture
def tables(spark):
    draw = random.Random(3)
    existing = [(f"k{i}", i, "old") for i in range(5000)]
    incoming = [(f"k{draw.randrange(5000) if i % 100 == 0 else 10_000 + draw.randrange(4000)}", i, f"v{i}")
                for i in range(3000)] + [(None, 1, "a"), (None, 2, "b"), ("hot", 9, "x")] + [("hot", i, "y") for i in range(10, 900)]
    return spark.createDataFrame(existing, KINDS), spark.createDataFrame(incoming, KINDS).repartition(5)


@pytest.mark.parametrize("parts,bits", [(1, 1 << 12), (4, 1 << 16), (64, 1 << 16)])
def test_same_rows_as_the_plain_insert(tables, tmp_path, parts, bits):
    """Also where the filter is far too small and nearly every key is a false alarm."""
    existing, incoming = tables
    path = str(tmp_path / "keys")
    for batch, rows in enumerate((existing.filter("id < 4000"), existing.filter("id >= 4000"))):
        kk.add_keys(rows, path, batch, parts=parts, bits=bits)
    got = kk.insert_new_filtered(existing, incoming, path, order=["id"]).collect()
    assert sorted(got, key=repr) == sorted(ingest.insert_new(existing, incoming, order=["id"]).collect(), key=repr)


def test_few_rows_meet_where_few_are_known(tables, tmp_path):
    """A hundredth of the incoming rows is known: over nine tenths of the table stay where they are."""
    existing, incoming = tables
    path = str(tmp_path / "keys")
    kk.add_keys(existing, path, 0, parts=4, bits=1 << 16)
    maybe = kk.maybe_known(incoming.select("identifier").distinct(), path)
    known = {r.identifier for r in incoming.join(existing, "identifier", "left_semi").collect()}
    found = {r.identifier for r in maybe.collect()}
    assert known <= found and len(found) <= len(known) + 0.03 * 3000
    assert kk.may_meet(existing.select("identifier"), maybe).count() <= 0.1 * 5000
    plan = kk.may_meet(existing, maybe)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_batch_that_runs_again_and_an_empty_one(spark, tables, tmp_path):
    existing, incoming = tables
    path = str(tmp_path / "keys")
    kk.add_keys(existing.limit(0), path, 0)
    assert kk.maybe_known(incoming.select("identifier"), path).collect() == []
    assert sorted(kk.new_rows_filtered(existing.limit(0), incoming, path, order=["id"]).collect(), key=repr) == sorted(
        ingest.new_rows(existing.limit(0), incoming, order=["id"]).collect(), key=repr)
    for _ in range(2):
        kk.add_keys(existing, path, 0, parts=2, bits=1 << 16)
    assert spark.read.parquet(path).count() == 2


def test_bits_of_a_key(spark):
    hashed = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 2000)
    bitmap = kk.Bitmap(1 << 15)
    bitmap.add(hashed[:1000])
    assert bitmap.may_hold(hashed[:1000]).all() and bitmap.may_hold(hashed[1000:]).mean() < 0.03
    assert kk.Bitmap(1 << 15, bitmap.bytes.tobytes()).may_hold(hashed[:1000]).all()
