"""Nearest neighbours against comparing everything."""

import numpy as np
import pytest

from lectern.llm import neighbours
from lectern.llm.queries import QUERIES


def brute_force(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted(
                (-float(neighbours.cosines(v, w[None, :])[0]), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    hits = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items())
    return hits / sum(map(len, want.values()))


def test_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select(
        "vec_id", "embedding").collect()]
    want = brute_force(rows, 5, 50)
    got = as_lists(QUERIES["op4_neighbours"].run(spark, data))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert all(len(found) == 5 for found in got.values())
    exact = {i: dict(brute) for i, brute in brute_force(rows, len(rows), 50).items()}
    assert all(exact[i][j] == s for i, found in got.items() for j, s in found)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_many_cells_and_blocks(spark, monkeypatch, spread, many_partitions):
    """Clusters, with a third of the rows at one place."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((12, 24))
    vectors = centers[rng.integers(0, 12, 1200)] + spread * rng.standard_normal((1200, 24))
    vectors[::3] = vectors[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got, want = as_lists(neighbours.nearest(df, every=10)), brute_force(rows, 5, 10)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    assert all(len(found) == 5 for found in got.values())
    # among equal vectors the smaller ids come first
    for i in range(0, 1200, 30):
        assert got[i] == want[i]


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]),
            (50, [-1.0, 0.0]), (100, [0.0, 0.0]), (0, [0.0, 3.0])]
    df = spark.createDataFrame(
        [(*r, 1, 0.5) for r in rows],
        "vec_id bigint, embedding array<double>, rank int, score double").repartition(3)
    got = as_lists(neighbours.nearest(df))
    assert set(got) == {0, 50}
    assert [j for j, _ in got[50]] == [0, 1, 0, 9] and got[50][-1][1] == -1.0
    assert 0 not in {j for j, _ in got[0]}
    assert neighbours.nearest(df.limit(0)).collect() == []


def test_every_query_gets_its_rows(spark):
    """All rows as queries, far fewer cells and a sample that is the table, then one that is not."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 12)))]
    for size in (300, 7, 4):
        df = spark.createDataFrame(rows[:size], "vec_id bigint, embedding array<double>")
        got = as_lists(neighbours.nearest(df, every=1))
        assert {len(found) for found in got.values()} == {min(5, size - 1)} and len(got) == size


def test_chi_square():
    assert abs(neighbours.chi_square(7.344, 8) - 0.5) < 1e-4
    assert abs(neighbours.chi_square_limit(0.95, 8) - 15.507) < 1e-3
