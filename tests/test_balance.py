"""Endpoints by rendezvous hashing, and pooling of vectors of any length, against plain loops."""

import hashlib
import math
import random
from collections import Counter

import pytest

from lectern.operators import requests, vectors

WEIGHTS = {f"http://h{i}": w for i, w in enumerate((1.0, 2.0, 4.0, 1.0))}


def preferences(key, weights):
    def cost(name):
        digest = hashlib.md5(f"{key} {name}".encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 1) / 16 ** 13) / weights[name]
    return sorted(weights, key=lambda n: (cost(n), n))


def placed(df, call, weights, **more):
    return {r.key: r.endpoint for r in call(df, weights, "key", **more).collect()}


@pytest.fixture
def keys(spark):
    return spark.range(4000).selectExpr("CONCAT('k', id) AS key").repartition(5)


def test_first_choice_by_weight(keys):
    got = placed(keys, requests.rendezvous_endpoint, WEIGHTS)
    assert got == {k: preferences(k, WEIGHTS)[0] for k in got}
    loads = Counter(got.values())
    assert all(abs(loads[n] / 4000 - w / 8) < 0.03 for n, w in WEIGHTS.items())
    fewer = {n: w for n, w in WEIGHTS.items() if n != "http://h2"}
    after = placed(keys, requests.rendezvous_endpoint, fewer)
    assert all(after[k] == e for k, e in got.items() if e != "http://h2")


@pytest.mark.parametrize("bound", [1.02, 1.25, 9.0])
def test_no_endpoint_is_above_its_bound(keys, bound):
    got = placed(keys, requests.balanced_endpoint, WEIGHTS, bound=bound)
    loads = Counter(got.values())
    assert len(got) == 4000 and all(loads[n] <= bound * 4000 * w / 8 for n, w in WEIGHTS.items())
    stayed = sum(e == preferences(k, WEIGHTS)[0] for k, e in got.items())
    assert stayed >= (0.9 if bound < 9 else 1) * 4000
    assert got == placed(keys.repartition(2), requests.balanced_endpoint, WEIGHTS, bound=bound)


def test_a_key_of_a_third_of_the_rows_stays_together(spark, keys):
    hot = spark.range(2000).selectExpr("'hot' AS key").unionByName(keys)
    rows = requests.balanced_endpoint(hot, WEIGHTS, "key").groupBy("key", "endpoint").count().filter("key = 'hot'").collect()
    assert len(rows) == 1 and rows[0]["count"] == 2000
    with pytest.raises(ValueError):
        requests.balanced_endpoint(keys, {"no url": 1.0}, "key")
    assert requests.balanced_endpoint(keys.limit(0), WEIGHTS, "key").collect() == []


@pytest.mark.parametrize("held", [1 << 23, 50])
def test_pooling_of_any_length(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "_HELD", held)
    draw = random.Random(6)
    rows = [(draw.choice(["a", "b", "c", None]), draw.choice([None, [], [draw.choice([None, 1.0, -2.5, 1e6]) for _ in range(
        draw.randint(1, 9))]])) for _ in range(800)] + [("only null", None), ("one", [None, 2.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(4)
    got = {r.k: (r.token_num, r["mean"]) for r in vectors.mean_pool(df, "k", "v").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        vecs = [v for key, v in rows if key == k and v]
        if vecs:
            means = []
            for i in range(max(map(len, vecs))):
                there = [v[i] for v in vecs if len(v) > i and v[i] is not None]
                means.append(sum(there) / len(there) if there else None)
            want[k] = (len(vecs), means)
    assert got.keys() == want.keys()
    for k, (n, means) in want.items():
        assert got[k][0] == n and got[k][1] == [None if m is None else pytest.approx(m) for m in means]
    plan = vectors.mean_pool(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == df._jdf.queryExecution().executedPlan().toString().count(
        "Exchange") + 1
