"""The mix against its SQL, and raking against its margins."""

import hashlib

import pytest
from compare import connect, differences

from lectern.llm import mixing
from lectern.llm.queries import QUERIES


def test_query_gives_the_rows_of_its_sql(spark, data):
    query = QUERIES["op6_mixing"]
    assert differences(query.run(spark, data), connect(data), query.sql) is None


def test_raked_weights_meet_the_margins():
    totals = {(a, b): n for a, b, n in [
        ("x", "p", 100), ("x", "q", 5), ("y", "p", 30), ("y", "q", 70), ("z", "q", 20), ("z", "p", 0)]}
    targets = [{"x": 0.5, "y": 0.25, "z": 0.25, "w": 1.0}, {"p": 0.3, "q": 0.7}]
    weights = mixing.rake(totals, targets, 200)
    whole = {c: w * totals[c] for c, w in weights.items()}
    assert ("z", "p") not in weights
    total = sum(whole.values())
    for k, name, share in ((0, "x", 0.5), (0, "y", 0.25), (1, "p", 0.3), (1, "q", 0.7)):
        assert abs(sum(v for c, v in whole.items() if c[k] == name) / total - share) < 1e-6


def test_expected_and_drawn_tokens_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select(
        "doc_id", "source", "lang", mixing.topic(docs["text"]).alias("topic"),
        mixing.token_count(docs["text"]).alias("n"), mixing.share(docs).alias("p")).toPandas()
    rows["expected"] = rows["n"] * rows["p"]
    drawn = {r.doc_id: r.n_tokens for r in mixing.mix(docs).collect()}
    noise = 4 * ((rows["n"] ** 2 * rows["p"] * (1 - rows["p"])).sum()) ** 0.5
    for name, target in mixing.TARGETS.items():
        for category, share in target.items():
            if category != mixing.REST:
                here = rows[name] == category
                # no document is of the rest of languages, so the others have its share
                want = share / (0.99 if name == "lang" else 1) * rows["expected"].sum()
                assert abs(rows.loc[here, "expected"].sum() - want) < 1e-3 * want
                assert abs(sum(drawn.get(d, 0) for d in rows.loc[here, "doc_id"]) - want) < noise


def plain_uniform(key):
    return int(hashlib.md5(f"{'null' if key is None else key}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16 ** 13


def test_hard_rows(spark):
    rows = [(i, "words and words " * (i % 7), ["src0", "src9", None][i % 3], ["en", None, "xx", "de"][i % 4])
            for i in range(200)] + [(None, None, None, None), (3, "a", "src0", "en"), (3, "a", "src0", "en")]
    docs = spark.createDataFrame(
        [(*r, 5, "topic") for r in rows],
        "doc_id bigint, text string, source string, lang string, n_tokens int, topic string")
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    shares = {r.doc_id: r.probability for r in mixing.mix(docs).collect()}
    assert {r.doc_id for r in drawn.collect()} == set(shares)
    assert all(plain_uniform(d) < p <= 1 for d, p in shares.items())
    assert None in shares  # it has no tokens
    assert mixing.draw(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.draw(docs, {"lang": {"en": 1.0}})


def margins(found, totals, k):
    sums = {}
    for c, p in found.items():
        sums[c[k]] = sums.get(c[k], 0) + p * totals[c]
    return sums


def test_one_stray_row_among_many_leaves_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    stray = spark.createDataFrame(
        [(-1, "word " * 300, "src9", None)], "doc_id bigint, text string, source string, lang string")
    alone = {r.doc_id for r in mixing.mix(docs).collect()}
    drawn = {r.doc_id: r for r in mixing.mix(docs.unionByName(stray)).collect()}
    assert drawn.pop(-1).probability == 1
    assert len(alone) > 2000 and alone == drawn.keys()


def test_scarce_categories_are_whole_and_the_rest_meets_its_targets():
    totals = {("a", "x"): 1e6, ("b", "x"): 4e6, ("a", "y"): 3e5, ("b", "y"): 9e5, ("c", "x"): 30, ("a", "z"): 5}
    targets = [{"a": 0.3, "b": 0.6, "c": 0.1}, {"x": 0.7, "y": 0.28, "z": 0.02}]
    assert mixing.scarce(totals, targets) == {("c", "x"), ("a", "z")}
    found = mixing.probabilities(totals, targets)
    assert found["c", "x"] == found["a", "z"] == 1 and max(found.values()) == 1
    whole = sum(p * totals[c] for c, p in found.items())
    assert whole > 0.4 * sum(totals.values())
    for k, want in ((0, {"a": 1 / 3, "b": 2 / 3}), (1, {"x": 0.7 / 0.98, "y": 0.28 / 0.98})):
        got = margins(found, totals, k)
        assert all(abs(got[x] / whole - v) < 1e-3 for x, v in want.items())


def test_a_scarce_cell_does_not_bound_the_mix():
    """Every category has enough, but one cell has next to nothing and would have a huge weight."""
    totals = {("a", "x"): 9e5, ("a", "y"): 1e4, ("b", "x"): 2e4, ("b", "y"): 10, ("b", "z"): 1.3e4, ("a", "z"): 5e4}
    targets = [{"a": 0.7, "b": 0.3}, {"x": 0.6, "y": 0.1, "z": 0.3}]
    weights = mixing.rake(totals, targets)
    assert 1 / max(weights.values()) < mixing.LEAST and not mixing.scarce(totals, targets)
    found = mixing.probabilities(totals, targets)
    whole = sum(totals.values())
    assert abs(sum(p * totals[c] for c, p in found.items()) / whole - mixing.LEAST) < 1e-6
    assert max(found.values()) == 1
    for k, target in enumerate(targets):
        got = margins(found, totals, k)
        assert all(abs(got[x] / (mixing.LEAST * whole) - v) < 1e-3 for x, v in target.items())
