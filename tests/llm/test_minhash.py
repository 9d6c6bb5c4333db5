"""Fingerprints against loops, and the likeness against the share of common shingles."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import minhash
from lectern.llm.queries import QUERIES


def shingles(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def share(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """doc_id -> (n_chars, sha256, edited text, next text), ids without repeats."""
    rows = sorted(rows, reverse=True)
    out = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, after, text)
    return out


def check(got, rows, tolerance=0.17):
    want = expected(rows)
    assert len(got) == len(want)
    errors = []
    for r in got:
        n, sha, edited, after, text = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 2 * minhash.BINS
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            assert 0 <= near <= 1 and abs(near - share(text, other)) < tolerance
            errors.append(near - share(text, other))
    assert abs(sum(errors)) / len(errors) < 0.01
    by_text = {}
    for r in got:
        assert by_text.setdefault(want[r.doc_id][4], r.fingerprint) == r.fingerprint


def test_table(spark, data, docs_table):
    check(QUERIES["op7_fingerprints"].run(spark, data).collect(), [r[:2] for r in docs_table])


@pytest.mark.parametrize("run_rows", [1, 3, 2000])
def test_hard_rows(spark, monkeypatch, run_rows):
    monkeypatch.setattr(minhash, "RUN_ROWS", run_rows)
    texts = [None, "", " \n ", "one", "two words", "a b c d", "a b c d e", "A  B\tc d e", "é 日本 👩‍👩‍👧 x",
             "word " * 50000, " ".join(map(str, range(3000))), "a b c d e f g h i j k l m n o p q r s t"]
    rows = [(7 * i * i - 40, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(
        [(*r, 0, "x") for r in rows], "doc_id bigint, text string, run int, packed string").repartition(4)
    check(minhash.edited_fingerprints(docs).collect(), rows, 0.2)
    assert minhash.edited_fingerprints(docs.limit(0)).collect() == []


def test_repeated_and_null_ids(spark):
    rows = [(1, "b b"), (1, "b b"), (1, "a a"), (None, "n m"), (None, None), (9, "z y x")]
    got = minhash.edited_fingerprints(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()

    def sha(text, after):
        cut = len(text) // 3
        return hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()

    ring = ["z y x", "b b", "b b", "a a"]
    want = [(9, sha("z y x", "b b")), (1, sha("b b", "b b")), (1, sha("b b", "a a")), (1, sha("a a", "z y x")),
            (None, sha("n m", "")), (None, sha("", "n m"))]
    assert len(ring) == 4
    assert sorted(map(str, [(r.doc_id, r.edited_sha256) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("run_rows", [2, 50])
def test_wide_and_clustered_ids(spark, monkeypatch, run_rows):
    """Ids at both ends of the longs, and most of them in a few dense clusters."""
    monkeypatch.setattr(minhash, "RUN_ROWS", run_rows)
    ids = [-7 * 10**18, 5, 7 * 10**18, -(1 << 63), (1 << 63) - 1, *range(10**15, 10**15 + 60), *range(-70, -10)]
    texts = {i: f"text of {i} " * (1 + i % 3) for i in ids}
    docs = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id bigint, text string").repartition(5)
    ring = sorted(ids, reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in minhash.edited_fingerprints(docs).collect()}
    for i, after in zip(ring, [*ring[1:], ring[0]]):
        cut = len(texts[i]) // 3
        assert got[i] == hashlib.sha256(
            (texts[i][:len(texts[i]) - cut] + texts[after][:cut]).encode()).hexdigest()
    runs = docs.select(minhash.run_of(docs).alias("run")).groupBy("run").count().collect()
    assert max(r["count"] for r in runs) <= 4 * run_rows + 4


def test_one_document(spark):
    got = minhash.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string"))
    assert got.first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_bins_hold_the_smallest_and_empty_ones_are_filled(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(text,)], "text string")
    hashes, minima = df.select(
        minhash.shingle_hashes(F.col("text")), minhash.bin_minima(minhash.shingle_hashes(F.col("text")))).first()
    want = [None] * minhash.BINS
    for h in hashes:
        b = h >> 55
        want[b] = h if want[b] is None else min(h, want[b])
    assert minima == want
    full = df.select(minhash.densified(minhash.bin_minima(minhash.shingle_hashes(F.col("text"))))).first()[0]
    assert all(f == w for f, w in zip(full, want) if w is not None) and set(full) == set(want) - {None}


def test_no_python_runs(spark, data):
    plan = QUERIES["op7_fingerprints"].run(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
