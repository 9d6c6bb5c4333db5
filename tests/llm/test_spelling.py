"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import spelling as sp
from lectern.llm.common import written
from lectern.llm.queries import QUERIES


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (
        a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i:])


def plain_variants(rows):
    words = plain_counts(rows)
    cut = {}
    for w in words:
        for i in range(len(w)):
            cut.setdefault(w[:i] + w[i + 1:], set()).add(w)
    near = {w: {x for i in range(len(w)) for x in cut[w[:i] + w[i + 1:]]} | cut.get(w, set())
            | ({w[:i] + w[i + 1:] for i in range(len(w))} & words.keys()) for w in words}
    near = {w: {x for x in found if one_edit(w, x)} for w, found in near.items()}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def as_rows(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_query_against_all_pairs(spark, data, docs_table):
    got = as_rows(QUERIES["op11_spelling"].run(spark, data))
    assert got == plain_variants([r[:2] for r in docs_table])
    assert sum(r[1] is not None for r in got) >= 10


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = random.Random(3)
    for _ in range(300):
        places = draw.sample(range(12), draw.randint(3, 7))
        costs = [draw.randint(0, 9) for _ in places]
        got = sp.pivots(places, costs)
        cost = dict(zip(places, costs))
        assert got[1] - got[0] >= 2
        assert sum(map(cost.get, got)) == min(
            cost[i] + cost[j] for i, j in itertools.combinations(sorted(places), 2) if j - i >= 2)


@pytest.mark.parametrize("letters", ["ab", "abcdefghéÿ"])
def test_no_pair_is_missed(spark, letters):
    """Words of few letters, which repeat grams and crowd under every key; lengths 6 to 20."""
    draw = random.Random(4)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(6, 20))) for _ in range(500)}
    for w in list(words)[:400]:
        at, c = draw.randrange(len(w)), draw.choice(letters)
        words |= {w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w[:at] + w[at + 1:], w + c, c + w}
    words = sorted(w for w in words if len(w) >= 6)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint").repartition(3)
    got = [(r.a, r.b, r.n_a, r.n_b) for r in sp.near_pairs(df).collect()]
    number = {w: i for i, w in enumerate(words)}
    wanted = {(a, b, number[a], number[b]) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 400


def test_chains_of_forms(spark):
    """abcdef x 1 ... each five times the one before, one letter apart; ties go to the first."""
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    text = " ".join(" ".join([w] * (5 * 5 ** i)) for i, w in enumerate(chain))
    text += " " + " ".join(["tiewords"] * 5 + ["tieworda"] * 40 + ["tiewordb"] * 40)
    rows = [(1, text), (2, None), (3, ""), (None, "nobodys " * 7), (3, "NoBodyz ÉtÉtudes " * 6), (3, "NoBodyz " * 6)]
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id bigint, text string, word string, n int")
    got = as_rows(sp.variants(docs))
    assert got == plain_variants(rows)
    found = {r[0]: r for r in got}
    assert found[chain[0]][1:3] == (chain[1], chain[-1]) or zlib.crc32(b"1:abcdefgh") % 199 == 0
    assert found["tiewords"][1] == "tieworda"


def test_no_table_of_words_goes_to_the_driver(spark, monkeypatch):
    """Spark takes entries to be as few as words and files to be as small as they are compressed."""
    plans = []
    monkeypatch.setattr(sp, "written", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    text = " ".join(["abcdefgh"] * 8 + ["abcdefgx"] * 40 + ["abcdefyx"] * 200)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = sp.variants(docs)
    assert as_rows(got) == plain_variants([(1, text)])
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in x for x in plans) >= 4
    assert not any("Broadcast" in x for x in plans)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, ("x" * 5000 + " ") * 5 + ("x" * 5001 + " ") * 30)], "doc_id bigint, text string")
    assert as_rows(sp.variants(docs)) == plain_variants([(1, docs.first().text)])
    assert sp.variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sp.variants(docs, least_length=3)
