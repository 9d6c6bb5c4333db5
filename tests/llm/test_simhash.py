"""SimHash links against all pairs on small tables."""

import random
import re

import numpy as np
import xxhash

from lectern.llm import components, simhash
from lectern.llm.queries import QUERIES


def plain_fingerprint(text):
    """Bit by bit, as the rule says."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    if len(words) < 4:
        shingles = [" ".join(words)]
    else:
        shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(prints, bits=4):
    """Root of each (name, fingerprint) by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                parent[root(i)] = root(j)
    members = {}
    for i, (name, _) in enumerate(prints):
        members.setdefault(root(i), []).append(name)
    least = {k: min((n for n in v if n is not None), default=None) for k, v in members.items()}
    return [least[root(i)] for i in range(len(prints))]


HARD = [None, "", " \t\n", "One", "one two THREE", "É é", "a\xa0b c\x1cd e f g", "x " * 70000, "a b c d",
        "a b c d e", "A B C D E", "  zero", "日本 語 text 👩‍👩‍👧"]


def test_fingerprints_follow_the_rule(docs_table):
    for text in HARD + [r[1] for r in docs_table]:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def as_rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in df.collect())


def wanted(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    return sorted(((d is None, d or 0), f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints)))


def test_table_against_all_pairs(spark, data, docs_table):
    got = QUERIES["op8_simhash"].run(spark, data)
    want = wanted([r[:2] for r in docs_table])
    assert as_rows(got) == want
    assert len({c for *_, c in want}) < len(want)


def test_hard_and_repeated_rows(spark):
    rows = [(i, t) for i, t in enumerate(HARD * 2)] + [(None, "lone words here"), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame(
        [(a, b, 0, 1, "x") for a, b in rows],
        "doc_id bigint, text string, fp int, component_id int, root string")
    assert as_rows(simhash.near_duplicates(df)) == wanted(rows)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def chained(rng, count, start, step=4):
    found = [start]
    for _ in range(count - 1):
        value = found[-1] if rng.random() < 0.7 else rng.choice(found)
        for bit in rng.sample(range(64), rng.randint(1, step)):
            value ^= 1 << bit
        found.append(value)
    return found


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_links(spark, values):
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.find_links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[root(a)] = root(b)
    want = plain_components([(v, v) for v in values])
    groups = {}
    for v in values:
        groups.setdefault(root(v), []).append(v)
    assert [min(groups[root(v)]) for v in values] == want


def test_links_connect_chains_and_dense_groups(spark, monkeypatch, many_partitions):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(8):
        values += chained(rng, 15, rng.getrandbits(64))
    center = rng.getrandbits(64)
    for _ in range(250):  # near copies of one text
        value = center
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            value ^= 1 << bit
        values.append(value)
    values += [0, (1 << 64) - 1, 1, 15, 31 << 20]
    values = list(dict.fromkeys(values))
    check_links(spark, values)
    monkeypatch.setattr(simhash, "RUN", 7)  # crowded cells go on as blocks
    monkeypatch.setattr(simhash, "PAIRS", 3)
    check_links(spark, values)


def test_cells_meet_for_every_close_pair():
    rng = random.Random(6)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        one, other = (set(simhash.cells(np.array([x], np.uint64))[0].tolist()) for x in (a, b))
        assert one & other
        assert simhash.close(np.array([a], np.uint64), np.array([b], np.uint64)).all()


def test_components_of_random_links(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(None, 3)]
    got = dict(map(tuple, components.components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    real = [(a, b) for a, b in links if a is not None and a != b]
    for a, b in real:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {v: root(v) for pair in real for v in pair}


def test_one_of_each_group_stays(spark):
    """Ids of several texts, copies under other ids, groups without any id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (5, b), (5, a), (5, b), (None, a), (None, c), (None, c), (9, d), (9, d), (10, d), (11, None), (12, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, _fp string, root int").drop("_fp")
    got = simhash.keep_one(docs.repartition(3))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(3, a), (5, b), (None, a), (None, c), (9, d), (11, None)], key=repr)
    assert simhash.keep_one(docs.limit(0)).collect() == []
