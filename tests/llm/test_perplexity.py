"""The n-gram model against dictionaries and plain loops."""

import math
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lectern.llm import perplexity as px
from lectern.llm.queries import QUERIES

HARD = [None, "", " ", "a", "The the the THE", "x x", "é É ß 日本 👩‍👩‍👧", "a\nb\tb b\x00b", "no no! no! 12 12",
        "go go go go go go. Go", "a_b__c ½ ²³ 1²"]


def plain_subwords(text):
    out, before, times = [], None, 0
    for word in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or ""):
        if not word[0].isalpha():
            out.append("0" if word[0].isdigit() else word[:3])
            continue
        times = times + 1 if word == before else 0
        before, low = word, word.lower()
        form = "l" if word == low else "A" if len(word) > 1 and word.upper() == word else "C"
        out.append("=" * min(times, 4) if times else form + (low if len(low) <= 4 else "~" + low[-3:]))
    return out


def test_subwords_follow_the_rule(docs_table, monkeypatch):
    texts = HARD + [r[1] for r in docs_table[:80]]
    monkeypatch.setattr(px, "PIECE", 100)
    for _ in range(2):  # as the worker meets words for the first time, and again
        found, sizes = px.subwords(texts)
        for text, end, size in zip(texts, sizes.cumsum(), sizes):
            assert found[end - size:end].tolist() == [
                xxhash.xxh64_intdigest(x.encode()) for x in plain_subwords(text)]


def plain_model(texts):
    """Probability of a sub-word after another, as the textbook recursion."""
    counts = {2: Counter()}
    for text in texts:
        s = ["<s>", *plain_subwords(text)]
        counts[2].update(zip(s, s[1:]))
    counts[1] = Counter(b for _, b in counts[2])
    cut = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            cut[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], px.LEAST_DISCOUNT), i) for i in (1, 2, 3)]
        else:
            cut[k] = [0.5, 1, 1.5]
    after = defaultdict(list)
    for (a, _), v in counts[2].items():
        after[a].append(v)
    total = sum(counts[1].values())
    left = sum(cut[1][min(v, 3) - 1] for v in counts[1].values())

    def own(k, gram):
        v = counts[k].get(gram, 0)
        return v - cut[k][min(v, 3) - 1] if v else 0

    def p(a, b):
        if not total:
            return 1.0
        lower = own(1, b) / total + left / total / (len(counts[1]) + 1)
        if a not in after:
            return lower
        seen = sum(after[a])
        return own(2, (a, b)) / seen + sum(cut[2][min(v, 3) - 1] for v in after[a]) / seen * lower

    return p, counts


def plain_surprisal(p, text):
    s = ["<s>", *plain_subwords(text)]
    return -sum(math.log(p(a, b)) for a, b in zip(s, s[1:]))


def fold(text):
    return xxhash.xxh32_intdigest((text or "").encode()) % px.FOLDS


@pytest.mark.parametrize("count,most", [(3, 0), (40, 300), (40, 1 << 17)])
def test_model_is_the_textbook_recursion(spark, docs_table, monkeypatch, many_partitions, count, most):
    """With all, some and none of the n-grams found by joins, in many small blocks."""
    frequent = px.frequent
    monkeypatch.setattr(px, "frequent", lambda values: frequent(values, most))
    monkeypatch.setattr(px, "BLOCK_TEXTS", 20)
    texts = [r[1] for r in docs_table[:count]] + HARD
    asked = texts + [r[1] for r in docs_table[count:count + 60]]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    docs = spark.createDataFrame(
        [(i, t, "en") for i, t in enumerate(asked)], "doc_id bigint, text string, lang string").repartition(3)
    values, unseen = px.values_of(px.count_pairs(train))
    got = {r.doc_id: r for r in px.scores(docs, values, unseen).collect()}
    whole, counts = plain_model(texts)
    parts = [plain_model([t for t in texts if fold(t) != k])[0] for k in range(px.FOLDS)]
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        size = len(plain_subwords(text))
        assert got[i].n == size and got[i].empty == (not text)
        assert abs(got[i].full - plain_surprisal(whole, text)) <= 0.0015 * (size + 1)
        assert abs(got[i].fold - plain_surprisal(parts[fold(text)], text)) <= 0.0015 * (size + 1)
    names = list(counts[1])
    for a in [*names[:40], "never seen", "<s>"]:
        assert abs(sum(whole(a, b) for b in names) + whole(a, "not there") - 1) < 1e-9


def test_every_discount_leaves_something():
    """Counts as of very much text: few n-grams are rare, so the estimates fall below 0."""
    assert px.discounts([2, 200, 700, 1500])[0] == px.LEAST_DISCOUNT
    assert px.discounts([5, 0, 3, 1]) == [0.5, 1.0, 1.5]
    assert all(px.LEAST_DISCOUNT <= x <= k for k, x in enumerate(px.discounts([90, 40, 20, 10]), 1))


def test_blocks_do_not_hold_what_all_tasks_know(spark, docs_table, monkeypatch):
    """A block takes few bytes for each sub-word where the table knows all n-grams."""
    texts = [r[1] or "" for r in docs_table[:400]] * 5
    rows = pa.record_batch([
        pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()),
        pa.array(["en"] * len(texts)), pa.array(texts)], names=["doc_id", "mark", "lang", "text"])
    hashed, sizes = px.subwords(texts)
    last = np.zeros(len(hashed), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    keys = np.unique(np.concatenate([
        px.mixed(px.befores(hashed, sizes), hashed), px.mixed(hashed, np.where(last, px.LAST, px.INNER)),
        px.mixed(np.full(1, px.EDGE), np.full(1, px.INNER))]))
    table = px.Table(keys, np.ones((len(keys), px.MODELS), np.int16))
    monkeypatch.setattr(px, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    docs = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    run = px.blocks(docs, SimpleNamespace(value=table), 8)
    tracemalloc.start()
    out = list(run(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.num_rows for x in out] == [1] and out[0].column("tag").to_pylist() == [1]
    head = px._unpacked(out[0].column("places")[0].as_py())
    assert head.column("n").to_pylist() == sizes.tolist()
    # two n-grams for each sub-word, and that of the edge
    assert np.allclose(head.column("full").to_numpy(), (2 * sizes + (sizes > 0)) * px.GRAIN)
    assert peak < 100 * len(hashed)


@pytest.mark.parametrize("call", [px.quality, px.keep_good])
def test_texts_go_to_python_in_batches_of_bounded_bytes(spark, call):
    docs = spark.createDataFrame([(i, "a b", "en") for i in range(4)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str((1 << 31) - 1))
    call(docs, labels).collect()
    assert int(spark.conf.get(name)) <= 8 << 20


def plain_quality(rows, labels, quantile):
    """(surprisal, limit) of each (doc_id, text, lang)."""
    said = defaultdict(list)
    for doc, quality in labels:
        if doc is not None and quality is not None:
            said[doc].append(quality)
    trusted = {d for d, v in said.items() if min(v) == 1}
    texts = [t for d, t, _ in rows if d in trusted]
    whole = plain_model(texts)[0]
    parts = [plain_model([t for t in texts if fold(t) != k])[0] for k in range(px.FOLDS)]
    sums = [(plain_surprisal(parts[fold(t)] if d in trusted else whole, t), len(plain_subwords(t))) for d, t, _ in rows]
    ours = [s for s, (d, *_) in zip(sums, rows) if d in trusted]
    mean = sum(x for x, _ in ours) / sum(n for _, n in ours)
    score = [(x + px.PRIOR * mean) / (n + px.PRIOR) if t else None for (x, n), (_, t, _) in zip(sums, rows)]
    by_lang = defaultdict(list)
    for (doc, _, lang), s in zip(rows, score):
        if doc in trusted and s is not None:
            by_lang[None].append(s)
            if lang is not None:
                by_lang[lang].append(s)
    limit = {k: sorted(v)[math.ceil(len(v) * quantile) - 1] for k, v in by_lang.items()}
    few = {k for k, v in by_lang.items() if len(v) < px.OWN_LIMIT}
    return score, [max(limit[k], limit[None]) if (k := lang if lang in limit else None) in few else limit[k]
                   for *_, lang in rows]


@pytest.mark.parametrize("own_limit", [1000, 30])
def test_query_against_plain_loops(spark, data, docs_table, monkeypatch, own_limit):
    import duckdb

    monkeypatch.setattr(px, "OWN_LIMIT", own_limit)
    labels = duckdb.connect().execute(
        f"SELECT doc_id, quality FROM read_parquet('{data}/labels.parquet')").fetchall()
    rows = [(d, t, lang) for d, t, lang, _ in docs_table]
    got = {r.doc_id: r for r in QUERIES["op10_quality"].run(spark, data).collect()}
    for (doc, _, _), s, m in zip(rows, *plain_quality(rows, labels, px.QUANTILE)):
        r = got.pop(doc)
        assert math.isclose(math.log(r.perplexity), s, abs_tol=2e-3)
        assert math.isclose(math.log(r.threshold), m, abs_tol=2e-3)
        assert r.rejected == (s > m) or abs(s - m) < 3e-3
    assert not got


def test_bad_goes_and_good_stays(spark):
    """Labels on half of the documents; the verdicts on the other half."""
    import duckdb

    rows = duckdb.connect().execute(
        "SELECT doc_id, text, lang, source, n_chars, quality FROM "
        "read_parquet('/root/testdata/sf0.01/documents.parquet') d LEFT JOIN "
        "read_parquet('/root/testdata/sf0.01/labels.parquet') l USING (doc_id)").fetchall()
    docs = spark.createDataFrame(
        [r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame(
        [(r[0], r[5], 0) for r in rows if r[5] is not None and r[0] % 2], "doc_id bigint, quality int, toxic int")
    kept = px.keep_good(docs, labels)
    assert kept.columns == docs.columns
    kept = {r.doc_id for r in kept.collect()}
    held_out = [r for r in rows if r[5] is not None and r[0] % 2 == 0]
    good = [r[0] in kept for r in held_out if r[5] == 1]
    bad = [r[0] in kept for r in held_out if r[5] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 20
    verdicts = {r.doc_id for r in px.quality(docs, labels).collect() if not r.rejected}
    assert verdicts == kept


def test_hard_rows(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(HARD)] + [
        (1, "", "en"), (None, "nobody", "xx"), (50, "abc " * 40000, "en"), (50, "abc " * 40000, "en")]
    docs = spark.createDataFrame(
        [(*r, 1, 2.0) for r in rows], "doc_id bigint, text string, lang string, step int, perplexity double")
    labels = spark.createDataFrame(
        [(3, 1), (4, 1), (4, 0), (5, None), (None, 1), (1, 1), (8, 1), (8, 1)], "doc_id bigint, quality int")
    got = px.quality(docs, labels).collect()
    assert len(got) == len(rows)
    assert all((r.perplexity is None) == (not t) for r, t in zip(
        sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.perplexity or 0)),
        [t for _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0], len(r[1] or "")))]))
    assert not any(r.rejected for r in got if r.perplexity is None)
    assert px.keep_good(docs, labels).count() == sum(not r.rejected for r in got)
    none = px.quality(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.rejected for r in none)
    assert px.quality(docs.limit(0), labels).collect() == []
    assert px.keep_good(docs.limit(0), labels.limit(0)).collect() == []
