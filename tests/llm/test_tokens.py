"""Token files, packing and token counts against the tokenizers library called on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import common, packing, queries, separators, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
JSON = common.tokenizer_file(PATH)
HARD = [
    None, "", " ", "\n\n", "It's we'll I'D 's", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z w v",
    "ΑΣ ΣΑΣ İstanbul ǅ ﬁ Straße", "é ́e à́.", "12 34,5.6 ... ?!.;:,", "日本語 текст नमस्ते 👩‍👩‍👧",
    "word" * 3000, "ªº a­.", "one.two, three!four?", "\t tab\x0bvt\x0cff\r\ncr", "#", "\x00 nul"]


def plain(specials_are_text=False):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = specials_are_text
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, rows):
    """Documents with columns whose names clash with those of the results."""
    return spark.createDataFrame(
        [(a, b, 1, 2, "x") for a, b in rows],
        "doc_id bigint, text string, start int, n_tokens int, part string").repartition(5)


@pytest.mark.parametrize("as_text", [False, True])
def test_words_encode_as_whole_texts(as_text, docs_table):
    texts = HARD + [row[1] for row in docs_table]
    encoder, want = common.word_encoder(JSON, "<u4", as_text), plain(as_text)
    got = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want(t) for t in texts]


@given(st.lists(st.one_of(st.text(), st.text("aàéÀß's.,!́ʼ \n<|endoftext|>1")), max_size=4))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_as_whole(texts):
    encoder, want = common.word_encoder(JSON), plain()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [want(t) for t in texts]


def test_cache_turns_over(monkeypatch, docs_table):
    texts = [row[1] for row in docs_table[:60]]
    monkeypatch.setattr(common, "CACHED_WORDS", 50)
    assert not common.word_encoder(JSON).whole
    encoder, want = common.WordEncoder(Tokenizer.from_file(PATH), "<u4"), plain()
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want(text)


def expected_files(rows):
    want, start, out = plain(), 0, []
    for doc_id, text in rows:
        ids = want(text) + [2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark, data, docs_table):
    got = queries.QUERIES["op2_token_files"].run(spark, data)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected_files([r[:2] for r in docs_table])


def test_token_files_of_hard_texts(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(HARD)]
    docs = frame(spark, rows)
    for kind in ("byte", "bit"):
        got = token_files.token_files(
            docs, folder=str(tmp_path / kind), kind=kind, block_ids=64, file_ids=50)
        assert sorted(map(tuple, got.collect())) == expected_files(rows)
        assert len(list((tmp_path / kind).glob("part-*"))) > 1


def test_token_files_of_repeated_and_null_rows(spark):
    rows = [(5, "b"), (5, "b"), (None, "a"), (5, "c"), (1, None)]
    got = token_files.token_files(frame(spark, rows)).collect()
    want = plain()
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted(
        (a or 0, crc(want(b) + [2])) for a, b in rows)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert token_files.token_files(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_blocks_are_found_by_the_index(kind):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 32, 1001, dtype=np.uint32)
    image = token_files.pack_file(ids, [7, None], np.array([1000, 1]), 2, 3, kind, 100)
    assert all((token_files.read_block(image, k) == ids[100 * k:100 * k + 100]).all() for k in range(11))
    back, names, sizes = token_files.read_file(image)
    assert (back == ids).all() and names == [7, None] and sizes.tolist() == [1000, 1]
    with pytest.raises(ValueError):
        token_files.trailer(image[:-1] + b"x")


def check_pieces(rows, pieces, length):
    """Pieces hold every document once, without gaps, in full sequences."""
    want = plain()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    ids_of = {d: want(t) + [2] for d, t in rows}
    assert set(by_doc) == set(ids_of)
    for doc, found in by_doc.items():
        ids, at = ids_of[doc], 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == crc(ids[at:at + p.length])
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    filled = []
    for k in sorted(sequences):
        at = 0
        for offset, size in sorted(sequences[k]):
            assert offset == at
            at += size
        filled.append(at)
    assert all(x == length for x in filled[:-1]) and filled[-1] <= length


def test_packing_of_the_table(spark, data, docs_table):
    got = queries.QUERIES["op5_packing"].run(spark, data).collect()
    check_pieces([r[:2] for r in docs_table], got, 4096)


def test_packing_of_hard_texts(spark):
    rows = list(enumerate(HARD))
    for length in (1, 7, 64):
        got = packing.pack(frame(spark, rows), length).collect()
        check_pieces(rows, got, length)
    padded = {p.sequence_id: p.padded_to for p in got}
    total = sum(p.length for p in got)
    tail = total % 64 or 64
    assert padded[max(padded)] == (tail if tail & (tail - 1) == 0 else 64)
    assert packing.pack(frame(spark, rows).limit(0)).collect() == []


def test_packing_keeps_repeated_rows(spark):
    got = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((p.doc_id or 0, p.length) for p in got) == [(0, 1), (1, 3), (1, 3)]


def test_counts_of_the_table(spark, data, docs_table):
    got = queries.QUERIES["op9_token_counts"].run(spark, data).collect()
    want = plain(True)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(r[0], len(want(r[1]))) for r in docs_table]
    spans = sorted((r.start, r.start + r.n_tokens + 1) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_counts_over_file_and_block_ends(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(HARD * 2)]
    want = plain(True)
    for file_ids, block_ids in ((1, 1), (50, 7), (64, 64)):
        got = separators.token_counts(frame(spark, rows), file_ids=file_ids, block_ids=block_ids)
        assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted(
            (a or -1, len(want(b))) for a, b in rows)
    assert separators.token_counts(frame(spark, rows).limit(0)).collect() == []


def test_counts_of_any_stream(spark):
    rng = random.Random(4)
    for size in (0, 1, 40, 900):
        stream = [rng.choice([9, 1, 2, 3, 4]) for _ in range(size)]
        cuts = sorted(rng.randrange(size + 1) for _ in range(6))
        files = [stream[a:b] for a, b in zip([0, *cuts], [*cuts, size])]
        df = spark.createDataFrame(
            [(k // 3, k % 3, bytearray(np.array(f, "<u2").tobytes() + b"\n")) for k, f in enumerate(files)],
            "part bigint, file bigint, content binary")
        got = separators.count_documents(separators.find_ends(df, 9, block_ids=11)).collect()
        expected, start = [], 0
        for i, x in enumerate(stream):
            if x == 9:
                expected.append((start, i - start, True))
                start = i + 1
        if start < size:
            expected.append((start, size - start, False))
        assert sorted((r.start, r.n_tokens, r.closed) for r in got) == expected


def test_token_files_are_read_once(spark, tmp_path, monkeypatch):
    """Their totals come from the rows of their documents; the images are opened by one job."""
    from lectern.llm import token_files as tf

    opened = []
    monkeypatch.setattr(tf, "written", lambda df, name, _w=tf.written: opened.append(
        df._jdf.queryExecution().executedPlan().toString().count("binaryFile")) or _w(df, name))
    docs = spark.createDataFrame([(i, "a few words " * (i % 7)) for i in range(50)], "doc_id bigint, text string")
    tf.write_token_files(docs, str(tmp_path / "files"), file_ids=40)
    got = tf.read_token_files(spark, str(tmp_path / "files"))
    assert sum(map(bool, opened)) == 1 and "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, got.select("doc_id", "start", "n_tokens").collect()))
    assert len(rows) == 50 and all(s + n == t for (_, s, n), (_, t, _) in zip(rows, rows[1:])) and rows[0][1] == 0
