"""Each stage of the pipeline on what the stage before it kept, against plain loops."""

from test_mixing import plain_uniform
from test_simhash import plain_components, plain_fingerprint
from test_tokens import check_pieces

import corpus_pipeline as pipeline
from lectern.llm import mixing, perplexity, simhash, toxicity


def test_stages_follow_each_other(spark, data, docs_table):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns, rows = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, data)
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
        rows[name] = docs.collect()
        if name != "packing":
            docs = spark.createDataFrame(rows[name], before.schema)
        if name == "quality":
            bad = {r.doc_id for r in perplexity.quality(before, labels).collect() if r.rejected}
            assert {r.doc_id for r in rows[name]} == {r[0] for r in docs_table} - bad and bad
        elif name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(before, labels).collect() if r.rejected}
            assert {r.doc_id for r in rows[name]} == {r.doc_id for r in rows["quality"]} - bad and bad
        elif name == "near_duplicates":
            prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows["toxicity"]]
            want = {d for (d, _), c in zip(prints, plain_components(prints)) if c == d}
            assert sorted(r.doc_id for r in rows[name]) == sorted(want) and len(want) < len(prints)
        elif name == "mixing":
            shares = {r.doc_id: r.p for r in before.select(
                "doc_id", mixing.share(before).alias("p")).collect()}
            assert sorted(r.doc_id for r in rows[name]) == sorted(
                d for d, p in shares.items() if plain_uniform(d) < p)
        else:
            check_pieces([(r.doc_id, r.text) for r in rows["mixing"]], rows[name], 4096)
    got = pipeline.run(spark, data).collect()
    key = [(r.doc_id, r.start, r.length, r.ids_crc32) for r in got if r.start == 0 and r.length == r.doc_tokens]
    # where windows are cut depends on the order of the documents, which documents are there does not
    assert {r.doc_id for r in got} == {r.doc_id for r in rows["packing"]} and key


def test_keep_one_of_hard_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text), (1, text.upper()), (3, text), (2, "quite another text than that one over there"),
            (2, "quite another text than that one over there"), (None, text), (None, text), (None, None), (8, None),
            (9, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, n int, root int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect() if r.doc_id) == sorted(
        [(1, text.upper()), (2, "quite another text than that one over there"), (8, None)], key=lambda r: r[0])
    assert sorted(str(r.text) for r in kept.collect() if not r.doc_id) == ["None", text]
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                        ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


