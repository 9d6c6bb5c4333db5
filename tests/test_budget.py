"""Batches by token budget, and what is left out when a run goes on after one that died."""

import os

import pytest

from lectern.operators import requests

BUDGET = 120


@pytest.fixture
def prompts(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 61))) for i in range(400)] + [(1000, "w " * 500), (1001, None), (1002, "")]
    return spark.createDataFrame([(*r, 1) for r in rows], "id bigint, prompt string, tokens int").repartition(4)


def make_model(folder, bomb=None):
    def model(texts):
        with open(f"{folder}/{os.getpid()}.log", "a") as log:
            log.write(f"{len(texts)} {max(len(t.split()) for t in texts)}\n")
        if bomb and os.path.exists(bomb) and any(len(t.split()) == 500 for t in texts):
            os._exit(1)
        return [{"text": f"{len(t.split())}", "finish_reason": "stop", "total_tokens": len(t.split())} for t in texts]
    return model


def calls(folder):
    return [tuple(map(int, line.split())) for name in os.listdir(folder) if name.endswith(".log")
            for line in open(f"{folder}/{name}")]


def test_batches_stay_within_the_budget(spark, prompts, tmp_path):
    got = requests.complete_by_budget(prompts, make_model(str(tmp_path)), "id", str(tmp_path / "out"), budget=BUDGET, waves=2)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 403 and got.count() == 403
    assert all(r.text == str(r.tokens) and r.width >= r.tokens for r in rows.values())
    made = calls(str(tmp_path))
    assert all(n * width <= BUDGET or n == 1 for n, width in made if width)
    assert sum(n for n, _ in made) == 403 and len(made) < 250
    assert requests.padding_share(got.filter("width > 0")).first().padding < 0.15


def test_a_run_goes_on_where_one_died(spark, prompts, tmp_path):
    """The model dies over one prompt; what was written before is not asked for again."""
    bomb, out = tmp_path / "bomb", str(tmp_path / "out")
    bomb.write_text("")
    model = make_model(str(tmp_path), str(bomb))
    with pytest.raises(Exception):
        requests.complete_by_budget(prompts, model, "id", out, budget=BUDGET, waves=6)
    kept = spark.read.parquet(out)
    finished = {r.id for r in kept.collect()}
    for name in os.listdir(tmp_path):
        if name.endswith(".log"):
            (tmp_path / name).write_text("")
    bomb.rename(tmp_path / "defused")
    got = requests.complete_by_budget(prompts, model, "id", out, budget=BUDGET, waves=6).collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in prompts.collect())
    assert sum(n for n, _ in calls(str(tmp_path))) == 403 - len(finished)
    before = len(calls(str(tmp_path)))
    assert len(requests.complete_by_budget(prompts, model, "id", out, budget=BUDGET, waves=6).collect()) == 403
    assert len(calls(str(tmp_path))) == before


def test_errors_stay_with_their_rows(spark, tmp_path):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [{"text": t} for t in texts]

    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "fine")], "id bigint, prompt string")
    rows = {r.id: (r.text, r.error) for r in requests.complete_by_budget(
        df, model, "id", str(tmp_path / "out"), waves=1).collect()}
    assert rows == {1: ("good", None), 2: (None, "refused"), 3: ("fine", None)}
    assert requests.complete_by_budget(df.limit(0), model, "id", str(tmp_path / "none"), waves=1).collect() == []
