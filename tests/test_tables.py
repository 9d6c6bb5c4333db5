"""Catalogue, reading state and account cases with NULLs, ties and rejects."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import accounts, catalog, progress, requests, status

NOW = datetime.datetime(2024, 1, 1)


def day(n):
    return NOW + datetime.timedelta(days=n)


def books(spark, *rows):
    return spark.createDataFrame(
        [(i, t, a, c, v, day(d)) for i, t, a, c, v, d in rows],
        "id bigint, title string, author string, category string, count_visit bigint, ctime timestamp")


def test_search(spark):
    df = books(spark, (1, "50% off", "Ann", "x", 0, 1), (2, "500 off", "ÄNN", "x", 0, 1), (3, None, "bob", "y", 0, 1))
    ids = lambda **k: [r.id for r in catalog.search_books(df, **k).collect()]
    assert ids(q="50%") == [1]
    assert ids(q="50%", wildcards=True) == [1, 2]
    assert ids(q="ANN") == [1]
    assert ids(q="ANN", ci=False) == []
    assert ids(q="BOB") == [3]
    assert ids(page_size=2, page_num=1) == [3]
    assert ids(q="o", category="x", author="Ann") == [1]
    assert catalog.search_total(df, q="off").first().total == 2
    with pytest.raises(ValueError):
        catalog.search_books(df, page_num=-1)


def test_recent_random_home(spark):
    df = books(spark, (1, "a", "", "", 0, 1), (2, "b", "", "", 1, 9), (3, "c", "", "", 0, 3), (4, "d", "", "", 0, 3))
    assert [r.id for r in catalog.recent_books(df, 2).collect()] == [3, 4]
    omit = spark.createDataFrame([(3,)], "id bigint")
    assert [r.id for r in catalog.recent_books(df, 0, omit).collect()] == [4, 1]
    assert [r.id for r in catalog.recent_books(df, 0, [3, 4]).collect()] == [1]
    first = [r.id for r in catalog.random_books(df, 3, seed="s").collect()]
    assert first == [r.id for r in catalog.random_books(df, 3, seed="s").collect()] and len(set(first)) == 3
    assert catalog.random_books(df, 2).count() == 2
    with pytest.raises(ValueError):
        catalog.home_feed(df, random=30)


def test_stats(spark):
    df = spark.createDataFrame([("a", "p"), ("a", None), (None, "q")], "author string, publisher string")
    row = catalog.book_stats(df).first()
    assert (row.total, row.author, row.publisher, row.tag) == (3, 1, 2, 0)
    assert catalog.book_stats(df, approx=True).first().publisher == 2


def test_public_view_and_envelope(spark):
    df = spark.createDataFrame([(1, "/p", "", "x", "1970-01-01")],
                               "id int, path string, sub_title string, series string, publish_date string")
    view = catalog.public_view(df)
    assert view.columns == ["id", "sub_title", "series", "pubdate"]
    assert catalog.to_envelope(view).first().body == (
        '{"code":200,"message":"sucesss","data":{"id":1,"series":"x","pubdate":"1970-01-01"}}')


EVENTS = "event_id bigint, ts timestamp, book_id bigint, user_id bigint, progress double, progress_index bigint, para_position bigint"


def test_progress_rules(spark):
    events = spark.createDataFrame(
        [(1, day(1), 1, 1, 0.1, 1, 1), (2, day(3), 1, 1, 0.3, 3, 3), (3, day(3), 1, 1, 0.2, 2, 2),
         (4, day(1), None, 1, 0.1, 1, 1), (5, day(1), 1, 0, 0.1, 1, 1)], EVENTS)
    good, bad = progress.valid_progress(events)
    assert (good.count(), bad.count()) == (3, 2)
    table = progress.upsert_progress(None, events)
    row = table.first()
    assert (row.start_date, row.updated_at, row.progress, row.expt_end_date, row.end_date) == (
        day(1), day(3), 0.2, day(16), None)
    late = spark.createDataFrame([(9, day(2), 1, 1, None, 9, 9), (9, day(2), 2, 1, 0.5, 9, 9)], EVENTS)
    rows = {r.book_id: r for r in progress.upsert_progress(table, late).collect()}
    assert (rows[1].start_date, rows[1].updated_at, rows[1].progress, rows[1].para_position) == (
        day(1), day(2), None, 9)
    assert rows[2].start_date == day(2)
    changed = progress.update_progress(table, late).collect()
    assert [(r.book_id, r.progress, r.progress_index) for r in changed] == [(1, None, 9)]


def test_one_event_gives_the_whole_state(spark):
    """A null event id comes before all others of its time, and a later one still decides everything."""
    events = spark.createDataFrame(
        [(5, day(1), 1, 1, 0.1, 1, 1), (None, day(2), 1, 1, 0.9, 9, 9), (None, day(3), 2, 1, 0.5, 5, 5),
         (-7, day(3), 2, 1, 0.6, 6, 6), (8, None, 2, 1, 0.7, 7, 7)], EVENTS)
    rows = {r.book_id: (r.updated_at, r.progress, r.progress_index, r.para_position)
            for r in progress.upsert_progress(None, events).collect()}
    assert rows == {1: (day(2), 0.9, 9, 9), 2: (day(3), 0.6, 6, 6)}
    table = progress.upsert_progress(None, events.filter("event_id = 5"))
    assert progress.update_progress(table, events).first().progress == 0.9


def test_shelves(spark):
    shelf = books(spark, *[(i, f"t{i}", "a", "", 0, 1) for i in (1, 2, 4)])
    events = spark.createDataFrame([(i, day(i), i, 7, 0.1, 1, 1) for i in (1, 2, 3)], EVENTS)
    table = progress.upsert_progress(None, events)
    # the page of two is taken before book 3 turns out to be missing
    assert [r.id for r in progress.reading_books(shelf, table, 7, 2).collect()] == [2]
    favs = progress.upsert_favs(spark.createDataFrame(
        [(b, 7, day(d)) for b, d in ((1, 1), (2, 5), (3, 9), (4, 5), (1, 2))] + [(1, 8, day(1))],
        "book_id bigint, user_id bigint, ts timestamp"))
    liked = progress.liked_books(shelf, favs, table, 7, 2).collect()
    assert [(r.id, r.progress) for r in liked] == [(2, 0.1), (4, None)]
    both = progress.all_shelves(shelf, favs, table, 2).collect()
    assert sorted((r.user_id, r.shelf, r.position, r.book_id) for r in both) == [
        (7, "liked", 1, 2), (7, "liked", 2, 4), (7, "reading", 2, 2), (8, "liked", 1, 1)]


def test_accounts(spark):
    users = spark.createDataFrame(
        [(1, "a@x", "", "ann", 1), (2, "b@x", "555", "a@x", 2), (3, None, "555", "bob", 2)],
        "id bigint, email string, mobile string, user_name string, role_id bigint")
    asked = spark.createDataFrame(
        [(1, "a@x"), (2, "555"), (3, "bob"), (4, ""), (5, None), (6, "zed")], "request_id int, account string")
    got = {r.request_id: (r.user_id, r.error) for r in accounts.resolve_accounts(asked, users).collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (3, None), 4: (None, "empty account"),
                   5: (None, "empty account"), 6: (None, "not found")}
    tokens = spark.createDataFrame([(1, "k1", 1), (2, "k2", 2), (3, "k9", 9)], "id int, api_key string, user_id bigint")
    log = spark.createDataFrame(
        [(1, "Bearer k1", True), (2, "Bearer k2", True), (3, "Bearer k2", False), (4, "bearer k1", False),
         (5, None, False), (6, "Bearer ", False), (7, "Bearer k9", False), (8, "Bearer k1 ", False)],
        "request_id int, authorization string, admin_route boolean")
    got = {r.request_id: r.outcome for r in accounts.authorize_requests(log, tokens, users).collect()}
    assert got == {1: "ok", 2: "forbidden", 3: "ok", **{i: "unauthorized" for i in (4, 5, 6, 7, 8)}}
    missing = accounts.missing_tokens(users, tokens, "s").collect()
    assert [(r.user_id, len(r.api_key)) for r in missing] == [(3, 40)]


def test_request_defaults_and_models(spark):
    df = spark.createDataFrame([(0, 3), (None, None), (5, 1)], "max_tokens int, n int")
    assert [tuple(r) for r in requests.apply_request_defaults(df).collect()] == [(512, 1), (512, None), (5, 1)]
    asked = spark.createDataFrame([("vicuna-13b-v1.5-16k",), ("gpt-4",), (None,)], "model string")
    classified = requests.classify_models(asked, requests.model_registry(spark))
    served, rejected = requests.split_supported(classified)
    assert [r.type_code for r in served.collect()] == [200]
    assert sorted(r.type_code for r in rejected.collect()) == [0, 100]


def test_ticks_run_over_days(spark):
    rows = [(day(0), True), (day(0), False), (day(0) + datetime.timedelta(seconds=5), True), (day(2), False)]
    ticks = status.status_ticks(spark.createDataFrame(rows, "ts timestamp, ok boolean")).orderBy("tick").collect()
    assert [(r.n, r.scan_count, r.new_errors) for r in ticks] == [(2, 2, 1), (1, 3, 0), (1, 4, 1)]


def test_plans_that_matter_at_scale(spark, data):
    """Rows of one user are cut before the shuffle, and a hot join key is split."""
    from lectern.plans.registry import all_queries

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan(all_queries()["all_shelves"].run(spark, data))
    listing = plan(all_queries()["scan_library"].run(spark, data))
    assert "content" not in listing.split("ReadSchema")[-1]
    names = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in zip(names, ("20kb", "20kb", "-1", "2")):
            spark.conf.set(name, value)
        log = spark.range(60_000, numPartitions=16).select(
            F.col("id").alias("request_id"), F.lit(False).alias("admin_route"),
            F.when(F.col("id") % 3 == 0, F.lit("Bearer hot"))
            .otherwise(F.concat(F.lit("Bearer k"), "id")).alias("authorization"))
        tokens = spark.range(20_000).select(
            F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("api_key"),
            F.col("id").alias("user_id"))
        users = spark.range(20_000).select("id", F.lit(2).cast("bigint").alias("role_id"))
        out = accounts.authorize_requests(log, tokens, users)
        assert out.filter("outcome = 'ok'").count() == 20_000 + 13_333
        out.collect()
        assert "skew=true" in plan(out)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
