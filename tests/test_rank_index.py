"""Pages by the rank index against offset and limit."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import rank_index as ri


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    made = [(i, draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, "a", "b", "ü"]), draw.random()) for i in range(3000)]
    return spark.createDataFrame(made, "id bigint, user_id bigint, name string, score double").repartition(7).cache()


def order():
    return [F.desc("score"), "id"]


@pytest.fixture(scope="module")
def by_user(spark, rows, tmp_path_factory):
    path, key = str(tmp_path_factory.mktemp("rank")), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # as many ranges as the settings say, though they are small
    ri.build_rank_index(rows, path, order(), ["user_id"])
    spark.conf.unset(key)
    return path


@pytest.mark.parametrize("user", [1, 2, None, 99])
def test_as_offset_and_limit(spark, rows, by_user, user):
    want = rows.filter(F.col("user_id").eqNullSafe(F.lit(user))).orderBy(*order()).collect()
    for limit, offset in ((10, 7), (1, 1400), (2000, 3), (0, 5), (5, 10**12), (400, 150)):
        assert ri.page(spark, by_user, limit, offset, user_id=user).collect() == want[offset:offset + limit]
    assert ri.group_size(spark, by_user, user_id=user).first().total == rows.filter(
        F.col("user_id").eqNullSafe(F.lit(user))).count()


def test_without_a_group(spark, rows, tmp_path):
    path = str(tmp_path / "rank")
    for _ in range(2):
        ri.build_rank_index(rows, path, ["name", F.desc("id")])
    want = rows.orderBy("name", F.desc("id")).collect()
    for limit, offset in ((50, 1490), (10, 2995), (3000, 0)):
        assert ri.page(spark, path, limit, offset).collect() == want[offset:offset + limit]


def test_a_page_reads_the_ranges_that_hold_it(spark, rows, by_user):
    files = spark.read.parquet(f"{by_user}/{ri.ROWS}").inputFiles()
    assert len(files) >= 6
    for offset in (0, 700, 1400):
        plan = ri.page(spark, by_user, 10, offset, user_id=1)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*_range", plan)
        read = spark.read.parquet(f"{by_user}/{ri.RANGES}").filter(
            (F.col("user_id") == 1) & (F.col("_before") < offset + 10) & (F.col("_before") + F.col("_n") > offset)).count()
        assert read <= 2


def test_odd_tables(spark, rows, tmp_path):
    path = str(tmp_path / "rank")
    ri.build_rank_index(rows.limit(0), path, ["id"])
    assert ri.page(spark, path, 10).collect() == [] and ri.group_size(spark, path).first().total == 0
    with pytest.raises(ValueError):
        ri.page(spark, path, -1)
    with pytest.raises(ValueError):
        ri.build_rank_index(rows.withColumn("_at", F.lit(1)), path, ["id"])
