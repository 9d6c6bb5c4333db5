"""A named query: how to run it on a folder of tables, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


class QuerySet(dict):
    """Queries of one area; ``add`` registers a function under its own name."""

    def add(self, sql: str | None = None) -> Callable[[Run], Run]:
        def register(run: Run) -> Run:
            if run.__name__ in self:
                raise ValueError(f"query {run.__name__} exists")

            def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
                # the tables hold times without a zone; operators compare them as UTC instants
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return plain_times(run(spark, sf_dir))

            self[run.__name__] = Query(in_utc, sql)
            return run
        return register


def plain_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the SQL side has them."""
    if not any(kind == "timestamp" for _, kind in df.dtypes):
        return df
    return df.select(*[
        F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
        for name, kind in df.dtypes])
