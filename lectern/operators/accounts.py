"""Accounts and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADMIN_ROLE = 1
BEARER = "Bearer "


def resolve_accounts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """User id for each request(request_id, account) by email, mobile or user name.

    Several users may share an account text; the lowest id wins. An empty account is an error.
    The three columns become one key column, so the OR of the lookup is a plain equi-join, and the
    key side is reduced to one row per text first.
    """
    by_text = (
        users.select("id", F.explode(F.array_distinct(
            F.array("email", "mobile", "user_name"))).alias("account"))
        .filter(F.col("account") != "")
        .groupBy("account").agg(F.min("id").alias("user_id")))
    return requests.join(by_text, "account", "left").select(
        *requests.columns, "user_id",
        F.when(F.coalesce(F.col("account"), F.lit("")) == "", F.lit("empty account"))
        .when(F.col("user_id").isNull(), F.lit("not found")).alias("error"))


def mask_users(users: DataFrame) -> DataFrame:
    return users.withColumn("credential", F.lit(""))


def tokens_for(users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens of the given users."""
    return tokens.join(users.select(F.col("id").alias("user_id")).distinct(), "user_id", "left_semi")


def delete_tokens(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    return tokens.join(ids.select("id"), "id", "left_anti")


def authorize_requests(log: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome per request of log(request_id, authorization, admin_route): ok, unauthorized, forbidden.

    Tokens and users are joined first, so the log is shuffled once. Requests without a token get a
    key of their own that matches nothing; as NULL keys they would all meet in one partition.
    """
    holders = tokens.join(
        users.select(F.col("id").alias("user_id"), "role_id"), "user_id", "inner"
    ).select(F.col("api_key").alias("token"), "user_id", "role_id")
    given = F.when(F.startswith(F.col("authorization"), F.lit(BEARER)),
                   F.nullif(F.substr(F.col("authorization"), F.lit(len(BEARER) + 1)), F.lit("")))
    keyed = log.withColumn(
        "token", F.coalesce(given, F.concat(F.lit("\x00none "), F.col("request_id"))))
    return keyed.join(holders, "token", "left").select(
        *log.columns, "user_id",
        F.when(F.col("user_id").isNull(), F.lit("unauthorized"))
        .when(F.col("admin_route") & (F.coalesce(F.col("role_id"), F.lit(0)) != ADMIN_ROLE),
              F.lit("forbidden"))
        .otherwise(F.lit("ok")).alias("outcome"))


def missing_tokens(users: DataFrame, tokens: DataFrame, salt: str) -> DataFrame:
    """New 40-character keys for the users that have no token."""
    return users.select(F.col("id").alias("user_id")).join(
        tokens.select("user_id"), "user_id", "left_anti"
    ).select("user_id", F.sha1(F.concat(F.col("user_id").cast("string"), F.lit(salt))).alias("api_key"))
