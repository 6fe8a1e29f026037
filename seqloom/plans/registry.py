"""The query registry, and what several packs of queries say about the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seqloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: One letter for each event type: token strings for byte-wise and code-point distances alike.
CODE = "substr(event_type, 1, 1)"
SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
ORDER = ["ts", "event_id"]
#: Event streams with their 1-based places.
STREAM = f"SELECT event_id, user_id, ts, {SECONDS} AS s, value, {CODE} AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"
#: Lower-case ASCII words of a text column c.
FOLD = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def seconds() -> Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("tok", F.expr("substr(event_type, 1, 1)"))


def numbered(spark, d) -> DataFrame:
    return events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)))


def joined(tokens: str, order: str = "i") -> Column:
    """The tokens of a group as one string, in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, tokens))), lambda x: x[tokens]), "")


def listed(tokens: str, order: str = "i") -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(order, tokens))), lambda x: x[tokens])
