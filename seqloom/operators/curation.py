"""Corpus curation: label joins, verdict precedence, splits, quality buckets, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def join_labels(rows: DataFrame, reference: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) rows against a reference with one row a key."""
    return rows.join(reference, on), rows.join(reference, on, "left_anti")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet written: append them to ``done`` for an idempotent sink."""
    return rows.join(done.select(key), key, "left_anti")


def apply_verdicts(rows: DataFrame, key: str, label: str, keep: DataFrame, discard: DataFrame, relabel: DataFrame, suspect: Column) -> DataFrame:
    """Human verdicts over machine flags: keep and relabel protect a row, discard and unprotected suspects
    go, relabel replaces the label. ``relabel`` has (key, new_label); the others (key)."""
    marks = (
        rows.join(keep.select(key).distinct().withColumn("_keep", F.lit(True)), key, "left")
        .join(discard.select(key).distinct().withColumn("_discard", F.lit(True)), key, "left")
        .join(relabel.select(key, "new_label"), key, "left")
    )
    protected = F.coalesce("_keep", F.lit(False)) | F.col("new_label").isNotNull()
    gone = (F.coalesce("_discard", F.lit(False)) | suspect) & ~protected
    return marks.where(~gone).withColumn(label, F.coalesce("new_label", F.col(label))).drop("_keep", "_discard", "new_label")


def buckets(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """An ordered cascade: the first rule that holds names the bucket."""
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def completeness(rows: DataFrame, expected: DataFrame, key: str, value: str, wanted: str) -> DataFrame:
    """Distinct values a key against the expected number: complete, partial or missing."""
    have = rows.groupBy(key).agg(F.count_distinct(value).alias("have"))
    both = expected.join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return both.withColumn("verdict", F.when(F.col("have") >= F.col(wanted), "complete").when(F.col("have") > 0, "partial").otherwise("missing"))


def union_all(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def parse_ranges(df: DataFrame, text: str) -> DataFrame:
    """'112:1-4 113:1' -> one row for each key (first, second)."""
    part = df.withColumn("_p", F.explode(F.split(F.trim(F.col(text)), r"\s+")))
    first = F.regexp_extract("_p", r"^(\d+):", 1).cast("int")
    low = F.regexp_extract("_p", r":(\d+)", 1).cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract("_p", r"-(\d+)$", 1), F.lit("")).cast("int"), low)
    return part.withColumn("first", first).withColumn("second", F.explode(F.sequence(low, high))).drop("_p")


def as_of(rows: DataFrame, marks: DataFrame, at: Column, start: str, value: str, keys: list[str]) -> DataFrame:
    """The value of the mark with the greatest start at or below ``at``.

    One sorted pass over rows and marks together (a window with the last mark seen), so no pair of a row
    and a mark is ever made."""
    left = rows.select(*[F.col(c) for c in rows.columns], at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"))
    right = marks.select(*[F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.col(start).cast(left.schema["_at"].dataType).alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_kind = 1").drop("_at", "_kind", "_value")


def not_among(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is none of ``values``; rows without a value stay."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(values))


def valid_file(size: Column, magic: Column, known: list[str], duration: Column, expected: Column) -> Column:
    """Large enough, a known beginning and a duration within max(10 s, 5 %) of the expected one."""
    begins = F.lit(False)
    for beginning in known:
        begins = begins | F.startswith(magic, F.lit(beginning))
    return (size >= 1024) & begins & (F.abs(duration - expected) <= F.greatest(F.lit(10.0), 0.05 * expected))


def covering(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """(key, at, n): how many spans of a key cover each row of ``points``, ends included; points that repeat give a row each.

    Starts add one and ends take one away in a single sorted pass, so no pair of a point and a span is made."""
    opened = spans.select(key, F.col(start).alias(at), F.lit(0).alias("_kind"), F.lit(1).alias("_step"))
    closed = spans.select(key, F.col(end).alias(at), F.lit(2).alias("_kind"), F.lit(-1).alias("_step"))
    asked = points.select(key, at, F.lit(1).alias("_kind"), F.lit(0).alias("_step"))
    w = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return opened.unionByName(closed).unionByName(asked).withColumn("n", F.sum("_step").over(w)).where("_kind = 1").select(key, at, "n")


def running_total(rows: DataFrame, key: str, value: str, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` over all rows up to this one in the order of the unique ``key``.

    Ranges of the key are summed apart; only their sums, one row a range, are added up in one place. A row's range follows from
    its key and fixed bounds alone: a partition's number is not the same in two branches of a plan once partitions are coalesced. ``keys`` may hold the keys where ``rows`` cost more to compute."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = (rows if keys is None else keys).select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges)).first()[0] or []
    part = F.lit(0)
    for bound in sorted(set(bounds)):
        part = part + F.coalesce((F.col(key) > F.lit(bound)).cast("int"), F.lit(0))
    ranged = rows.withColumn("_part", part)
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.withColumn("_before", F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("total", F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")
