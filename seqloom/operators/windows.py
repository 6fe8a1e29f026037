"""Ordered operators over token and span tables, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def collapse(df: DataFrame, stream: str, order: list[str], token: str, blank=None) -> DataFrame:
    """CTC-style greedy collapse: rows whose token differs from the one before and is not ``blank``."""
    before = F.lag(token).over(Window.partitionBy(stream).orderBy(*order))
    keep = before.isNull() | (F.col(token) != before)
    out = df.withColumn("_keep", keep).where("_keep").drop("_keep")
    return out if blank is None else out.where(F.col(token) != F.lit(blank))


def hop_windows(df: DataFrame, second: Column, width: int, hop: int) -> DataFrame:
    """One row for each hopping window [w0, w0 + width) that holds the row; seconds from the stream's start."""
    first = F.greatest(F.lit(0), F.ceil((second - F.lit(width) + 1) / F.lit(hop)) * F.lit(hop))
    last = F.floor(second / F.lit(hop)) * F.lit(hop)
    starts = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(hop).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("w0", F.explode(starts)).withColumn("w1", F.col("w0") + F.lit(width))


def sessions(df: DataFrame, stream: str, order: list[str], second: Column, gap: int) -> DataFrame:
    """``session``: 1, 2, ... within a stream, new after more than ``gap`` seconds of silence."""
    w = Window.partitionBy(stream).orderBy(*order)
    timed = df.withColumn("_s", second)
    return timed.withColumn("_new", F.coalesce((F.col("_s") - F.lag("_s").over(w) > gap).cast("int"), F.lit(1))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_new")


def islands(df: DataFrame, stream: str, order: list[str], value: str) -> DataFrame:
    """``island`` numbers runs of equal ``value``; ``run`` is the 1-based place in the run."""
    w = Window.partitionBy(stream).orderBy(*order)
    marked = df.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return marked.withColumn("run", F.row_number().over(Window.partitionBy(stream, "island").orderBy(*order)))


def first_commit(df: DataFrame, stream: str, order: list[str], leader: str, sure: Column, need: int) -> DataFrame:
    """The first row of each stream at which one leader has been sure ``need`` times in a row."""
    step = df.withColumn("_key", F.when(sure, F.col(leader).cast("string")).otherwise(F.lit("")))
    runs = islands(step, stream, order, "_key").where((F.col("_key") != "") & (F.col("run") >= need))
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(stream).orderBy(*order))).where("_n = 1").drop("_n", "_key", "island", "run")


def midpoint_cuts(df: DataFrame, group: str, order: list[str], start: str, end: str) -> DataFrame:
    """``cut_start``, ``cut_end``: neighbours meet halfway between one's end and the next one's start."""
    w = Window.partitionBy(group).orderBy(*order)
    left, right = F.lag(end).over(w), F.lead(start).over(w)
    return df.withColumn("cut_start", F.coalesce((left + F.col(start)) / 2, F.col(start))).withColumn("cut_end", F.coalesce((F.col(end) + right) / 2, F.col(end)))


def offsets(df: DataFrame, group: str, order: list[str], length: str) -> DataFrame:
    """``offset``: the lengths before, summed."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def merge_tiny(df: DataFrame, group: str, order: list[str], length: str, least: int) -> DataFrame:
    """``piece``: fragments shorter than ``least`` join the one before; a group's first fragment never does."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when((F.col(length) >= least) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def smooth_sandwich(df: DataFrame, stream: str, order: list[str], value: str) -> DataFrame:
    """Rows without consecutive repeats and without single values between two equal ones."""
    once = collapse(df, stream, order, value)
    w = Window.partitionBy(stream).orderBy(*order)
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    kept = once.withColumn("_odd", F.coalesce(left == right, F.lit(False))).where("not _odd").drop("_odd")
    return collapse(kept, stream, order, value)


def neighbours(df: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("before", F.lag(key).over(w)).withColumn("after", F.lead(key).over(w))


def ranked_split(df: DataFrame, unit: str, test: int = 3, val: int = 3) -> DataFrame:
    """``split`` by unit, without leakage: the last ``test`` units in order are test, the ``val`` before them val."""
    units = df.select(unit).where(F.col(unit).isNotNull()).distinct()
    ranked = units.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(unit))))  # over units, not rows
    split = F.when(F.col("_r") <= test, "test").when(F.col("_r") <= test + val, "val").otherwise("train")
    return df.join(ranked.select(unit, split.alias("split")), unit)


def split_at(df: DataFrame, stream: str, order: list[str], mark: Column) -> DataFrame:
    """``segment``: how many marks stand before a row; the marks go."""
    marked = df.withColumn("_mark", mark)
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("segment", F.sum(F.col("_mark").cast("int")).over(w)).where("not _mark").drop("_mark")


def energy_segments(df: DataFrame, stream: str, frame: str, loud: Column, gap: int, least: int, pad: int) -> DataFrame:
    """(stream, first, last): runs of loud frames; gaps of up to ``gap`` frames are closed, runs under ``least`` go, ``pad`` is added."""
    w = Window.partitionBy(stream).orderBy(frame)
    on = df.where(loud).select(stream, frame)
    new = F.coalesce((F.col(frame) - F.lag(frame).over(w) > gap + 1).cast("int"), F.lit(1))
    runs = on.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(stream, "_run").agg(F.min(frame).alias("first"), F.max(frame).alias("last")).where(F.col("last") - F.col("first") + 1 >= least)
    return spans.select(stream, F.greatest(F.lit(1), F.col("first") - pad).alias("first"), (F.col("last") + pad).alias("last"))


def greedy_runs(df: DataFrame, group: str, place: str, length: str, bad: Column, most: int) -> DataFrame:
    """``last_i`` for every row that is not bad: the furthest row up to which lengths add up to ``most`` and none is bad.

    Within a group ends rise with places, so the furthest end is the last one in a range frame over the running sum: no pairs."""
    w = Window.partitionBy(group).orderBy(place)
    sums = df.withColumn("_bad", bad).withColumn("_runs", F.sum(F.col("_bad").cast("int")).over(w)).withColumn("_end", F.sum(length).over(w))
    reach = Window.partitionBy(group, "_runs").orderBy("_end").rangeBetween(0, most)
    held = sums.withColumn("_ends", F.collect_list(F.struct("_end", place)).over(reach))  # as many as fit ``most``
    last = F.array_max(F.transform(F.filter("_ends", lambda x: x["_end"] - F.col("_end") + F.col(length) <= most), lambda x: x[place]))
    return held.where("not _bad").withColumn("last_i", last).drop("_bad", "_runs", "_end", "_ends")


def best_two(df: DataFrame, stream: str, order: list[str], value: str) -> DataFrame:
    """(stream, best, second): the values of the first two rows in order."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stream).orderBy(*order))).where("_r <= 2")
    return ranked.groupBy(stream).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("second"))
