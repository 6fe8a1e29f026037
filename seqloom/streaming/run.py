"""Steppers over whole tables and over streams, and event-time windows with watermarks.

In both runs one stream's rows are stepped in order; memory holds one state, not one stream's rows. A fold in
order is sequential within a stream by its nature, so the longest stream bounds the slowest task.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from seqloom.streaming.steppers import Stepper


def fold(df: DataFrame, stream: str, order: list[str], stepper: Stepper, flush: bool = True) -> DataFrame:
    """(stream, at: the 0-based row that caused it, outputs) of all streams of a table.

    What ``finish`` says comes with ``at`` = the number of rows. Rows with a null stream go.
    """
    columns = [c.split()[0] for c in stepper.schema.split(", ")]
    kind = dict(df.dtypes)[stream]

    def run(frames):
        now, state, at = None, None, 0
        for frame in frames:
            out: list[tuple] = []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if state is None or row[stream] != now:
                    if state is not None and flush:
                        out += [(now, at, *x) for x in stepper.finish(state)]
                    now, state, at = row[stream], stepper.start(), 0
                out += [(now, at, *x) for x in stepper.step(state, row)]
                at += 1
            yield pd.DataFrame(out, columns=[stream, "at", *columns])
        if state is not None and flush:
            yield pd.DataFrame([(now, at, *x) for x in stepper.finish(state)], columns=[stream, "at", *columns])

    dealt = df.where(F.col(stream).isNotNull()).repartition(stream).sortWithinPartitions(stream, *order)
    return dealt.mapInPandas(run, f"{stream} {kind}, at bigint, {stepper.schema}")


def follow(df: DataFrame, stream: str, order: list[str], stepper: Stepper, idle: str | None = None) -> DataFrame:
    """``fold`` of an unbounded table; rows of one micro-batch are put in order first.

    With ``idle`` (such as "10 minutes") a stream that was silent so long is finished and forgotten.
    """
    columns = [c.split()[0] for c in stepper.schema.split(", ")]
    kind = dict(df.dtypes)[stream]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key, frames, held):
        if held.hasTimedOut:
            at, state = held.get
            out = [(key[0], at, *x) for x in stepper.finish(json.loads(state))]
            held.remove()
        else:
            at, state = held.get if held.exists else (0, None)
            state, out = json.loads(state) if state else stepper.start(), []
            rows = pd.concat(list(frames)).sort_values(order, kind="stable")
            for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                out += [(key[0], at, *x) for x in stepper.step(state, row)]
                at += 1
            held.update((at, json.dumps(state)))
            if idle:
                held.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[stream, "at", *columns])

    grouped = df.where(F.col(stream).isNotNull()).groupBy(stream)
    return grouped.applyInPandasWithState(run, f"{stream} {kind}, at bigint, {stepper.schema}", "at bigint, state string", "append", timeout)


def hopping_counts(df: DataFrame, time: str, keys: list[str], width: str, hop: str, late: str) -> DataFrame:
    """Rows a hopping window and key; windows close when the watermark, ``late`` behind, has passed them."""
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if df.isStreaming else timed
    return timed.groupBy(F.window(time, width, hop).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("w0"), F.col("w.end").alias("w1"), "n")


def silent_sessions(df: DataFrame, time: str, stream: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream, ended by ``gap`` of silence."""
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if df.isStreaming else timed
    return timed.groupBy(F.session_window(time, gap).alias("w"), stream).agg(F.count("*").alias("n")).select(stream, F.col("w.start").alias("s0"), F.col("w.end").alias("s1"), "n")
