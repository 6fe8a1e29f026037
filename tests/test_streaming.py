"""Hand traces of the state machines; a streamed run says what the batch fold says."""

import pytest
from pyspark.sql import functions as F

from seqloom.plans import catalog
from seqloom.streaming import run, steppers

SF = "/root/testdata/sf0.001"


def trace(stepper, rows):
    state, out = stepper.start(), []
    for row in rows:
        out += stepper.step(state, row)
    return out, stepper.finish(state)


def test_segmenter():
    s = steppers.Segmenter({"a": "b", "b": "c"})
    rows = [("x", 0.9), ("a", 0.1), ("a", 0.2), ("b", 0.3), ("z", 0.1), ("b", 0.1), ("z", 0.1), ("y", 0.1), ("y", 0.2), (None, 0.0)]
    out, _ = trace(s, [{"key": k, "cost": c} for k, c in rows])
    assert out == [("detect", "a", 0.1), ("advance", "b", 0.3), ("jump", "y", 0.2)]


def test_commit():
    sure = [{"key": k, "margin": m} for k, m in [("a", 0.2), ("a", 0.1), ("a", 0.2), ("a", 0.2), ("b", 0.3), ("b", 0.3), (None, 1.0), ("b", 0.3), ("b", 0.3), ("b", 0.3)]]
    assert trace(steppers.Commit(0.15, 2, 3), sure)[0] == [("a",), ("b",)]


@pytest.mark.parametrize("units, chain, tail", [
    (["1#1", "1#2", "1#4"], ["1#1", "1#2", "1#4"], []),  # the first waits for the second
    (["1#1", "9", "1#2"], ["1#1", "1#2"], []),  # one stranger between is tolerated
    (["1#1", "1#2", "1#1", "1#2"], ["1#1", "1#2"], []),  # repeats go
    (["5", "6", "7", "5"], [], ["7"]),  # nothing supported: the oldest that still waits
    (["1#1", "1#2", "2", "3"], ["1#1", "1#2", "2", "3"], []),  # across parents by the successor table
])
def test_assemble(units, chain, tail):
    def unit(u):
        return (u.split("#")[0], int(u.split("#")[1]) if "#" in u else None)

    out, rest = trace(steppers.Assemble({"1#2": "2", "2": "3"}), [dict(zip(("parent", "place"), unit(u))) for u in units])
    assert out == [unit(u) for u in chain] and rest == [unit(u) for u in tail]


def test_merge():
    rows = [("a", 0.2, None, None), ("a", 0.1, "c", 0.5), ("z", 0.1, "d", 0.4), ("z", 0.3, "y", 0.3), (None, None, "a", 0.0)]
    columns = ("sliding_key", "sliding_cost", "stream_key", "stream_cost")
    out, _ = trace(steppers.Merge({"a": "b", "c": "d"}, 3), [dict(zip(columns, r)) for r in rows])
    assert out == [("detect", "a", "sliding"), ("jump", "c", "stream"), ("advance", "d", "stream"), ("jump", "z", "sliding"), ("jump", "a", "stream")]


@pytest.mark.parametrize("said, last", [
    ("a b", (["b"], [], None, "b")),  # the key before tells the look-alikes apart
    ("b", ([], ["b", "y"], "await_successor", None)),
    ("y c", (["b", "c"], [], None, "c")),  # heard as y, known as b by what follows
    ("b q", (["q"], [], None, "q")),  # nothing told them apart; the next sure key goes on
    ("m", ([], ["m", "n"], "needs_choice", None)),  # one has no successor
    ("m !n", (["n"], [], None, "n")),
    ("m !b", ([], ["m", "n"], "needs_choice", None)),  # not among the options
    ("b c m", ([], ["m", "n"], "needs_choice", "c")),
])
def test_highlight(said, last):
    s = steppers.Highlight({"b": ["b", "y"], "y": ["b", "y"], "m": ["m", "n"], "n": ["m", "n"]}, {"b": "a", "y": "x"}, {"b": "c", "y": "z", "m": "o"})
    rows = [{"action": "choose" if k[0] == "!" else "detect", "key": k.lstrip("!")} for k in said.split()]
    assert trace(s, rows)[0][-1] == last


def streamed(spark, df, tmp_path, plan, mode="append"):
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = plan(source).writeStream.format("memory").queryName("seen").outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(tuple, spark.table("seen").collect()), key=str)


@pytest.mark.parametrize("stepper", [steppers.Segmenter(catalog.AFTER), steppers.Commit(0.02, 2, 3)])
def test_stream_equals_batch(spark, tmp_path, stepper):
    df = catalog._ranked(spark, SF).where("user_id < 20").withColumn("ts", F.col("ts").cast("string"))
    want = sorted(map(tuple, run.fold(df, "user_id", ["ts", "event_id"], stepper).collect()), key=str)
    assert want and streamed(spark, df, tmp_path, lambda s: run.follow(s, "user_id", ["ts", "event_id"], stepper)) == want


def test_windows_on_streams(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).where("user_id < 5")
    want = sorted(map(tuple, run.hopping_counts(df, "ts", ["user_id"], "2 hours", "1 hour", "1 hour").collect()), key=str)
    assert streamed(spark, df, tmp_path, lambda s: run.hopping_counts(s, "ts", ["user_id"], "2 hours", "1 hour", "1 hour"), "complete") == want
