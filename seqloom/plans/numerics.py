"""Array numerics, maps and PCM bytes over event values."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from seqloom.functions import arrays
from seqloom.plans.registry import SECONDS, STREAM, listed, numbered, query
from seqloom.runtime import table
from seqloom.streaming import run, steppers

_VALUES = f"SELECT user_id, list(value / 100 ORDER BY i) AS x FROM ({STREAM}) GROUP BY user_id"


def _values(spark, d):
    return numbered(spark, d).withColumn("v", F.col("value") / 100).groupBy("user_id").agg(listed("v").alias("x"))


@query(f"SELECT user_id, round(list_aggregate(y, 'max'), 6) AS top, round(list_aggregate(y, 'sum'), 5) AS total FROM (SELECT user_id, list_transform(x, lambda v: least(1.0::DOUBLE, greatest(-1.0::DOUBLE, v * 0.1::DOUBLE / r))) AS y FROM (SELECT user_id, x, sqrt(list_aggregate(list_transform(x, lambda v: v * v), 'sum') / len(x)) AS r FROM ({_VALUES})))")
def level_normalized(spark, d):
    """Samples at one level, clamped."""
    y = arrays.normalized(F.col("x"), 0.1)
    return _values(spark, d).select("user_id", F.round(F.array_max(y), 6).alias("top"), F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"SELECT user_id, count(*) AS n, round(sum(x[l + 1] + (p - l) * (x[least(len(x), l + 2)] - x[l + 1])), 5) AS total FROM (SELECT user_id, x, p, CAST(floor(p) AS BIGINT) AS l FROM (SELECT user_id, x, unnest(generate_series(0, CAST(floor((len(x) - 1) / 1.5::DOUBLE) AS BIGINT))) * 1.5::DOUBLE AS p FROM ({_VALUES}))) GROUP BY user_id")
def linear_resample(spark, d):
    """D3: values between samples."""
    y = arrays.resampled(F.col("x"), 1.5)
    return _values(spark, d).select("user_id", F.size(y).cast("bigint").alias("n"), F.round(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"SELECT user_id, round(max(e) / sum(e), 4) AS top FROM (SELECT user_id, exp(v - max(v) OVER (PARTITION BY user_id)) AS e FROM (SELECT user_id, value / 100 AS v FROM ({STREAM}) WHERE i <= 5)) GROUP BY user_id")
def softmax_top(spark, d):
    """The largest probability, to four places."""
    return _values(spark, d).select("user_id", F.round(F.array_max(arrays.softmax(F.slice("x", 1, 5))), 4).alias("top"))


@query("SELECT n_nationkey, round(CASE WHEN s < 500 THEN 0.001::DOUBLE * s / 500 ELSE 0.0005::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (s - 500) / 1500.0::DOUBLE))) END, 9) AS rate FROM (SELECT n_nationkey, n_nationkey * 100 AS s FROM nation)")
def learning_rates(spark, d):
    """Warm-up, then a cosine."""
    return table(spark, d, "nation").select("n_nationkey", F.round(arrays.cosine_rate(F.col("n_nationkey") * 100, 500, 2000, 0.001), 9).alias("rate"))


@query(f"WITH s AS (SELECT user_id, string_agg(tok, '' ORDER BY i) AS s FROM ({STREAM}) GROUP BY user_id) SELECT user_id, rpad(s, CAST((SELECT max(length(s)) FROM s) AS INTEGER), '-') AS padded, substr(s, 2, 3) AS part FROM s")
def collated(spark, d):
    """M1: slices, and arrays padded to the longest one."""
    w = numbered(spark, d).groupBy("user_id").agg(listed("tok").alias("w"))
    most = w.agg(F.max(F.size("w")).alias("most"))
    both = w.crossJoin(F.broadcast(most))  # one row
    return both.select("user_id", F.array_join(arrays.padded(F.col("w"), F.col("most"), F.lit("-")), "").alias("padded"), F.array_join(F.slice("w", 2, 3), "").alias("part"))


@query(f"SELECT user_id, string_agg(tok || '=' || m, ',' ORDER BY tok) AS merged, count(DISTINCT m) AS values FROM (SELECT user_id, tok, CAST(floor(max(value)) AS BIGINT) AS m FROM ({STREAM}) GROUP BY user_id, tok) GROUP BY user_id")
def map_merge(spark, d):
    """M2: maps of two halves merged by the larger value, and inverted."""
    t = numbered(spark, d).withColumn("v", F.floor("value")).groupBy("user_id", "tok", (F.col("i") % 2).alias("half")).agg(F.max("v").alias("m"))
    half = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("half") == k, F.struct("tok", "m"))))
    maps = t.groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b")).select("user_id", arrays.merged_by_most(F.col("a"), F.col("b")).alias("m"))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("user_id", F.array_join(pairs, ",").alias("merged"), F.size(F.array_distinct(F.map_values("m"))).cast("bigint").alias("values"))


@query(f"SELECT user_id, max(k) AS shared FROM (SELECT a.user_id, k FROM (SELECT user_id, string_agg(tok, '' ORDER BY i) AS s FROM ({STREAM}) GROUP BY user_id) a JOIN (SELECT user_id - 1 AS user_id, string_agg(tok, '' ORDER BY i) AS t FROM ({STREAM}) GROUP BY user_id) b USING (user_id), generate_series(0, 200) g(k) WHERE k <= length(s) AND k <= length(t) AND substr(s, 1, k) = substr(t, 1, k)) GROUP BY user_id")
def shared_beginnings(spark, d):
    """The longest common prefix of a stream and the next one."""
    w = numbered(spark, d).groupBy("user_id").agg(listed("tok").alias("w"))
    other = w.select((F.col("user_id") - 1).alias("user_id"), F.col("w").alias("t"))
    return w.join(other, "user_id").select("user_id", arrays.common_prefix(F.col("w"), F.col("t")).alias("shared"))


_PCM = f"SELECT user_id, i, CAST(trunc(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, value / 50 - 0.5::DOUBLE)) * 32767) AS BIGINT) AS v FROM ({STREAM})"


@query(f"SELECT user_id, 16000 AS rate, count(*) AS n, sum(v) AS total FROM ({_PCM}) GROUP BY user_id")
def wav_roundtrip(spark, d):
    """Samples become 16-bit bytes, get a header if they have none, and are parsed again."""
    t = numbered(spark, d).withColumn("v", F.col("value") / 50 - 0.5).groupBy("user_id").agg(listed("v").alias("x"))
    wav = arrays.repaired(arrays.repaired(arrays.pcm16(F.col("x")), 16000), 16000)
    read = t.select("user_id", arrays.wav_samples(wav).alias("w"))
    whole = F.aggregate("w.samples", F.lit(0).cast("bigint"), lambda a, v: a + F.round(v * 32767).cast("bigint"))
    return read.select("user_id", "w.rate", F.size("w.samples").cast("bigint").alias("n"), whole.alias("total"))


@query(f"SELECT user_id, count(*) AS n, sum(v) AS total FROM ({_PCM}) WHERE i BETWEEN 5 AND 12 GROUP BY user_id")
def pcm_slices(spark, d):
    """A stretch of raw samples by seconds (here four samples a second, from 1 s for 2 s)."""
    t = numbered(spark, d).withColumn("v", F.col("value") / 50 - 0.5).groupBy("user_id").agg(listed("v").alias("x"))
    part = arrays.pcm_slice(arrays.pcm16(F.col("x")), F.lit(1), F.lit(2), 4)
    read = t.select("user_id", arrays.wav_samples(arrays.with_header(part, 4)).alias("w"))
    whole = F.aggregate("w.samples", F.lit(0).cast("bigint"), lambda a, v: a + F.round(v * 32767).cast("bigint"))
    return read.where(F.size("w.samples") > 0).select("user_id", F.size("w.samples").cast("bigint").alias("n"), whole.alias("total"))


@query("SELECT vec_id, len(embedding) AS n, round(list_aggregate(embedding, 'max')::DOUBLE, 5) AS top FROM embeddings")
def float_blobs(spark, d):
    """32-bit floats as bytes, loaded with a check of their size."""
    blob = arrays.as_floats32(F.col("embedding"))
    read = table(spark, d, "embeddings").select("vec_id", arrays.floats32(blob, 64).alias("x"))
    return read.select("vec_id", F.size("x").cast("bigint").alias("n"), F.round(F.array_max("x").cast("double"), 5).alias("top"))


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, i, value / 100 AS p FROM ({STREAM})), f(user_id, i, on_, quiet, said) AS (
SELECT user_id, i, p >= 0.2::DOUBLE, 0, CASE WHEN p >= 0.2::DOUBLE THEN 'start' END FROM t WHERE i = 1 UNION ALL
SELECT t.user_id, t.i, CASE WHEN p >= 0.2::DOUBLE THEN true WHEN on_ AND p < 0.05::DOUBLE AND quiet > 0 AND t.i - quiet >= 3 THEN false ELSE on_ END,
CASE WHEN p >= 0.2::DOUBLE THEN 0 WHEN on_ AND p < 0.05::DOUBLE AND quiet > 0 AND t.i - quiet >= 3 THEN 0 WHEN on_ AND p < 0.05::DOUBLE AND quiet = 0 THEN t.i ELSE quiet END,
CASE WHEN p >= 0.2::DOUBLE AND NOT on_ THEN 'start' WHEN on_ AND p < 0.05::DOUBLE AND quiet > 0 AND t.i - quiet >= 3 THEN 'end' END FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)
SELECT user_id, i - 1 AS at, said AS event FROM f WHERE said IS NOT NULL
""")
def speech_ends(spark, d):
    """A speech gate with hysteresis that closes after enough silence."""
    t = numbered(spark, d).select("user_id", "i", (F.col("value") / 100).alias("p"))
    return run.fold(t, "user_id", ["i"], steppers.SpeechGate(0.2, 0.15, 3)).select("user_id", "at", "event")


@query(f"SELECT user_id, i, CAST(CASE WHEN i <= 6 THEN 0 ELSE (i - 3) // 4 END AS BIGINT) AS chunk FROM ({STREAM})")
def settled_interior(spark, d):
    """Overlapping chunks of 8 rows every 4; of each only its settled inside is kept, the first one's beginning too."""
    t = numbered(spark, d).select("user_id", "i").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    starts = F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - 8 + 3) / 4).cast("int")), F.floor((F.col("i") - 1) / 4).cast("int"))
    chunks = t.withColumn("chunk", F.explode(starts)).withColumn("place", F.col("i") - 4 * F.col("chunk")).where("place between 1 and 8")
    kept = chunks.where("(place between 3 and 6) or (chunk = 0 and place <= 2)")
    return kept.select("user_id", "i", F.col("chunk").cast("bigint").alias("chunk"))
