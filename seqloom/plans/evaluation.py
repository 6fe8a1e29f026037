"""Evaluation and analysis over windows, references and their outcomes."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from seqloom.functions import distances
from seqloom.plans.registry import STREAM, joined, listed, numbered, query
from seqloom.plans.scoring import letters

_HEAD = f"SELECT user_id, string_agg(tok, '' ORDER BY i) AS ref FROM ({STREAM}) WHERE i <= 8 GROUP BY user_id"
_HEARD = f"SELECT user_id, string_agg(tok, '' ORDER BY i) AS heard FROM (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY i) AS p FROM ({STREAM})) WHERE i <= 10 AND (p IS NULL OR p <> tok) GROUP BY user_id"
_PAIRS = f"SELECT user_id, ref, heard, levenshtein(heard, ref) AS dist FROM ({_HEAD}) JOIN ({_HEARD}) USING (user_id)"


def _pairs(spark, d):
    """(user_id, ref, heard, dist): a truth of eight tokens and what was heard of it."""
    t = numbered(spark, d).withColumn("p", F.lag("tok").over(Window.partitionBy("user_id").orderBy("i")))
    ref = t.where("i <= 8").groupBy("user_id").agg(joined("tok").alias("ref"))
    heard = t.where("i <= 10 and (p is null or p <> tok)").groupBy("user_id").agg(joined("tok").alias("heard"))
    return ref.join(heard, "user_id").withColumn("dist", F.levenshtein("heard", "ref"))


@query(f"SELECT count(*) AS n, round(sum(dist)::DOUBLE / sum(length(ref)), 9) AS error_rate, count(*) FILTER (dist = 0) AS exact FROM ({_PAIRS})")
def corpus_error_rate(spark, d):
    """A17, EV1: errors over all tokens, not a mean of rates; exact sequences."""
    return _pairs(spark, d).agg(F.count("*").alias("n"), F.round(F.sum("dist") / F.sum(F.length("ref")), 9).alias("error_rate"), F.count_if(F.col("dist") == 0).alias("exact"))


_STEPS = f"SELECT user_id, i, n, tok = truth AS hit, run, tok, truth FROM (SELECT *, first_value(tok) OVER w AS truth, count(*) OVER (PARTITION BY user_id) AS n, tok = lag(tok) OVER w AS run FROM ({STREAM}) WINDOW w AS (PARTITION BY user_id ORDER BY i))"


@query(f"""
WITH u AS (SELECT user_id, bool_or(hit AND i = n) AS top1, bool_or(hit AND i > n - 3) AS top3, min(i) FILTER (hit AND i > 1)::DOUBLE / max(n) AS ttd, arg_min(tok, i) FILTER (run) AS committed, max(truth) AS truth FROM ({_STEPS}) GROUP BY user_id)
SELECT count(*) AS n, count(*) FILTER (top1) AS top1, count(*) FILTER (top3) AS top3, round(avg(ttd), 6) AS ttd, count(committed) AS committed, count(*) FILTER (committed <> truth) AS false_commits FROM u
""")
def accuracy_rollup(spark, d):
    """A14, EV2: top-1, top-3, time to detection, commits and false ones; a stream's first commit counts."""
    w = Window.partitionBy("user_id")
    t = numbered(spark, d).withColumns({"truth": F.first("tok").over(w.orderBy("i")), "n": F.count("*").over(w), "run": F.col("tok") == F.lag("tok").over(w.orderBy("i"))})
    hit = F.col("tok") == F.col("truth")
    u = t.groupBy("user_id").agg(
        F.bool_or(hit & (F.col("i") == F.col("n"))).alias("top1"), F.bool_or(hit & (F.col("i") > F.col("n") - 3)).alias("top3"),
        (F.min(F.when(hit & (F.col("i") > 1), F.col("i"))) / F.max("n")).alias("ttd"), F.min(F.when(F.col("run"), F.struct("i", "tok")))["tok"].alias("committed"), F.max("truth").alias("truth"),
    )
    return u.agg(F.count("*").alias("n"), F.count_if("top1").alias("top1"), F.count_if("top3").alias("top3"), F.round(F.avg("ttd"), 6).alias("ttd"), F.count("committed").alias("committed"), F.count_if(F.col("committed") != F.col("truth")).alias("false_commits"))


_ARMS = f"SELECT 'raw' AS arm, user_id, ref, substr(ref, 1, 6) AS said FROM ({_HEAD}) UNION ALL SELECT 'heard', user_id, ref, heard FROM ({_PAIRS})"


@query(f"SELECT arm, count(*) AS n, round(sum(levenshtein(said, ref))::DOUBLE / sum(length(ref)), 9) AS error_rate, count(*) FILTER (said = ref) AS exact FROM ({_ARMS}) GROUP BY arm")
def chain_ablation(spark, d):
    """EV4: two arms over the same truth."""
    arms = _arms(spark, d)
    return arms.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.sum(F.levenshtein("said", "ref")) / F.sum(F.length("ref")), 9).alias("error_rate"), F.count_if(F.col("said") == F.col("ref")).alias("exact"))


def _arms(spark, d):
    pairs = _pairs(spark, d)
    return pairs.select(F.lit("raw").alias("arm"), "user_id", "ref", F.substring("ref", 1, 6).alias("said")).unionByName(pairs.select(F.lit("heard").alias("arm"), "user_id", "ref", F.col("heard").alias("said")))


@query(f"SELECT arm, least(k, 4) AS position, count(*) AS n, count(*) FILTER (substr(said, k, 1) = substr(ref, k, 1)) AS hits FROM ({_ARMS}), generate_series(1, 8) g(k) WHERE k <= length(ref) GROUP BY arm, least(k, 4)")
def positional_accuracy(spark, d):
    """EV4: hits by position, those from the fourth on together."""
    k = F.explode(F.sequence(F.lit(1), F.length("ref"))).alias("k")
    t = _arms(spark, d).select("arm", "ref", "said", k)
    same = F.expr("substr(said, k, 1) = substr(ref, k, 1)")
    return t.groupBy("arm", F.least(F.col("k"), F.lit(4)).alias("position")).agg(F.count("*").alias("n"), F.count_if(same).alias("hits"))


@query(f"SELECT arm, first, count(*) AS n, median(ttd) AS ttd FROM (SELECT 'whole' AS arm, i <= 20 AS first, i % 20 AS ttd FROM ({STREAM}) WHERE tok = 'p' UNION ALL SELECT 'segment', i <= 5, i % 5 FROM ({STREAM}) WHERE tok = 'p') GROUP BY arm, first")
def unit_ablation(spark, d):
    """EV6: hits and the median delay by size of the unit, first units and later ones apart."""
    p = numbered(spark, d).where("tok = 'p'")
    arms = [p.select(F.lit(name).alias("arm"), (F.col("i") <= size).alias("first"), (F.col("i") % size).alias("ttd")) for name, size in (("whole", 20), ("segment", 5))]
    return arms[0].unionByName(arms[1]).groupBy("arm", "first").agg(F.count("*").alias("n"), F.median("ttd").alias("ttd"))


@query(f"SELECT CASE WHEN dist = 0 THEN 'exact' WHEN dist <= 2 THEN 'near' WHEN dist <= 4 THEN 'close' ELSE 'other' END AS miss, count(*) AS n FROM ({_PAIRS}) GROUP BY 1")
def miss_classes(spark, d):
    """EV7: misses by how far they are off."""
    miss = F.when(F.col("dist") == 0, "exact").when(F.col("dist") <= 2, "near").when(F.col("dist") <= 4, "close").otherwise("other")
    return _pairs(spark, d).groupBy(miss.alias("miss")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max(fires) FILTER (threshold = 10) AS at_ten, max(fires) AS best, min(threshold) FILTER (fires = most) AS at FROM (SELECT *, max(fires) OVER (PARTITION BY user_id) AS most FROM (SELECT user_id, threshold, count(*) FILTER (value <= threshold) - 2 * count(*) FILTER (value <= threshold / 2.0) AS fires FROM events, (VALUES (2), (5), (10), (20), (40)) g(threshold) GROUP BY user_id, threshold)) GROUP BY user_id")
def cost_sweep(spark, d):
    """EV10: a session's outcome at every threshold, the best one and the headroom over a fixed one."""
    from seqloom.runtime import table

    grid = spark.createDataFrame([(t,) for t in (2, 5, 10, 20, 40)], "threshold int")
    e = table(spark, d, "events").select("user_id", "value").crossJoin(F.broadcast(grid))  # five settings
    fires = e.groupBy("user_id", "threshold").agg((F.count_if(F.col("value") <= F.col("threshold")) - 2 * F.count_if(F.col("value") <= F.col("threshold") / 2)).alias("fires"))
    best = fires.groupBy("user_id").agg(F.max(F.when(F.col("threshold") == 10, F.col("fires"))).alias("at_ten"), F.max("fires").alias("best"), F.max(F.struct("fires", -F.col("threshold"))).alias("b"))
    return best.select("user_id", "at_ten", "best", (-F.col("b")["col2"]).alias("at"))


@query(f"""
WITH a AS (SELECT user_id, tok, min(value) AS cost FROM ({STREAM}) GROUP BY user_id, tok), t AS (SELECT user_id, tok AS truth FROM ({STREAM}) WHERE i = 1)
SELECT a.user_id, count(*) FILTER (cost <= 5 AND tok = truth) AS hits, count(*) FILTER (cost <= 5 AND tok <> truth) AS extras, count(*) FILTER (cost + CASE WHEN tok IN ('c', 'v') THEN 0 ELSE 3 END <= 5 AND tok = truth) AS page_hits, count(*) FILTER (cost + CASE WHEN tok IN ('c', 'v') THEN 0 ELSE 3 END <= 5 AND tok <> truth) AS page_extras FROM a JOIN t ON t.user_id = a.user_id GROUP BY a.user_id
""")
def page_prior_arms(spark, d):
    """EV11: hits and extras with and without a penalty for what is not on the page."""
    truth = F.first("tok").over(Window.partitionBy("user_id").orderBy("i"))
    a = numbered(spark, d).withColumn("truth", truth).groupBy("user_id", "truth", "tok").agg(F.min("value").alias("cost"))
    a = a.withColumn("paged", F.col("cost") + F.when(F.col("tok").isin("c", "v"), 0.0).otherwise(3.0))
    true, counted = F.col("tok") == F.col("truth"), lambda c, hit: F.count_if((F.col(c) <= 5) & hit)
    return a.groupBy("user_id").agg(counted("cost", true).alias("hits"), counted("cost", ~true).alias("extras"), counted("paged", true).alias("page_hits"), counted("paged", ~true).alias("page_extras"))


@query(f"SELECT tok, round(count(*) FILTER (nxt IS NOT NULL AND nxt <> tok)::DOUBLE / count(*), 6) AS kept FROM (SELECT tok, lead(tok) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM ({STREAM})) GROUP BY tok")
def suppression_ratio(spark, d):
    """EV12: occurrences in context over all."""
    nxt = F.lead("tok").over(Window.partitionBy("user_id").orderBy("i"))
    t = numbered(spark, d).withColumn("nxt", nxt)
    return t.groupBy("tok").agg(F.round(F.count_if(F.col("nxt").isNotNull() & (F.col("nxt") != F.col("tok"))) / F.count("*"), 6).alias("kept"))


@query("SELECT conv_id, min(turn) || '-' || max(turn) AS truth, CASE WHEN count(DISTINCT turn) = max(turn) - min(turn) + 1 THEN 'OK' WHEN count(DISTINCT turn) >= 0.5 * (max(turn) - min(turn) + 1) THEN 'PARTIAL' ELSE 'CHECK' END AS flag FROM conversations GROUP BY conv_id")
def session_proposals(spark, d):
    """EV13, A18: a label proposed from the hull of what was detected, flagged by its coverage."""
    from seqloom.runtime import table

    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("k"))
    span = F.col("hi") - F.col("lo") + 1
    return g.select("conv_id", F.concat_ws("-", "lo", "hi").alias("truth"), F.when(F.col("k") == span, "OK").when(F.col("k") >= 0.5 * span, "PARTIAL").otherwise("CHECK").alias("flag"))


@query(f"SELECT truth, said, count(*) AS n FROM (SELECT tok AS truth, coalesce(lead(tok) OVER (PARTITION BY user_id ORDER BY i), '-') AS said FROM ({STREAM})) GROUP BY truth, said")
def confusion_report(spark, d):
    """EV14: truths against answers."""
    said = F.coalesce(F.lead("tok").over(Window.partitionBy("user_id").orderBy("i")), F.lit("-"))
    return numbered(spark, d).select(F.col("tok").alias("truth"), said.alias("said")).groupBy("truth", "said").agg(F.count("*").alias("n"))


@query()
def in_order_recall(spark, d):
    """EV9, E13, E14: truths recalled in order, by the longest common subsequence and greedily (held against brute force)."""
    t = _pairs(spark, d).select("user_id", letters("ref").alias("truth"), letters("heard").alias("heard"))
    return t.select("user_id", F.size("truth").alias("n"), distances.lcs_col(F.col("truth"), F.col("heard")).alias("lcs"), distances.in_order_hits_col(F.col("truth"), F.col("heard")).alias("greedy"))


@query(f"SELECT user_id, length(ref) - levenshtein(heard, ref) AS least_hits, dist AS errors FROM ({_PAIRS})")
def aligned_errors(spark, d):
    """EV5, E12: substitutions, deletions and insertions of the alignment add up to the distance."""
    t = _pairs(spark, d).select("user_id", letters("ref").alias("truth"), letters("heard").alias("heard"))
    done = t.select("user_id", F.size("truth").alias("n"), distances.edit_ops_col(F.col("truth"), F.col("heard")).alias("ops"))
    errors = F.size(F.filter("ops", lambda x: x["op"] != "hit"))
    return done.select("user_id", (F.col("n") - errors).cast("bigint").alias("least_hits"), errors.cast("bigint").alias("errors"))
