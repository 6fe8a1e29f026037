"""Retrieval and scoring of windows against a lexicon: shortlists, page prior, black list, context, relabelling."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from seqloom.functions import distances
from seqloom.operators import retrieval
from seqloom.plans.registry import STREAM, events, numbered, query
from seqloom.streaming import run, steppers

_RUNS = f"SELECT user_id, i, tok FROM (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY i) AS p FROM ({STREAM})) WHERE p IS NULL OR p <> tok"
_WIN = f"SELECT user_id, string_agg(tok, '' ORDER BY i) AS win FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM ({_RUNS})) WHERE back <= 12 GROUP BY user_id"
_REF = f"SELECT user_id AS unit, string_agg(tok, '' ORDER BY i) AS ref FROM ({STREAM}) WHERE i <= 8 GROUP BY user_id"
_UNIT_GRAMS = f"SELECT DISTINCT unit, substr(ref, p, 3) AS gram FROM (SELECT unit, ref, unnest(generate_series(1, length(ref) - 2)) AS p FROM ({_REF}) WHERE length(ref) >= 3)"
_COUNTED = f"SELECT user_id, unit, count(*) AS cnt, min(pos) - 1 AS first_pos FROM (SELECT user_id, pos, substr(win, pos, 3) AS gram FROM (SELECT user_id, win, unnest(generate_series(1, length(win) - 2)) AS pos FROM ({_WIN}) WHERE length(win) >= 3)) JOIN ({_UNIT_GRAMS}) USING (gram) GROUP BY user_id, unit"
_RANKED = f"SELECT c.*, ref, win, row_number() OVER (PARTITION BY c.user_id ORDER BY cnt DESC, first_pos, c.unit) AS rr, row_number() OVER (PARTITION BY c.user_id ORDER BY cnt::DOUBLE / length(ref) DESC, first_pos, c.unit) AS sr FROM ({_COUNTED}) c JOIN ({_REF}) u ON u.unit = c.unit JOIN ({_WIN}) w ON w.user_id = c.user_id"


def letters(column: str):
    return F.filter(F.split(F.col(column), ""), lambda x: x != "")


def _windows(spark, d):
    from seqloom.plans.catalog import trailing_windows

    return trailing_windows(spark, d)


def _units(spark, d):
    from seqloom.plans.catalog import lexicon

    return lexicon(spark, d)


def shortlisted(spark, d):
    """(window, win, unit, ref, place): the candidates of every trailing window by shared 3-grams."""
    w, u = _windows(spark, d), _units(spark, d)
    near = F.broadcast(u) if u.count() <= retrieval.LEXICON_ROWS else u  # checked size: candidates are then shuffled by window only
    index = retrieval.postings(u.select("unit", letters("ref").alias("w")), "unit", "w")
    lengths = near.select("unit", F.length("ref").alias("len"), F.col("unit").alias("unit_ord"))
    short = retrieval.gram_shortlist(w.select("user_id", letters("win").alias("w")), "user_id", "w", index, lengths)
    place = F.when(F.col("raw_rank") <= 60, F.col("raw_rank")).otherwise(60 + F.col("scaled_rank"))
    return short.select("window", "unit", place.alias("place")).join(near, "unit").join(w.withColumnRenamed("user_id", "window"), "window")


@query(f"""
WITH s AS (SELECT *, CASE WHEN rr <= 60 THEN rr ELSE 60 + sr END AS place, unit % 10 = user_id % 10 AS on_page FROM ({_RANKED}) WHERE rr <= 60 OR sr <= 20),
f AS (SELECT * FROM s WHERE length(ref) >= 0.5::DOUBLE * length(win) AND length(ref) <= 1.3::DOUBLE * length(win) AND NOT (unit % 7 = 0 AND NOT on_page)),
c AS (SELECT user_id, unit, place, on_page, ref, win, min(levenshtein(ref, substr(win, i, j - i))) AS dist FROM (SELECT *, unnest(generate_series(1, length(win) + 1)) AS i FROM f) p, generate_series(1, 13) g(j) WHERE j >= i AND j <= length(win) + 1 GROUP BY user_id, unit, place, on_page, ref, win),
e AS (SELECT *, round(dist / length(ref)::DOUBLE + CASE WHEN on_page THEN 0 ELSE 0.08::DOUBLE END, 9) AS eff FROM c),
b AS (SELECT *, round(eff - 0.15::DOUBLE * least(length(ref), length(win)) / length(win), 9) AS blend FROM e)
SELECT "window", unit, eff, eff <= 0.3::DOUBLE AS fired FROM (SELECT user_id AS "window", unit, eff, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN eff <= 0.3::DOUBLE THEN 0 ELSE 1 END, CASE WHEN eff <= 0.3::DOUBLE THEN blend ELSE eff END, place, unit) AS r FROM b) WHERE r = 1
""")
def chain_best(spark, d):
    """Shortlist, length band, black list unless the page vouches, infix cost, off-page penalty, blended choice.

    A unit's page is its number modulo 10, as is a window's; every seventh unit is on the black list."""
    c = shortlisted(spark, d).withColumn("on_page", F.col("unit") % 10 == F.col("window") % 10).withColumn("blacklisted", F.col("unit") % 7 == 0)
    return retrieval.window_best(c)


_SLOTS = f"SELECT user_id, i, x FROM (SELECT user_id, i, unnest(CASE WHEN value < 20 AND nxt IS NOT NULL THEN [tok, nxt] ELSE [tok] END) AS x FROM (SELECT *, lead(tok) OVER (PARTITION BY user_id ORDER BY i) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM ({STREAM})) WHERE back <= 12)"


@query(f'SELECT user_id AS "window", unit, count(*) AS cnt FROM (SELECT DISTINCT a.user_id, a.i, unit FROM ({_SLOTS}) a JOIN ({_SLOTS}) b ON b.user_id = a.user_id AND b.i = a.i + 1 JOIN ({_SLOTS}) c ON c.user_id = a.user_id AND c.i = a.i + 2 JOIN ({_UNIT_GRAMS}) g ON gram = a.x || b.x || c.x) GROUP BY user_id, unit')
def expanded_counts(spark, d):
    """Where a token is unsure its second choice (here the next token) is looked up too; a position counts once a unit."""
    w = Window.partitionBy("user_id")
    t = numbered(spark, d).withColumn("nxt", F.lead("tok").over(w.orderBy("i"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("i")))).where("back <= 12")
    t = t.withColumn("second", F.when(F.col("value") < 20, F.col("nxt")))
    slots = F.sort_array(F.collect_list(F.struct("i", "tok", "second")))
    windows = t.groupBy("user_id").agg(slots.alias("s")).select("user_id", F.transform("s", lambda x: x["tok"]).alias("w"), F.transform("s", lambda x: x["second"]).alias("second"))
    index = retrieval.postings(_units(spark, d).select("unit", letters("ref").alias("w")), "unit", "w")
    return retrieval.expanded_counts(windows, "user_id", "w", "second", index).select("window", "unit", "cnt")


@query(f"""
SELECT event_id, round(CASE WHEN now IS NULL THEN 0 ELSE greatest(CASE WHEN unit - now BETWEEN 1 AND 2 THEN (0.22::DOUBLE + 0.05::DOUBLE * least(streak, 4)) * (1 - (unit - now - 1) / 3.0::DOUBLE) ELSE 0 END, CASE WHEN unit // 10 = now // 10 THEN 0.1::DOUBLE ELSE 0 END) END, 6) AS bonus
FROM (SELECT event_id, event_id % 50 AS unit, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY i) AS now, i % 7 AS streak FROM ({STREAM}))
""")
def context_bonuses(spark, d):
    """What the sequential context takes off a unit's cost."""
    t = numbered(spark, d).select("user_id", "event_id", "i", (F.col("event_id") % 50).alias("unit"))
    t = t.withColumn("now", F.lag("unit").over(Window.partitionBy("user_id").orderBy("i")))
    return t.select("event_id", F.round(retrieval.context_bonus(F.col("unit"), F.col("now"), F.col("i") % 7, 10), 6).alias("bonus"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value / 100 - CASE WHEN event_type = 'click' THEN 0.1::DOUBLE ELSE 0 END, 9), CAST(event_id AS VARCHAR), event_id % 10) AS place FROM events) WHERE place <= 5")
def context_rerank(spark, d):
    """O3: by adjusted cost, then by key as a string, then by progress."""
    cost = F.round(F.col("value") / 100 - F.when(F.col("event_type") == "click", 0.1).otherwise(0.0), 9)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(cost, F.col("event_id").cast("string"), F.col("event_id") % 10))
    return events(spark, d).select("user_id", "event_id", place.alias("place")).where("place <= 5")


@query(f"""
WITH l AS (SELECT user_id, tok AS label FROM ({STREAM}) WHERE i = 1), c AS (SELECT s.user_id, label, tok AS candidate, min(value) / 20 AS cost FROM ({STREAM}) s JOIN l ON l.user_id = s.user_id GROUP BY s.user_id, label, tok),
b AS (SELECT user_id, label, coalesce(min(cost) FILTER (candidate = label), 1.0) AS own, min(cost) FILTER (candidate <> label) AS other, arg_min(candidate, (cost, candidate)) FILTER (candidate <> label) AS suggestion FROM c GROUP BY user_id, label)
SELECT user_id, label, CASE WHEN own - other >= 0.15::DOUBLE AND other <= 0.45::DOUBLE THEN suggestion END AS suggestion FROM b
""")
def mislabel_suggestions(spark, d):
    """Another label that fits so much better that it is proposed."""
    first = F.first("tok").over(Window.partitionBy("user_id").orderBy("i"))
    t = numbered(spark, d).withColumn("label", first).groupBy("user_id", "label", F.col("tok").alias("candidate")).agg((F.min("value") / 20).alias("cost"))
    return retrieval.better_label(t, "user_id", "label")


@query("SELECT user_id, arg_min(event_type, (m, event_type)) AS choice, round(min(m), 6) AS cost FROM (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def calibrated_choice(spark, d):
    """The candidate with the least median cost."""
    m = events(spark, d).groupBy("user_id", "event_type").agg(F.median("value").alias("m"))
    best = m.groupBy("user_id").agg(F.min(F.struct("m", "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("choice"), F.round("b.m", 6).alias("cost"))


@query()
def soft_infix_cost(spark, d):
    """E5: window tokens carry alternatives with probabilities, which make substitutions cheaper (held against brute force)."""
    t = numbered(spark, d).withColumn("nxt", F.lead("tok").over(Window.partitionBy("user_id").orderBy("i"))).where("i <= 12")
    p = F.greatest(F.lit(0.5), 1 - F.col("value") / 200)
    alts = F.array(F.struct(F.col("tok").alias("token"), p.alias("p")), F.struct(F.coalesce("nxt", F.lit("-")).alias("token"), (1 - p).alias("p")))
    s = t.withColumn("alts", alts).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "tok", "alts"))).alias("s"))
    w = s.select("user_id", F.transform("s", lambda x: x["tok"]).alias("win"), F.transform("s", lambda x: x["alts"]).alias("alts"))
    refs = _units(spark, d).select((F.col("unit") - 1).alias("user_id"), letters("ref").alias("ref"))  # every window with the next stream's unit
    return w.join(refs, "user_id").select("user_id", distances.soft_infix_col(F.col("ref"), F.col("win"), F.col("alts")).alias("cost"))


#: Units for the state machines: orders of letters of the five event types, numbered 'parent:place'.
CHAIN = {"1:1": "cevps", "1:2": "pvsec", "1:3": "sspcv", "2:1": "vvcep", "2:2": "ecpsv"}


@query()
def voted_chain(spark, d):
    """Fires of every event's best unit, voted into a chain (held against hand traces and a plain loop)."""
    refs = {k: list(v) for k, v in CHAIN.items()}
    order = list(refs)
    after = dict(zip(order, order[1:]))
    named = F.element_at(F.array(*[F.lit(k) for k in order]), (F.col("event_id") % len(order) + 1).cast("int"))
    t = numbered(spark, d).select("user_id", "i", F.col("i").cast("double").alias("w1"), named.alias("key"), (F.col("value") / 100).alias("cost"), F.lit(None).cast("array<string>").alias("win"))
    return run.fold(t, "user_id", ["i"], steppers.Voter(refs, after, {}))


@query()
def prefix_events(spark, d):
    """T5: a growing window of the stream's last tokens against the units it may begin (held against a plain loop)."""
    refs = {k: list(v) for k, v in CHAIN.items()}
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-4, 0)
    t = numbered(spark, d).withColumn("win", F.collect_list("tok").over(w)).select("user_id", "i", "win")
    return run.fold(t, "user_id", ["i"], steppers.PrefixDetector(refs, list(refs)))


@query(f"SELECT user_id, count(*) AS resets FROM (SELECT *, i - max(CASE WHEN tok <> 'p' THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS since FROM ({STREAM})) WHERE tok = 'p' AND since <= 2 GROUP BY user_id")
def gated_resets(spark, d):
    """Silences that come soon after something was said."""
    t = numbered(spark, d).select("user_id", F.col("i").cast("double").alias("t"), F.when(F.col("tok") == "p", "silence").otherwise("commit").alias("event"))
    return run.fold(t, "user_id", ["t"], steppers.GatedReset(2.0)).groupBy("user_id").agg(F.count("*").alias("resets"))
