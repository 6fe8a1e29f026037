"""All queries of the engine's own operators, bound to the test tables, with their DuckDB counterparts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window, functions as F

from seqloom.functions import bits, text as txt
from seqloom.operators import blocks, curation, retrieval, windows
from seqloom.plans.registry import CODE, FOLD, ORACLES, ORDER as _ORDER, QUERIES, SECONDS, STREAM as _STREAM, events, joined as _joined, numbered as _numbered, query, seconds
from seqloom.runtime import table
from seqloom.streaming import run, steppers


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


# ---- scans, keys, projections -------------------------------------------------------------------


@query("SELECT doc_id, source || ':' || lang AS key, format('{}_s{:03d}_a{:03d}', source, CAST(doc_id % 114 AS INTEGER), CAST(doc_id % 7 AS INTEGER)) AS recording_id, n_chars FROM documents WHERE n_chars <= 3000")
def manifest_ids(spark, d):
    """Projection, composed keys and a length cap."""
    t = table(spark, d, "documents").where("n_chars <= 3000")
    return t.select("doc_id", txt.make_key(F.col("source"), F.col("lang")).alias("key"), txt.padded_id(F.col("source"), F.col("doc_id") % 114, F.col("doc_id") % 7).alias("recording_id"), "n_chars")


@query("SELECT l_orderkey || ':' || l_partkey || '#' || l_linenumber AS key, CAST(l_orderkey AS INTEGER) AS first, CAST(l_partkey AS INTEGER) AS second, l_linenumber AS segment FROM lineitem")
def key_roundtrip(spark, d):
    """Keys composed and taken apart again."""
    t = table(spark, d, "lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit("#"), F.col("l_linenumber").cast("string"))
    return t.select(key.alias("key")).select("key", txt.split_key(F.col("key")).alias("k")).select("key", "k.first", "k.second", "k.segment")


@query("SELECT page_id, regexp_replace(replace('C:\\x\\data\\' || url, '\\', '/'), '^.*/data/', '') AS path, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages")
def path_anchor(spark, d):
    """Path re-anchoring and extensions."""
    t = table(spark, d, "pages")
    return t.select("page_id", txt.anchor_path(F.concat(F.lit("C:\\x\\data\\"), "url")).alias("path"), txt.extension(F.col("url")).alias("ext"))


@query("SELECT o_orderkey, n_name, n_regionkey * 1000 + n_nationkey AS packed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%A%'")
def name_map_drop(spark, d):
    """Names mapped through a dimension, unmapped rows dropped, ids packed."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).where("n_name like '%A%'").select("o_orderkey", "n_name", (F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("packed"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def text_normalize(spark, d):
    """X1-style folding of label text."""
    return table(spark, d, "documents").select("doc_id", txt.fold_words(F.col("text")).alias("norm"))


# ---- joins --------------------------------------------------------------------------------------

_LABEL_SQL = """
WITH n AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents),
r AS (SELECT lang, norm, min(doc_id) AS ref_id FROM n WHERE doc_id % 2 = 0 GROUP BY lang, norm)
"""


def _label_sides(spark, d):
    n = table(spark, d, "documents").select("doc_id", "lang", txt.fold_words(F.col("text")).alias("norm"))
    return n.where("doc_id % 2 = 1"), n.where("doc_id % 2 = 0").groupBy("lang", "norm").agg(F.min("doc_id").alias("ref_id"))


@query(_LABEL_SQL + "SELECT n.doc_id, r.ref_id FROM n JOIN r ON n.lang = r.lang AND n.norm = r.norm WHERE n.doc_id % 2 = 1")
def label_join_matched(spark, d):
    """Clips matched to a reference on normalised text."""
    return curation.join_labels(*_label_sides(spark, d), ["lang", "norm"])[0].select("doc_id", "ref_id")


@query(_LABEL_SQL + "SELECT n.doc_id FROM n WHERE n.doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE n.lang = r.lang AND n.norm = r.norm)")
def label_join_unmatched(spark, d):
    """The clips without a reference."""
    return curation.join_labels(*_label_sides(spark, d), ["lang", "norm"])[1].select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, d):
    """What an idempotent append has still to write."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return curation.resume(table(spark, d, "orders"), done, "o_orderkey").select("o_orderkey")


@query("""
SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'relabelled' ELSE d.lang END AS lang
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
WHERE coalesce(l.quality = 1, false) OR d.doc_id % 11 = 0 OR NOT (coalesce(l.toxic = 1, false) OR d.n_chars < 200)
""")
def verdict_precedence(spark, d):
    """Keep and relabel protect, discards and suspects go, relabels apply."""
    docs, l = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels")
    relabel = docs.where("doc_id % 11 = 0").select("doc_id", F.lit("relabelled").alias("new_label"))
    return curation.apply_verdicts(docs, "doc_id", "lang", l.where("quality = 1"), l.where("toxic = 1"), relabel, F.col("n_chars") < 200).select("doc_id", "lang")


@query("SELECT doc_id, coalesce(b.text, d.lang) AS label FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def relabel_coalesce(spark, d):
    """Update by id."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("new"))
    return table(spark, d, "documents").select("doc_id", "lang").join(b, "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("label"))


@query("SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING count(DISTINCT l_linenumber) = max(l_linenumber)")
def all_present_join(spark, d):
    """Groups all of whose parts are there."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    g = o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("k"), F.max("l_linenumber").alias("m"))
    return g.where("k = m").select("o_custkey", "n")


@query(f"""
WITH t AS (SELECT event_id, user_id, {SECONDS} AS s, event_type FROM events)
SELECT a.event_id, (SELECT max(b.s) FROM t b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.s <= a.s) AS last_purchase FROM t a
""")
def asof_group(spark, d):
    """The last purchase at or before each event of the same user, in one sorted pass."""
    e = table(spark, d, "events").select("event_id", "user_id", seconds().alias("s"), "event_type")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("s").alias("start"), F.col("s").alias("last_purchase"))
    return curation.as_of(e, marks, F.col("s"), "start", "last_purchase", ["user_id"]).select("event_id", "last_purchase")


@query("WITH b AS (SELECT c_nationkey, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY c_nationkey) SELECT b.c_nationkey, count(*) AS inside, count(*) FILTER (c.c_nationkey = b.c_nationkey) AS own FROM b JOIN customer c ON c.c_custkey BETWEEN b.lo AND b.hi GROUP BY b.c_nationkey")
def range_members(spark, d):
    """Ids between two bounds; the bounds are a layout of fixed size, one row a nation."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    bounds = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    met = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("of")).join(F.broadcast(bounds), F.col("k").between(F.col("lo"), F.col("hi")))
    return met.groupBy("c_nationkey").agg(F.count("*").alias("inside"), F.count_if(F.col("of") == F.col("c_nationkey")).alias("own"))


@query("SELECT n_nationkey, lag(n_nationkey) OVER w AS before, lead(n_nationkey) OVER w AS after FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def successor_lookup(spark, d):
    """Neighbours in canonical order, never across groups."""
    return windows.neighbours(table(spark, d, "nation"), "n_regionkey", ["n_nationkey"], "n_nationkey").select("n_nationkey", "before", "after")


@query("SELECT text, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_twins(spark, d):
    """Groups of equal sequences."""
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# ---- aggregation and distribution ---------------------------------------------------------------


@query("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source, lang")
def coverage_by_key(spark, d):
    """A1: counts and sums by key."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH h AS (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS have FROM customer GROUP BY c_nationkey)
SELECT n_nationkey, coalesce(have, 0) AS have, CASE WHEN coalesce(have, 0) >= 5 THEN 'complete' WHEN coalesce(have, 0) > 0 THEN 'partial' ELSE 'missing' END AS verdict
FROM nation LEFT JOIN h ON n_nationkey = c_nationkey
""")
def coverage_completeness(spark, d):
    """A2: distinct members against the expected number."""
    have = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    want = table(spark, d, "nation").select("n_nationkey", F.lit(5).alias("wanted"))
    return curation.completeness(have, want, "n_nationkey", "c_mktsegment", "wanted").select("n_nationkey", "have", "verdict")


_BUCKET_SQL = "CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars > 8000 THEN 'long' WHEN length(text) - length(replace(text, '|', '')) > 10 THEN 'list' ELSE 'ok' END"


def _bucketed(spark, d):
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    rules = [("short", F.col("n_chars") < 100), ("long", F.col("n_chars") > 8000), ("list", bars > 10)]
    return table(spark, d, "documents").withColumn("bucket", curation.buckets(rules, "ok"))


@query(f"SELECT doc_id, {_BUCKET_SQL} AS bucket FROM documents")
def quality_buckets(spark, d):
    """F8: an ordered cascade of gates."""
    return _bucketed(spark, d).select("doc_id", "bucket")


@query(f"SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT {_BUCKET_SQL} AS bucket FROM documents) GROUP BY bucket")
def bucket_distribution(spark, d):
    """A4: value counts and shares."""
    g = _bucketed(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@query(f"SELECT bucket, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS good FROM (SELECT doc_id, {_BUCKET_SQL} AS bucket FROM documents) JOIN labels USING (doc_id) GROUP BY bucket")
def bucket_crosscheck(spark, d):
    """A5: conditional rates by label."""
    return _bucketed(spark, d).select("doc_id", "bucket").join(table(spark, d, "labels"), "doc_id").groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("good"))


@query("SELECT user_id, event_type, round(median(value), 6) AS mid, max(value) AS top, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY user_id, event_type")
def robust_stats(spark, d):
    """Medians, maxima, percentiles by two keys."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.median("value"), 6).alias("mid"), F.max("value").alias("top"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


_WORDS_SQL = "SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents"


def _words(spark, d, name="documents", key="doc_id"):
    return table(spark, d, name).select(key, F.explode(F.split(txt.fold_words(F.col("text")), " ")).alias("word")).where("word <> ''")


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs, min(length(word)) AS len FROM ({_WORDS_SQL}) WHERE word <> '' GROUP BY word")
def token_frequency(spark, d):
    """Token statistics."""
    by_doc = _words(spark, d).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min(F.length("word")).alias("len"))


@query(f"SELECT DISTINCT word FROM ({_WORDS_SQL.replace('doc_id, ', '').replace('documents', 'benchmark')}) WHERE word <> '' AND word NOT IN (SELECT word FROM ({_WORDS_SQL}))")
def oov_tokens(spark, d):
    """Tokens outside the inventory."""
    return _words(spark, d, "benchmark", "item_id").select("word").distinct().join(_words(spark, d).select("word").distinct(), "word", "left_anti")


@query(f"""
WITH g AS (SELECT DISTINCT user_id, {CODE} AS tok, lead({CODE}) OVER w AS nxt, date_trunc('day', ts) AS day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT tok, nxt, count(DISTINCT user_id) AS users, count(DISTINCT day) AS days FROM g WHERE nxt IS NOT NULL GROUP BY tok, nxt
""")
def collision_counts(spark, d):
    """Distinct contexts in which a pattern occurs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = events(spark, d).select("user_id", "tok", F.lead("tok").over(w).alias("nxt"), F.date_trunc("day", F.col("ts")).alias("day"))
    return g.where("nxt is not null").groupBy("tok", "nxt").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("day").alias("days"))


@query("SELECT user_id, bool_or(value > 50) AS a, bool_or(value > 50 AND event_type = 'purchase') AS b, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks FROM events GROUP BY user_id")
def funnel(spark, d):
    """A13, EV8: any-window hits and conditional sums."""
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 50).alias("a"), F.bool_or((F.col("value") > 50) & (F.col("event_type") == "purchase")).alias("b"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"))


@query("SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, CASE WHEN count(DISTINCT l_linenumber) = max(l_linenumber) - min(l_linenumber) + 1 THEN 'OK' ELSE 'GAPS' END AS flag FROM lineitem GROUP BY l_orderkey")
def range_hull(spark, d):
    """A18, EV13: hulls and a coverage flag."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.count_distinct("l_linenumber").alias("k"))
    return g.select("l_orderkey", "lo", "hi", F.when(F.expr("k = hi - lo + 1"), "OK").otherwise("GAPS").alias("flag"))


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, d):
    """A10: the first row of each key in a total order."""
    return curation.first_wins(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id AS id, lang AS tag, NULL AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def hetero_union(spark, d):
    """Union by name with missing columns."""
    return curation.union_all(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag")), table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role"))


@query("SELECT n_nationkey AS unit FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT s_nationkey * 100 FROM supplier")
def unit_index(spark, d):
    """U4: segments plus the wholes that have none."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return table(spark, d, "nation").join(s, "n_nationkey", "left_anti").select(F.col("n_nationkey").alias("unit")).unionAll(s.select((F.col("n_nationkey") * 100).alias("unit")))


@query("WITH r AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN r <= 3 THEN 'test' WHEN r <= 6 THEN 'val' ELSE 'train' END AS split FROM documents JOIN r USING (source)")
def source_rank_split(spark, d):
    """Leakage-free split by rank of the source."""
    return windows.ranked_split(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query("SELECT doc_id, md5('7:' || doc_id) < '33333333333333333333333333333333' AS held_out FROM documents")
def hash_split_holdout(spark, d):
    """A seeded, engine-independent hold-out by md5 order."""
    return table(spark, d, "documents").select("doc_id", (F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))) < "3" * 32).alias("held_out"))


# ---- token streams ------------------------------------------------------------------------------

_STREAM = f"SELECT event_id, user_id, ts, {SECONDS} AS s, value, {CODE} AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"
_ORDER = ["ts", "event_id"]


@query(f"SELECT event_id, user_id, tok FROM (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ({_STREAM})) WHERE (p IS NULL OR p <> tok) AND tok <> 'v'")
def ctc_collapse(spark, d):
    """Repeats and the blank go."""
    return windows.collapse(events(spark, d), "user_id", _ORDER, "tok", "v").select("event_id", "user_id", "tok")


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY value DESC, event_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id")
def alts_topk(spark, d):
    """The k best alternatives in a total order."""
    t = table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("r <= 3")
    return t.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("top"))


_REL = f"SELECT event_id, user_id, s - min(s) OVER (PARTITION BY user_id) AS t, tok FROM ({_STREAM})"


def _relative(spark, d):
    e = events(spark, d).withColumn("s", seconds())
    return e.withColumn("t", F.col("s") - F.min("s").over(Window.partitionBy("user_id")))


@query(f"SELECT user_id, w0, w0 + 86400 AS w1, count(*) AS n FROM (SELECT user_id, unnest(generate_series(greatest(0, CAST(ceil((t - 86400 + 1) / 43200.0) AS BIGINT) * 43200), (t // 43200) * 43200, 43200)) AS w0 FROM ({_REL})) GROUP BY user_id, w0")
def hop_windows(spark, d):
    """Hopping windows in stream time."""
    return windows.hop_windows(_relative(spark, d), F.col("t"), 86400, 43200).groupBy("user_id", "w0", "w1").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT {w} AS scale, user_id, w0, count(*) AS n FROM (SELECT user_id, unnest(generate_series(greatest(0, CAST(ceil((t - {w} + 1) / 86400.0) AS BIGINT) * 86400), (t // 86400) * 86400, 86400)) AS w0 FROM ({_REL})) GROUP BY user_id, w0" for w in (86400, 172800, 345600)))
def multiscale_windows(spark, d):
    """A bank of window widths with one hop."""
    rel = _relative(spark, d)
    out = None
    for w in (86400, 172800, 345600):
        one = windows.hop_windows(rel, F.col("t"), w, 86400).groupBy("user_id", "w0").agg(F.count("*").alias("n")).select(F.lit(w).alias("scale"), "user_id", "w0", "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"SELECT user_id, session, count(*) AS n, min(s) AS s0, max(s) AS s1 FROM (SELECT *, sum(CASE WHEN s - p <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ({_STREAM}))) GROUP BY user_id, session")
def silence_sessions(spark, d):
    """Sessions cut by silence."""
    e = windows.sessions(events(spark, d).withColumn("s", seconds()), "user_id", _ORDER, F.col("s"), 21600)
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1"))


_COMMIT = """SELECT user_id, event_id, tok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, key, i - k ORDER BY i) AS run FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY i) AS k FROM (SELECT *, CASE WHEN value >= {t} THEN tok ELSE '' END AS key FROM ({s})))) WHERE key <> '' AND run >= {k}) WHERE n = 1"""


@query(_COMMIT.format(t=5, k=2, s=_STREAM))
def persistence_first_commit(spark, d):
    """The first leader that stays sure long enough."""
    return windows.first_commit(events(spark, d), "user_id", _ORDER, "tok", F.col("value") >= 5, 2).select("user_id", "event_id", "tok")


_THRESHOLDS, _NEEDS = (1, 2, 5, 10, 20, 40), (1, 2, 3, 4, 5, 6)


@query(" UNION ALL ".join(f"SELECT {t} AS threshold, {k} AS need, count(*) AS committed FROM ({_COMMIT.format(t=t, k=k, s=_STREAM)})" for t in _THRESHOLDS for k in _NEEDS))
def commit_grid(spark, d):
    """EV3, J21: the trajectories once, 6 x 6 settings against them."""
    e = events(spark, d).select("user_id", "ts", "event_id", "tok", "value")
    grid = spark.createDataFrame([(t, k) for t in _THRESHOLDS for k in _NEEDS], "threshold int, need int")
    runs = windows.islands(e.crossJoin(F.broadcast(grid.select("threshold").distinct())).withColumn("key", F.when(F.col("value") >= F.col("threshold"), F.col("tok")).otherwise("")).withColumn("lane", F.concat_ws("/", "user_id", "threshold")), "lane", _ORDER, "key")
    best = runs.where("key <> ''").groupBy("user_id", "threshold").agg(F.max("run").alias("longest"))
    return grid.join(best, "threshold", "left").groupBy(F.col("threshold"), F.col("need")).agg(F.count(F.when(F.col("longest") >= F.col("need"), 1)).alias("committed"))


_SPAN = "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, CAST(l_quantity AS BIGINT) AS len FROM lineitem"


def _spans(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("i", F.row_number().over(w)).select("l_orderkey", "i", F.col("l_quantity").cast("bigint").alias("len"))


@query(f"SELECT l_orderkey, i, len, CAST(coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({_SPAN})")
def cumulative_offsets(spark, d):
    """Running offsets of parts."""
    return windows.offsets(_spans(spark, d), "l_orderkey", ["i"], "len")


@query(f"""
WITH o AS (SELECT *, 2 * sum(len) OVER (PARTITION BY l_orderkey ORDER BY i) + 7 * i AS e FROM ({_SPAN})), p AS (SELECT l_orderkey, i, e - 2 * len AS s, e FROM o)
SELECT l_orderkey, i, coalesce((lag(e) OVER w + s) / 2.0, s) AS cut_start, coalesce((e + lead(s) OVER w) / 2.0, e) AS cut_end FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)
""")
def midpoint_cuts(spark, d):
    """Neighbouring spans meet halfway."""
    w = Window.partitionBy("l_orderkey").orderBy("i")
    o = _spans(spark, d).withColumn("e", 2 * F.sum("len").over(w) + 7 * F.col("i")).withColumn("s", F.col("e") - 2 * F.col("len"))
    return windows.midpoint_cuts(o, "l_orderkey", ["i"], "s", "e").select("l_orderkey", "i", F.col("cut_start").cast("double").alias("cut_start"), F.col("cut_end").cast("double").alias("cut_end"))


@query(f"SELECT l_orderkey, piece, sum(len)::BIGINT AS len, count(*) AS parts FROM (SELECT *, sum(CASE WHEN len >= 10 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS piece FROM ({_SPAN})) GROUP BY l_orderkey, piece")
def tiny_merge(spark, d):
    """Fragments join the piece before."""
    return windows.merge_tiny(_spans(spark, d), "l_orderkey", ["i"], "len", 10).groupBy("l_orderkey", "piece").agg(F.sum("len").alias("len"), F.count("*").alias("parts"))


@query(f"""
WITH b AS (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY i) AS e, sum(CASE WHEN len > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS bad FROM ({_SPAN}))
SELECT a.l_orderkey, a.i, max(z.i) AS last_i FROM b a JOIN b z ON z.l_orderkey = a.l_orderkey AND z.i >= a.i AND z.e - a.e + a.len <= 100 AND z.bad = a.bad WHERE a.len <= 45 GROUP BY a.l_orderkey, a.i
""")
def greedy_runs(spark, d):
    """From each row the longest run within a span cap without a bad row."""
    w = Window.partitionBy("l_orderkey").orderBy("i")
    b = _spans(spark, d).withColumn("e", F.sum("len").over(w)).withColumn("bad", F.sum((F.col("len") > 45).cast("int")).over(w))
    z = b.select("l_orderkey", F.col("i").alias("z_i"), F.col("e").alias("z_e"), F.col("bad").alias("z_bad"))
    met = b.where("len <= 45").join(z, "l_orderkey").where("z_i >= i and z_e - e + len <= 100 and z_bad = bad")
    return met.groupBy("l_orderkey", "i").agg(F.max("z_i").alias("last_i"))


_DEDUP = "SELECT * FROM (SELECT *, lag({v}) OVER w AS p FROM ({t}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p IS NULL OR p <> {v}"


@query("SELECT event_id, user_id, tok FROM (" + _DEDUP.format(v="tok", t="SELECT event_id, user_id, ts, tok FROM (SELECT event_id, user_id, ts, tok, lag(tok) OVER w AS l, lead(tok) OVER w AS r FROM (" + _DEDUP.format(v="tok", t=_STREAM).replace("SELECT * FROM", "SELECT event_id, user_id, ts, tok FROM", 1) + ") WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE NOT coalesce(l = r, false)") + ")")
def consecutive_dedup(spark, d):
    """Repeats and single-value sandwiches smoothed away."""
    return windows.smooth_sandwich(events(spark, d), "user_id", _ORDER, "tok").select("event_id", "user_id", "tok")


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM conversations)) GROUP BY conv_id, g")
def consecutive_runs(spark, d):
    """runs of consecutive numbers."""
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    g = c.withColumn("g", F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return g.groupBy("conv_id", "g").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("g")


# ---- matching -----------------------------------------------------------------------------------

_TAIL = f"SELECT user_id, string_agg(tok, '' ORDER BY i) AS win FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM (SELECT user_id, tok, i FROM (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY i) AS p FROM ({_STREAM})) WHERE p IS NULL OR p <> tok)) WHERE back <= 12 GROUP BY user_id"
_HEAD = f"SELECT user_id AS unit, string_agg(tok, '' ORDER BY i) AS ref FROM ({_STREAM}) WHERE i <= 8 GROUP BY user_id"


def trailing_windows(spark, d, n: int = 12):
    """(user_id, win): the last ``n`` collapsed tokens of every stream, as a string."""
    c = windows.collapse(_numbered(spark, d), "user_id", ["i"], "tok")
    last = c.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("i")))).where(f"back <= {n}")
    return last.groupBy("user_id").agg(_joined("tok").alias("win"))


def lexicon(spark, d, n: int = 8):
    """(unit, ref): the first ``n`` tokens of every stream."""
    return _numbered(spark, d).where(f"i <= {n}").groupBy(F.col("user_id").alias("unit")).agg(_joined("tok").alias("ref"))


#: Lengths of units that a window can match (J10, F11), as a share of its own, and its inverse.
BAND = 0.6


def _best(spark, d, k: int):
    """(user_id, unit, cost): for every window at least its ``k`` best units."""
    c = blocks.nearest_units(trailing_windows(spark, d), "user_id", "win", lexicon(spark, d), "unit", "ref", BAND, k)
    return c.select("user_id", "unit", F.round(F.col("dist") / F.col("longest"), 9).alias("cost"))


def _costs(spark, d, kernel, cost, least: int = 1):
    """(user_id, unit, cost) of every window and all units of a length it can match."""
    return blocks.every_unit(trailing_windows(spark, d), "user_id", "win", lexicon(spark, d).where(F.length("ref") >= least), "unit", "ref", BAND, kernel, cost)


_PAIRED = f"SELECT * FROM ({_TAIL}) w JOIN ({_HEAD}) u ON length(ref) >= ceil(length(win) * 0.6::DOUBLE) AND length(ref) <= floor(length(win) / 0.6::DOUBLE)"


@query(f"SELECT user_id, unit, cost FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost, unit) AS r FROM (SELECT user_id, unit, round(levenshtein(win, ref)::DOUBLE / greatest(length(win), length(ref)), 9) AS cost FROM ({_PAIRED}))) WHERE r = 1")
def session_top_unit(spark, d):
    """The flagship: collapse, trailing window, length-banded join, normalised edit cost, best unit a session."""
    return _best(spark, d, 1).groupBy("user_id").agg(F.min(F.struct("cost", "unit")).alias("best")).select("user_id", "best.unit", "best.cost")


@query(f"SELECT user_id, unit, cost, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost, unit) AS r FROM (SELECT user_id, unit, round(levenshtein(win, ref)::DOUBLE / greatest(length(win), length(ref)), 9) AS cost FROM ({_PAIRED}))) WHERE r <= 5")
def edit_norm_topk(spark, d):
    """The five best units."""
    c = _best(spark, d, 5)
    return c.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("cost", "unit"))).where("r <= 5").select("user_id", "unit", "cost", "r")


@query(f"SELECT user_id, unit, min(levenshtein(ref, substr(win, i, j - i))) / length(ref)::DOUBLE AS cost FROM (SELECT user_id, unit, win, ref, unnest(generate_series(1, length(win) + 1)) AS i FROM ({_PAIRED})) p, generate_series(1, 13) g(j) WHERE j >= i AND j <= length(win) + 1 GROUP BY user_id, unit, ref")
def infix_cost(spark, d):
    """A reference as a stretch of the window; the oracle tries every stretch."""
    return _costs(spark, d, bits.infix_distances, lambda code, size, n: code / size)


@query(f"SELECT user_id, unit, min(levenshtein(win, substr(ref, 1, k)))::DOUBLE / length(win) AS cost FROM ({_PAIRED}) p, generate_series(1, 8) g(k) WHERE k <= length(ref) GROUP BY user_id, unit, win")
def prefix_align_cost(spark, d):
    """The whole window against the best prefix of a reference."""
    return _costs(spark, d, bits.prefix_align_distances, lambda code, size, n: code / n)


@query(f"""
WITH p AS (SELECT user_id, unit, win, ref, unnest(generate_series(4, length(ref))) AS i FROM ({_PAIRED})), e AS (SELECT *, length(win) - unnest([0, 1, 2]) AS e FROM p)
SELECT user_id, unit, min(levenshtein(substr(ref, 1, i), substr(win, s, e - s + 1))::DOUBLE / i) AS cost FROM e, generate_series(1, 13) g(s) WHERE e >= 0 AND s <= e + 1 GROUP BY user_id, unit
""")
def prefix_cost(spark, d):
    """The beginning of a reference against the window's end."""
    return _costs(spark, d, partial(bits.prefix_distances, least=4), lambda code, size, n: F.shiftright(code, 7) / code.bitwiseAND(F.lit(127).cast("smallint")), 4)


_GRAMS = "SELECT {k}, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram, unnest(generate_series(0, len(w) - 3)) AS pos FROM (SELECT {k}, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM {t}) WHERE len(w) >= 3"
_POST = f"SELECT DISTINCT item_id AS unit, gram FROM ({_GRAMS.format(k='item_id', t='benchmark')})"
_COUNTS = f"SELECT doc_id AS \"window\", unit, count(*) AS cnt, min(pos) AS first_pos FROM ({_GRAMS.format(k='doc_id', t='documents')}) JOIN ({_POST}) USING (gram) GROUP BY doc_id, unit"


def _tokens(spark, d, name, key):
    return retrieval.over_all_cores(table(spark, d, name).select(key, "text")).select(key, F.split(txt.fold_words(F.col("text")), " ").alias("w"))


def _counts(spark, d):
    return retrieval.gram_counts(_tokens(spark, d, "documents", "doc_id"), "doc_id", "w", retrieval.postings(_tokens(spark, d, "benchmark", "item_id"), "item_id", "w"))


@query(_POST)
def ngram_postings(spark, d):
    """The inverted index."""
    return retrieval.postings(_tokens(spark, d, "benchmark", "item_id"), "item_id", "w")


@query(_COUNTS)
def ngram_counts(spark, d):
    """R2: window positions that hit a unit."""
    return _counts(spark, d)


@query(f"""
WITH c AS ({_COUNTS}), l AS (SELECT item_id AS unit, len(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS n FROM benchmark),
r AS (SELECT "window", c.unit, cnt, row_number() OVER (PARTITION BY "window" ORDER BY cnt DESC, first_pos, c.unit) AS raw_rank, row_number() OVER (PARTITION BY "window" ORDER BY cnt::DOUBLE / n DESC, first_pos, c.unit) AS scaled_rank FROM c JOIN l ON c.unit = l.unit)
SELECT "window", unit, cnt, raw_rank, scaled_rank FROM r WHERE raw_rank <= 60 OR scaled_rank <= 20
""")
def ngram_shortlist(spark, d):
    """Two rankings, one shortlist."""
    lengths = _tokens(spark, d, "benchmark", "item_id").select(F.col("item_id").alias("unit"), F.size("w").alias("len"), F.col("item_id").alias("unit_ord"))
    return retrieval.shortlist(_counts(spark, d), lengths).select("window", "unit", "cnt", "raw_rank", "scaled_rank")


_UNITS = f"SELECT user_id AS id, string_agg(tok, '' ORDER BY i) AS code FROM ({_STREAM}) GROUP BY user_id"
_NEAR = f"SELECT a.id AS a, b.id AS b, levenshtein(a.code, b.code) AS dist FROM ({_UNITS}) a JOIN ({_UNITS}) b ON a.id < b.id WHERE levenshtein(a.code, b.code) <= floor(0.53::DOUBLE * greatest(length(a.code), length(b.code)))"


def _codes(spark, d):
    """Whole streams as units: their id and code, and the share of the longer one's length that look-alikes may differ by."""
    return _numbered(spark, d).groupBy(F.col("user_id").alias("id")).agg(_joined("tok").alias("code")), "id", "code", 0.53


@query(_NEAR)
def confusable_pairs(spark, d):
    """Look-alike units by a length-bucketed join."""
    return retrieval.confusable_pairs(*_codes(spark, d))


@query(f"WITH RECURSIVE e AS (SELECT a, b FROM ({_NEAR}) UNION SELECT b, a FROM ({_NEAR})), r(node, seen) AS (SELECT a, a FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON r.node = e.a) SELECT node, min(seen) AS component FROM r GROUP BY node")
def confusable_components(spark, d):
    """Components of the look-alike graph."""
    return retrieval.confusable_components(*_codes(spark, d))


_CHAIN = "SELECT unit, lag(unit) OVER w AS before, lead(unit) OVER w AS after FROM (SELECT DISTINCT user_id AS unit FROM events) WINDOW w AS (PARTITION BY unit % 10 ORDER BY unit)"


@query(f"""
WITH near AS ({_NEAR}), e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), amb AS (SELECT DISTINCT a FROM e), c AS ({_CHAIN}),
t AS (SELECT e.a, m.before AS p, m.after AS s, o.before AS p2, o.after AS s2 FROM e JOIN c m ON m.unit = e.a JOIN c o ON o.unit = e.b),
g AS (SELECT a, bool_and(p IS NOT NULL AND p NOT IN (SELECT a FROM amb) AND p IS DISTINCT FROM p2) AS pred, bool_and(s IS NOT NULL AND s NOT IN (SELECT a FROM amb) AND s IS DISTINCT FROM s2) AS succ FROM t GROUP BY a)
SELECT a AS unit, CASE WHEN pred AND succ THEN 'both' WHEN pred THEN 'pred' WHEN succ THEN 'succ' ELSE 'none' END AS kind FROM g
""")
def neighbor_resolution(spark, d):
    """Which neighbours tell look-alikes apart."""
    users = table(spark, d, "events").select((F.col("user_id") % 10).alias("g"), F.col("user_id").alias("unit")).distinct()
    chain = windows.neighbours(users, "g", ["unit"], "unit").select("unit", "before", "after")
    return retrieval.resolvable(*_codes(spark, d), chain)


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_concat(spark, d):
    """Ordered concatenation of parts."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ").alias("roles"))


@query(f"WITH RECURSIVE e AS (SELECT a, b FROM ({_NEAR}) UNION SELECT b, a FROM ({_NEAR})), r(node, seen) AS (SELECT a, a FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node) SELECT component, count(*) AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members, row_number() OVER (ORDER BY count(*) DESC, component) AS place FROM c GROUP BY component")
def component_order(spark, d):
    """Components by size, then by their first unit; members in order."""
    parts = retrieval.confusable_components(*_codes(spark, d)).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members"))
    return parts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "component")))  # a report, one row a component


# ---- state machines: order-dependent folds, in SQL as recursive queries a row at a time ---------

#: The canonical order of event letters for successor rules.
AFTER = {"c": "e", "e": "p", "p": "s", "s": "v"}


def _ranked(spark, d):
    return events(spark, d).select("user_id", "ts", "event_id", F.col("tok").alias("key"), (1 / (1 + F.col("value"))).alias("cost"), (F.col("value") / 100).alias("margin"))


_NEXT = "CASE {k} WHEN 'c' THEN 'e' WHEN 'e' THEN 'p' WHEN 'p' THEN 's' WHEN 's' THEN 'v' END"


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, i, tok AS key, 1 / (1 + value) AS cost FROM ({_STREAM})), f(user_id, i, now, rival, seen, event, key, cost) AS (
SELECT user_id, i, CASE WHEN cost <= 0.3::DOUBLE THEN key END, NULL::VARCHAR, 0, CASE WHEN cost <= 0.3::DOUBLE THEN 'detect' END, key, cost FROM t WHERE i = 1 UNION ALL
SELECT user_id, i, CASE WHEN event IS NULL THEN now ELSE key END, CASE WHEN skip THEN rival WHEN event IS NULL AND key <> now THEN key END, CASE WHEN skip THEN seen WHEN event IS NULL AND key <> now THEN seen2 ELSE 0 END, event, key, cost FROM (
SELECT t.user_id, t.i, now, rival, seen, t.key, t.cost, t.cost > 0.3::DOUBLE AS skip, CASE WHEN rival = t.key THEN seen + 1 ELSE 1 END AS seen2,
CASE WHEN t.cost > 0.3::DOUBLE THEN NULL WHEN now IS NULL THEN 'detect' WHEN t.key = now THEN NULL WHEN t.key = {_NEXT.format(k='now')} THEN 'advance' WHEN CASE WHEN rival = t.key THEN seen + 1 ELSE 1 END >= 2 THEN 'jump' END AS event
FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1))
SELECT user_id, i - 1 AS at, event, key, cost FROM f WHERE event IS NOT NULL
""")
def sliding_events(spark, d):
    """T4: detect, advance and jump events of every stream."""
    return run.fold(_ranked(spark, d), "user_id", _ORDER, steppers.Segmenter(AFTER))


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, i, CASE WHEN value / 100 >= 0.02::DOUBLE THEN tok END AS key FROM ({_STREAM})), f(user_id, i, leader, run, held, said) AS (
SELECT user_id, i, key, 1, NULL::VARCHAR, NULL::VARCHAR FROM t WHERE i = 1 UNION ALL
SELECT user_id, i, key, run2, CASE WHEN now THEN key ELSE held END, CASE WHEN now THEN key END FROM (SELECT *, key IS NOT NULL AND key IS DISTINCT FROM held AND run2 >= CASE WHEN held IS NULL THEN 2 ELSE 3 END AS now FROM (
SELECT t.user_id, t.i, t.key, held, CASE WHEN t.key IS NOT DISTINCT FROM leader THEN run + 1 ELSE 1 END AS run2 FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)))
SELECT user_id, i - 1 AS at, said AS key FROM f WHERE said IS NOT NULL
""")
def commit_revise(spark, d):
    """Commits and their revisions (short runs, for five tokens only)."""
    return run.fold(_ranked(spark, d), "user_id", _ORDER, steppers.Commit(0.02, 2, 3))


@query("""
WITH RECURSIVE t AS (SELECT l_suppkey, l_orderkey::VARCHAR AS p, l_linenumber AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey::VARCHAR, l_linenumber) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
f(l_suppkey, i, n, p, k, lp, lk, ap, ak, bp, bk, sure, xp, xk) AS (
SELECT l_suppkey, i, n, p, k, NULL::VARCHAR, NULL::INTEGER, NULL::VARCHAR, NULL::INTEGER, p, k, false, NULL::VARCHAR, NULL::INTEGER FROM t WHERE i = 1 UNION ALL
SELECT l_suppkey, i, n, p, k, CASE WHEN sure THEN p ELSE lp END, CASE WHEN sure THEN k ELSE lk END, CASE WHEN sure THEN NULL WHEN waits THEN bp ELSE ap END, CASE WHEN sure THEN NULL WHEN waits THEN bk ELSE ak END, CASE WHEN sure THEN NULL WHEN waits THEN p ELSE bp END, CASE WHEN sure THEN NULL WHEN waits THEN k ELSE bk END, sure, CASE WHEN second THEN bp WHEN first THEN ap END, CASE WHEN second THEN bk WHEN first THEN ak END
FROM (SELECT *, first OR second OR coalesce(p = lp AND k > lk, false) AS sure, lp IS NULL OR p <> lp AS waits FROM (
SELECT t.l_suppkey, t.i, t.n, t.p, t.k, lp, lk, ap, ak, bp, bk, coalesce(t.p = ap AND t.k > ak, false) AS first, coalesce(t.p = bp AND t.k > bk, false) AS second FROM f JOIN t ON t.l_suppkey = f.l_suppkey AND t.i = f.i + 1)))
SELECT l_suppkey, i - 1 AS at, xp AS parent, xk AS place FROM f WHERE xp IS NOT NULL UNION ALL SELECT l_suppkey, i - 1, p, k FROM f WHERE sure
UNION ALL SELECT l_suppkey, n, coalesce(ap, bp), CASE WHEN ap IS NULL THEN bk ELSE ak END FROM f WHERE i = n AND lp IS NULL
""")
def chain_assemble(spark, d):
    """The lines each supplier ships, in order of shipping, assembled to chains of an order's lines."""
    units = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", F.col("l_orderkey").cast("string").alias("parent"), F.col("l_linenumber").cast("int").alias("place"))
    return run.fold(units, "l_suppkey", ["l_shipdate", "parent", "place"], steppers.Assemble({}))


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, i, tok AS a, 1 / (1 + value) AS ac, lag(tok) OVER (PARTITION BY user_id ORDER BY i) AS b, value / 100 AS bc FROM ({_STREAM})), f(user_id, i, older, last, event, key, source) AS (
SELECT user_id, i, NULL::VARCHAR, a, 'detect', a, 'sliding' FROM t WHERE i = 1 UNION ALL
SELECT user_id, i, CASE WHEN key IS NULL THEN older ELSE last END, coalesce(key, last), CASE WHEN key IS NULL THEN NULL WHEN key = want THEN 'advance' ELSE 'jump' END, key, source FROM (
SELECT *, CASE WHEN fresh_a AND (NOT fresh_b OR (a IS DISTINCT FROM want, ac) <= (b IS DISTINCT FROM want, bc)) THEN a WHEN fresh_b THEN b END AS key, CASE WHEN fresh_a AND (NOT fresh_b OR (a IS DISTINCT FROM want, ac) <= (b IS DISTINCT FROM want, bc)) THEN 'sliding' WHEN fresh_b THEN 'stream' END AS source FROM (
SELECT t.*, older, last, {_NEXT.format(k='last')} AS want, a <> last AND a IS DISTINCT FROM older AS fresh_a, b IS NOT NULL AND b <> last AND b IS DISTINCT FROM older AS fresh_b FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)))
SELECT user_id, i - 1 AS at, event, key, source FROM f WHERE event IS NOT NULL
""")
def merged_events(spark, d):
    """The event before is what the second detector says."""
    before = F.lag("key").over(Window.partitionBy("user_id").orderBy(*_ORDER))
    offers = _ranked(spark, d).select("user_id", *_ORDER, F.col("key").alias("sliding_key"), F.col("cost").alias("sliding_cost"), before.alias("stream_key"), F.col("margin").alias("stream_cost"))
    return run.fold(offers, "user_id", _ORDER, steppers.Merge(AFTER, 2))


@query()
def highlight_states(spark, d):
    """Two letters look alike; sure rows are choices."""
    rows = _ranked(spark, d).withColumn("action", F.when(F.col("margin") > 1, "choose").otherwise("detect"))
    return run.fold(rows, "user_id", _ORDER, steppers.Highlight({k: ["c", "p"] for k in "cp"}, {b: a for a, b in AFTER.items()}, AFTER))


@query(f"SELECT user_id, i - 1 AS at, tok AS token FROM (SELECT *, lag(tok) OVER (PARTITION BY user_id ORDER BY i) AS p FROM ({_STREAM})) WHERE (p IS NULL OR p <> tok) AND tok <> 'v'")
def collapse_carry(spark, d):
    """The collapse as a fold with a carried token, as streams run it; whole tables are faster by ``ctc_collapse``'s window."""
    return run.fold(events(spark, d).select("user_id", "ts", "event_id", F.col("tok").alias("token")), "user_id", _ORDER, steppers.Collapse("v"))


@query("SELECT user_id, date_trunc('hour', ts) AS w0, date_trunc('hour', ts) + INTERVAL 1 HOUR AS w1, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    """Event-time windows, by the plan that also runs on streams."""
    out = run.hopping_counts(table(spark, d, "events"), "ts", ["user_id"], "1 hour", "1 hour", "1 hour")
    return out.withColumn("w0", F.col("w0").cast("timestamp_ntz")).withColumn("w1", F.col("w1").cast("timestamp_ntz"))


from seqloom.plans import evaluation, files, numerics, relational, scoring  # noqa: E402, F401  (they register their queries)
