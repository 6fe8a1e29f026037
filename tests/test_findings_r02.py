"""Small cases of the second round's findings, each of which failed before."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from seqloom.functions import bits, distances
from seqloom.operators import blocks, curation, retrieval
from seqloom.plans import catalog
from seqloom.streaming.steppers import SpeechGate


def written(spark, folder, **tables):
    """A folder of tables: rows and a schema by name."""
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_running_total_when_partitions_are_coalesced(spark):
    """ranges are the same in both branches of the plan, however their partitions are put together."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(50_000).select("id", (F.col("id") % 3).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = curation.running_total(rows, "id", "n").select("id", "n", "total", "wide").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 50_000
    total = 0
    for r in sorted(got):
        total += r["n"]
        assert r["total"] == total


def test_two_windows_of_one_centre(spark, tmp_path):
    """both events of one second ask for the spans that cover its centre, as in the SQL."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=s), 1, "view", 1.0, "") for k, s in enumerate((0, 0, 1800, 9000))]
    d = written(spark, tmp_path, events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    assert sorted(r["spans"] for r in catalog.queries()["covering_spans"](spark, d).collect()) == [0, 1, 2]


def test_speech_gate_at_its_lower_bound():
    """0.2 - 0.15 is 0.05, so a probability of 0.05 is not silence."""
    gate = SpeechGate(0.2, 0.15, 3)
    state = gate.start()
    assert [e for p in (0.5, 0.05, 0.05, 0.05, 0.05) for e in gate.step(state, {"p": p})] == [("start",)]


def streams(spark, folder, lengths, seed=1, letters="cepsv"):
    """Events of one stream for each of ``lengths``."""
    rng, rows, names = random.Random(seed), [], dict(c="click", e="error", p="purchase", s="signup", v="view", x="x")
    for user, n in enumerate(lengths):
        for _ in range(n):
            rows.append((len(rows), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=len(rows)), user, names[rng.choice(letters)], rng.uniform(0, 60), ""))
    return written(spark, folder, events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bit_kernels():
    """Bit-parallel columns against plain tables, at all word sizes and window lengths."""
    rng = random.Random(3)
    for size in (1, 3, 8, 9, 17, 40, 64):
        refs = ["".join(rng.choices("abc\u00e9", k=size)) for _ in range(15)]
        wins = ["".join(rng.choices("abcd\u00e9", k=rng.choice((1, 2, 7, 12, 13, 90)))) for _ in range(15)]
        units = bits.Units(refs)
        assert {k: v.tolist() for k, v in bits.edit_distances(units, wins)} == {k: [distances.levenshtein(w, r) for r in refs] for k, w in enumerate(wins)}
        assert {k: [x / size for x in v.tolist()] for k, v in bits.infix_distances(units, wins)} == {k: [distances.infix_norm(r, w) for r in refs] for k, w in enumerate(wins)}
        assert {k: [x / len(wins[k]) for x in v.tolist()] for k, v in bits.prefix_align_distances(units, wins)} == {k: [distances.prefix_align(w, r)[0] for r in refs] for k, w in enumerate(wins)}
        assert {k: [(x >> 7) / (x & 127) for x in v.tolist()] for k, v in bits.prefix_distances(units, wins, 1)} == {k: [distances.prefix_norm(r, w, 1) for r in refs] for k, w in enumerate(wins)}


def test_best_units_make_no_row_a_pair(spark, tmp_path):
    """the best unit of every window, its rows as many as windows, not as pairs; equal units by their number."""
    d = streams(spark, tmp_path, [3, 5, 8, 9, 12, 30, 30, 2, 1] * 3)
    windows, units = catalog.trailing_windows(spark, d), catalog.lexicon(spark, d)
    near = blocks.nearest_units(windows, "user_id", "win", units, "unit", "ref", 0.6, 1).collect()
    lengths = len({len(r["ref"]) for r in units.collect()})
    assert len(near) <= 27 * lengths * 1 and "LevenshteinDistance" not in plan_of(catalog.queries()["session_top_unit"](spark, d))
    want = {}
    for w in windows.collect():
        fit = [(round(distances.edit_norm(w["win"], u["ref"]), 9), u["unit"]) for u in units.collect() if blocks.fits(w["win"], len(u["ref"]), 0.6)]
        if fit:
            want[w["user_id"]] = min(fit)
    assert {r["user_id"]: (r["cost"], r["unit"]) for r in catalog.queries()["session_top_unit"](spark, d).collect()} == want


def test_five_best_units(spark, tmp_path):
    """the same with five, over several blocks of units."""
    d, held = streams(spark, tmp_path, [8, 9, 12, 30, 3] * 4, letters="ce"), blocks.UNITS
    windows, units = catalog.trailing_windows(spark, d).collect(), catalog.lexicon(spark, d).collect()
    try:
        blocks.UNITS = 3
        got = catalog.queries()["edit_norm_topk"](spark, d).collect()
    finally:
        blocks.UNITS = held
    want = []
    for w in windows:
        fit = sorted((round(distances.edit_norm(w["win"], u["ref"]), 9), u["unit"]) for u in units if blocks.fits(w["win"], len(u["ref"]), 0.6))
        want += [(w["user_id"], unit, cost, k) for k, (cost, unit) in enumerate(fit[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_costs_of_all_pairs(spark, tmp_path):
    """F8: every pair of admissible lengths once, units in several blocks."""
    d, held = streams(spark, tmp_path, [8, 9, 12, 30, 3] * 4), blocks.UNITS
    windows, units = catalog.trailing_windows(spark, d).collect(), catalog.lexicon(spark, d).collect()
    try:
        blocks.UNITS = 3
        df = catalog.queries()["infix_cost"](spark, d)
        got = df.collect()
    finally:
        blocks.UNITS = held
    assert "ArrowEvalPython" not in plan_of(df)
    assert sorted(map(tuple, got)) == sorted((w["user_id"], u["unit"], distances.infix_norm(u["ref"], w["win"])) for w in windows for u in units if blocks.fits(w["win"], len(u["ref"]), 0.6))


def test_prefix_costs_of_short_units(spark, tmp_path):
    """a unit of under four tokens has no beginning of four, so no row (before: an infinite cost)."""
    d = streams(spark, tmp_path, [3, 4, 5, 8, 12, 2])
    windows, units = catalog.trailing_windows(spark, d).collect(), catalog.lexicon(spark, d).collect()
    got = {(r["user_id"], r["unit"]): r["cost"] for r in catalog.queries()["prefix_cost"](spark, d).collect()}
    assert got == {(w["user_id"], u["unit"]): distances.prefix_norm(u["ref"], w["win"], 4) for w in windows for u in units if len(u["ref"]) >= 4 and blocks.fits(w["win"], len(u["ref"]), 0.6)}


def test_prefix_align_costs_without_a_row_in_python(spark, tmp_path):
    """codes leave Python as arrays, not a row a pair."""
    d = streams(spark, tmp_path, [8, 9, 12, 30, 3] * 2)
    windows, units = catalog.trailing_windows(spark, d).collect(), catalog.lexicon(spark, d).collect()
    df = catalog.queries()["prefix_align_cost"](spark, d)
    assert "ArrowEvalPython" not in plan_of(df)
    assert sorted(map(tuple, df.collect())) == sorted((w["user_id"], u["unit"], distances.prefix_align(w["win"], u["ref"])[0]) for w in windows for u in units if blocks.fits(w["win"], len(u["ref"]), 0.6))


def look_alike_units(lengths, seed=7):
    """(id, code) with planted look-alikes and copies."""
    rng = random.Random(seed)
    codes = ["".join(rng.choices("cepsv", k=n)) for n in lengths]
    codes += ["".join("c" if rng.random() < 0.4 else t for t in c) for c in codes[::3]] + codes[::5]
    return list(enumerate(codes))


def brute_pairs(units, tau):
    return {(a, b): k for a, x in units for b, y in units if a < b and x and y and (k := distances.levenshtein(x, y)) <= int(tau * max(len(x), len(y)))}


def in_small_blocks(make, size=8):
    held = blocks.CODES
    blocks.CODES = size
    try:
        return make()
    finally:
        blocks.CODES = held


def test_look_alikes_by_blocks(spark):
    """all pairs once, over blocks of one and of several lengths, bands of a word and wider ones."""
    for tau, lengths in ((0.53, [*range(45, 80, 3), 150, 160, 0, 1, 2]), (0.9, [5, 60, 60, 61, 70])):
        units = look_alike_units(lengths)
        df = spark.createDataFrame(units, "id long, code string")
        got = in_small_blocks(lambda: retrieval.confusable_pairs(df, "id", "code", tau).collect())
        assert len(got) == len(set(got)) and {(r["a"], r["b"]): r["dist"] for r in got} == brute_pairs(units, tau)
    assert "BatchEvalPython" not in plan_of(retrieval.confusable_pairs(df, "id", "code", tau)) and "ArrowEvalPython" not in plan_of(retrieval.confusable_pairs(df, "id", "code", tau))


def test_components_from_spanning_links(spark):
    """a pair of blocks gives fewer links than it has codes, and the components are those of all pairs."""
    units = look_alike_units(range(20, 60, 2)) + [(1000 + k, "cepsvcepsv") for k in range(30)]
    df = spark.createDataFrame(units, "id long, code string")
    parent = {k: k for k, _ in units}
    pairs = brute_pairs(units, 0.53)
    for a, b in sorted(pairs) * len(units):
        parent[a] = parent[b] = min(parent[a], parent[b])
    assert blocks.look_alike_links(df, "id", "code", 0.53).count() < len(pairs)
    got = in_small_blocks(lambda: retrieval.confusable_components(df, "id", "code", 0.53).collect())
    assert {r["node"]: r["component"] for r in got} == {k: parent[k] for k in {x for p in pairs for x in p}}


def test_component_order_of_copies(spark, tmp_path):
    """components by size, then by first unit, from spanning links."""
    d = streams(spark, tmp_path, [40] * 12, letters="ce")
    r = catalog.queries()["component_order"](spark, d).collect()
    units = [(u["id"], u["code"]) for u in catalog._codes(spark, d)[0].collect()]
    assert sorted(int(m) for x in r for m in x["members"].split(",")) == sorted({x for p in brute_pairs(units, 0.53) for x in p})
    assert [x["place"] for x in sorted(r, key=lambda x: (-x["size"], x["component"]))] == list(range(1, len(r) + 1))


def test_neighbours_tell_look_alikes_apart(spark):
    """each side judged over all look-alikes, with neighbours shared, missing and ambiguous."""
    units = look_alike_units(range(20, 50, 2))
    rng = random.Random(9)
    chain = [(k, rng.choice((None, 900, 901, k - 1)), rng.choice((None, 902, k + 1))) for k, _ in units]
    pairs = brute_pairs(units, 0.53)
    twins = {}
    for a, b in pairs:
        twins.setdefault(a, set()).add(b)
        twins.setdefault(b, set()).add(a)
    by = {k: (p, s) for k, p, s in chain}
    tells = lambda a, n: by[a][n] is not None and by[a][n] not in twins and all(by[b][n] != by[a][n] for b in twins[a])
    want = {a: {(True, True): "both", (True, False): "pred", (False, True): "succ", (False, False): "none"}[tells(a, 0), tells(a, 1)] for a in twins}
    tables = spark.createDataFrame(units, "id long, code string"), spark.createDataFrame(chain, "unit long, before long, after long")
    got = in_small_blocks(lambda: retrieval.resolvable(tables[0], "id", "code", 0.53, tables[1]).collect())
    assert {r["unit"]: r["kind"] for r in got} == want and len(set(want.values())) > 1


def test_shortlist_by_blocks(spark):
    """both rankings as from all counts, over units of several lengths and blocks, frequent and rare grams."""
    rng, held = random.Random(6), blocks.INDEXED
    units = [(k, rng.choices("abcdefgh" if k % 3 else "ab", k=rng.randrange(3, 9))) for k in range(120)]
    windows = spark.createDataFrame([(k, rng.choices("abcdefgh" if k % 2 else "ab", k=12)) for k in range(20)], "window long, w array<string>")
    u = spark.createDataFrame(units, "unit long, w array<string>")
    index, lengths = retrieval.postings(u, "unit", "w"), u.select("unit", F.size("w").alias("len"), (-F.col("unit")).alias("unit_ord"))
    want = retrieval.shortlist(retrieval.gram_counts(windows, "window", "w", index), lengths, 6, 3)
    try:
        blocks.INDEXED = 30
        hits = retrieval.gram_shortlist(windows, "window", "w", index, lengths, raw=6, scaled=3)
        columns = ["window", "unit", "cnt", "first_pos", "raw_rank", "scaled_rank"]
        few = lambda df: {(r["window"], r["unit"], r["cnt"], r["first_pos"], r["raw_rank"] if r["raw_rank"] <= 6 else 0, r["scaled_rank"] if r["scaled_rank"] <= 3 else 0) for r in df.select(*columns).collect()}
        assert few(hits) == few(want)
    finally:
        blocks.INDEXED = held


def test_expanded_counts_by_blocks(spark):
    """positions with second choices, counted in arrays; the plan has no row for a gram of a pair."""
    rng = random.Random(4)
    units = [(k, rng.choices("abc", k=rng.randrange(1, 9))) for k in range(25)]
    windows = [(100 + k, rng.choices("abcd", k=n), [rng.choice((None, "a", "b")) for _ in range(n)]) for k, n in enumerate((1, 2, 3, 7, 12, 12, 12))]
    index = retrieval.postings(spark.createDataFrame(units, "unit long, w array<string>"), "unit", "w")
    df = retrieval.expanded_counts(spark.createDataFrame(windows, "window long, w array<string>, second array<string>"), "window", "w", "second", index)
    want = {}
    for key, w, second in windows:
        for unit, ref in units:
            have = {tuple(ref[k : k + 3]) for k in range(len(ref) - 2)}
            hits = [k for k in range(len(w) - 2) if any(g in have for g in itertools.product(*[{w[j], second[j]} - {None} for j in range(k, k + 3)]))]
            if hits:
                want[key, unit] = (len(hits), hits[0])
    assert {(r["window"], r["unit"]): (r["cnt"], r["first_pos"]) for r in df.collect()} == want
    assert "SortMergeJoin" not in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)
