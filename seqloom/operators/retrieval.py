"""n-gram retrieval, scoring and confusability over token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.functions import distances
from seqloom.operators import blocks
from seqloom.operators.components import connected_components
from seqloom.runtime import cut


def grams(tokens: Column, n: int = 3) -> Column:
    """All n-grams in order, as space-joined strings (an empty array for short inputs)."""
    last = F.size(tokens) - n + 1
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))


def postings(units: DataFrame, unit: str, tokens: str, n: int = 3) -> DataFrame:
    """(gram, unit), each pair once: the inverted index."""
    return units.select(F.col(unit).alias("unit"), F.explode(F.array_distinct(grams(F.col(tokens), n))).alias("gram"))


def gram_counts(windows: DataFrame, window: str, tokens: str, index: DataFrame, n: int = 3) -> DataFrame:
    """(window, unit, cnt, first_pos): window positions whose n-gram occurs in the unit. A window's equal grams meet the index once."""
    probes = windows.select(F.col(window).alias("window"), F.posexplode(grams(F.col(tokens), n)).alias("pos", "gram"))
    probes = probes.groupBy("window", "gram").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))
    return probes.join(index, "gram").groupBy("window", "unit").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"))


def expanded_counts(windows: DataFrame, window: str, tokens: str, seconds: str, index: DataFrame, n: int = 3) -> DataFrame:
    """``gram_counts`` that also looks up each token's second choice where ``seconds`` (array, as long as ``tokens``) has one.

    A position counts once for a unit, however many of its up to 2 ** n n-grams occur there.
    """
    slots = windows.select(F.col(window).alias("window"), F.transform(F.arrays_zip(F.col(tokens).alias("t"), F.col(seconds).alias("u")), lambda x: F.array_compact(F.array(x["t"], x["u"]))).alias("s"))
    last = F.size("s") - n + 1

    def crossed(left, right):
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat_ws(" ", x, y))))

    def at(i):
        found = F.element_at("s", i.cast("int"))
        for k in range(1, n):
            found = crossed(found, F.element_at("s", (i + k).cast("int")))
        return F.array_distinct(found)

    places = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), at))
    return blocks.gram_hits(slots.where(last >= 1).select("window", places.alias("slots")), index)


def gram_shortlist(windows: DataFrame, window: str, tokens: str, index: DataFrame, lengths: DataFrame, n: int = 3, raw: int = 60, scaled: int = 20) -> DataFrame:
    """``shortlist`` of ``gram_counts`` that makes no row for a pair of a window and a unit out of reach of both rankings."""
    slots = windows.select(F.col(window).alias("window"), F.transform(grams(F.col(tokens), n), lambda g: F.array(g)).alias("slots")).where("size(slots) > 0")
    return shortlist(blocks.gram_hits(slots, index, lengths, max(raw, scaled)), lengths, raw, scaled)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over four partitions a core: few bytes that make many pairs, which Spark would otherwise put into one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def over_all_cores(scan: DataFrame) -> DataFrame:
    """A scan that has fewer splits than there are cores, dealt to all of them; a large one stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Lexicons up to so many rows go to every task.
LEXICON_ROWS = 200_000


def length_banded(windows: DataFrame, units: DataFrame, window: str, ref: str, band: float) -> DataFrame:
    """Every window (string) with every unit whose length is within [band * n, n / band] of the window's n.

    The lexicon is a dimension: up to ``LEXICON_ROWS`` units (checked) it is broadcast, grouped by length, and windows stay where
    they are. Beyond that both sides meet by length, and each length's units are dealt into chunks of that size, so that no
    length is one task.
    """
    w = windows.withColumn("n", F.length(window))
    w = w.withColumn("len", F.explode(F.sequence(F.ceil(F.col("n") * band).cast("int"), F.floor(F.col("n") / band).cast("int"))))
    u = units.withColumn("len", F.length(ref))
    count = units.count()
    if count <= LEXICON_ROWS:
        return spread(w).join(F.broadcast(u), "len")
    chunks = -(-count // LEXICON_ROWS)
    w = w.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return w.join(u.withColumn("chunk", F.pmod(F.xxhash64(ref), F.lit(chunks)).cast("int")), ["len", "chunk"]).drop("chunk")


def shortlist(counts: DataFrame, lengths: DataFrame, raw: int = 60, scaled: int = 20) -> DataFrame:
    """Top ``raw`` units by count and top ``scaled`` by count over length, each window, joined without repeats.

    Ties go by first position, then unit order. ``lengths``: (unit, len, unit_ord).
    """
    c = counts.join(lengths, "unit")
    by_raw = Window.partitionBy("window").orderBy(F.desc("cnt"), "first_pos", "unit_ord")
    by_scaled = Window.partitionBy("window").orderBy(F.desc(F.col("cnt") / F.col("len")), "first_pos", "unit_ord")
    ranked = c.withColumn("raw_rank", F.row_number().over(by_raw)).withColumn("scaled_rank", F.row_number().over(by_scaled))
    return ranked.where((F.col("raw_rank") <= raw) | (F.col("scaled_rank") <= scaled))


def window_best(candidates: DataFrame, fire: float = 0.30, page_penalty: float = 0.08, coverage: float = 0.15, low: float = 0.5, high: float = 1.3) -> DataFrame:
    """The best unit for each window, with its cost ``eff``.

    ``candidates``: (window, win, unit, ref, place in the shortlist, on_page, blacklisted), win and ref as strings of one-letter
    tokens. Length band, black list unless the page vouches, infix cost plus the off-page penalty; among units at or under
    ``fire`` the least coverage-blended score wins, else the least cost; ties by place.
    """
    n, size = F.length("win"), F.length("ref")
    fit = candidates.where((size >= low * n) & (size <= high * n) & ~(F.col("blacklisted") & ~F.col("on_page")))
    cost = distances.infix_norm_letters(F.col("ref"), F.col("win")) + F.when(F.col("on_page"), 0.0).otherwise(page_penalty)
    scored = fit.withColumn("eff", F.round(cost, 9)).withColumn("blend", F.round(F.col("eff") - F.lit(coverage) * F.least(size, n) / n, 9))
    fires = F.col("eff") <= fire
    best = F.struct(F.when(fires, 0).otherwise(1).alias("no"), F.when(fires, F.col("blend")).otherwise(F.col("eff")).alias("score"), "place", "unit", "eff")
    return scored.groupBy("window").agg(F.min(best).alias("best")).select("window", "best.unit", "best.eff", (F.col("best.no") == 0).alias("fired"))


def context_bonus(unit: Column, now: Column, streak: Column, parent_width: int, bonus: float = 0.22, ahead: int = 2, same: float = 0.10, by_streak: float = 0.05, cap: int = 4) -> Column:
    """What a unit's cost is lowered by after ``now`` (integers in canonical order; a parent holds ``parent_width`` of them).

    The next ``ahead`` units get a bonus that decays with distance and grows with the streak; units of the same parent at least ``same``.
    """
    gap, whole = unit - now, F.lit(bonus) + F.lit(by_streak) * F.least(streak, F.lit(cap))
    near = F.when((gap >= 1) & (gap <= ahead), whole * (1 - (gap - 1) / F.lit(ahead + 1.0))).otherwise(0.0)
    stays = F.when(F.floor(unit / parent_width) == F.floor(now / parent_width), same).otherwise(0.0)
    return F.when(now.isNull(), 0.0).otherwise(F.greatest(near, stays))


def better_label(costs: DataFrame, key: str, label: str, least_gain: float = 0.15, most_cost: float = 0.45) -> DataFrame:
    """(key, label, suggestion): the best other candidate where it beats the label's own cost by ``least_gain`` and is at most ``most_cost``.

    ``costs``: (key, label, candidate, cost); a label without a cost counts as 1.
    """
    own = F.min(F.when(F.col("candidate") == F.col(label), F.col("cost")))
    other = F.min(F.when(F.col("candidate") != F.col(label), F.struct("cost", "candidate")))
    best = costs.groupBy(key, label).agg(F.coalesce(own, F.lit(1.0)).alias("own"), other.alias("other"))
    good = (F.col("own") - F.col("other.cost") >= least_gain) & (F.col("other.cost") <= most_cost)
    return best.select(key, label, F.when(good, F.col("other.candidate")).alias("suggestion"))


def confusable_pairs(units: DataFrame, unit: str, code: str, tau: float) -> DataFrame:
    """(a, b, dist), a < b: units whose distance is at most floor(tau * max length).

    Units are dealt into blocks in order of length, and each pair of blocks is compared once, a code against a block at a
    time (``functions.bits.Codes``): a pair's lengths differ by no more than its distance allows, and of its edit table only a band of
    diagonals is computed. A row is made for a pair that is found."""
    return blocks.look_alikes(units, unit, code, tau)


def confusable_components(units: DataFrame, unit: str, code: str, tau: float) -> DataFrame:
    """(node, component) over ``confusable_pairs``, of which only links that span a pair of blocks' components are kept."""
    return connected_components(blocks.look_alike_links(units, unit, code, tau))


def resolvable(units: DataFrame, unit: str, code: str, tau: float, chain: DataFrame) -> DataFrame:
    """(unit, kind): whether neighbours tell an ambiguous unit from its look-alikes: both, pred, succ or none.

    ``chain``: (unit, before, after), one row a unit. A side helps if the unit has a neighbour there that is not ambiguous itself and that no
    look-alike shares."""
    held = units.select(F.col(unit).alias("unit"), F.col(code).alias("code")).join(chain.select("unit", "before", "after"), "unit")
    found = cut(blocks.look_alike_neighbours(held, "unit", "code", tau, "before", "after"))  # a row a unit, read three times
    twin = lambda side: found.select(F.col("unit").alias(side), F.lit(True).alias(f"{side}_twin"))
    t = found.join(chain.select("unit", "before", "after"), "unit").join(twin("before"), "before", "left").join(twin("after"), "after", "left")
    helps = lambda side: F.col(side).isNotNull() & ~F.col(f"same_{side}") & F.col(f"{side}_twin").isNull()
    kind = F.when(helps("before") & helps("after"), "both").when(helps("before"), "pred").when(helps("after"), "succ").otherwise("none")
    return t.select("unit", kind.alias("kind"))
