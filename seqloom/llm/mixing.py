"""Operator 3: mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). What is raked are the cells' expected tokens: they start at an equal
share of every cell and are scaled in turn to the targets of each side until all three are met. No cell can give more than
it has: what a cap takes from a side is made up by its other cells inside the raking, so the targets hold for
the probabilities themselves. A document is taken if a hash of its id falls below its cell's probability, expected over
all tokens of the cell. DataFrame operations only.

``targets`` gives a side's shares by value, {"source": {"web": 0.5, "books": 0.5}}; they are normalised, and values
without one get nothing. A side without targets keeps its observed token shares raised to ``flatten`` (below 1: large values
shrink, small ones grow). A value whose share of ``keep_tokens`` of all tokens is more than it has is taken whole, and the
others share the rest in proportion; where all of a side is not enough, all of it is taken.

The topic is the one of ``topics`` (name -> words) with the most words in the text (see ``forms``), ties in the order given,
else "other".

Defined cases: null or blank source, language or text are values of their own ('', topic "other", 0
tokens); a document without tokens is taken with its cell's probability, which is 1 where the whole cell has none (it costs
nothing), but for values that ``targets`` leaves out; repeated rows share their id's draw, and rows without an id one draw; very
long texts are counted whole; an empty table gives an empty result; further columns pass through untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents
from seqloom.runtime import Scratch, cut

SIDES = ("source", "lang", "topic")
CELL_ROWS = 100_000
#: Topics by some of their words in the four languages of the test tables; a parameter.
TOPICS = {
    "software": "software license code api key token password secret server error function data file http https www version copyright lizenz licence licencia",
    "people": "name email mail phone tel telefon address adresse call contact mr mrs user",
    "trade": "price order offer sale buy shop market product customer preis prix precio",
    "science": "study research theory result method analysis data science experiment",
}


def forms(words: str) -> list[str]:
    """The words as they stand in running text: lower case, capitalised or upper case, with or without a mark behind."""
    return sorted({form + mark for w in words.lower().split() for form in (w, w.capitalize(), w.upper()) for mark in ("", ".", ",", ":", ";")})


def _cells_of(docs: DataFrame, topics: dict[str, str]) -> DataFrame:
    """(row: struct of the input columns, source, lang, topic, tokens)."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    known = {name: forms(found) for name, found in topics.items()}
    everything = sorted({w for found in known.values() for w in found})
    told = F.filter("w", lambda w: w.isin(everything)) if everything else F.array().cast("array<string>")
    count = lambda found: F.size(F.filter("told", lambda w: w.isin(found)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words.alias("w"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SIDES[:2]])
    packed = packed.select("row", "source", "lang", F.size("w").cast("bigint").alias("tokens"), told.alias("told"))
    best = F.array_max(F.array(F.struct(F.lit(0).alias("n"), F.lit(-len(known) - 1).alias("at"), F.lit("other").alias("name")), *[F.struct(count(found).alias("n"), F.lit(-k).alias("at"), F.lit(name).alias("name")) for k, (name, found) in enumerate(known.items())]))
    topic = F.when(F.size("told") > 0, F.coalesce(best["name"], F.lit("other"))).otherwise(F.lit("other"))  # never null, so that a join need not ask
    return packed.select("row", "source", "lang", topic.alias("topic"), "tokens")


def side_targets(cells: DataFrame, side: str, shares: dict[str, float] | None, flatten: float, budget: float) -> DataFrame:
    """(side, goal): the tokens that every value of a side shall give, none more than it has.

    With shares s and tokens t, goal = min(t, c * s); c is raised until the goals add up to ``budget`` or all is taken. One row
    of sums comes back a round; a round settles at least one value or is the last.
    """
    spark = cells.sparkSession
    sums = cells.groupBy(side).agg(F.sum("tokens").cast("double").alias("t"))
    if shares is None:
        sums = sums.withColumn("s", F.pow("t", F.lit(flatten)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{side} string, s double")  # as long as the parameter
        sums = sums.join(F.broadcast(given), side, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    sums = cut(sums)
    scale, before = 0.0, -1.0
    while True:
        full = F.col("s") * F.lit(scale) >= F.col("t")
        row = sums.agg(F.sum(F.when(full, F.col("t")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("s")))).first()
        taken, open_ = float(row[0] or 0.0), float(row[1] or 0.0)
        if taken == before or open_ <= 0:
            break
        scale, before = max(scale, (budget - taken) / open_), taken
    return sums.select(side, F.least(F.col("t"), F.col("s") * F.lit(scale)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = 0.7, keep_tokens: float = 0.5, tolerance: float = 1e-3, rounds: int = 60) -> DataFrame:
    """(source, lang, topic, tokens) -> the same with ``expected`` tokens, raked to the targets of every side (``goal_`` columns).

    Ends when no side's value is off its target by more than ``tolerance`` of all expected tokens, when a round hardly changes
    that (targets that contradict each other), or after ``rounds`` rounds.
    """
    budget = keep_tokens * float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
    now = cells.withColumn("expected", F.col("tokens") * F.lit(float(keep_tokens)))
    for side in SIDES:
        now = now.join(side_targets(cells, side, (targets or {}).get(side), flatten, budget).withColumnRenamed("goal", f"goal_{side}"), side)
    with Scratch() as keep:
        now, before = keep(now.select(*SIDES, "tokens", "expected", *[f"goal_{s}" for s in SIDES]), each=1), None
        for _ in range(rounds):
            new = now
            for side in SIDES:
                new = scaled(new, side)
            new = keep(new, each=1)  # written every round, as a side reads what it scales twice
            keep.drop(now)
            now, off = new, worst(new)
            if off <= tolerance * budget or (before is not None and off >= before * 0.98):
                break
            before = off
        return cut(now)


def scaled(now: DataFrame, side: str) -> DataFrame:
    """Every value of ``side`` brought to its goal: all its cells shrink, or those below their cap grow."""
    at_cap = F.col("expected") >= F.col("tokens")
    sums = now.groupBy(side).agg(F.sum("expected").alias("have"), F.sum(F.when(at_cap, F.col("expected")).otherwise(0.0)).alias("capped"))
    goal = F.col(f"goal_{side}")
    less = F.col("expected") * F.try_divide(goal, F.col("have"))
    more = F.least(F.col("tokens").cast("double"), F.col("expected") * F.try_divide(goal - F.col("capped"), F.col("have") - F.col("capped")))
    new = F.when(goal <= F.col("have"), less).when(at_cap, F.col("expected")).otherwise(more)
    return now.join(sums, side).withColumn("expected", F.coalesce(new, F.lit(0.0))).select(*now.columns)


def worst(raked: DataFrame) -> float:
    """The most tokens by which any value of any side is off its target."""
    off = [raked.groupBy(s).agg(F.abs(F.sum("expected") - F.first(f"goal_{s}")).alias("off")).agg(F.max("off").alias("off")) for s in SIDES]
    return float(off[0].unionAll(off[1]).unionAll(off[2]).agg(F.max("off")).first()[0] or 0.0)


def probabilities(raked: DataFrame) -> DataFrame:
    """``raked`` with ``p``: expected tokens over tokens; cells without tokens have 1, or 0 where a side gives their value nothing."""
    free = F.lit(True)
    for side in SIDES[:2]:
        sums = raked.groupBy(side).agg((F.sum("tokens") == 0).alias(f"none_{side}"))  # such a value asks for nothing, which is no refusal
        raked = raked.join(sums, side)
        free = free & ((F.col(f"goal_{side}") > 0) | F.col(f"none_{side}"))
    p = F.when(F.col("tokens") == 0, free.cast("double")).otherwise(F.least(F.lit(1.0), F.col("expected") / F.col("tokens")))
    return raked.select(*SIDES, "tokens", "expected", *[f"goal_{s}" for s in SIDES], p.alias("p"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topics: dict[str, str] | None = None, flatten: float = 0.7, keep_tokens: float = 0.5, seed: int = 17) -> DataFrame:
    """(row: struct of the input columns, source, lang, topic, tokens, expected, p, taken); ``expected`` is the cell's."""
    rows = _cells_of(docs, TOPICS if topics is None else topics)
    cells = cut(rows.groupBy(*SIDES).agg(F.sum("tokens").alias("tokens")))
    table = cut(probabilities(rake(cells, targets, flatten, keep_tokens)))
    share = table.select(*SIDES, "expected", "p")
    if table.count() <= CELL_ROWS:  # checked size; beyond it Spark picks the join
        share = F.broadcast(share)
    return rows.join(share, list(SIDES)).withColumn("taken", draw(F.col("row.doc_id"), seed) < F.col("p"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("row.doc_id", "source", "lang", "topic", "tokens", F.col("expected").alias("cell_tokens"), "p", "taken")
