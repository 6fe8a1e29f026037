"""The detector as one object: a configuration, a lexicon, and runs over tables and streams of tokens."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.operators import retrieval
from seqloom.streaming import run, steppers


@dataclass(frozen=True)
class Config:
    """Every tunable of the chain detector, with its default."""

    window_s: float = 10.0
    hop_s: float = 1.5
    scales: tuple[float, ...] = (0.2, 0.7, 1.0, 1.5, 2.2)
    least_tokens: int = 4
    most_cost: float = 0.30
    coverage: float = 0.15
    shortlist: int = 60
    shortlist_by_length: int = 20
    page_bonus: float = 0.0
    votes_next: int = 1
    votes_jump: int = 2
    strong: float = 0.15
    advance: float = 2.0
    repeat: float = 20.0
    streak_least: int = 3
    near: int = 2
    depth: int = 2
    early_prefix: float | None = None


@dataclass
class Detector:
    """``units``: key 's:a' or 's:a#k' -> tokens, in canonical order; ``twins``: key -> keys that sound alike."""

    spark: SparkSession
    units: dict[str, list[str]]
    twins: dict[str, list[str]] = field(default_factory=dict)
    config: Config = Config()
    page: frozenset[str] = frozenset()
    blacklist: frozenset[str] = frozenset()

    def with_page(self, keys) -> Detector:
        return replace(self, page=frozenset(keys))

    def with_blacklist(self, keys) -> Detector:
        return replace(self, blacklist=frozenset(keys))

    @property
    def successor(self) -> dict[str, str]:
        order = list(self.units)
        return dict(zip(order, order[1:]))

    def letters(self) -> dict[str, str]:
        """Token -> its own code point, in first-seen order; the private area holds thousands."""
        seen = dict.fromkeys(t for tokens in self.units.values() for t in tokens)
        return {t: chr(0xE001 + k) for k, t in enumerate(seen)}

    def windows(self, tokens: DataFrame) -> DataFrame:
        """(stream, t, token) -> (window: struct<stream, scale, w1>, win): hopping windows of every scale as strings, unknown tokens as one letter."""
        c, letters = self.config, self.letters()
        known = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])  # as long as the vocabulary
        rows = tokens.select("stream", "t", F.coalesce(F.try_element_at(known, F.col("token")), F.lit(chr(0xE000))).alias("letter"))
        scale = F.explode(F.array(*[F.lit(float(s)) for s in c.scales])).alias("scale")
        rows = rows.select("*", scale).withColumn("width", F.col("scale") * c.window_s)
        first = F.greatest(F.lit(0.0), F.ceil((F.col("t") - F.col("width")) / c.hop_s + 1e-9))
        hops = F.sequence(first.cast("int"), F.floor(F.col("t") / c.hop_s + 1e-9).cast("int"))
        rows = rows.withColumn("hop", F.explode(F.when(first <= F.floor(F.col("t") / c.hop_s + 1e-9), hops).otherwise(F.array().cast("array<int>"))))
        w1 = F.round(F.col("hop") * c.hop_s + F.col("width"), 6)
        whole = F.sort_array(F.collect_list(F.struct("t", "letter")))  # one window
        made = rows.groupBy(F.struct("stream", "scale", w1.alias("w1")).alias("window")).agg(F.array_join(F.transform(whole, lambda x: x["letter"]), "").alias("win"))
        return made.where(F.length("win") >= c.least_tokens)

    def fires(self, tokens: DataFrame) -> DataFrame:
        """(stream, w1, kind, key, cost, win): the best unit of every window that is good enough, and, for early firing, the widest windows."""
        c, letters = self.config, self.letters()
        rows = [(k, "".join(letters[t] for t in tokens), i) for i, (k, tokens) in enumerate(self.units.items())]
        units = self.spark.createDataFrame(rows, "unit string, ref string, unit_ord int")
        windows = self.windows(tokens)
        split = lambda name: F.filter(F.split(F.col(name), ""), lambda x: x != "")
        index = F.broadcast(retrieval.postings(units.select("unit", split("ref").alias("w")), "unit", "w"))  # the lexicon, a dimension
        counts = retrieval.gram_counts(windows.select("window", split("win").alias("w")), "window", "w", index)
        short = retrieval.shortlist(counts, F.broadcast(units.select("unit", F.length("ref").alias("len"), "unit_ord")), c.shortlist, c.shortlist_by_length)
        place = F.when(F.col("raw_rank") <= c.shortlist, F.col("raw_rank")).otherwise(c.shortlist + F.col("scaled_rank"))
        found = short.select("window", "unit", place.alias("place")).join(F.broadcast(units), "unit").join(windows, "window")
        on_page = F.col("unit").isin(list(self.page)) if self.page else F.lit(not self.blacklist)
        black = F.col("unit").isin(list(self.blacklist)) if self.blacklist else F.lit(False)
        bonus = c.page_bonus if self.page else 0.0
        best = retrieval.window_best(found.withColumn("on_page", on_page).withColumn("blacklisted", black), c.most_cost, bonus, c.coverage)
        fired = best.where("fired").select("window.stream", "window.w1", F.lit(1).alias("kind"), F.col("unit").alias("key"), F.col("eff").alias("cost"), F.lit(None).cast("array<string>").alias("win"))
        if c.early_prefix is None:
            return fired
        back = {v: k for k, v in letters.items()}
        known = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])
        heard = F.transform(split("win"), lambda x: F.coalesce(F.try_element_at(known, x), F.lit("")))
        asked = windows.where(F.col("window.scale") == float(max(c.scales))).select("window.stream", "window.w1", F.lit(0).alias("kind"), F.lit("").alias("key"), F.lit(0.0).alias("cost"), heard.alias("win"))
        return fired.unionByName(asked)

    def voter(self) -> steppers.Voter:
        c = self.config
        return steppers.Voter(self.units, self.successor, self.twins, c.votes_next, c.votes_jump, c.most_cost, c.strong, c.advance, 2.0, c.repeat, c.streak_least, c.near, c.early_prefix)

    def run(self, tokens: DataFrame) -> DataFrame:
        """(stream, at, key, w1, cost): what every stream emits, in order."""
        return run.fold(self.fires(tokens), "stream", ["w1", "kind", "key", "cost"], self.voter())

    def chains(self, tokens: DataFrame) -> DataFrame:
        """(stream, at, parent, place): emissions that make a chain; the rest is held back and goes."""
        parts = F.split("key", "#")
        said = self.run(tokens).select("stream", "at", "w1", parts[0].alias("parent"), F.get(parts, 1).cast("int").alias("place"))
        return run.fold(said, "stream", ["at", "w1"], steppers.Assemble(self.successor, self.config.depth))

    def run_stream(self, fires: DataFrame, idle: str | None = None) -> DataFrame:
        """``run`` of an unbounded table of fires: one state a stream, finished after ``idle`` without rows."""
        return run.follow(fires, "stream", ["w1", "kind", "key", "cost"], self.voter(), idle)


def decoded(buffers: DataFrame, decode) -> DataFrame:
    """(stream, t0, samples: array<double>) -> (stream, t, token) by an injected ``decode``: samples -> [(token, seconds from t0), ...]."""
    kind = dict(buffers.dtypes)["stream"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for stream, t0, samples in zip(*(batch.column(c).to_pylist() for c in ("stream", "t0", "samples"))):
                out += [(stream, t0 + at, token) for token, at in decode(np.array(samples))]
            streams, times, tokens = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(streams, batch.schema.field("stream").type), pa.array(times, pa.float64()), pa.array(tokens, pa.string())], names=["stream", "t", "token"])

    return buffers.select("stream", "t0", "samples").mapInArrow(run, f"stream {kind}, t double, token string")


def observe(spark: SparkSession, on_status):
    """Calls ``on_status`` (name, batch, rows) after every micro-batch of any stream; returns the listener, for removal."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            on_status(event.progress.name, event.progress.batchId, event.progress.numInputRows)

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
