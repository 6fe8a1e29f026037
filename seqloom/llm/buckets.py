"""Buckets of rows that share a key, split so that no group is large, and links inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def pair_groups(rows: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """``rows`` with (chunk, lo, hi): rows that share ``keys`` meet in at least one group (keys, lo, hi).

    Keys with one row are dropped. A key with more than ``limit`` rows is split by hash of ``by`` into
    c chunks and each row goes to c groups, one for each pair of chunks with its own; a group then holds
    about 2 * limit rows at most. Counting is a grouped sum, the join against it (one row a key) is one
    Spark can split.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1")
    chunks = F.ceil(F.col("bucket_rows") / F.lit(limit)).cast("int")
    met = rows.join(counts, keys).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "chunks", "bucket_rows")


def dealt(groups: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``groups`` partitioned by group (keys, lo, hi) and sorted by it."""
    return groups.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", by)


def far_groups(rows: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """Large buckets after their rows were compared with one of them, the pivot: ``rows`` says in ``near`` which are linked to it.

    Those belong together already, so only a far row has to meet the others. Far rows are split into chunks of
    ``limit``, all rows likewise, and every chunk of far rows meets every chunk of all in a group (keys, lo, hi). A bucket
    of copies of one row costs one pass; the number of rows dealt is that of all rows times chunks of far ones.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_all"), F.count_if(~F.col("near")).alias("n_far")).where("n_far > 0")
    met = rows.join(counts, keys).withColumns({
        "fars": F.ceil(F.col("n_far") / F.lit(limit)).cast("int"), "alls": F.ceil(F.col("n_all") / F.lit(limit)).cast("int"),
    }).withColumns({"far": F.pmod(F.xxhash64(by), F.col("fars")).cast("int"), "own": F.pmod(F.xxhash64(by), F.col("alls")).cast("int")})
    among = F.transform(F.sequence(F.lit(0), F.col("fars") - 1), lambda f: F.struct(f.alias("lo"), F.col("own").alias("hi")))
    against = F.transform(F.sequence(F.lit(0), F.col("alls") - 1), lambda a: F.struct(F.col("far").alias("lo"), a.alias("hi")))
    places = F.when(F.col("near"), among).otherwise(F.array_union(among, against))
    return met.withColumn("place", F.explode(places)).select(*[c for c in rows.columns if c != "near"], "place.lo", "place.hi")


def group_numbers(columns: list[np.ndarray]) -> np.ndarray:
    """0, 1, ... for sorted rows, rising where any of ``columns`` changes."""
    change = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def group_edges(columns: list[np.ndarray]) -> list[int]:
    """The rows at which groups of sorted rows begin, and the number of rows."""
    of = group_numbers(columns)
    return [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]


class Forest:
    """Union-find over 0..n-1, with whole-array relabelling between rounds of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for all i, by hooking least labels until nothing changes."""
        while len(a):
            x, y = self.label[a], self.label[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            least = np.minimum(x, y)
            root = self.label.copy()
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
            while not np.array_equal(again := root[root], root):
                root = again
            self.label = root[self.label]
