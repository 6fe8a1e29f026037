"""Operator 8: embedding near-duplicates by Euclidean p-stable hashing.

Vectors of equal label are compared by cosine. Exact copies are one class. Normalised class vectors are
projected on Gaussian directions, shifted and cut into steps of ``width``; ``k`` such numbers make a
key and ``tables`` tables of keys bucket the vectors. At the threshold's distance d = sqrt(2 - 2 * cos)
one projection agrees with probability p (closed form below), so a pair is found with probability
1 - (1 - p^k)^tables, at least ``recall``; k grows with the logarithm of the number of classes, which
keeps buckets small. Every pair that shares a bucket is then checked exactly in double precision, and
counted in the first table in which it meets.

Buckets are formed from keys alone; a vector follows only into buckets that it shares, in the type it came in. Hot buckets
are split into pairs of chunks, so no task holds one whole; pairs never leave a task, only link counts and
spanning links do.

Defined cases: null labels, null or zero vectors, null or non-finite components and lengths that differ
link with nothing (0 links, own component); exact copies of one label link with each other; repeated rows count
as other vectors, as do two vectors of one vec_id, each with its own label and links; components are named by their least
vec_id, so ids that name two vectors can name two components; rows with a null vec_id link and count like others but
have no component of their own name and are not kept; components of any size up to the largest double are
scaled first; very long vectors are hashed and compared whole; an empty table gives an empty result; other
columns are ignored. Copies are told by 128-bit hashes of label and vector.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import map_batches, map_sorted_groups
from seqloom.llm.buckets import Forest, dealt, group_edges, pair_groups
from seqloom.operators.components import connected_components
from seqloom.runtime import Scratch, cut

WIDTH, LIMIT = 1.6, 1024


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two points at ``distance`` agrees."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def scheme(classes: int, threshold: float, recall: float = 0.997) -> tuple[int, int]:
    """(k, tables) for so many classes."""
    p, chance = agreement(sqrt(2 - 2 * threshold)), agreement(sqrt(2))
    k = max(4, ceil(log(max(1, classes) / 2000) / -log(chance))) if classes > 2000 else 4
    return k, ceil(log(1 - recall) / log(1 - p**k))


def keys_of(vectors: np.ndarray, k: int, tables: int, seed: int = 8) -> np.ndarray:
    """(n, tables) int64 keys of unit vectors."""
    make = np.random.default_rng([seed, vectors.shape[1]])
    directions = make.standard_normal((vectors.shape[1], k * tables))
    shifts = make.uniform(0, WIDTH, k * tables)
    cells = np.floor((vectors @ directions + shifts) / WIDTH).astype(np.int64).reshape(len(vectors), tables, k)
    out = np.zeros(cells.shape[:2], dtype=np.int64)
    for j in range(k):
        out = out * 1_000_003 + cells[:, :, j]
    return out


def links_in_group(vectors: np.ndarray, keys: np.ndarray, table: int, weight: np.ndarray, cross: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row counted here, first row of its component). ``vectors`` are scaled: no component is over 1.

    ``cross``: rows' chunk numbers when only rows of different chunks are compared.
    """
    norm = np.sqrt((vectors * vectors).sum(1))
    linked = (vectors @ vectors.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(linked, False)
    if cross is not None:
        linked &= cross[:, None] != cross[None, :]
    i, j = np.nonzero(np.triu(linked))
    forest = Forest(len(vectors))
    forest.link(i, j)
    if table:
        fresh = ~(keys[i, :table] == keys[j, :table]).any(1)
        i, j = i[fresh], j[fresh]
    count = np.bincount(i, weight[j], len(vectors)) + np.bincount(j, weight[i], len(vectors))
    return count.astype(np.int64), forest.label


def scaled(flat: np.ndarray, width: int) -> np.ndarray:
    """(n, width) doubles, every row divided by its largest component, so that squares neither overflow nor vanish."""
    x = flat.reshape(-1, width).astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True)


def hashed_classes(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """(node, label, width, keys) of every class."""

    def make(batch: pa.RecordBatch) -> dict:
        lists = batch.column("v")
        widths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(widths)])
        keys = np.zeros((len(widths), tables), dtype=np.int64)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            x = scaled(flat[(at[rows][:, None] + np.arange(width)).ravel()], width)
            keys[rows] = keys_of(x / np.sqrt((x * x).sum(1, keepdims=True)), k, tables)
        return {"node": batch.column("node"), "label": batch.column("label"), "width": pa.array(widths.astype(np.int32)), "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))}

    kind = classes.schema["label"].dataType.simpleString()
    return map_batches(classes.select("node", "label", "v"), make, f"node bigint, label {kind}, width int, keys array<bigint>")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    known = rows.where("fine").select("vec_id", "label", "v", F.xxhash64("label", "v").alias("c1"), F.xxhash64(F.lit(7).cast("bigint"), "label", "v").alias("c2"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    with Scratch() as keep:
        copies = known.groupBy("c1", "c2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        classes = keep(copies.withColumn("node", F.xxhash64(F.monotonically_increasing_id())))  # one-to-one on 64-bit numbers
        k, tables = scheme(classes.count(), threshold)
        keyed = keep(hashed_classes(classes, k, tables))
        found = keep(bucket_links(classes, keyed, tables, threshold, limit, keep))
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        parts = connected_components(found.select(F.col("node").alias("a"), F.col("first").alias("b")))
        named = keep(classes.select("c1", "c2", "node", "least", "copies").join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
        names = named.groupBy("component").agg(F.min("least").alias("component_id"))
        told = cut(named.join(names, "component").select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    whole = known.select("vec_id", "c1", "c2").join(told, ["c1", "c2"]).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return whole.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def bucket_links(classes: DataFrame, keyed: DataFrame, tables: int, threshold: float, limit: int, keep: Scratch) -> DataFrame:
    """(node, links, first): for every class and group its links counted there and the first class of its component there."""
    # the label is part of the key, so only vectors of one label and one length meet
    cells = keyed.select("node", "label", "width", F.posexplode("keys").alias("t", "cell"))
    names = ["label", "width", "t", "cell"]
    groups = pair_groups(cells, names, "node", limit).select(F.xxhash64(*names).alias("g1"), F.xxhash64(F.lit(7).cast("bigint"), *names).alias("g2"), "t", "chunk", "lo", "hi", "node")
    vectors = classes.select("node", "v", "copies").join(keyed.select("node", "keys"), "node")
    # of its keys a vector takes those of earlier tables along: a pair counts in the first table in which it meets
    met = groups.join(vectors, "node").withColumn("keys", F.slice("keys", F.lit(1), F.col("t")))

    def make(table: pa.Table) -> dict:
        t, chunk, lo, hi = (table[c].to_numpy() for c in ("t", "chunk", "lo", "hi"))
        edges = group_edges([table["g1"].to_numpy(), table["g2"].to_numpy(), lo, hi])
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy().astype(float)
        flat, keys = table["v"].combine_chunks(), table["keys"].combine_chunks()
        flat_v, flat_k = flat.flatten().to_numpy(), keys.flatten().to_numpy()
        start, before = (np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))]) for x in (flat, keys))
        out: dict[str, list] = {"node": [], "links": [], "first": []}
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            x = scaled(flat_v[start[a] : start[b]], int(start[a + 1] - start[a]))
            cross = chunk[a:b] if lo[a] != hi[a] else None
            count, first = links_in_group(x, flat_k[before[a] : before[b]].reshape(b - a, int(t[a])), int(t[a]), copies[a:b], cross, threshold)
            some = (count > 0) | (first != np.arange(b - a))
            out["node"] += node[a:b][some].tolist()
            out["links"] += count[some].tolist()
            out["first"] += node[a:b][first[some]].tolist()
        return out

    columns = ["g1", "g2", "lo", "hi", "t", "chunk", "node", "copies", "v", "keys"]
    return map_sorted_groups(dealt(met.select(*columns), ["g1", "g2"], "node"), ["g1", "g2", "lo", "hi"], make, "node bigint, links bigint, first bigint", most_rows=8_000)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
