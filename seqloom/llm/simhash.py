"""Operator 7: SimHash near-duplicates by bit-sliced comparison.

64-bit fingerprints (majority bits of the hashes of word shingles) link when at most ``radius`` bits
differ. Distinct fingerprints go to tables whose keys are the bits of all but ``radius`` + extra blocks:
with b blocks and radius r, any two fingerprints within r agree on b - r whole blocks, so the C(b, r)
tables that each keep b - r blocks miss no pair. b grows with the number of distinct fingerprints, so
buckets stay small; every choice is exact.

Inside buckets the comparison is bit-sliced: bit planes are stored vertically (a word holds one bit of 64
fingerprints), and a whole bucket run is compared with itself shifted by 1, 2, ... rows. Carry-save
adders update 64 distances with a few word operations a plane, and words whose 64 distances
all exceed the radius are abandoned. Only spanning links leave a task; components come from
distributed star contraction. A bucket of over ``limit`` fingerprints is first compared with its least row's, one
by one; only fingerprints that are not linked to it meet the others, in chunks.

Defined cases: null or wordless text has fingerprint 0, linked like any other; fewer words than a
shingle make one shingle; very long texts are hashed whole; repeated rows get the same component, and of rows that share a doc_id but
not the text each gets its own text's; rows with a null doc_id have no component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, map_sorted_groups, texts
from seqloom.llm.buckets import Forest, dealt, far_groups, group_numbers
from seqloom.operators.components import connected_components
from seqloom.runtime import cut

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4
LIMIT = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp: the 64 bits as a signed long)."""

    def make(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle) for t in texts(batch)], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, "doc_id bigint, fp bigint")


def table_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The key bits of every table, as signed longs."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Two key blocks of about 21 bits to 2**24 fingerprints, then three, then four."""
    return radius + (2 if n < 1 << 24 else 3 if n < 1 << 30 else 4)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) uint64: bit i of word w of plane k is bit k of fingerprint 64 * w + i."""
    words = -(-len(fps) // 64) + 1  # one word of padding for shifts
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    held = np.zeros((BITS, words * 64), dtype=np.uint8)
    held[:, : len(fps)] = bits.T
    return np.packbits(held, axis=1, bitorder="little").view("<u8")


def shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes moved down by ``by`` rows; rows beyond the end are zero."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(planes)
    kept = planes[:, words:]
    out[:, : kept.shape[1]] = kept >> np.uint64(bits)
    if bits and kept.shape[1] > 1:
        out[:, : kept.shape[1] - 1] |= kept[:, 1:] << np.uint64(64 - bits)
    return out


def within(planes: np.ndarray, other: np.ndarray, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """``alive`` (words of candidate bits) without the bits whose planes differ in over ``radius`` places.

    Distances are kept in bit-sliced counters that saturate at 8; words without a candidate left are
    abandoned after each block of eight planes.
    """
    result = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    live = alive[at]
    ones, twos, fours, eights = (np.zeros(len(at), dtype=np.uint64) for _ in range(4))
    for k in range(0, BITS, 8):
        diff = planes[k : k + 8, at] ^ other[k : k + 8, at]
        for j in range(0, 8, 2):
            a, b = diff[j], diff[j + 1]
            u = ones ^ a  # full adder: ones + a + b
            carry = (ones & a) | (u & b)
            ones = u ^ b
            more = twos & carry
            twos = twos ^ carry
            eights |= fours & more
            fours = fours ^ more
        over = eights | (fours & (ones | twos)) if radius == 4 else _over(ones, twos, fours, eights, radius)
        live = live & ~over
        keep = live != 0
        if not keep.all():
            at, live, ones, twos, fours, eights = (x[keep] for x in (at, live, ones, twos, fours, eights))
            if not len(at):
                return result
    result[at] = live
    return result


def _over(ones, twos, fours, eights, radius: int):
    """Bits whose counters exceed a radius of 0 to 7."""
    over, equal = eights.copy(), ~eights
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal = equal & plane
        else:
            over |= equal & plane
            equal = equal & ~plane
    return over


def linked(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group: the first row of each row's component under links inside its group."""
    forest = Forest(len(fps))
    sizes = np.bincount(group)[group]
    rows = np.arange(len(fps))
    lag = 1
    while True:
        rows = rows[sizes[rows] > lag]
        if not len(rows):
            return forest.label
        planes, of = planes_of(fps[rows]), group[rows]
        for d in range(lag, 2 * lag):
            if d >= len(rows):
                break
            same = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
            same[: len(rows) - d] = of[:-d] == of[d:]
            alive = np.packbits(same, bitorder="little").view("<u8")
            if not alive.any():
                break
            found = within(planes, shifted(planes, d), alive, radius)
            hits = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
            if len(hits):
                forest.link(rows[hits], rows[hits + d])
        lag *= 2


def link_edges(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(node, fp) with distinct fp -> (a, b): links that span every component of fingerprints within ``radius``."""
    masks = table_masks(blocks_for(nodes.count(), radius), radius)
    keyed = nodes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks])).alias("t", "bits"))
    shared = keyed.groupBy("t", "bits").agg(F.count("*").alias("n"), F.min("fp").alias("pivot"), F.min_by("node", "fp").alias("pivot_node")).where("n > 1")
    met = cut(keyed.join(shared, ["t", "bits"]), each=2)
    keys = ["t", "bits", "lo", "hi"]

    def make(table: pa.Table) -> dict:
        of = group_numbers([table[c].to_numpy() for c in keys])
        node = table["node"].to_numpy()
        first = linked(table["fp"].to_numpy().view(np.uint64), of, radius)
        moved = first != np.arange(len(first))
        pairs = np.unique(np.stack([node[first[moved]], node[moved]], axis=1), axis=0)
        return {"a": pairs[:, 0], "b": pairs[:, 1]}

    whole = met.where(f"n <= {limit}").select("t", "bits", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", "fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius
    hot = met.where(f"n > {limit}").select("t", "bits", "node", "fp", "pivot_node", near.alias("near"))
    split = far_groups(hot.drop("pivot_node"), ["t", "bits"], "node", limit)
    groups = whole.unionByName(split).select(*keys, "node", "fp")
    found = map_sorted_groups(dealt(groups, ["t", "bits"], "node"), keys, make, "a bigint, b bigint")
    return found.unionAll(hot.where("near and node <> pivot_node").select(F.col("pivot_node").alias("a"), F.col("node").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    prints = cut(fingerprints(docs, shingle), each=4)  # 16 bytes a document
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64(F.monotonically_increasing_id())), each=2)  # one-to-one
    parts = connected_components(link_edges(nodes.select("node", "fp"), radius))
    grouped = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
