"""Operator 9: fuzzy line dedup by MinHash.

Lines are split at \\n; blank ones (nothing but ASCII white space) are left alone. One pass over the texts gives
every line a 128-bit identity and, with at least ``Q`` characters, MinHash values over its character shingles in
bands of rows; only identities and band keys are shuffled from there on. ``scheme`` sets bands and rows: a pair at
Jaccard 0.8 shares a band with probability ``RECALL`` at least, and rows grow with the logarithm of the corpus,
so that chance meetings stay few. Lines that share a band are fetched from their texts and compared by exact
Jaccard over sorted arrays of 51-bit shingle hashes; links go to distributed star contraction. Of each component one line stays:
the one with the least (first document, identity); in that document, its first occurrence.

Buckets that hold the same lines are compared once. A bucket of over ``LIMIT`` lines (fewer, if they are long) is first
compared with its least line, row by row; only lines that are not linked to it meet the others, in chunks.

Defined cases: null text passes unchanged and counts as no lines; rows with a null doc_id pass unchanged
and take no part; repeated rows (one doc_id) keep the same lines; lines shorter than Q characters match
exactly only; a line counts as repeated if it stands in two documents or twice in one; a text all of whose lines go
becomes empty; very long lines are hashed piece by piece, whole; ties in the first document go by identity; empty
tables give empty results; further columns pass through untouched, whatever their names. Bytes that are not UTF-8
count as replacement characters when lines are compared, and as they are in identities.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, map_sorted_groups, mix64, texts, tidy
from seqloom.llm.buckets import Forest, dealt, far_groups, group_edges
from seqloom.operators.components import connected_components
from seqloom.runtime import Scratch, cut

Q, SIMILARITY, RECALL = 8, 0.8, 0.998
LIMIT, CHUNK_CHARS, PIECE = 256, 1 << 20, 1 << 20
BROADCAST_KEYS = 500_000


def scheme(documents: int) -> tuple[int, int]:
    """(bands, rows) for so many documents."""
    rows = max(3, ceil(log10(max(1, documents)) / 3))
    return ceil(log(1 - RECALL) / log(1 - SIMILARITY**rows)), rows


def blocks(lines: list[str], most: int = 60_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of lines with about ``most`` characters together: their arrays stay in the processor's cache."""
    first, held = 0, 0
    for k, line in enumerate(lines, 1):
        held += len(line)
        if held >= most or k == len(lines):
            yield first, k
            first, held = k, 0


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a hash of the Q characters from every place, starts, ends): line k's shingles lie at [starts[k], ends[k]).

    The lines are laid end to end; what lies between those stretches crosses into the next line. Every line has
    at least Q characters.
    """
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h, step = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1), 1
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):  # Q = 8 characters by doubling
        h = h[:-step] * np.uint64(factor) + h[step:]
        step *= 2
    ends = np.cumsum(sizes)
    return mix64(h), ends - sizes, ends - (Q - 1)


def pieces_of(lines: list[str]) -> tuple[list[str], list[int]]:
    """Lines cut into stretches that have all their shingles, and the first stretch of each line."""
    if all(len(x) <= PIECE for x in lines):
        return lines, list(range(len(lines)))
    pieces: list[str] = []
    first: list[int] = []
    for line in lines:
        first.append(len(pieces))
        pieces += [line[a : a + PIECE + Q - 1] for a in range(0, len(line) - Q + 1, PIECE)]
    return pieces, first


def signatures(lines: list[str], bands: int, rows: int, seed: int = 9) -> np.ndarray:
    """(lines, bands) int64 band keys; every line has at least Q characters."""
    multipliers = np.random.default_rng(seed).integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    if not lines:
        return np.zeros((0, bands), dtype=np.int64)
    pieces, first = pieces_of(lines)
    least = np.empty((len(multipliers), len(pieces)), dtype=np.uint32)
    for a, b in blocks(pieces):
        h, starts, ends = shingle_hashes(pieces[a:b])
        h = (h >> np.uint64(32)).astype(np.uint32)
        edges = np.stack([starts, ends], 1).ravel()[:-1]
        for k, m in enumerate(multipliers):
            least[k, a:b] = np.minimum.reduceat(h * m, edges)[::2]
    if len(pieces) > len(lines):
        least = np.minimum.reduceat(least, first, axis=1)
    out = np.zeros((len(lines), bands), dtype=np.uint64)
    for k in range(len(multipliers)):
        out[:, k // rows] = out[:, k // rows] * np.uint64(0xD6E8FEB86659FD93) + least[k]
    out += np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(out).view(np.int64)


PLACE = 51  # bits of a hash in a set; the 13 above number lines or pairs while many are sorted at once


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (``PLACE`` bits) of every line."""
    pieces, first = pieces_of(lines)
    found: list[np.ndarray] = []
    for a, b in blocks(pieces):  # at most 60,000 characters or one piece, so fewer lines than 13 bits number
        h, starts, ends = shingle_hashes(pieces[a:b])
        counts = ends - starts
        line = np.repeat(np.arange(b - a, dtype=np.uint64), counts)
        place = np.arange(len(line)) + np.repeat(starts - np.cumsum(counts) + counts, counts)
        key = np.sort((line << np.uint64(PLACE)) | (h[place] >> np.uint64(64 - PLACE)))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        edges = np.searchsorted(key, np.arange(1, b - a, dtype=np.uint64) << np.uint64(PLACE))
        found += np.split(key & np.uint64((1 << PLACE) - 1), edges)
    if len(pieces) == len(lines):
        return found
    return [np.unique(np.concatenate(found[a:b])) for a, b in zip(first, [*first[1:], len(pieces)])]


def enough(shared: np.ndarray, one: np.ndarray, other: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether sets of these sizes with so many shared elements have Jaccard ``similarity`` or more."""
    return shared * (1 + similarity) >= similarity * (one + other) - 1e-9


def alike(one: list[np.ndarray], other: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each pair of hash sets whether its exact Jaccard is ``similarity`` or more; all sorted, distinct and not empty."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (one, other)]
    out = np.zeros(len(one), dtype=bool)
    fits = np.flatnonzero(np.minimum(*sizes) >= similarity * np.maximum(*sizes) - 1e-9)
    at, held = 0, np.cumsum(sizes[0][fits] + sizes[1][fits])
    while at < len(fits):  # up to 4096 pairs or about 200,000 hashes are sorted at once
        most = (held[at - 1] if at else 0) + 200_000
        some = fits[at : max(at + 1, min(at + 4096, int(np.searchsorted(held, most))))]
        at += len(some)
        flat = np.concatenate([x for k in some for x in (one[k], other[k])])
        pair = np.repeat(np.arange(len(some), dtype=np.uint64), sizes[0][some] + sizes[1][some])
        key = np.sort((pair << np.uint64(PLACE)) | flat)
        both = (key[1:][key[1:] == key[:-1]] >> np.uint64(PLACE)).astype(np.int64)
        out[some] = enough(np.bincount(both, minlength=len(some)), sizes[0][some], sizes[1][some], similarity)
    return out


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """(n, n): how many hashes each two of n sets share, by products of 0/1 matrices over the hashes that two or more hold."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    same = flat[1:] == flat[:-1]
    held = np.zeros(len(flat), dtype=bool)
    held[1:] |= same
    held[:-1] |= same
    flat, row = flat[held], row[held]
    out = np.zeros((len(sets), len(sets)))
    if len(flat):
        column = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
        for a in range(0, int(column[-1]) + 1, width):
            i, j = np.searchsorted(column, [a, a + width])
            block = np.zeros((len(sets), width), dtype=np.float32)
            block[row[i:j], column[i:j] - a] = 1
            out += block @ block.T
    return out


def links_in_bucket(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """For each hash set the first one of its component under exact Jaccard links."""
    if len(sets) < 2:
        return list(range(len(sets)))
    sizes = np.array([len(x) for x in sets])
    linked = enough(shared_counts(sets), sizes[:, None], sizes[None, :], similarity)
    forest = Forest(len(sets))
    forest.link(*np.nonzero(np.triu(linked, 1)))
    return forest.label.tolist()


def links_in_buckets(sets: list[np.ndarray], edges: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(first of its component, other) for the sets of buckets [edges[n], edges[n + 1]); buckets of two, the most by far, all at once."""
    two = [a for a, b in zip(edges, edges[1:]) if b - a == 2]
    near = alike([sets[a] for a in two], [sets[a + 1] for a in two], similarity)
    out = [(a, a + 1) for a, x in zip(two, near.tolist()) if x]
    for a, b in zip(edges, edges[1:]):
        if b - a > 2:
            out += [(a + first, a + k) for k, first in enumerate(links_in_bucket(sets[a:b], similarity)) if first != k]
    return out


def plain(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def line_table(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, h1, h2, chars, b0, b1, ...): every text's lines, each once. Of equal lines in a batch one has band keys."""
    from xxhash import xxh3_128_digest

    names = [f"b{k}" for k in range(bands)]

    def make(batch: pa.RecordBatch) -> dict:
        ids: list[int] = []
        digests: list[bytes] = []
        first: dict[bytes, int] = {}
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            for raw in dict.fromkeys(text.split(b"\n")):
                if raw and not raw.isspace():
                    first.setdefault(raw, len(ids))
                    ids.append(doc)
                    digests.append(xxh3_128_digest(raw))
        found = [(at, line) for raw, at in first.items() if len(line := plain(raw)) >= Q]
        at = np.array([k for k, _ in found], dtype=np.int64)
        keys = signatures([line for _, line in found], bands, rows)
        without = np.ones(len(ids), dtype=bool)
        without[at] = False
        chars = np.zeros(len(ids), dtype=np.int64)
        chars[at] = [len(line) for _, line in found]
        out = {"doc_id": pa.array(ids, pa.int64()), "chars": pa.array(chars)}
        hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        out |= {"h1": pa.array(hashes[:, 0]), "h2": pa.array(hashes[:, 1])}
        for k, name in enumerate(names):
            column = np.zeros(len(ids), dtype=np.int64)  # Arrow takes it over
            column[at] = keys[:, k]
            out[name] = pa.array(column, mask=without)
        return out

    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return map_batches(known, make, "doc_id bigint, h1 bigint, h2 bigint, chars bigint, " + ", ".join(f"{n} bigint" for n in names))


def bucket_members(distinct: DataFrame, bands: int, keep: Scratch) -> DataFrame:
    """(bucket, pivot, chunks, node) of the lines that share a band with others.

    Buckets of two or three lines are known from grouped sums alone (count, least, largest and xor of their nodes). Nodes
    are hashes, so those sums also tell buckets that hold the same lines.
    """
    keyed = distinct.where("b0 is not null").select("node", "chars", F.explode(F.array(*[f"b{k}" for k in range(bands)])).alias("band"))
    sums = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor("node").alias("mark"), F.max("chars").alias("longest"))
    once = sums.where("n > 1").groupBy("n", "least", "most", "mark").agg(F.min("band").alias("bucket"), F.max("longest").alias("longest"))
    shared = keep(once)
    middle = F.col("mark").bitwiseXOR(F.col("least")).bitwiseXOR(F.col("most"))
    few = shared.where("n <= 3").select("bucket", F.col("least").alias("pivot"), F.lit(1).alias("chunks"), F.explode(F.when(F.col("n") == 2, F.array("least", "most")).otherwise(F.array("least", middle, "most"))).alias("node"))
    most = F.least(F.lit(LIMIT), F.greatest(F.lit(2), F.floor(F.lit(CHUNK_CHARS) / F.greatest("longest", F.lit(1))))).cast("int")
    large = shared.where("n > 3").select(F.col("bucket").alias("band"), F.col("least").alias("pivot"), F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    if large.count() <= BROADCAST_KEYS:  # checked size, 20 bytes each; beyond it a join by key
        large = F.broadcast(large)
    many = keyed.join(large, "band").select(F.col("band").alias("bucket"), "pivot", "chunks", "node")
    return keep(few.unionAll(many))


def line_texts(docs: DataFrame, distinct: DataFrame, members: DataFrame) -> DataFrame:
    """(node, line as bytes) of the lines in ``members``, taken from the first documents that have them."""
    from xxhash import xxh3_128_digest

    nodes = members.select("node").distinct().join(distinct.select("node", "h1", "h2", "first_doc"), "node")
    wanted = nodes.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct("h1", "h2", "node")).alias("wanted"))  # at most a text's lines

    def fetch(batch: pa.RecordBatch) -> dict:
        nodes: list[int] = []
        lines: list[bytes] = []
        for text, wanted in zip(texts(batch), batch.column("wanted").to_pylist()):
            open_ = {w["h1"].to_bytes(8, "big", signed=True) + w["h2"].to_bytes(8, "big", signed=True): w["node"] for w in wanted}
            for raw in text.split(b"\n"):
                node = open_.pop(xxh3_128_digest(raw), None) if open_ else None
                if node is not None:
                    nodes.append(node)
                    lines.append(raw)
        return {"node": nodes, "line": pa.array(lines, pa.binary())}

    return map_batches(docs.join(wanted, "doc_id").select("text", "wanted"), fetch, "node bigint, line binary")


def fuzzy_links(docs: DataFrame, distinct: DataFrame, bands: int, keep: Scratch) -> DataFrame:
    """(a, b) of nodes: links that span every component of similar lines."""
    members = bucket_members(distinct, bands, keep)
    lines = keep(line_texts(docs, distinct, members))
    whole = members.where("chunks = 1").select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node").join(lines, "node")
    found = keep(compare(whole))
    hot = members.where("chunks > 1").select("bucket", "pivot", "node")
    if hot.isEmpty():
        return found

    def beside(batch: pa.RecordBatch) -> dict:
        rows = list(zip(batch.column("pivot_line").to_pylist(), batch.column("line").to_pylist()))
        sets = {x: s for x in dict.fromkeys(x for x, _ in rows) for s in shingle_sets([plain(x)])}
        near = alike([sets[x] for x, _ in rows], shingle_sets([plain(y) for _, y in rows]))
        return {"bucket": batch.column("bucket"), "pivot": batch.column("pivot"), "node": batch.column("node"), "near": near}

    pivots = lines.select(F.col("node").alias("pivot"), F.col("line").alias("pivot_line"))
    judged = keep(map_batches(hot.join(lines, "node").join(pivots, "pivot"), beside, "bucket bigint, pivot bigint, node bigint, near boolean"))
    groups = far_groups(judged.select("bucket", "node", "near"), ["bucket"], "node", LIMIT)
    rest = keep(compare(groups.join(lines, "node")))
    return found.unionAll(rest).unionAll(judged.where("near and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))


def compare(groups: DataFrame) -> DataFrame:
    """(bucket, lo, hi, node, line) -> (a, b): spanning links of every group."""
    keys = ["bucket", "lo", "hi"]

    def make(table: pa.Table) -> dict:
        edges = group_edges([table[c].to_numpy() for c in keys])
        node, sets = table["node"].to_pylist(), shingle_sets([plain(x) for x in table["line"].to_pylist()])
        pairs = {(node[a], node[b]) for a, b in links_in_buckets(sets, edges)}
        return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

    return map_sorted_groups(dealt(groups.select(*keys, "node", "line"), ["bucket"], "node"), keys, make, "a bigint, b bigint", most_rows=20_000)


def lines_to_drop(docs: DataFrame) -> DataFrame:
    """(doc_id, drop: identities of the lines that do not stay in this document)."""
    bands, rows = scheme(docs.count())
    with Scratch() as keep:
        table = keep(line_table(docs, bands, rows))
        sums = table.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.max("chars").alias("chars"), *[F.max(f"b{k}").alias(f"b{k}") for k in range(bands)])
        distinct = keep(sums.withColumn("node", F.xxhash64(F.monotonically_increasing_id())))  # one-to-one on 64-bit numbers
        parts = connected_components(fuzzy_links(docs, distinct, bands, keep))
        places = distinct.select("node", "h1", "h2", "first_doc", "n")
        fuzzy = keep(parts.join(places, "node").select("component", "h1", "h2", "first_doc"))
        keepers = fuzzy.groupBy("component").agg(F.min(F.struct("first_doc", "h1", "h2")).alias("best"))
        stays = (F.col("h1") == F.col("best.h1")) & (F.col("h2") == F.col("best.h2"))
        decided = fuzzy.join(keepers, "component").select("h1", "h2", F.when(stays, F.col("first_doc")).alias("keep_doc"))
        exact = places.where("n > 1").join(fuzzy.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("first_doc").alias("keep_doc"))
        here = table.select("h1", "h2", "doc_id").join(decided.unionAll(exact), ["h1", "h2"]).where("not (doc_id <=> keep_doc)")
        return cut(here.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop")))  # at most a text's lines


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(row: struct of the input columns, kept: the remaining text, n_lines, n_kept), one row per input row."""
    from xxhash import xxh3_128_digest

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = lines_to_drop(packed.select("doc_id", "text"))

    @F.arrow_udf("struct<kept:binary,n_lines:bigint,n_kept:bigint>")
    def clean(text: pa.Array, drop: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for whole, gone, has_id in zip(text.to_pylist(), drop.to_pylist(), known.to_pylist()):
            bad = {x["h1"].to_bytes(8, "big", signed=True) + x["h2"].to_bytes(8, "big", signed=True) for x in gone or ()}
            seen: set[bytes] = set()
            kept, n, k = [], 0, 0
            for raw in (whole or b"").split(b"\n"):
                if raw and not raw.isspace():
                    n += 1
                    if has_id and (raw in seen or (bad and xxh3_128_digest(raw) in bad)):
                        continue
                    seen.add(raw)
                    k += 1
                kept.append(raw)
            out.append({"kept": b"\n".join(kept) if k < n else None, "n_lines": n, "n_kept": k})  # null: as it was
        made = pa.array(out, pa.struct([("kept", pa.binary()), ("n_lines", pa.int64()), ("n_kept", pa.int64())]))
        del out
        tidy()
        return made

    joined = packed.join(drops, "doc_id", "left")
    done = joined.select("row", "text", clean(F.col("text").cast("binary"), "drop", F.col("doc_id").isNotNull()).alias("c"))
    return done.select("row", F.coalesce(F.col("c.kept").cast("string"), "text").alias("kept"), "c.n_lines", "c.n_kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_kept", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
