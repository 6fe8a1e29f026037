"""Operator 1: exact removal of repeated byte strings with run-length indexes.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else in the corpus goes.

Routing: in every window of LENGTH bytes the least hash of its ``K``-byte strings (leftmost on ties) is the
window's anchor; equal windows have equal anchors at equal places. Consecutive windows with one anchor
form a segment (LENGTH to LENGTH + 168 bytes). Segments whose anchor hash occurs once in the corpus
cannot repeat and are dropped after a grouped count; segments that occur twice as a whole are repeats
throughout; what is left, one copy of each distinct segment that shares its anchor with another, is
indexed.

Index: the distinct segments of a block of anchors become one text; its suffixes are sorted to a depth
beyond LENGTH, its Burrows-Wheeler transform is kept run by run, with the text positions and the
common-prefix lengths at both ends of each run sampled. Matching statistics of the text against
everything else in it are streamed from those samples alone: inside a run they fall by one a
position. Windows whose statistic reaches LENGTH occur elsewhere.

Blocks are bounded: an anchor with more than ``HOT`` distinct segments is not indexed; its windows are
counted by hash instead, one grouped sum for all, which is exact too and needs no group in one place.

Defined cases: null or empty text has no bytes and keeps the empty string; texts shorter than LENGTH
keep all; repeated rows (same doc_id and text) are other occurrences of their strings; very
long texts are handled a part of ``PART`` bytes at a time, whole; empty tables give empty results; other columns are
ignored. Hashes that stand for segments or rows have 128 bits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, map_sorted_groups, mix64, texts
from seqloom.runtime import Scratch, cut

LENGTH, K = 200, 32
SPAN = LENGTH - K + 1  # places of a K-byte string in a window
HOT = 4096  # at most 1.5 MB of segments
PART = 1 << 20  # bytes handled at once, at about 60 times that of memory
PLACE = (1 << 24) - 1
BLOCK_BYTES = 1 << 19  # an index takes about 100 times that of memory; a single anchor may go beyond it


def string_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from every place."""
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        h = h[:-step] * np.uint64(factor) + h[step:]
        step *= 2
    return mix64(h)


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of all segments of texts laid end to end.

    ``ends``: the end of each text. Windows do not cross texts.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    h = string_hashes(data)
    key = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if SPAN > width:
        key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
    anchor = (key & np.uint64(PLACE)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, side="right")
    valid = starts + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    starts, anchor, text = starts[valid], anchor[valid], text[valid]
    if not len(starts):
        return none, none, np.zeros(0, np.uint64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), h[anchor[first]]


def parts_of(found: list[bytes]):
    """Lists of (text number, place in the text, bytes), up to PART bytes together; long texts are
    split with an overlap so that every window lies in exactly one part."""
    held, size = [], 0
    for k, text in enumerate(found):
        for a in range(0, max(0, len(text) - LENGTH + 1), PART):
            piece = text[a : a + PART + LENGTH - 1]
            if held and size + len(piece) > PART:
                yield held
                held, size = [], 0
            held.append((k, a, piece))
            size += len(piece)
    if held:
        yield held


def occurrences(rows: DataFrame, whole: bool) -> DataFrame:
    """(r1, r2, text) -> the segments of all texts: anchor ``h``, and with ``whole`` also the content hash
    ``dg``, ``r1``, ``r2`` and ``at`` = place * 256 + windows."""

    def make(batch: pa.RecordBatch) -> dict | None:
        from xxhash import xxh64_intdigest

        found = texts(batch)
        keys = [batch.column(c).to_numpy() for c in ("r1", "r2")] if whole else None
        out: list[tuple] = []
        for part in parts_of(found):
            joined = b"".join(p for _, _, p in part)
            ends = np.cumsum([len(p) for _, _, p in part])
            first, count, h = segments(np.frombuffer(joined, np.uint8), ends)
            if not whole:
                out.append((h,))
                continue
            text = np.searchsorted(ends, first, side="right")
            base = ends - np.array([len(p) for _, _, p in part])
            place = first - base[text] + np.array([a for _, a, _ in part])[text]
            stops = (first + count + (LENGTH - 1)).tolist()
            dg = np.fromiter((xxh64_intdigest(joined[a:b], 1) for a, b in zip(first.tolist(), stops)), np.uint64, len(first))
            row = np.array([k for k, _, _ in part])[text]
            out.append((h, dg, keys[0][row], keys[1][row], place * 256 + count))
        if not out:
            return None
        columns = [np.concatenate(c) for c in zip(*out)]
        names = ("h", "dg", "r1", "r2", "at")
        return {n: pa.array(c.view(np.int64)) for n, c in zip(names, columns)}

    schema = "h bigint, dg bigint, r1 bigint, r2 bigint, at bigint" if whole else "h bigint"
    return map_batches(rows if whole else rows.select("text"), make, schema)


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with samples at both ends of its runs.

    ``heads`` and ``starts`` are the runs; ``places`` the text positions at the first and last row of
    each run; ``shared`` the common prefix of those rows' suffixes with the row before the run or after
    it, up to ``depth``.
    """

    WORD = 7

    def __init__(self, text: np.ndarray):
        """``text``: symbols 0 (separator) to 256."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(self.WORD, text.dtype)]).astype(np.int64)
        packed = np.zeros(n, np.int64)
        for j in range(self.WORD):
            packed = (packed << 9) | padded[j : j + n]
        order = np.argsort(packed).astype(np.int32)
        place = np.arange(n, dtype=np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = self._heads(packed[order], place)
        levels, width = [(self.WORD, rank)], self.WORD
        del packed, padded, place
        while width < LENGTH:
            at = rank[order]  # rows in groups of more than one are sorted on, the others have their place
            alone = np.ones(n, dtype=bool)
            alone[1:] = at[1:] != at[:-1]
            alone[:-1] &= alone[1:].copy()
            rows = np.flatnonzero(~alone)
            tied = order[rows]
            after = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
            key = rank[tied].astype(np.int64) * (n + 1) + after
            by = np.argsort(key)
            order[rows] = tied[by]
            rank = rank.copy()
            rank[tied[by]] = self._heads(key[by], rows.astype(np.int32))
            del key, by, after, tied, rows
            width *= 2
            levels.append((width, rank))
        self.depth = width
        before = np.where(order > 0, text[order - 1], -1)  # the transform; nothing stands before the first suffix
        new = np.ones(n, dtype=bool)
        new[1:] = before[1:] != before[:-1]
        self.starts = np.flatnonzero(new)
        self.heads = before[self.starts]
        last = np.append(self.starts[1:], n) - 1
        self.n = n
        # suffixes that agree to the full depth are not ordered further, so their rows are sampled too
        tied = np.zeros(n, dtype=bool)
        tied[1:] = rank[order[1:]] == rank[order[:-1]]
        upper = np.union1d(self.starts[1:], np.flatnonzero(tied))
        self.places = np.stack([order[self.starts], order[last]])
        above, here = order[upper - 1], order[upper]
        self.sampled = np.concatenate([here, above])
        self.shared = np.tile(self._common(levels, text, here, above), 2)

    @staticmethod
    def _heads(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For sorted keys in ``rows``: the row of the first one equal to each."""
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        return rows[np.flatnonzero(new)[np.cumsum(new) - 1]]

    def _common(self, levels: list, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at ``a`` and ``b``, up to the depth."""
        length = np.zeros(len(a), np.int32)
        for width, rank in reversed(levels):
            x, y = a + length, b + length
            inside = (x < self.n) & (y < self.n)
            same = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            length[same] += width
        for _ in range(self.WORD - 1):
            x, y = a + length, b + length
            inside = (x < self.n) & (y < self.n)
            same = inside & (text[np.minimum(x, self.n - 1)] == text[np.minimum(y, self.n - 1)])
            going = same if _ == 0 else same & going
            length += going
        return np.minimum(length, self.depth)

    def matching_statistics(self) -> np.ndarray:
        """For every position, how far its suffix agrees with another one (to the depth), streamed
        from the samples: a match of length m at p is one of m - 1 at p + 1."""
        best = np.zeros(self.n, np.int32)
        np.maximum.at(best, self.sampled, self.shared)
        at = np.arange(self.n, dtype=np.int32)
        return np.maximum(0, np.maximum.accumulate(best + at) - at)


def repeated_windows(found: list[bytes]) -> list[np.ndarray]:
    """For each of some distinct texts: which of its windows occur elsewhere among them."""
    sizes = np.array([len(x) for x in found]) + 1
    text = np.zeros(int(sizes.sum()), np.int16)
    data = np.frombuffer(b"\0".join(found) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes)
    data[ends - 1] = 0
    text[:] = data
    reach = RunIndex(text).matching_statistics() >= LENGTH
    return [reach[b - s : b - LENGTH] for b, s in zip(ends.tolist(), sizes.tolist())]


def ranges(flags: np.ndarray) -> list[int]:
    """[from, to, from, to, ...] of the runs of true."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _segment_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, dg, c, r1, r2, at, kinds) -> (h, dg, c, kinds, seg): the bytes of one copy of each segment."""
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("h", "dg", "c", "kinds", "at")).alias("segs"))  # bounded by a text's length

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"h": [], "dg": [], "c": [], "kinds": [], "seg": []}
        for text, segs in zip(texts(batch), batch.column("segs").to_pylist()):
            for s in segs:
                place, count = divmod(s["at"], 256)
                out["h"].append(s["h"])
                out["dg"].append(s["dg"])
                out["c"].append(s["c"])
                out["kinds"].append(s["kinds"])
                out["seg"].append(text[place : place + count + LENGTH - 1])
        return out

    one = rows.join(lists, ["r1", "r2"]).select("text", "segs")
    return map_batches(one, make, "h bigint, dg bigint, c bigint, kinds bigint, seg binary")


def _indexed(segs: DataFrame) -> DataFrame:
    """(h, dg, ranges of windows) by run-length indexes over blocks of whole anchors."""

    def make(table: pa.Table) -> dict:
        seg = table["seg"].to_pylist()
        h, count = table["h"].to_numpy(), table["c"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        size = np.concatenate([[0], np.cumsum([len(s) for s in seg])])
        found: list[list[int]] = []
        a = 0
        while a < len(seg):  # as many whole anchors as fit a block, at least one
            fit = int(np.searchsorted(size[edges], size[a] + BLOCK_BYTES, side="right")) - 1
            b = int(edges[max(fit, int(np.searchsorted(edges, a, side="right")))])
            distinct = dict.fromkeys(seg[a:b])
            flags = dict(zip(distinct, repeated_windows(list(distinct))))
            found += [ranges(flags[s]) for s in seg[a:b]]
            a = b
        keep = [k for k, f in enumerate(found) if f and count[k] == 1]
        return {"h": h[keep], "dg": table["dg"].to_numpy()[keep], "found": [found[k] for k in keep]}

    dealt = segs.repartition("h").sortWithinPartitions("h")
    return map_sorted_groups(dealt, ["h"], make, "h bigint, dg bigint, found array<int>", most_rows=20_000, most_bytes=4 << 20)


def _counted(wanted: DataFrame, segs: DataFrame) -> DataFrame:
    """(h, dg, ranges of windows) of ``wanted`` by counting all windows of the segments of hot anchors."""

    def windows(batch: pa.RecordBatch) -> dict:
        from xxhash import xxh64_intdigest

        out: dict[str, list] = {"h": [], "dg": [], "o": [], "wd": []}
        for h, dg, seg in zip(batch.column("h").to_pylist(), batch.column("dg").to_pylist(), batch.column("seg").to_pylist()):
            n = len(seg) - LENGTH + 1
            out["h"] += [h] * n
            out["dg"] += [dg] * n
            out["o"] += range(n)
            out["wd"] += [xxh64_intdigest(seg[o : o + LENGTH], 2) for o in range(n)]
        return out | {"wd": np.array(out["wd"], np.uint64).view(np.int64)}

    schema = "h bigint, dg bigint, o int, wd bigint"
    twice = map_batches(segs, windows, schema).groupBy("h", "wd").agg(F.count("*").alias("n")).where("n > 1").select("h", "wd")
    hits = map_batches(wanted, windows, schema).join(twice, ["h", "wd"]).groupBy("h", "dg").agg(F.sort_array(F.collect_list("o")).alias("os"))  # at most SPAN places
    pairs = F.flatten(F.transform("os", lambda o: F.array(o, o + 1)))
    return hits.select("h", "dg", pairs.alias("found"))


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(r1, r2, text) -> (r1, r2, found): the byte ranges [from, to, ...] of a text's repeats."""
    with Scratch() as keep:
        # what one side of a join counts is written first, so that the join's own shuffles can be split at hot anchors
        twice = keep(occurrences(rows, False).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        kept = keep(occurrences(rows, True).join(twice, "h"))
        keep.drop(twice)
        distinct = keep(kept.groupBy("h", "dg").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("r1", "r2", "at")]))
        kinds = distinct.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
        whole = distinct.where("c > 1").select("h", "dg", F.array(F.lit(0), F.pmod("at", F.lit(256)).cast("int")).alias("found"))
        segs = keep(_segment_texts(rows, distinct.join(kinds, "h")))  # before the next shuffle of the same bytes
        marks = [keep(_indexed(segs.where(F.col("kinds") <= HOT)))]
        hot = segs.where(F.col("kinds") > HOT)
        if not hot.isEmpty():
            marks.append(keep(_counted(hot.where("c = 1"), hot)))
        keep.drop(segs)
        place = (F.col("at") / 256).cast("bigint")
        spans = F.transform(F.col("found"), lambda x, i: F.when(i % 2 == 0, place + x).otherwise(place + x + F.lit(LENGTH - 1)))
        marked = reduce(DataFrame.unionAll, marks, whole)
        return cut(kept.join(marked, ["h", "dg"]).select("r1", "r2", spans.alias("found")).groupBy("r1", "r2").agg(F.flatten(F.collect_list("found")).alias("found")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: the remaining bytes, spans: removed runs)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"r1": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"), "r2": F.xxhash64(F.lit(7), F.col("doc_id").isNull(), "doc_id", "text")})
    found = repeated_ranges(rows.select("r1", "r2", "text"))

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for text, pairs in zip(texts(batch), batch.column("found").to_pylist()):
            spans: list[int] = []
            if pairs:
                edge = np.zeros(len(text) + 1, np.int32)
                both = np.array(pairs, np.int64).reshape(-1, 2)
                np.add.at(edge, both[:, 0], 1)
                np.add.at(edge, both[:, 1], -1)
                spans = ranges(np.cumsum(edge)[:-1] > 0)
            kept = b"".join(text[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(text)]))
            for name, value in zip(out, (len(text), len(text) - len(kept), len(spans) // 2, kept, spans)):
                out[name].append(value)
        return {"doc_id": batch.column("doc_id")} | out

    joined = rows.join(found, ["r1", "r2"], "left").select("doc_id", "text", "found")
    return map_batches(joined, make, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<bigint>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
