"""All windows against all units, block by block: a block of windows and one of units are one row each, and a pair of blocks is one
array computation (``functions.bits``). No row is made for a pair of a window and a unit but those that a result needs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions import bits
from seqloom.runtime import cut, settle

#: Units and windows of a block; units of a block of grams.
UNITS, WINDOWS, INDEXED = 16_384, 512, 1 << 17
#: Lexicons up to so many rows go to every task.
LEXICON_ROWS = 200_000


def arrow(df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``df`` through ``make``, which yields columns by name for an Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    settle(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in make(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, most: int, apart: str | None = None) -> DataFrame:
    """Runs of up to ``most`` rows of a partition as one row of arrays; ``apart`` (an int column) is equal within a run and stays as it is."""
    columns = [c for c in df.columns if c != apart]
    schema = ", ".join([f"{c} array<{dict(df.dtypes)[c]}>" for c in columns] + ([f"{apart} int"] if apart else []))

    def make(batch: pa.RecordBatch):
        edges = [*range(0, batch.num_rows, most), batch.num_rows]
        if apart:
            values = batch.column(apart).to_numpy(zero_copy_only=False)
            edges = sorted({*edges, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()})
        out = {c: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column(c)) for c in columns}
        yield out | ({apart: [int(values[k]) for k in edges[:-1]]} if apart else {})

    return arrow(df, make, schema)


def _cores(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def met(windows: DataFrame, window: str, units: DataFrame, unit: str, ref: str) -> tuple[DataFrame, DataFrame, bool]:
    """(pairs of blocks, blocks of units, whether these are few): windows sorted, so that equal beginnings lie together; units of a length, in their order.

    Units up to ``LEXICON_ROWS`` (checked) go to every task."""
    key = next(c for c in windows.columns if c != window)
    w = windows.select(F.col(key).alias("keys"), F.col(window).alias("wins"))
    w = packed(w.repartitionByRange(_cores(w), "wins", "keys").sortWithinPartitions("wins"), WINDOWS)
    count = units.count()
    u = units.select(F.col(unit).alias("units"), F.col(ref).alias("refs"), F.length(ref).cast("int").alias("size"))
    u = packed(u.repartition(max(1, ceil(count / UNITS)), "units").sortWithinPartitions("size", "units"), UNITS, "size").withColumn("block", F.col("units")[0])
    few = count <= LEXICON_ROWS
    return w.crossJoin(F.broadcast(u) if few else u), u, few


def fits(window: str, size: int, band: float) -> bool:
    return ceil(len(window) * band) <= size <= floor(len(window) / band)


def nearest(distances: np.ndarray, k: int) -> list[int]:
    """The first ``k`` places in order of distance, then place."""
    out: list[int] = []
    level, k = int(distances.min()), min(k, len(distances))
    while len(out) < k:
        out += np.flatnonzero(distances == level)[: k - len(out)].tolist()
        level += 1
    return out


def nearest_units(windows: DataFrame, key: str, window: str, units: DataFrame, unit: str, ref: str, band: float, k: int) -> DataFrame:
    """(key, unit, dist, longest): of each block of units the ``k`` nearest to every window, lesser units first; their lengths are within the band.

    Within a length the normalised distance grows with the distance, so the ``k`` best of all are among these."""
    pairs, _, _ = met(windows.select(key, window), window, units, unit, ref)

    def make(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            size, held, found = row["size"], bits.Units(row["refs"]), []
            places = [j for j, w in enumerate(row["wins"]) if fits(w, size, band)]
            for j, dist in bits.edit_distances(held, [row["wins"][j] for j in places]):
                win = places[j]
                found += [(row["keys"][win], row["units"][x], int(dist[x]), max(size, len(row["wins"][win]))) for x in nearest(dist, k)]
            yield dict(zip((key, unit, "dist", "longest"), map(list, zip(*found)) if found else ([], [], [], [])))

    kinds = dict(windows.dtypes) | dict(units.dtypes)
    return arrow(pairs, make, f"{key} {kinds[key]}, {unit} {kinds[unit]}, dist int, longest int")


def every_unit(windows: DataFrame, key: str, window: str, units: DataFrame, unit: str, ref: str, band: float, kernel: Callable, cost: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(key, unit, cost) of all pairs with lengths within the band: ``kernel`` gives a window's codes for a block of units, ``cost`` reads a code, the unit's and the window's length.

    Codes leave Python as arrays, two bytes a pair; rows are made where they are used."""
    pairs, blocks, few = met(windows.select(key, window), window, units, unit, ref)
    kinds = dict(windows.dtypes) | dict(units.dtypes)

    def make(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            size, held = row["size"], bits.Units(row["refs"])
            places = [j for j, w in enumerate(row["wins"]) if fits(w, size, band)]
            keys, lengths, codes = [], [], []

            def out() -> dict:
                edges = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * held.n)
                return {key: keys, "n": lengths, "size": [size] * len(keys), "block": [row["block"]] * len(keys), "codes": pa.ListArray.from_arrays(edges, pa.array(np.concatenate(codes)))}

            for j, found in kernel(held, [row["wins"][j] for j in places]):
                win = places[j]
                keys.append(row["keys"][win])
                lengths.append(len(row["wins"][win]))
                codes.append(found.astype(np.int16))
                if len(keys) == 64:
                    yield out()
                    keys, lengths, codes = [], [], []
            if keys:
                yield out()

    found = arrow(pairs, make, f"{key} {kinds[key]}, n int, size int, block {kinds[unit]}, codes array<smallint>")
    named = blocks.select(F.col("block").alias("named"), "units")
    found = found.join(F.broadcast(named) if few else named, F.col("block").eqNullSafe(F.col("named")))
    rows = found.select(key, "n", "size", "units", F.posexplode("codes").alias("at", "code"))
    return rows.select(key, F.col("units")[F.col("at")].alias(unit), cost(F.col("code"), F.col("size"), F.col("n")).alias("cost"))


#: Codes of a block: so few that their tables stay in a core's cache.
CODES = 4096


def _code_pairs(units: DataFrame, unit: str, code: str, carried: list[str]) -> DataFrame:
    """Each pair of blocks once, as (same, x_..., y_...) of unit, code and the ``carried`` columns, no code of y shorter than one of x."""
    held = units.select(F.col(unit).alias("id"), F.col(code).alias("code"), *carried).where("id is not null and length(code) > 0").withColumn("len", F.length("code"))
    count = held.count()
    most = min(CODES, max(64, ceil(count / 24)))
    ordered = held.repartitionByRange(max(1, ceil(count / most)), "len", "id").sortWithinPartitions("len", "id")
    # blocks must be the same wherever they are read, and ranges are sampled
    blocks = cut(packed(ordered.drop("len"), CODES).withColumn("first", F.struct(F.length(F.col("code")[0]).alias("len"), F.col("id")[0].alias("id"))))
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    x, y = side("x"), side("y")
    firsts = x.select("x_first").crossJoin(y.select("y_first")).where("x_first <= y_first")
    number = blocks.count()
    few = count <= LEXICON_ROWS  # checked size; beyond it blocks are joined by key
    pairs = firsts.repartition(max(1, min(number * (number + 1) // 2, 64 * _cores(units))))
    pairs = pairs.join(F.broadcast(x) if few else x, "x_first").join(F.broadcast(y) if few else y, "y_first")
    return pairs.withColumn("same", F.col("x_first") == F.col("y_first")).drop("x_first", "y_first")


def _near(row: dict, tau: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in x, places in y, distances) of a pair of blocks."""
    held = bits.Codes(row["y_code"])
    for k, text in enumerate(row["x_code"]):
        places, dist = held.near(text, k + 1 if row["same"] else 0, tau)
        if len(places):
            yield k, places, dist


def look_alikes(units: DataFrame, unit: str, code: str, tau: float) -> DataFrame:
    """(a, b, dist), a < b: all pairs of units whose distance is at most floor(tau * the longer one's length)."""
    kind = dict(units.dtypes)[unit]

    def make(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            ids, out, rows = np.array(row["y_id"]), {"a": [], "b": [], "dist": []}, 0
            for k, places, dist in _near(row, tau):
                out["a"].append(np.repeat(np.array(row["x_id"][k : k + 1]), len(places)))
                out["b"].append(ids[places])
                out["dist"].append(dist)
                rows += len(places)
                if rows > 100_000:
                    yield {c: np.concatenate(v) for c, v in out.items()}
                    out, rows = {"a": [], "b": [], "dist": []}, 0
            if rows:
                yield {c: np.concatenate(v) for c, v in out.items()}

    found = arrow(_code_pairs(units, unit, code, []), make, f"a {kind}, b {kind}, dist int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")


def look_alike_links(units: DataFrame, unit: str, code: str, tau: float) -> DataFrame:
    """(a, b): links that span the components of ``look_alikes``; a pair of blocks gives fewer links than it has codes."""
    kind = dict(units.dtypes)[unit]

    def make(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            ids = row["x_id"] + ([] if row["same"] else row["y_id"])
            label, shift = np.arange(len(ids)), 0 if row["same"] else len(row["x_id"])
            for k, places, _ in _near(row, tau):
                met = np.unique(label[np.append(places + shift, k)])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield {"a": [ids[k] for k in label[moved]], "b": [ids[k] for k in moved]}

    return arrow(_code_pairs(units, unit, code, []), make, f"a {kind}, b {kind}")


def look_alike_neighbours(units: DataFrame, unit: str, code: str, tau: float, before: str, after: str) -> DataFrame:
    """(unit, same_before, same_after) of units with look-alikes: whether one of these has the same, known, neighbour on a side."""
    kind = dict(units.dtypes)[unit]

    def make(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            sides = []
            for side in (before, after):
                book: dict = {}
                sides.append([np.array([-1 if v is None else book.setdefault(v, len(book)) for v in row[f"{s}_{side}"]]) for s in "xy"])
            seen = [np.zeros((3, len(row[f"{s}_id"])), dtype=bool) for s in "xy"]
            for k, places, _ in _near(row, tau):
                seen[0][0, k] = True
                seen[1][0, places] = True
                for n, (mine, theirs) in enumerate(sides, 1):
                    equal = places[theirs[places] == mine[k]] if mine[k] >= 0 else places[:0]
                    seen[0][n, k] |= len(equal) > 0
                    seen[1][n, equal] = True
            for s, marks in zip("xy", seen):
                some = np.flatnonzero(marks[0])
                yield {"unit": [row[f"{s}_id"][k] for k in some], "same_before": marks[1, some], "same_after": marks[2, some]}

    found = arrow(_code_pairs(units, unit, code, [before, after]), make, f"unit {kind}, same_before boolean, same_after boolean")
    return found.groupBy("unit").agg(F.max("same_before").alias("same_before"), F.max("same_after").alias("same_after"))


class GramIndex:
    """The grams of a block of units, which lie in their order: the places of a gram's units, or a mark for every unit where these are many."""

    def __init__(self, grams: pa.ListArray):
        flat, self.n = grams.flatten().dictionary_encode(), len(grams)
        of = np.repeat(np.arange(self.n), np.diff(grams.offsets.to_numpy()))
        codes = flat.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(flat.dictionary) + 1))
        self.places = {g: of[order[a:b]] for g, a, b in zip(flat.dictionary.to_pylist(), edges, edges[1:])}
        self.marks: dict[str, np.ndarray] = {}

    def add(self, gram: str, to: np.ndarray) -> None:
        """Sets ``to`` where a unit has the gram."""
        places = self.places.get(gram)
        if places is None:
            return
        if 16 * len(places) < self.n:
            to[places] = True
            return
        if gram not in self.marks:
            self.marks[gram] = np.zeros(self.n, bool)
            self.marks[gram][places] = True
        np.logical_or(to, self.marks[gram], out=to)

    def hits(self, slots: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(how many positions hit each unit, the first of these), for the grams of every position."""
        kind = np.uint8 if len(slots) < 256 else np.int32
        count, left, one = np.zeros(self.n, kind), np.zeros(self.n, kind), np.empty(self.n, bool)
        for k, slot in enumerate(slots):
            one[:] = False
            for gram in slot:
                self.add(gram, one)
            np.add(count, one.view(np.uint8), out=count)
            np.maximum(left, one.view(np.uint8) * kind(len(slots) - k), out=left)
        return count, len(slots) - left.astype(np.int64)


def _gram_pairs(windows: DataFrame, index: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """Pairs of blocks of windows (window, slots) and of units (unit, grams) of a length, in the order of ``lengths``."""
    held = index.groupBy("unit").agg(F.collect_list("gram").alias("grams"))
    held = held.withColumn("len", F.lit(0)) if lengths is None else held.join(lengths.select("unit", F.col("len").cast("int").alias("len"), "unit_ord"), "unit")
    count = held.count()
    u = held.repartition(max(1, ceil(count / INDEXED)), "unit").sortWithinPartitions("len", *(["unit_ord"] if lengths is not None else []), "unit")
    u = packed(u, INDEXED, "len")
    w = packed(windows.repartition(_cores(windows), "window"), 4 * WINDOWS)
    return w.crossJoin(F.broadcast(u) if count <= LEXICON_ROWS else u)


def gram_hits(windows: DataFrame, index: DataFrame, lengths: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(window, unit, cnt, first_pos): windows' positions of which a gram occurs in the unit, for ``windows`` (window, slots: the grams of each position).

    With ``best`` only units that can be among the ``best`` of a window by count, or by count over length, ties by first position and
    ``unit_ord``: as many of every length and block, since both orders are one within a length."""
    kinds = dict(windows.dtypes) | {"unit": dict(index.dtypes)["unit"]}

    def make(batch: pa.RecordBatch):
        for row in range(batch.num_rows):
            keys, slots, units = (batch.column(c)[row].as_py() for c in ("window", "slots", "unit"))
            held, units = GramIndex(batch.column("grams")[row].values), np.array(units)
            out, rows = [], 0
            for key, slot in zip(keys, slots):
                count, first = held.hits(slot)
                if best is None:
                    places = np.flatnonzero(count)
                else:
                    score = count.astype(np.int32) * (len(slot) + 1) + (len(slot) - first)
                    places = np.array(nearest(-score, min(best, int(np.count_nonzero(count)))) if count.any() else [], dtype=np.int64)
                out.append((np.repeat(np.array([key]), len(places)), units[places], count[places].astype(np.int64), first[places]))
                rows += len(places)
                if rows > 100_000:
                    yield dict(zip(("window", "unit", "cnt", "first_pos"), map(np.concatenate, zip(*out))))
                    out, rows = [], 0
            if rows:
                yield dict(zip(("window", "unit", "cnt", "first_pos"), map(np.concatenate, zip(*out))))

    return arrow(_gram_pairs(windows, index, lengths), make, f"window {kinds['window']}, unit {kinds['unit']}, cnt bigint, first_pos int")
