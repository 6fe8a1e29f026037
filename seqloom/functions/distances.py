"""Sequence distances: numpy kernels over token codes and their Arrow-batched column functions.

Kernels take sequences of hashable tokens. ``infix``, ``prefix`` and ``prefix_align`` follow closed forms
that tests use as brute-force definitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    book: dict = {}
    return tuple(np.array([book.setdefault(t, len(book)) for t in s], dtype=np.int64) for s in (a, b))


def _row(above: np.ndarray, substitution: np.ndarray, first: float) -> np.ndarray:
    """The next row of an edit table: ``above`` is the row before, ``first`` the new row's first cell."""
    best = np.concatenate([[first], np.minimum(above[1:] + 1, above[:-1] + substitution)])
    steps = np.arange(len(best))
    return np.minimum.accumulate(best - steps) + steps  # insertions run along the row


def levenshtein(a, b) -> int:
    x, y = _codes(a, b)
    row = np.arange(len(y) + 1, dtype=float)
    for i, c in enumerate(x):
        row = _row(row, (y != c).astype(float), i + 1.0)
    return int(row[-1])


def edit_norm(a, b) -> float:
    longest = max(len(a), len(b))
    return levenshtein(a, b) / longest if longest else 0.0


def cutoff_levenshtein(a, b, cutoff: int) -> int:
    """The distance, or cutoff + 1 once it is certain to exceed ``cutoff``."""
    if abs(len(a) - len(b)) > cutoff:
        return cutoff + 1
    x, y = _codes(a, b)
    row = np.arange(len(y) + 1, dtype=float)
    for i, c in enumerate(x):
        row = _row(row, (y != c).astype(float), i + 1.0)
        if row.min() > cutoff:
            return cutoff + 1
    return min(int(row[-1]), cutoff + 1)


def infix_norm(ref, window, substitution=None) -> float:
    """The cheapest alignment of all of ``ref`` with any stretch of ``window``, over len(ref)."""
    if not len(ref):
        return 0.0
    x, y = _codes(ref, window)
    row = np.zeros(len(y) + 1)
    for i, c in enumerate(x):
        row = _row(row, (y != c).astype(float) if substitution is None else substitution[i], i + 1.0)
    return float(row.min()) / len(x)


def soft_infix_norm(ref, window, alternatives, least: float = 0.1) -> float:
    """``infix_norm`` whose substitution costs max(least, 1 - p(ref token) / p(best token)) when the
    window token's alternatives, a list of (token, probability) best first, hold the ref token."""
    table = np.ones((len(ref), len(window)))
    for j, (token, found) in enumerate(zip(window, alternatives)):
        chances = {t: p for t, p in found or []}
        best = max(chances.values(), default=0.0)
        for i, wanted in enumerate(ref):
            if wanted == token:
                table[i, j] = 0.0
            elif wanted in chances and best > 0:
                table[i, j] = max(least, 1 - chances[wanted] / best)
    return infix_norm(ref, window, table)


def prefix_norm(ref, window, least: int, slack: int = 2) -> float:
    """The cheapest alignment of a prefix of ``ref`` (``least`` tokens or more) with a stretch that ends
    within ``slack`` tokens of the window's end, over the prefix length."""
    x, y = _codes(ref, window)
    row, best = np.zeros(len(y) + 1), np.inf
    for i, c in enumerate(x, 1):
        row = _row(row, (y != c).astype(float), float(i))
        if i >= least:
            best = min(best, row[max(0, len(y) - slack) :].min() / i)
    return float(best)


def prefix_align(given, ref) -> tuple[float, int]:
    """(cost / len(given), k): all of ``given`` against the best prefix ref[:k], k >= 1, the first minimum."""
    if not len(given) or not len(ref):
        return (0.0 if not len(given) else 1.0), 0
    x, y = _codes(given, ref)
    row = np.arange(len(y) + 1, dtype=float)
    for i, c in enumerate(x):
        row = _row(row, (y != c).astype(float), i + 1.0)
    k = int(np.argmin(row[1:])) + 1
    return float(row[k]) / len(x), k


def stream_cost(ref, given, max_del: int = 2) -> list[float]:
    """Cost of having matched ref[:d], d = 0..len(ref), after all of ``given``, read token by token.

    As in a frontier that advances a node at a time: before the first token only the root is active, and a
    step may skip at most ``max_del`` reference tokens after its match or insertion.
    """
    n = len(ref)
    cost = [0.0] + [np.inf] * n
    for token in given:
        new = [c + 1 for c in cost]
        for d in range(n):
            new[d + 1] = min(new[d + 1], cost[d] + (ref[d] != token))
        for _ in range(max_del):
            new = [min(new[d], new[d - 1] + 1) if d else new[0] for d in range(n + 1)]
        cost = new
    return cost


def partial_score(cost: list[float]) -> tuple[float, float]:
    """(best cost per matched token over started depths, share of the reference of the best depth)."""
    best = min(((c / d, -d) for d, c in enumerate(cost) if d and np.isfinite(c)), default=(np.inf, 0))
    return best[0], -best[1] / max(1, len(cost) - 1)


def completed(cost: list[float], steps: int, most: float = 0.5, share: float = 0.6) -> bool:
    n = len(cost) - 1
    return n > 0 and cost[n] / n <= most and steps >= share * n


def edit_ops(truth, given) -> list[tuple[str, int, int]]:
    """(op, truth index, given index) from the start; op in hit, sub, del, ins; diagonals first."""
    n, m = len(truth), len(given)
    d = np.zeros((n + 1, m + 1), dtype=int)
    d[:, 0], d[0, :] = np.arange(n + 1), np.arange(m + 1)
    for i in range(n):
        for j in range(m):
            d[i + 1, j + 1] = min(d[i, j] + (truth[i] != given[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
    ops, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (truth[i - 1] != given[j - 1]):
            i, j = i - 1, j - 1
            ops.append(("hit" if truth[i] == given[j] else "sub", i, j))
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            ops.append(("del", i, -1))
        else:
            j -= 1
            ops.append(("ins", -1, j))
    return ops[::-1]


def lcs_length(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def in_order_hits(truth, given) -> int:
    at, hits = 0, 0
    for t in truth:
        for j in range(at, len(given)):
            if given[j] == t:
                at, hits = j + 1, hits + 1
                break
    return hits


def common_prefix(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _by_lengths(kernel, least: int = 0):
    """A column function of two strings of one-letter tokens: pairs of equal lengths are aligned together, one array operation for a cell of all of them."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = a.to_pylist(), b.to_pylist()
        out = np.full(len(left), np.nan)
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (x, y) in enumerate(zip(left, right)):
            if x is not None and y is not None:
                groups.setdefault((len(x), len(y)), []).append(k)
        for (n, m), rows in groups.items():
            x, y = (np.frombuffer("".join(s[k] for k in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), size).T for s, size in ((left, n), (right, m)))
            out[rows] = kernel(x, y)
        return pa.array(out, mask=np.isnan(out))

    return run


def _rows(x: np.ndarray, y: np.ndarray, first: np.ndarray):
    """The rows of the edit tables of many pairs: x (n, pairs), y (m, pairs), ``first`` (m + 1, pairs) the row above."""
    row = first
    yield row
    for i in range(len(x)):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (y != x[i]), out=new[1:])
        for j in range(1, len(new)):
            np.minimum(new[j], new[j - 1] + 1, out=new[j])
        row = new
        yield row


def batched_infix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``infix_norm`` of many pairs."""
    if not len(x):
        return np.zeros(x.shape[1])
    *_, row = _rows(x, y, np.zeros((len(y) + 1, x.shape[1]), dtype=np.int16))
    return row.min(0) / len(x)


def batched_prefix(x: np.ndarray, y: np.ndarray, least: int, slack: int = 2) -> np.ndarray:
    """``prefix_norm`` of many pairs."""
    best = np.full(x.shape[1], np.inf)
    for i, row in enumerate(_rows(x, y, np.zeros((len(y) + 1, x.shape[1]), dtype=np.int16))):
        if i and i >= least:
            best = np.minimum(best, row[max(0, len(y) - slack) :].min(0) / i)
    return best


def batched_prefix_align(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``prefix_align``'s cost of many pairs."""
    if not len(x) or not len(y):
        return np.full(x.shape[1], 1.0 if len(x) else 0.0)
    *_, row = _rows(x, y, np.repeat(np.arange(len(y) + 1, dtype=np.int16)[:, None], x.shape[1], axis=1))
    return row[1:].min(0) / len(x)


def batched_levenshtein(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of many pairs of any lengths: one table for all, read where each pair ends."""
    n, m = (np.array([len(s) for s in side]) for side in (left, right))
    pad = lambda side, size, fill: np.frombuffer("".join(s.ljust(size, fill) for s in side).encode("utf-32-le"), np.uint32).reshape(len(side), size).T
    x, y = pad(left, int(n.max(initial=0)), "\0"), pad(right, int(m.max(initial=0)), "\1")
    out = np.zeros(len(left), dtype=np.int64)
    for i, row in enumerate(_rows(x, y, np.repeat(np.arange(len(y) + 1, dtype=np.int16)[:, None], len(left), axis=1))):
        ends = np.flatnonzero(n == i)
        out[ends] = row[m[ends], ends]
    return out


def levenshtein_letters(a: Column, b: Column) -> Column:
    """The distance of strings of one-letter tokens, a batch of pairs at a time; several times as fast as one pair after another."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = a.to_pylist(), b.to_pylist()
        known = [k for k, (x, y) in enumerate(zip(left, right)) if x is not None and y is not None]
        out, missing = np.zeros(len(left), dtype=np.int32), np.ones(len(left), dtype=bool)
        for k in range(0, len(known), 1024):
            some = known[k : k + 1024]
            out[some], missing[some] = batched_levenshtein([left[j] for j in some], [right[j] for j in some]), False
        return pa.array(out, mask=missing)

    return run(a, b)


def infix_norm_letters(ref: Column, window: Column) -> Column:
    return _by_lengths(batched_infix)(ref, window)


def prefix_norm_letters(ref: Column, window: Column, least: int, slack: int = 2) -> Column:
    return _by_lengths(lambda x, y: batched_prefix(x, y, least, slack))(ref, window)


def prefix_align_letters(given: Column, ref: Column) -> Column:
    return _by_lengths(batched_prefix_align)(given, ref)


def _pairwise(kernel, kind: str):
    """A column function of two token arrays, pair by pair."""

    @F.arrow_udf(kind)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else kernel(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], {"double": pa.float64(), "int": pa.int32()}[kind])

    return run


def lcs_col(a: Column, b: Column) -> Column:
    return _pairwise(lcs_length, "int")(a, b)


def in_order_hits_col(truth: Column, given: Column) -> Column:
    return _pairwise(in_order_hits, "int")(truth, given)


def edit_ops_col(truth: Column, given: Column) -> Column:
    """array<struct<op, truth, given>> of the alignment, places from 0 and -1 for none."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("truth", pa.int32()), ("given", pa.int32())]))

    @F.arrow_udf("array<struct<op:string,truth:int,given:int>>")
    def run(truth: pa.Array, given: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else [{"op": o, "truth": i, "given": j} for o, i, j in edit_ops(x, y)] for x, y in zip(truth.to_pylist(), given.to_pylist())], kind)

    return run(truth, given)


def soft_infix_col(ref: Column, window: Column, alternatives: Column, least: float = 0.1) -> Column:
    """E5 on arrays: ``alternatives`` is array<array<struct<token, p>>>, one for each window token, best first."""

    @F.arrow_udf("double")
    def run(ref: pa.Array, window: pa.Array, alternatives: pa.Array) -> pa.Array:
        rows = zip(ref.to_pylist(), window.to_pylist(), alternatives.to_pylist())
        return pa.array([None if None in (x, y, a) else soft_infix_norm(x, y, [[(z["token"], z["p"]) for z in found or []] for found in a], least) for x, y, a in rows], pa.float64())

    return run(ref, window, alternatives)


def edit_norm_col(a: Column, b: Column) -> Column:
    """For one-character-a-token strings, JVM-side."""
    return F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
