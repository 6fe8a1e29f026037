"""Monotone alignments: tokens to frames by Viterbi over CTC states, and token sequences within a band."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def forced_alignment(log_probs: np.ndarray, tokens: list[int], blank: int = 0) -> list[tuple[int, int, float]] | None:
    """(first frame, last frame, mean log probability) of each token on the likeliest path; None if the frames are too few.

    States are blank, token, blank, token, ..., blank. A path goes on, moves to the next state, or skips a blank between two
    different tokens.
    """
    frames, states = len(log_probs), [blank]
    for token in tokens:
        states += [token, blank]
    n = len(states)
    skips = np.array([k >= 2 and states[k] != blank and states[k] != states[k - 2] for k in range(n)])
    score = np.full(n, -np.inf)
    score[:2] = log_probs[0, states[:2]] if frames else -np.inf
    steps = np.zeros((frames, n), dtype=np.int8)
    for t in range(1, frames):
        one = np.concatenate([[-np.inf], score[:-1]])
        two = np.where(skips, np.concatenate([[-np.inf] * 2, score[:-2]])[:n], -np.inf)
        moves = np.stack([score, one, two])
        steps[t] = moves.argmax(0)
        score = moves.max(0) + log_probs[t, states]
    if not frames or not tokens:
        return [] if not tokens else None
    at = n - 1 if score[n - 1] >= score[n - 2] else n - 2
    if not np.isfinite(score[at]):
        return None
    spans: list[list[int]] = [[] for _ in tokens]
    for t in range(frames - 1, -1, -1):
        if at % 2:
            spans[at // 2].append(t)
        at -= steps[t, at]
    return [(s[-1], s[0], float(np.mean([log_probs[t, tokens[k]] for t in s]))) for k, s in enumerate(spans)]


def verdict(mean: float | None, least: float = -2.5) -> str:
    return "ROUGH_ONLY" if mean is None else "OK" if mean >= least else "LOW_SCORE"


def forced_alignment_col(log_probs: Column, tokens: Column, blank: int = 0) -> Column:
    """array<struct<first, last, score, flag>> from array<array<double>> and array<int>."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("flag", pa.string())]))

    @F.arrow_udf("array<struct<first:int,last:int,score:double,flag:string>>")
    def run(log_probs: pa.Array, tokens: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(log_probs.to_pylist(), tokens.to_pylist()):
            found = None if x is None or y is None else forced_alignment(np.array(x), y, blank)
            out.append(None if found is None else [{"first": a, "last": b, "score": s, "flag": verdict(s)} for a, b, s in found])
        return pa.array(out, kind)

    return run(log_probs, tokens)


def banded_alignment(ref: list, given: list, least_band: int = 200, share: float = 0.12) -> tuple[float, list[tuple[int, int]]]:
    """(cost, matched places (ref, given)) of all of ``ref`` inside ``given``, whose ends are free, near the diagonal.

    Row i looks at places of ``given`` within max(least_band, share * len(given)) of i * len(given) / len(ref).
    """
    n, m = len(ref), len(given)
    band = max(least_band, int(share * m))
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0] = 0
    for i in range(1, n + 1):
        centre = i * m // max(1, n)
        low, high = max(0, centre - band), min(m, centre + band)
        if low == 0:
            cost[i, 0] = i
        for j in range(max(1, low), high + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (ref[i - 1] != given[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    j = int(np.argmin(cost[n]))
    best, pairs, i = float(cost[n, j]), [], n
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (ref[i - 1] != given[j - 1]):
            i, j = i - 1, j - 1
            if ref[i] == given[j]:
                pairs.append((i, j))
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return best, pairs[::-1]
