"""Operator 10: toxicity by maximum-scoring segments of token log-odds.

Every token is scored: its log-odds between toxic and clean documents under Dirichlet priors, learned from labelled
documents for word beginnings of 4 to 8 letters and whole words. Priors are nested: a part's prior is ``PRIOR`` documents
at the rate of the next shorter part, that of the shortest ones and of short words at the rate of all, so what is rare is drawn towards what its
beginning says. A word takes the longest part that at least ``LEAST`` training documents hold, or 0.
Documents count a token once, so no single text can make one. A constant drift is taken from every token; which one
of ``DRIFTS``, is estimated. A linear-time scan then finds every maximal segment (a toxic passage).

Extreme-value statistics judge them: in n clean tokens K * n + 1 segments times exp(-lambda * S) are expected to reach S, with
lambda the root of mean(exp(lambda * score)) = 1 over the tokens of clean training documents and K by maximum likelihood
from those documents' best segments. Segments add up by the sum statistic: with T the sum of the r best
values lambda * S - log(K * n + 1), the chance of that much is about exp(-T) * T^(r-1) / (r! (r-1)!), and the r that makes
it least counts. A one-dimensional logistic fit on its negative log gives the score; the drift with the likeliest fit is
taken. Training documents are scored without their own counts.

``max_train`` bounds the labelled documents used for fitting (chosen by hash of doc_id), and with them the model.
Everything else covers all documents.

Defined cases: null or empty text scores as a text with no toxic passage; ids with several label
rows take the largest label, null labels are ignored; without labels of both kinds nothing can be
learned and every score is the prior rate; repeated rows are scored each; very long texts are scanned whole; of
segments that tie each is a passage; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, texts
from seqloom.runtime import Scratch

WORD = re.compile(r"[^\W\d_]+")
FOLDS = 5
SHORTEST, LONGEST, LEAST = 4, 8, 3
PRIOR = 30.0
DRIFTS = (0.75, 1.0, 1.5, 2.0)
SIGNIFICANT = 0.05
STEPS, EDGE = 20, 12  # the background histogram: 20 bins a unit from -12 to 12
SCHEMA = "doc_id bigint, n_tokens bigint, best double, passages array<struct<first:int,last:int,score:double>>, score double"


def tokens(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def parts(word: str) -> list[str]:
    """The word itself, then its beginnings from long to short."""
    return [f"={word}"] + [word[:k] for k in range(min(LONGEST, len(word)), SHORTEST - 1, -1)]


class Scores(dict):
    """Word -> score, from the scores of parts; known words are kept up to a bounded number."""

    def __init__(self, known: dict[str, int], odds: np.ndarray):
        super().__init__()
        self.known, self.odds = known, odds

    def __missing__(self, word: str) -> float:
        at = next((self.known[p] for p in parts(word) if p in self.known), -1)
        if len(self) > 200_000:
            self.clear()
        found = self[word] = float(self.odds[at]) if at >= 0 else 0.0
        return found

    def of(self, text: bytes) -> np.ndarray:
        words = tokens(text)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def best_segment(scores: np.ndarray) -> float:
    """The largest sum of a run of scores, 0 for none."""
    if not len(scores):
        return 0.0
    total = np.cumsum(scores)
    least = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    return max(0.0, float((total - least).max()))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, sum) of all maximal scoring segments, in order.

    The classic stack algorithm over runs of positive scores; each segment keeps the sum of all before its start
    and up to its end, and the nearest segment on its left that starts lower, so the search on the left skips.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    up = np.concatenate([[False], scores > 0, [False]])
    starts, ends = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1])
    stack: list[tuple[float, float, int, int, int]] = []
    for left, right, a, b in zip(total[starts].tolist(), total[ends].tolist(), starts.tolist(), (ends - 1).tolist()):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, a, b, j))
                break
            left, a = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for left, right, a, b, _ in stack]


def labelled(docs: DataFrame, labels: DataFrame, column: str, max_train: int, held_out: bool = True) -> DataFrame:
    """(doc_id, label, text) of at most about ``max_train`` labelled documents outside the held-out fold.

    The bound is a documented parameter of the fits that use it: ids are taken by hash.
    """
    marks = labels.where(f"{column} is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    if held_out:
        marks = marks.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != 0)
    total = marks.count()
    if total > max_train:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / total))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")  # at most about max_train rows


def learn_tokens(train: DataFrame, prior: float = PRIOR) -> tuple[dict[str, int], np.ndarray]:
    """(part -> row, log-odds of shape (3, parts): as learned, without one toxic document, without one clean one)."""

    def make(batch: pa.RecordBatch) -> dict:
        count: Counter[tuple[str, int]] = Counter()
        for text, label in zip(texts(batch), batch.column("label").to_pylist()):
            held = {part for word in set(tokens(text)) for part in parts(word)}
            count.update((part, label) for part in held)
        return {"part": [k[0] for k in count], "label": [k[1] for k in count], "n": list(count.values())}

    counts = map_batches(train, make, "part string, label int, n bigint").groupBy("part").agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("t"), F.sum(F.expr("if(label = 1, 0, n)")).alias("c"))
    known = counts.where(f"t + c >= {LEAST}").toArrow()  # parts of at most about max_train documents
    return nested_odds(known["part"].to_pylist(), known["t"].to_numpy().astype(float), known["c"].to_numpy().astype(float), prior)


def nested_odds(found: list[str], t: np.ndarray, c: np.ndarray, prior: float = PRIOR) -> tuple[dict[str, int], np.ndarray]:
    """(part -> row, log-odds) from the numbers of toxic and clean documents that hold each part; beginnings come with all their own."""
    row = {p: k for k, p in enumerate(found)}
    if not t.sum() or not c.sum():
        return {}, np.zeros((3, 0))
    share = t.sum() / (t.sum() + c.sum())
    whole = [p.startswith("=") for p in found]
    above = np.array([row.get(p[1 : LONGEST + 1], -1) if w else row.get(p[:-1], -1) for p, w in zip(found, whole)])
    level = np.array([LONGEST + 1 if w else len(p) for p, w in zip(found, whole)])

    def odds(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        rate = np.full(len(found) + 1, share)  # the last is that of all
        for k in range(SHORTEST, LONGEST + 2):
            at = np.flatnonzero(level == k)
            rate[at] = (np.maximum(t[at], 0) + prior * rate[above[at]]) / (np.maximum(t[at], 0) + np.maximum(c[at], 0) + prior)
        rate = rate[:-1]
        return np.log(rate / (1 - rate)) - np.log(share / (1 - share))

    return row, np.stack([odds(t, c), odds(t - 1, c), odds(t, c - 1)])


def evidence(segments: list[float], n: int, decay: float, scale: float) -> float:
    """-log of the chance that n background tokens hold segments as good as the best r of these, for the r that makes it least."""
    base = math.log1p(scale * n)
    if not segments:
        return -base
    total = np.cumsum(decay * np.sort(segments)[::-1] - base)
    r = np.arange(1, len(total) + 1)
    factorials = np.concatenate([[0.0], np.cumsum(np.log(r))])  # log r!
    large = total > r  # where the statistic holds
    more = total - (r - 1) * np.log(np.where(large, total, 1.0)) + factorials[1:] + factorials[:-1]
    return float(max(total[0], np.where(large, more, -np.inf).max()))


def decay_of(histogram: np.ndarray, drift: float) -> float:
    """lambda: the positive root of mean(exp(lambda * score)) = 1 over background tokens."""
    score = (np.arange(len(histogram)) + 0.5) / STEPS - EDGE - drift
    held = histogram > 0
    score, weight = score[held], histogram[held] / histogram.sum()
    if (score * weight).sum() >= 0 or score.max() <= 0:
        return 1.0  # no background segments to speak of
    value = lambda x: np.log((weight * np.exp(np.minimum(x * score, 700))).sum())
    low, high = 0.0, 1.0
    while value(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """(log likelihood, intercept, slope); the slope is drawn to 0 a little, so separable classes stay finite."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    a, b = math.log(rate / (1 - rate)), 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([(y - p).sum(), ((y - p) * x).sum() - ridge * b])
        step = np.linalg.solve(np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]]), gradient)
        step = np.clip(step, -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))), 1e-12, 1 - 1e-12)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), float(a), float(b)


def toxic_passages(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """Per document: tokens, best segment score, the toxic passages (token spans) and the score."""
    with Scratch() as keep:
        train = keep(labelled(docs, labels, "toxic", max_train))  # read three times
        learned = docs.sparkSession.sparkContext.broadcast(learn_tokens(train))
        fitted = calibrate(train, learned) if learned.value[0] else None
        seen = train.agg(F.count("*"), F.sum("label")).first()
    rate = ((seen[1] or 0) + 0.01) / (seen[0] + 1)

    def make(batch: pa.RecordBatch) -> dict:
        known, odds = learned.value
        value = Scores(known, odds[0] if known else np.zeros(0))
        out: dict[str, list] = {k: [] for k in ("n_tokens", "best", "passages", "score")}
        for text in texts(batch):
            scores = value.of(text)
            n, found, level = len(scores), [], math.log(rate / (1 - rate)) if fitted is None else 0.0
            if fitted is not None:
                drift, decay, scale, a, b = fitted
                found = maximal_segments(scores - drift)
                level = a + b * evidence([s for *_, s in found], n, decay, scale)
                least = (math.log1p(scale * n) - math.log(SIGNIFICANT)) / decay
                out["passages"].append([{"first": f, "last": l, "score": s} for f, l, s in found if s > least])
            else:
                out["passages"].append([])
            out["n_tokens"].append(n)
            out["best"].append(max((s for *_, s in found), default=0.0))
            out["score"].append(1 / (1 + math.exp(-max(-30.0, min(30.0, level)))))
        return {"doc_id": batch.column("doc_id")} | out

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, SCHEMA)


def calibrate(train: DataFrame, learned) -> tuple[float, float, float, float, float] | None:
    """(drift, lambda, K, intercept, slope) from the training documents; None without documents of both kinds."""

    def scored(batch: pa.RecordBatch):
        """(label, scores) of every document by what is known without it."""
        known, odds = learned.value
        by_class = {1: Scores(known, odds[1]), 0: Scores(known, odds[2])}
        for text, y in zip(texts(batch), batch.column("label").to_pylist()):
            yield int(y == 1), by_class[int(y == 1)].of(text)

    def background(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n": [], "y": [], "best": [], "histogram": []}
        held = np.zeros(2 * EDGE * STEPS, dtype=np.int64)
        for y, scores in scored(batch):
            if not y:
                at = np.clip(((scores + EDGE) * STEPS).astype(np.int64), 0, len(held) - 1)
                held += np.bincount(at, minlength=len(held))
            for name, value in zip(out, (len(scores), y, [best_segment(scores - d) for d in DRIFTS], None)):
                out[name].append(value)
        for name, value in zip(out, (None, None, None, held.tolist())):
            out[name].append(value)
        return out

    found = map_batches(train, background, "n bigint, y int, best array<double>, histogram array<bigint>").toArrow().to_pylist()  # at most about max_train rows
    rows = [r for r in found if r["y"] is not None]
    clean = [r for r in rows if not r["y"]]
    if not clean or len(clean) == len(rows):
        return None
    histogram = np.sum([r["histogram"] for r in found if r["histogram"]], axis=0)
    decays = [decay_of(histogram, d) for d in DRIFTS]
    n, best = np.maximum(1, [r["n"] for r in clean]), np.array([r["best"] for r in clean])
    scales = [float(len(clean) / (n * np.exp(-decay * best[:, k])).sum()) for k, decay in enumerate(decays)]

    def judged(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"y": [], "x": []}
        for y, scores in scored(batch):
            out["y"].append(y)
            out["x"].append([evidence([s for *_, s in maximal_segments(scores - d)], len(scores), decay, scale) for d, decay, scale in zip(DRIFTS, decays, scales)])
        return out

    rows = map_batches(train, judged, "y int, x array<double>").toArrow().to_pylist()  # at most about max_train rows
    y, x = np.array([r["y"] for r in rows], dtype=float), np.array([r["x"] for r in rows])
    fits = [(*logistic(x[:, k], y), drift, decays[k], scales[k]) for k, drift in enumerate(DRIFTS)]
    _, a, b, drift, decay, scale = max(fits)
    return drift, decay, scale, a, b


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxic_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_tokens", F.size("passages").alias("n_passages"))
