"""Operator 2: hierarchical empirical Bayes quality classifier.

A logistic model of text features gives each document its own evidence. Host and path level
posteriors come from grouped sums of that evidence: a path's rate is shrunk towards its host's, a
host's towards the global rate, each with a concentration estimated from the spread of the group
rates (method of moments), so sparse sites count for little. A document's log-odds move by
``site_weight`` times how far its site's log-odds are from the global ones, at most ``site_reach``.
Every feature is of the whole text; vocabulary variety is the mean over 100-word windows end to end.

``max_train`` bounds the labelled documents the logistic model is fitted on (chosen by hash of
doc_id); site statistics cover all documents.

Defined cases: null text counts as empty; null host or path values form a site of their own; ids with
several label rows take the largest label, null labels are ignored; without labels of both kinds the
model is the prior and every document is kept; a score equal to the threshold keeps; repeated rows are scored each;
very long texts are measured whole; empty tables give empty results; further columns pass through untouched, whatever
their names.

Texts are never shuffled: sites are counted from evidence alone and come back to the documents as a broadcast table of
at most ``SITES`` rows, a checked size; beyond it by a join on the site.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, texts, tidy
from seqloom.llm.quality_rules import SPACES, SYMBOLS, repeat_words, variety
from seqloom.llm.toxicity import labelled
from seqloom.runtime import cut, settle

FEATURES = 12
SITES = 200_000


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    plain = b" ".join(words).decode("utf-8", "replace")
    chars = max(1, len(plain) - n + 1)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    ends = sum(w.endswith((b".", b",", b"?", b"!", b";", b":")) for w in words)
    return [
        min(1.0, n / 50),
        min(1.0, symbols / n),
        repeat_words(words) / n,
        (len(lines) - len(set(lines))) / len(lines),
        min(3.0, abs(chars / n - 5.5) / 5),
        sum(map(len, filter(str.isupper, plain.split(" ")))) / chars,
        min(1.0, words.count(b"|") / n),
        min(1.0, plain.count("!") / n),
        sum(map(plain.count, "0123456789")) / chars,
        min(1.0, ends / n),
        variety(words),
        1.0 if symbols > 0.1 * n else 0.0,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic regression by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def document_model(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple:
    """(mean, scale, weights) fitted on labelled documents; empty without labels of both kinds."""
    train = labelled(docs, labels, "quality", max_train, held_out=False)

    def make(batch: pa.RecordBatch) -> dict:
        return {"x": [features(t) for t in texts(batch)], "y": batch.column("label")}

    rows = map_batches(train, make, "x array<double>, y int").collect()  # at most about max_train rows
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(rows) == 0 or y.min() == y.max():
        return ()
    return fit_logistic(np.array([r["x"] for r in rows]), y)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _concentration(groups: DataFrame, rate: Column, n: Column, centre: Column) -> Column:
    """Beta concentration from the spread of group rates around their centres, kept in 5..2000 so that groups which agree, or are too few to tell, still count for something."""
    spread = F.sum(n * (rate - centre) * (rate - centre)) / F.sum(n)
    noise = F.sum(centre * (1 - centre)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-4))
    return F.least(F.lit(2000.0), F.greatest(F.lit(5.0), F.avg(centre * (1 - centre)) / between - 1))


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_train: int = 20_000,
    site_weight: float = 0.5, site_reach: float = 1.5, threshold: float = 0.5,
) -> DataFrame:
    """``docs`` with ``q_document``, ``q_site``, ``quality`` (posterior probabilities) and ``kept``.

    The scores travel as one struct column, so names in ``docs`` cannot clash: the result is
    (row: struct of all input columns, q: struct).
    """
    spark = docs.sparkSession
    settle(spark)
    shared = spark.sparkContext.broadcast(document_model(docs, labels, max_train))

    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        if not shared.value:
            return pa.array([0.9] * len(text), pa.float64())
        mean, scale, w = shared.value
        x = np.array([features(t or b"") for t in text.to_pylist()]).reshape(len(text), FEATURES)
        found = np.clip(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -20, 20))), 1e-4, 1 - 1e-4)
        tidy()
        return pa.array(found)

    none = F.lit("")
    site = [F.coalesce(F.col(host).cast("string"), none).alias("host"), F.coalesce(F.col(path).cast("string"), none).alias("path")]
    # "nondeterministic" only so that a filter on the verdict does not have the features computed a second time
    p = evidence.asNondeterministic()(F.col("text").cast("string").cast("binary")).alias("p")
    paths = cut(docs.select(*site, p).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    sites = cut(site_posteriors(paths))
    small = sites.count() <= SITES
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *site, p)
    joined = rows.join(F.broadcast(sites) if small else sites, ["host", "path"], "left")
    shift = F.least(F.lit(site_reach), F.greatest(F.lit(-site_reach), F.lit(site_weight) * (_logit(F.col("site")) - _logit(F.col("all_rate")))))
    odds = _logit(F.col("p")) + shift
    quality = 1 / (1 + F.exp(-odds))
    return joined.select("row", F.struct(F.col("p").alias("document"), F.col("site").alias("site"), quality.alias("quality"), (quality >= threshold).alias("kept")).alias("q"))


def site_posteriors(paths: DataFrame) -> DataFrame:
    """(host, path, n, s = sum of evidence) -> (host, path, site, all_rate), shrunk level by level."""
    clip = lambda c: F.least(F.lit(0.999), F.greatest(F.lit(0.001), c))
    total = paths.agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all")).select(clip(F.col("s_all") / F.col("n_all")).alias("all_rate"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("s").alias("s_host")).crossJoin(F.broadcast(total))  # one row
    rate = F.col("s_host") / F.col("n_host")
    k_host = hosts.agg(_concentration(hosts, rate, F.col("n_host"), F.col("all_rate")).alias("k_host"))
    hosts = hosts.crossJoin(F.broadcast(k_host)).select(
        "host", "all_rate", clip((F.col("s_host") + F.col("k_host") * F.col("all_rate")) / (F.col("n_host") + F.col("k_host"))).alias("host_rate")
    )
    below = paths.join(hosts, "host")
    k_path = below.agg(_concentration(below, F.col("s") / F.col("n"), F.col("n"), F.col("host_rate")).alias("k_path"))
    return below.crossJoin(F.broadcast(k_path)).select(
        "host", "path", "all_rate", clip((F.col("s") + F.col("k_path") * F.col("host_rate")) / (F.col("n") + F.col("k_path"))).alias("site")
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.doc_id", F.col("q.document").alias("p_document"), F.col("q.site").alias("p_site"), "q.quality", "q.kept")
