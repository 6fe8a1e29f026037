"""Operator 5: weak supervision over quality rules.

Every rule votes good (1), bad (-1) or abstains (0); the thresholds are the usual ones for web text. Rules overlap, so
that junk of any kind is seen by more than one. Expectation-maximisation over the counts of the distinct vote patterns (at most
3**rules of them, whatever the corpus size) estimates the share of good documents and, for each rule and class,
how often the rule votes good when it votes: its accuracy. Abstentions say nothing. A document is kept if its posterior
probability of being good reaches the threshold, instead of passing every rule: a rule that votes alike in both classes
has no weight, and a bad vote can be outvoted. Accuracies come from agreement alone; EM runs from several starts
(the votes' majority, any bad vote, and each rule by itself) and the likeliest result counts.

Defined cases: null text counts as empty; an empty text has zero counts, every rule but the length
rule abstains and the base check fails it; repeated rows are scored each; very long texts are
handled whole; a posterior equal to the threshold keeps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents, map_batches, mix64, texts
from seqloom.runtime import cut

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5
ENDS = (b".", b",", b"?", b"!", b";", b":")
ODD = bytes.maketrans(SYMBOLS + b"0123456789", b"#" * (len(SYMBOLS) + 10))
RULES = ("length", "symbols", "repeats", "lines", "word_length", "upper", "bars", "shouts", "sentences", "variety", "letters", "plain")
COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " + ", ".join(f"v_{r} int" for r in RULES)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    keys = codes[:n].copy()
    for k in range(1, WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = order[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def variety(words: list[bytes], size: int = 100) -> float:
    """The mean share of distinct words over windows of ``size`` words, end to end; the last one ends with the text.

    Shorter texts are one window."""
    n = len(words)
    if n <= size:
        return len(set(words)) / n
    starts = [*range(0, n - size, size), n - size]
    return sum(len(set(words[k : k + size])) for k in starts) / (size * len(starts))


def vote(good: bool, bad: bool) -> int:
    return -1 if bad else 1 if good else 0


def measure(text: bytes) -> tuple:
    """The base counts of a text, then each rule's vote."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    length = vote(n >= 100, n < 50)
    if n < 10:  # too few words for shares
        return (n, chars, symbols, dup_lines, repeats, length, *[0] * (len(RULES) - 1))
    upper = sum(map(len, filter(str.isupper, words_of(words)))) / chars
    mean = chars / n
    same = dup_lines / len(lines)
    ends = sum(w.endswith(ENDS) for w in words) / n
    fresh = variety(words)
    odd = sum(b"#" in w for w in text.translate(ODD).split()) / n
    letters = sum(map(has_letter, words_of(words))) / n
    bars, shouts = words.count(b"|") / n, joined.count(b"!") / n
    votes = (
        length,
        vote(symbols <= 0.02 * n, symbols >= 0.2 * n),
        vote(repeats <= 0.05 * n, repeats > 0.3 * n),
        vote(same <= 0.1, same > 0.4) if len(lines) >= 3 else 0,
        vote(3 <= mean <= 8, mean < 1 or mean > 10),
        vote(upper <= 0.1, upper > 0.4),
        vote(bars <= 0.01, bars > 0.15),
        vote(shouts <= 0.05, shouts > 0.3),
        vote(0.04 <= ends <= 0.4, ends < 0.01 or ends > 0.8) if n >= 20 else 0,
        vote(fresh >= 0.6, fresh < 0.3) if n >= 20 else 0,
        vote(letters >= 0.8, letters < 0.6),
        vote(odd <= 0.1, odd > 0.4),
    )
    return (n, chars, symbols, dup_lines, repeats, *votes)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def words_of(words: list[bytes]) -> list[str]:
    return b" ".join(words).decode("utf-8", "surrogatepass").split(" ")


def rule_votes(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and the rules' votes."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def make(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*map(measure, texts(batch))))
        return {"doc_id": batch.column("doc_id")} | dict(zip(names[1:], rows))

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), make, COLUMNS)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each vote pattern, P(good vote | class, a vote) of shape (2, rules), share of good documents).

    The likeliest of EM's results from several starts, under a Beta(2, 2) prior on every probability (one vote or
    document more either way). The good class is the one whose votes are good more often.
    """
    if not len(counts):
        return np.zeros(0), np.zeros((2, patterns.shape[1] if patterns.ndim == 2 else 0)), 0.5
    starts = [1 / (1 + np.exp(-patterns.sum(1))), np.where((patterns == -1).any(1), 0.25, 0.75)]
    starts += [np.where(votes == -1, 0.1, np.where(votes == 1, 0.7, 0.5)) for votes in patterns.T]
    found = [expect(patterns, counts, start, rounds) for start in starts]
    _, post, good, share = max(found, key=lambda x: round(x[0], 6))
    if good[0].mean() > good[1].mean():
        post, good, share = 1 - post, good[::-1], 1 - share
    return post, good, share


def expect(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """EM from the posteriors ``post``: (log posterior density, posteriors, P(good vote | class, a vote), share of class 1)."""
    yes, voted = (patterns == 1).astype(float), (patterns != 0).astype(float)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        good = (weight @ yes + 1) / (weight @ voted + 2)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.log(good) @ yes.T + np.log(1 - good) @ (voted - yes).T + np.log([[1 - share], [share]])
        most = logs.max(0)
        level = float(counts @ (most + np.log(np.exp(logs - most).sum(0))) + np.log(good * (1 - good)).sum() + np.log(share * (1 - share)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return level, post, good, float(share)


def quality_posterior(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, votes, ``posterior`` and ``kept`` for every document."""
    votes = cut(rule_votes(docs))  # counts and votes only
    names = [f"v_{r}" for r in RULES]
    # at most 3**12 = 531,441 rows, whatever the corpus; a few hundred in practice
    found = votes.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    patterns = np.array([[r[c] for c in names] for r in found], dtype=int).reshape(len(found), len(names))
    post, _, _ = fit(patterns, np.array([r["n"] for r in found], dtype=float))
    code = sum((F.col(c) + 1) * F.lit(3**i) for i, c in enumerate(names))
    table = {int(((p + 1) * 3 ** np.arange(len(names))).sum()): float(x) for p, x in zip(patterns, post)}
    spark = docs.sparkSession
    known = spark.createDataFrame(list(table.items()), "code int, posterior double")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return (
        votes.withColumn("code", code.cast("int"))
        .join(F.broadcast(known), "code", "left")
        .drop("code")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("posterior", F.lit(1.0)) >= F.lit(threshold)))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_posterior(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
