"""Operator 6: license scans by an exact set-similarity join.

Texts are cut into blocks of ``BLOCK`` words, every ``STEP`` words, so any run of up to STEP words lies
whole in a block. A block matches a template when it contains at least ``containment`` of the
template's distinct words. The join is exact and filtered: template words are ordered by document
frequency over the whole table, rarest first; only texts (then blocks) with a word of a template's
prefix (the first |T| - need + 1 words in that order) can match; a block needs ``need`` template words
at all (length filter); and if its first shared word is the k-th of the order, no more than |T| - k + 1
can be shared (positional filter). Templates are a parameter, so everything they yield is of bounded
size and sits in the plan; the documents are read twice and never shuffled, except for the counts of
template words. DataFrame expressions only.

Defined cases: null text is empty (0 words, no labels, score 0); ties in frequency are broken by the
word; repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.llm.arrow import documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STEP = 64, 32
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Sentences of public license notices; each has at most STEP words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def normal(text: Column) -> Column:
    """Lower-case words, single spaces between, none outside."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_order(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Documents of the whole table that hold each of ``words`` (a list of bounded size)."""
    counted = (
        docs.select(F.explode(F.array_intersect(F.split(normal(F.col("text")), " "), _array(words))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).collect()  # at most a row for each template word
    )
    return {w: 0 for w in words} | {r["word"]: r["n"] for r in counted}


def _first_and_last(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places, the first place and the last place of ``phrase`` as word numbers (null without any)."""
    spaced = f" {phrase} "
    found = F.contains(padded, F.lit(spaced))
    places = F.when(found, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(F.lit(0))
    first = F.when(found, _spaces(F.substring_index(padded, spaced, 1)))
    last = F.when(found, _spaces(padded) - 1 - _spaces(F.substring_index(padded, spaced, -1)) - phrase.count(" ") - 1)
    return places, first, last


def scan(docs: DataFrame, templates: tuple = TEMPLATES, containment: float = 0.8) -> DataFrame:
    """One row per document: words, base phrase places, base labels, all labels and the score."""
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    seen = word_order(docs, vocabulary)
    plans = []
    for label, words in sets:
        ordered = sorted(words, key=lambda w: (seen[w], w))
        need = ceil(containment * len(ordered) - 1e-9)
        plans.append((label, ordered, need, ordered[: len(ordered) - need + 1]))
    prefixes = sorted({w for *_, prefix in plans for w in prefix})

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal(F.col("text")).alias("plain"))
    base = base.select("doc_id", F.when(F.col("plain") == "", F.lit(0)).otherwise(_spaces(F.col("plain")) + 1).cast("bigint").alias("n_words"), F.concat(F.lit(" "), "plain", F.lit(" ")).alias("padded"))
    for k, (phrase, _) in enumerate(PHRASES):
        for name, column in zip(("n", "first", "last"), _first_and_last(F.col("padded"), phrase)):
            base = base.withColumn(f"{name}_{k}", column)
    words = F.split(F.trim("padded"), " ")
    base = base.withColumn("words", F.when(F.size(F.array_intersect(words, _array(prefixes))) > 0, words).otherwise(F.array().cast("array<string>")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(STEP))
    blocks = F.transform(starts, lambda i: F.array_intersect(F.slice(F.col("words"), i + 1, F.lit(BLOCK)), _array(vocabulary)))
    base = base.withColumn("blocks", F.when(F.size("words") > 0, blocks).otherwise(F.array().cast("array<array<string>>")))

    def shared(block: Column, ordered: list[str], need: int, prefix: list[str]) -> Column:
        """The template's share in a block; 0 as soon as a filter shows that it stays below ``need``."""
        first = F.array_position(F.transform(_array(prefix), lambda w: F.array_contains(block, w)), True)
        passes = (F.size(block) >= need) & (first > 0) & (F.lit(len(ordered) + 1) - first >= need)
        return F.when(passes, F.size(F.array_intersect(block, _array(ordered)))).otherwise(F.lit(0)) / F.lit(float(len(ordered)))

    for k, (_, ordered, need, prefix) in enumerate(plans):
        best = F.coalesce(F.array_max(F.transform(F.col("blocks"), lambda b: shared(b, ordered, need, prefix))), F.lit(0.0))
        base = base.withColumn(f"best_{k}", F.when(F.size("blocks") > 0, best).otherwise(F.lit(0.0)))
    none = F.lit(None).cast("string")
    base_marks = [F.when(F.col(f"n_{k}") > 0, F.lit(label)).otherwise(none) for k, (_, label) in enumerate(PHRASES)]
    marks = [F.when(F.col(f"best_{k}") >= F.lit(plans[k][2] / len(plans[k][1])) - 1e-9, F.lit(plans[k][0])).otherwise(none) for k in range(len(plans))]
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), ",")
    n_base = sum((F.col(f"n_{k}") for k in range(1, len(PHRASES))), F.col("n_0"))
    return base.select(
        "doc_id", "n_words", n_base.cast("bigint").alias("n_base"),
        F.least(*[F.col(f"first_{k}") for k in range(len(PHRASES))]).cast("bigint").alias("first_word"),
        F.greatest(*[F.col(f"last_{k}") for k in range(len(PHRASES))]).cast("bigint").alias("last_word"),
        joined(base_marks).alias("base_labels"), joined(base_marks + marks).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.greatest(*[F.col(f"best_{k}") for k in range(len(plans))])).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
