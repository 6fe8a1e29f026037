"""Text and key functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the label normaliser. Marks that go: combining signs of the Arabic blocks.
MARKS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED\\u08A0-\\u08FF]"
#: Letters that become others: the alef forms with maksura, Farsi yeh and keheh.
LETTERS = ("\u0622\u0623\u0625\u0649\u0671\u06CC\u06A9", "\u0627\u0627\u0627\u0627\u0627\u064A\u0643")
#: A dagger alef is a letter; on an alef maksura the two are one.
DAGGER, MAKSURA, ALEF, TATWEEL = "\u0670", "\u0649", "\u0627", "\u0640"


def normalize(text: Column) -> Column:
    """Label text without marks, with unified letters and single spaces; daggers become letters before marks go."""
    text = F.regexp_replace(text, f"{MAKSURA}?{DAGGER}", ALEF)
    text = F.regexp_replace(F.regexp_replace(text, MARKS, ""), TATWEEL, "")
    return F.trim(F.regexp_replace(F.translate(text, *LETTERS), r"(?U)\s+", " "))


def fold_words(text: Column) -> Column:
    """Lower-case ASCII words, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def make_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def padded_id(name: Column, first: Column, second: Column) -> Column:
    return F.format_string("%s_s%03d_a%03d", name, first.cast("int"), second.cast("int"))


def split_key(key: Column) -> Column:
    """'s:a#seg' -> struct<first, second, segment>; a missing segment is 0."""
    part = lambda pattern: F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).cast("int")
    return F.struct(part(r"^(\d+):").alias("first"), part(r":(\d+)").alias("second"), F.coalesce(part(r"#(\d+)$"), F.lit(0)).alias("segment"))


def anchor_path(path: Column, anchor: str = "data") -> Column:
    """Forward slashes, and everything up to the last '/data/' gone."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), f"^.*/{anchor}/", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def pattern_index(tokens: Column, pattern: Column) -> Column:
    """The token index at which ``pattern`` (array) first stands in ``tokens`` (array); null if nowhere."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    at = F.instr(joined, F.concat(F.lit(" "), F.array_join(pattern, " "), F.lit(" ")))
    before = F.substring(joined, F.lit(1), at)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1)


def clamp_confidence(cost: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - cost))


def glue_forward(words: Column, forward: list[str]) -> Column:
    """Words of ``forward`` written together with the word after them, as an array; one left over at the end stands alone."""
    step = lambda done, w: F.struct(
        F.when(w.isin(forward), done["out"]).otherwise(F.concat(done["out"], F.array(F.concat(done["held"], w)))).alias("out"),
        F.when(w.isin(forward), F.concat(done["held"], w)).otherwise(F.lit("")).alias("held"),
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return F.aggregate(words, start, step, lambda done: F.when(done["held"] == "", done["out"]).otherwise(F.concat(done["out"], F.array(done["held"]))))


def encode_first_seen(tokens: Column, first: int) -> Column:
    """Tokens as characters: the k-th distinct token is the code point first + k - 1."""
    known = F.array_distinct(tokens)
    return F.array_join(F.transform(tokens, lambda t: F.chr(F.array_position(known, t) + F.lit(first - 1))), "")


def simulated_error(token: Column, draw: Column, deleted: str = "1", substituted: str = "3", doubled: str = "5") -> Column:
    """A token with errors by a hex draw: below ``deleted`` it goes, below ``substituted`` it is x, below ``doubled`` y follows it."""
    return F.when(draw < deleted, "").when(draw < substituted, "x").when(draw < doubled, F.concat(token, F.lit("y"))).otherwise(token)


def escaped(text: Column) -> Column:
    """Text with the characters that HTML reads as its own replaced; the ampersand first."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text
