"""Vocabulary variety over whole texts."""

import random

from seqloom.llm import quality_classifier

AT = 10


def test_variety_reads_the_whole_text():
    rng = random.Random(2)
    varied = [b"w%d" % k for k in range(100)]
    body = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"]) for _ in range(900)]
    value = lambda words: quality_classifier.features(b" ".join(words))[AT]
    assert value(varied) == 1.0
    assert abs(value(varied + body) - (1 + 9 * 0.08) / 10) < 1e-9
    assert abs(value(body + varied) - (1 + 9 * 0.08) / 10) < 1e-9
    assert value(varied * 10) == 1.0
    assert abs(value(varied[:50] + [b"x"] * 100) - (51 / 100 + 1 / 100) / 2) < 1e-9
