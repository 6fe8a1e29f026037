"""Distances against their closed forms; components against union-find; FSM steppers by hand traces."""

import random

from hypothesis import given, settings, strategies as st

from seqloom.functions import distances as d
from seqloom.operators.components import connected_components

word = st.text("abc", max_size=7)


def lev(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(lev(a[1:], b[1:]) + (a[0] != b[0]), lev(a[1:], b) + 1, lev(a, b[1:]) + 1)


short = st.text("abc", max_size=5)


@given(short, short)
@settings(max_examples=60, deadline=None)
def test_levenshtein(a, b):
    assert d.levenshtein(a, b) == lev(a, b)
    for c in range(4):
        assert d.cutoff_levenshtein(a, b, c) == min(lev(a, b), c + 1)


@given(word.filter(bool), word)
@settings(max_examples=80, deadline=None)
def test_infix_and_prefix(ref, window):
    n = len(window)
    stretches = [window[i:j] for i in range(n + 1) for j in range(i, n + 1)]
    assert d.infix_norm(ref, window) == min(d.levenshtein(ref, s) for s in stretches) / len(ref)
    best = min(d.levenshtein(ref[:i], window[s:e]) / i for i in range(1, len(ref) + 1) for e in range(max(0, n - 2), n + 1) for s in range(e + 1))
    assert abs(d.prefix_norm(ref, window, 1) - best) < 1e-12
    if window:
        costs = [d.levenshtein(window, ref[:k]) for k in range(1, len(ref) + 1)]
        assert d.prefix_align(window, ref) == (min(costs) / n, costs.index(min(costs)) + 1)


def test_stream_cost_quirk():
    """A skipped first reference token costs 2, a skipped inner or last one 1."""
    assert d.stream_cost("abcd", "bcd")[-1] == 2
    assert d.stream_cost("abcd", "acd")[-1] == 1
    assert d.stream_cost("abcd", "abc")[-1] == 1


def test_alignment_and_counts():
    assert [o for o, _, _ in d.edit_ops("abc", "axc")] == ["hit", "sub", "hit"]
    assert d.lcs_length("abcbd", "bcd") == 3
    assert d.in_order_hits("abc", "xaxc") == 2
    assert d.common_prefix("abx", "aby") == 2
    assert d.soft_infix_norm("ab", "ax", [None, [("x", 0.6), ("b", 0.3)]]) == 0.25


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
