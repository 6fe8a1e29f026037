"""Line dedup against all pairs: components, buckets and the whole query."""

import random
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import lines


def shingles(line):
    return {line[k : k + 8] for k in range(len(line) - 7)}


def all_pairs(found):
    """The first line of every line's component."""
    sets = [shingles(x) for x in found]
    near = [[j for j, b in enumerate(sets) if a and b and len(a & b) >= lines.SIMILARITY * len(a | b) - 1e-9] for a in sets]
    label = [-1] * len(found)
    for k in range(len(found)):
        open_ = [k] if label[k] < 0 else []
        while open_:
            i = open_.pop()
            if label[i] < 0:
                label[i] = k
                open_ += near[i]
    return label


def test_links_in_bucket():
    rng = random.Random(3)
    for _ in range(20):
        bases = ["".join(rng.choices("abcde é", k=rng.randint(8, 200))) for _ in range(4)]
        found = []
        for _ in range(rng.randint(2, 25)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = "z"
            found.append("".join(line))
        assert lines.links_in_bucket(lines.shingle_sets(found)) == all_pairs(found)


def test_pairs_and_buckets_agree():
    rng = random.Random(8)
    found = ["".join(rng.choices("abcd e", k=rng.randint(8, 90))) for _ in range(120)]
    found += [x[:-1] + "q" for x in found]
    sets = lines.shingle_sets(found)
    assert [len(x) for x in sets] == [len(shingles(x)) for x in found]
    other = [rng.randrange(len(found)) for _ in found]
    want = [len(shingles(a) & shingles(found[k])) >= lines.SIMILARITY * len(shingles(a) | shingles(found[k])) - 1e-9 for a, k in zip(found, other)]
    assert lines.alike(sets, [sets[k] for k in other]).tolist() == want
    counts = lines.shared_counts(sets, width=7)
    assert all(counts[i, k] == len(shingles(found[i]) & shingles(found[k])) for i, k in enumerate(other) if k != i)
    edges = [0, 2, 3, 9, 120, 122, 240]
    want = {(a + f, a + k) for a, b in zip(edges, edges[1:]) for k, f in enumerate(all_pairs(found[a:b])) if f != k}
    assert set(lines.links_in_buckets(sets, edges)) == want


def test_long_lines_piecewise(monkeypatch):
    rng = random.Random(4)
    found = ["".join(rng.choices("abcdé ", k=n)) for n in (8, 9, 70, 500, 64, 71)]
    whole = lines.signatures(found, 5, 3), [x.tolist() for x in lines.shingle_sets(found)]
    monkeypatch.setattr(lines, "PIECE", 16)
    assert (lines.signatures(found, 5, 3) == whole[0]).all()
    assert [x.tolist() for x in lines.shingle_sets(found)] == whole[1]
    assert [len(x) for x in whole[1]] == [len(shingles(x)) for x in found]


@pytest.mark.parametrize("documents", [1000, 10**10])
def test_pairs_at_the_threshold_meet(documents):
    """Of planted pairs at Jaccard 0.8 exactly (80 of 100 shingles shared), 0.2 % at most share no band."""
    rng = random.Random(5)
    bands, rows = lines.scheme(documents)
    assert (1 - 0.8**rows) ** bands <= 1 - lines.RECALL + 1e-12
    code = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = [(x + code(10), x + code(10)) for x in (code(87) for _ in range(10_000))]
    a, b = (shingles(x) for x in pairs[0])
    assert len(a & b) / len(a | b) == 0.8
    left, right = (lines.signatures(list(side), bands, rows) for side in zip(*pairs))
    assert np.sum(~(left == right).any(1)) <= 40


def brute(rows):
    """(doc_id, kept, n_lines, n_kept) of every row, by all pairs of all lines."""
    white = " \t\n\v\f\r"
    first, n = {}, Counter()
    for doc, text in rows:
        if doc is not None and text is not None:
            for line in dict.fromkeys(text.split("\n")):
                if line.strip(white):
                    first[line] = min(doc, first.get(line, doc))
                    n[line] += 1
    found = list(first)
    groups = {}
    for line, label in zip(found, all_pairs(found)):
        groups.setdefault(label, []).append(line)
    from xxhash import xxh3_128_digest

    order = lambda x: (first[x], *np.frombuffer(xxh3_128_digest(x.encode()), ">i8").tolist())
    keeper = {x: min(g, key=order) for g in groups.values() for x in g}
    out = []
    for doc, text in rows:
        kept, seen, total, left = [], set(), 0, 0
        for line in [] if text is None else text.split("\n"):
            if not line.strip(white):
                kept.append(line)
                continue
            total += 1
            if doc is not None and (line in seen or keeper[line] != line or first[line] != doc):
                continue
            seen.add(line)
            left += 1
            kept.append(line)
        out.append((doc, None if text is None else "\n".join(kept), total, left))
    return out


def planted(rng):
    base = ["".join(rng.choices("abcdef gh", k=rng.randint(8, 120))) for _ in range(50)]

    def edited():
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            line[rng.randrange(len(line))] = "z"
        return "".join(line)

    rows = [(k, "\n".join(edited() for _ in range(rng.randint(0, 6)))) for k in range(120)]
    hot = "a line that stands in a third of all texts"
    rows += [(200 + k, f"{hot} {k % 30}\nown {k}{k}{k} line of text {k * 7919}") for k in range(60)]
    rows += [(300, None), (301, ""), (302, " \n\t\n \t "), (303, "x\n\t\ny\n\t"), (304, "short\nshort\nSHORT"), (305, "short")]
    rows += [(306, hot + "\n" + hot), (306, hot + "\n" + hot), (307, "é" * 3000), (308, "é" * 3001 + "\n" + "é" * 2999)]
    return rows + [(None, hot), (None, "short\nshort")]


@pytest.mark.parametrize("limit", [256, 4])
def test_whole_query(spark, monkeypatch, limit):
    """All rows, with hot lines, repeats, nulls, blanks, shared ids and clashing names; buckets whole and split."""
    monkeypatch.setattr(lines, "LIMIT", limit)
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 500_000 if limit > 4 else 0)
    rows = planted(random.Random(6))
    docs = spark.createDataFrame([(d, t, "k", "n") for d, t in rows], "doc_id long, text string, kept string, node string").repartition(3)
    out = lines.dedup_lines(docs)
    got = Counter((r["row"]["doc_id"], r["kept"], r["n_lines"], r["n_kept"]) for r in out.collect())
    assert got == Counter(brute(rows))
    assert set(out.schema["row"].dataType.names) == {"doc_id", "text", "kept", "node"}


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
