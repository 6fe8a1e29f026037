"""The training-data operators against brute force on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import embeddings, licenses, lines, mixing, packing, quality_classifier, quality_rules, repeats, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, p string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "ra"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, 90) for _ in range(6)]
    found = [(k, base[k % 6] if k % 3 == 0 else prose(rng, rng.randrange(1, 120)), "en", f"s{k % 4}", 1, "r", "p") for k in range(60)]
    near = base[0].split()
    found += [(100 + k, " ".join(w if i != k else "zzz" for i, w in enumerate(near)), "fr", "s0", 1, "r", "p") for k in range(20)]
    found += [(200, None, None, None, None, None, None), (201, "", "en", "s1", 0, "r", "p"), (202, "  \n\n ", "en", "s1", 0, "r", "p"), (203, "é" * 500 + "\n" + "é" * 300, "de", "s2", 1, "r", "p")]
    found += [(204, "under the MIT license. CC-BY-NC cc by nc", "en", "s1", 1, "r", "p"), (204, "under the MIT license. CC-BY-NC cc by nc", "en", "s1", 1, "r", "p"), (None, "no id", "en", "s1", 1, "r", "p")]
    found += [(205, ("word " * 3000).strip(), "en", "s3", 1, "r", "p"), (206, "\n".join(["same line here to stay"] * 5), "en", "s3", 1, "r", "p")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = Counter()
    for d, t in texts:
        gone = set()
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        want[d, len(t), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.remove_repeats(docs).collect())
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0


def test_simhash(docs, rows, empty):
    from xxhash import xxh64_intdigest

    def brute(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r[0]: brute(r[1]) for r in rows}
    ids = sorted(k for k in prints if k is not None)
    label = {k: k for k in ids}
    for _ in ids:
        for a in ids:
            label[a] = min(label[b] for b in ids if bin(prints[a] ^ prints[b]).count("1") <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
        assert r["component_id"] == label.get(r["doc_id"])
    assert simhash.near_duplicates(empty).count() == 0


def test_bit_sliced_links():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centres])
    group = np.sort(rng.integers(0, 3, len(fps)))
    label = np.arange(len(fps))
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (group[:, None] == group[None, :])
    for _ in range(60):
        label = np.where(near, label[None, :], len(fps)).min(1)
    assert (simhash.linked(fps, group) == label).all()
    assert (simhash.linked(fps, group) == simhash.linked(fps, group, 4)).all()


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    v = [(k, (centres[k % 40] + 0.08 * rng.standard_normal(16)).astype("float32").tolist(), k % 3 if k % 7 else None) for k in range(240)]
    v += [(500, v[0][1], v[0][2]), (501, v[1][1], v[1][2]), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, [1.0, None] * 8, 1), (None, v[2][1], v[2][2])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    ok = [x for x in v if x[1] and x[2] is not None and None not in x[1] and np.isfinite(x[1]).all() and any(x[1])]
    m = np.array([x[1] for x in ok], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    same = np.array([[a[2] == b[2] for b in ok] for a in ok])
    links = (m @ m.T >= 0.93) & same
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, limit=8).collect()}
    assert len(got) == len(v)
    want = {x[0]: int(n) for x, n in zip(ok, links.sum(1))}
    found = sum(got[k]["n_links"] for k in want)
    assert all(got[k]["n_links"] <= n for k, n in want.items()) and found >= 0.97 * sum(want.values()) > 0
    for k in (502, 503, 504, 505):
        assert got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_cases(spark):
    """Two vectors of one id, clashing labels, huge doubles; components by brute force."""
    x, y = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, x, 0), (1, y, 1), (9, [0.0, 1.0, 0.11], 1), (10, [1.0, 0.0, 0.11], 0), (20, [1e200, 2e200, 0.0], 3), (21, [2e199, 4e199, 0.0], 3), (22, [1e-200, 2e-200, 0.0], 3), (23, [1e200, -2e200, 0.0], 3)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (9, 1, 1, False), (10, 1, 1, False), (20, 2, 20, True), (21, 2, 20, False), (22, 2, 20, False), (23, 0, 23, True)]
    apart = [(1, x, 0), (1, y, 1), (9, [0.0, 1.0, 0.11], 2), (10, [1.0, 0.0, 0.11], 1)]
    got = sorted((r["vec_id"], r["n_links"]) for r in embeddings.near_duplicates(spark.createDataFrame(apart, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0), (1, 0), (9, 0), (10, 0)]


def test_embedding_components(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((30, 24))
    found = [(k, (centres[k % 30] + 0.05 * rng.standard_normal(24)).tolist(), "ab"[k % 2]) for k in range(300)]
    found += [(1000 + k, found[0][1], "a") for k in range(40)]
    m = np.array([x[1] for x in found], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = (m @ m.T >= 0.93) & (np.array([x[2] for x in found])[:, None] == np.array([x[2] for x in found])[None, :])
    np.fill_diagonal(links, False)
    ids = np.array([x[0] for x in found])
    label = ids.copy()
    for _ in found:
        label = np.minimum(label, np.where(links, label[None, :], 1 << 40).min(1))
    df = spark.createDataFrame(found, "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, limit=16).collect()}
    assert [got[k]["component_id"] for k in ids.tolist()] == label.tolist()
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * links.sum() and all(got[k]["n_links"] <= n for k, n in zip(ids.tolist(), links.sum(1)))


def test_lines(docs, rows, empty):
    got = {r["row"]["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[206]["kept"] == "same line here to stay" and (got[206]["n_lines"], got[206]["n_kept"]) == (5, 1)
    assert got[200]["kept"] is None and got[None]["kept"] == "no id" and got[202]["kept"] == "  \n\n "
    assert sum(got[100 + k]["n_kept"] for k in range(20)) == 0 and got[0]["n_kept"] == 1
    assert lines.dedup_lines(empty).count() == 0


def test_simhash_hot_bucket(spark, monkeypatch):
    """Hundreds of texts in one bucket, most within the radius of its first: whole and split buckets agree."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 3, dtype=np.int64)
    fps = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(e)) for c in centre for a, b, e in rng.integers(0, 62, (120, 3))}
    nodes = spark.createDataFrame(list(enumerate(sorted(fps))), "node long, fp long").cache()
    from seqloom.operators.components import connected_components

    def parts(limit):
        return sorted((r["node"], r["component"]) for r in connected_components(simhash.link_edges(nodes, 4, limit)).collect())

    ids = sorted(fps)
    v = np.array(ids, dtype=np.int64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.where(near, label[None, :], len(v)).min(1)
    want = [(k, int(x)) for k, x in enumerate(label) if (label == x).sum() > 1]
    assert parts(4096) == want == parts(8)


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for a in range(0, len(ids), 1024):
            want[r[0], a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)] += 1
    got = packing.pack(docs, group_docs=30, with_ids=True).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    full = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full[r["sequence_id"]]
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 1024
    assert packing.pack(empty).count() == 0


def test_best_fit():
    rng = random.Random(6)
    lengths = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    rooms: list[int] = []
    for n, w in zip(lengths, packing.best_fit_decreasing(lengths, 100)[0]):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert rooms[w] == min(fits)
            rooms[w] -= n
        else:
            assert w == len(rooms)
            rooms.append(100 - n)


def test_quality_rules(docs, rows, empty):
    got = quality_rules.quality_posterior(docs).collect()
    want = Counter()
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + k for i in range(len(words) - 4) for k in range(5) if windows[tuple(words[i : i + 5])] > 1}
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(inside)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert quality_rules.quality_posterior(empty).count() == 0


def plain_em(rows, start, rounds=300):
    """EM over documents one by one: (posteriors, accuracies)."""
    post = list(start)
    for _ in range(rounds):
        good = []
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            good.append([(sum(w for w, r in zip(weight, rows) if r[k] == 1) + 1) / (sum(w for w, r in zip(weight, rows) if r[k]) + 2) for k in range(len(rows[0]))])
        share = (sum(post) + 1) / (len(post) + 2)
        for i, r in enumerate(rows):
            level = [1 - share, share]
            for c in (0, 1):
                for k, v in enumerate(r):
                    level[c] *= good[c][k] if v == 1 else 1 - good[c][k] if v == -1 else 1
            post[i] = level[1] / (level[0] + level[1])
    return post, good


def test_em_recovers_planted_accuracies():
    rng = random.Random(30)
    truth = [rng.random() < 0.8 for _ in range(600)]
    accuracy = [(0.9, 0.2), (0.95, 0.4), (0.85, 0.1), (0.9, 0.3), (0.5, 0.5)]  # P(good vote | good), P(good vote | bad); the last says nothing
    rows = [tuple((1 if rng.random() < (g if y else b) else -1) if rng.random() < 0.8 else 0 for g, b in accuracy) for y in truth]
    counts = Counter(rows)
    patterns = np.array(sorted(counts))
    post, good, share = quality_rules.fit(patterns, np.array([counts[tuple(p)] for p in patterns], dtype=float))
    by_row = {tuple(p): x for p, x in zip(patterns.tolist(), post)}
    assert abs(share - 0.8) < 0.06
    for k, (g, b) in enumerate(accuracy):
        assert abs(good[1][k] - g) < 0.07 and abs(good[0][k] - b) < 0.17
    assert sum((by_row[r] >= 0.5) == y for r, y in zip(rows, truth)) / len(rows) > 0.9
    slow, theirs = plain_em(rows, [by_row[r] for r in rows])
    assert max(abs(by_row[r] - p) for r, p in zip(rows, slow)) < 1e-4 and np.abs(np.array(theirs) - good).max() < 1e-4
    # a bad vote of the rule that says nothing is outvoted
    assert by_row.get((1, 1, 1, 1, -1), 1.0) >= 0.5
    assert quality_rules.fit(np.zeros((0, 3)), np.zeros(0))[0].shape == (0,)
    clean, _, _ = quality_rules.fit(np.array([[1, 1, 1], [1, 0, 1]]), np.array([50.0, 9.0]))
    assert (clean >= 0.5).all()


def test_quality_verdict(spark):
    """Junk of any kind goes, short clean texts stay although the length rule votes against them."""
    rng = random.Random(31)
    clean = lambda n: " ".join(prose(rng, 9).capitalize() + "." for _ in range(n // 9 + 1))
    made = [(k, clean(rng.choice([18, 30, 200, 300]))) for k in range(400)]
    made += [(1000 + k, " ".join(w + "%%%" for w in prose(rng, 150).split())) for k in range(30)]
    made += [(2000 + k, "BUY NOW!!! CHEAP!!! " * 60) for k in range(30)]
    made += [(3000 + k, "\n".join(["menu | login | home | cart"] * 30)) for k in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.quality_posterior(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert sum(got[k]["kept"] for k in range(400)) >= 396
    assert any(got[k]["v_length"] == -1 and got[k]["kept"] for k in range(400))  # not all must pass
    assert not any(got[k]["kept"] for k in got if k >= 1000)


def test_licenses(docs, rows, empty):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = Counter()
    for r in rows:
        words = pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        want[r[0], len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = licenses.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert licenses.scan(empty).count() == 0


def test_license_join_is_exact(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(14)]
    templates = tuple((f"t{k}", " ".join(rng.sample(vocabulary, 6))) for k in range(5))
    texts = [" ".join(rng.choice(vocabulary + ["x"] * 6) for _ in range(rng.randrange(0, 150))) for _ in range(60)]
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    for k, text in enumerate(texts):
        words = text.split()
        blocks = [set(words[i : i + licenses.BLOCK]) for i in range(0, max(1, len(words)), licenses.STEP)]
        assert got[k] == {label for label, t in templates if any(len(b & set(t.split())) >= 5 for b in blocks)}


def capped_fit(cells, goals, rounds=300):
    """Cell -> expected tokens by bounded iterative fitting, one value at a time."""
    have = {c: t * 0.5 for c, t in cells.items()}
    for _ in range(rounds):
        for side in range(3):
            for value, goal in goals[side].items():
                mine = [c for c in cells if c[side] == value]
                total = sum(have[c] for c in mine)
                if total <= 0:
                    continue
                if goal <= total:
                    for c in mine:
                        have[c] *= goal / total
                else:
                    open_ = [c for c in mine if have[c] < cells[c]]
                    left = sum(have[c] for c in open_)
                    for c in open_:
                        have[c] = min(cells[c], have[c] * (goal - (total - left)) / left)
    return have


def test_raking_meets_targets(spark):
    rng = random.Random(21)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.randrange(200, 3000) for a in range(6) for b in range(3) for c in range(2)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    targets = {"source": {f"s{k}": k + 1.0 for k in range(6)}, "lang": {"l0": 2.0, "l1": 1.0, "l2": 1.0}}
    got = mixing.rake(df, targets, keep_tokens=0.4, tolerance=1e-6).collect()
    budget = 0.4 * sum(cells.values())
    goals = [{}, {}, {}]
    for r in got:
        for k, side in enumerate(mixing.SIDES):
            goals[k][r[side]] = r[f"goal_{side}"]
        assert -1e-9 <= r["expected"] <= r["tokens"] * (1 + 1e-9)
    assert all(abs(sum(g.values()) - budget) < 1e-6 * budget for g in goals)
    for k, side in enumerate(mixing.SIDES):
        for value, goal in goals[k].items():
            assert abs(sum(r["expected"] for r in got if r[side] == value) - goal) < 1e-5 * budget
    assert abs(goals[1]["l0"] / budget - 0.5) < 1e-9
    assert any(r["expected"] > r["tokens"] * (1 - 1e-9) for r in got)  # a cap binds
    want = capped_fit(cells, goals)
    assert all(abs(r["expected"] - want[r["source"], r["lang"], r["topic"]]) < 1e-3 * budget for r in got)


def test_side_targets(spark):
    cells = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 50)], "source string, tokens long")
    goals = lambda *x: {r["source"]: round(r["goal"], 6) for r in mixing.side_targets(cells, "source", *x).collect()}
    assert goals({"a": 1.0, "b": 1.0}, 0.7, 600.0) == {"a": 100.0, "b": 500.0, "c": 0.0}
    assert goals({"a": 1.0}, 0.7, 600.0) == {"a": 100.0, "b": 0.0, "c": 0.0}
    assert goals(None, 1.0, 575.0) == {"a": 50.0, "b": 500.0, "c": 25.0}


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["p"] <= 1 + 1e-12 for r in got)
    assert [r["p"] for r in got if r["lang"] == ""] == [1.0]  # a cell without tokens
    assert mixing.mix(empty).count() == 0
    made = [(k, f"{'software server' if k % 4 == 0 else 'Price, offer.' if k % 4 == 1 else ''} " + "w " * (k % 17), "en", f"s{k % 5}") for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), {"source": {"s0": 3.0, "s1": 1.0}}, topics={"software": "software server", "trade": "price offer"}, keep_tokens=0.2).collect()
    assert {r["topic"] for r in out if r["row"]["doc_id"] % 4 == 0} == {"software"} and {r["topic"] for r in out if r["row"]["doc_id"] % 4 == 1} == {"trade"}
    tokens = lambda keep: sum(r["tokens"] * r["p"] for r in out if keep(r))
    total = sum(r["tokens"] for r in out)
    assert abs(tokens(lambda r: r["source"] == "s0") - 0.15 * total) < 1e-3 * total and abs(tokens(lambda r: r["source"] == "s1") - 0.05 * total) < 1e-3 * total
    assert not any(r["taken"] for r in out if r["source"] not in ("s0", "s1"))
    taken = sum(r["tokens"] for r in out if r["taken"])
    assert abs(taken / total - 0.2) < 0.04


def labels_of(spark, values):
    return spark.createDataFrame(values, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(12)
    made = [(k, prose(rng, 40) + (" vileword nastyword vileword" if k % 6 == 0 else "")) for k in range(400)]
    t = spark.createDataFrame(made, "doc_id long, text string")
    labels = labels_of(spark, [(k, 1, int(k % 6 == 0)) for k in range(400)] + [(3, None, None), (None, 1, 1)])
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_passages(t, labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((got[k] >= 0.5) == (k % 6 == 0) for k in held)
    assert toxicity.toxic_passages(docs, labels).count() == len(rows)
    assert toxicity.toxic_passages(empty, labels).count() == 0
    assert toxicity.toxic_passages(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_keeps_mild_texts_and_finds_scattered_words(spark):
    """Common words lean either way without making a text toxic; toxic families of words are known by their beginnings."""
    rng = random.Random(13)
    bad = lambda: "vilest" + rng.choice("abcdefghijklmnop") + rng.choice("abcdefgh")

    def make(k):
        words = prose(rng, 120).split()
        if k % 8 == 0:
            for at in rng.sample(range(len(words)), 4):
                words[at] = bad()
        elif k % 8 == 1:
            words += ["mostly"] * 3  # in many toxic texts, and in more clean ones
        return k, " ".join(words)

    made = [make(k) for k in range(900)]
    made = [(k, t + (" mostly" if k % 8 == 0 else "")) for k, t in made] + [(5000, ""), (5001, None), (5002, "word " * 60_000)]
    t = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxic_passages(t, labels_of(spark, [(k, 1, int(k % 8 == 0)) for k in range(900)])).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k]["score"] >= 0.5) != (k % 8 == 0) for k in held) <= len(held) // 50
    assert all(got[k]["score"] < 0.5 and not got[k]["passages"] for k in (5000, 5001, 5002))


def test_nested_odds():
    """A rare word has the odds of its beginning, a common one its own."""
    found = ["hate", "hatef", "hateful", "hatefu", "=hateful", "=hates", "hates", "=the"]
    t, c = np.array([100, 60, 3, 40, 3, 40, 40, 400.0]), np.array([2, 1, 0, 0, 0, 0, 0, 4000.0])
    row, odds = toxicity.nested_odds(found, t, c)
    share = t.sum() / (t.sum() + c.sum())
    rate = share
    for part in ("hate", "hatef", "hatefu", "hateful", "=hateful"):
        k = row[part]
        rate = (t[k] + 30 * rate) / (t[k] + c[k] + 30)
        assert abs(odds[0, k] - (np.log(rate / (1 - rate)) - np.log(share / (1 - share)))) < 1e-9
    assert odds[0, row["=hateful"]] > 2 > abs(odds[0, row["=the"]])
    assert odds[1, row["=hateful"]] < odds[0, row["=hateful"]] < odds[2, row["hate"]] + 5


def test_maximal_segments():
    """Against the definition: repeatedly the best contiguous run, then both sides of it."""

    def brute(s, base=0):
        best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[2], -best[2] - best[1]
        return brute(s[:a], base) + [(base + a, base + b - 1)] + brute(s[b:], base + b)

    rng = random.Random(10)
    for _ in range(60):
        s = [rng.choice([-0.5, -0.53, -1.9, 1.37, 2.11]) for _ in range(14)]
        got = toxicity.maximal_segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == brute(s)
        assert abs(max((x for *_, x in got), default=0) - toxicity.best_segment(np.array(s))) < 1e-9


def test_quality_classifier(spark, docs, rows, empty):
    rng = random.Random(11)
    made = [(k, prose(rng, 60) if k % 5 else " ".join(w + "%%%" for w in prose(rng, 60).split()), f"h{k % 3}", "en") for k in range(300)]
    t = spark.createDataFrame(made, "doc_id long, text string, source string, lang string")
    labels = labels_of(spark, [(k, int(k % 5 > 0), 0) for k in range(200)])
    got = {r["row"]["doc_id"]: r["q"]["kept"] for r in quality_classifier.classify(t, labels).collect()}
    assert all(got[k] == (k % 5 > 0) for k in range(300))
    assert quality_classifier.classify(docs, labels).count() == len(rows)
    assert quality_classifier.classify(docs, labels.limit(0)).where("not q.kept").count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
