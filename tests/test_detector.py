"""The chain detector on planted streams, its state machines by hand traces, batched kernels against plain ones."""

import itertools
import random

import numpy as np
import pytest

from seqloom.api import Config, Detector
from seqloom.functions import alignment, distances
from seqloom.streaming.steppers import GatedReset, LiveWindows, PrefixDetector, Progress, Provisional, SpeechGate, Voter


def play(stepper, rows):
    state, out = stepper.start(), []
    for row in rows:
        out += stepper.step(state, row)
    return out


def test_batched_distances():
    rng = random.Random(1)
    for n, m in itertools.product((0, 1, 5, 8), (0, 1, 7, 12)):
        pairs = [("".join(rng.choices("abc", k=n)), "".join(rng.choices("abc", k=m))) for _ in range(20)]
        x, y = (np.array([[ord(c) for c in p[k]] for p in pairs], dtype=np.uint32).reshape(20, -1).T for k in (0, 1))
        assert np.allclose(distances.batched_infix(x, y), [distances.infix_norm(a, b) for a, b in pairs])
        assert np.allclose(distances.batched_prefix(x, y, 3), [distances.prefix_norm(a, b, 3) for a, b in pairs])
        assert np.allclose(distances.batched_prefix_align(x, y), [distances.prefix_align(a, b)[0] for a, b in pairs])


def test_batched_levenshtein():
    rng = random.Random(2)
    left, right = (["".join(rng.choices("abc", k=rng.randrange(0, 15))) for _ in range(60)] for _ in "xy")
    assert distances.batched_levenshtein(left, right).tolist() == [distances.levenshtein(a, b) for a, b in zip(left, right)]


def fire(w1, key, cost=0.2, win=None):
    return {"w1": float(w1), "key": key, "cost": cost, "win": win}


def test_voter():
    refs = {"1:1": list("abcdefgh"), "1:2": list("ijklmnop"), "1:3": list("qrstuvwx"), "2:1": list("abcdefgh"), "9:9": list("zzzzzzzz")}
    order = list(refs)
    after = dict(zip(order, order[1:]))
    said = lambda rows, **more: [k for k, *_ in play(Voter(refs, after, {}, **more), rows)]
    assert said([fire(1, "1:1"), fire(2, "1:1")]) == ["1:1"]  # a jump needs two votes
    assert said([fire(1, "1:1", 0.1), fire(5, "1:2")]) == ["1:1", "1:2"]  # strong at once, the expected one at once
    assert said([fire(1, "1:1", 0.1), fire(1, "1:2"), fire(0.5, "1:2")]) == ["1:1", "1:2"]
    assert said([fire(1, "1:1"), fire(2, "9:9"), fire(3, "1:1")]) == []  # votes must follow one another
    assert said([fire(9, "1:1", 0.5), fire(9, "1:1", 0.31)]) == []  # too dear
    # a look-alike of the expected unit counts as it
    assert said([fire(1, "9:9", 0.1)], ) == ["9:9"]
    assert [k for k, *_ in play(Voter(refs, {"1:3": "2:1"}, {}), [fire(1, "1:3", 0.1), fire(5, "1:1", 0.1)])] == ["1:3", "2:1"]
    # said again only after a while
    assert said([fire(1, "1:1", 0.1), fire(5, "1:2"), fire(9, "1:1", 0.1), fire(30, "1:1", 0.1)]) == ["1:1", "1:2", "1:1"]
    # after three expected commits a far jump needs three votes, or two strong ones
    run = [fire(1, "1:1", 0.1), fire(5, "1:2"), fire(9, "1:3"), fire(13, "2:1")]
    assert said(run + [fire(17, "9:9", 0.1)]) == order  # 9:9 is expected after 2:1
    far = {**after, "2:1": None}
    jump = lambda *costs: [k for k, *_ in play(Voter(refs, far, {}), run + [fire(17 + i, "9:9", c) for i, c in enumerate(costs)])][4:]
    assert jump(0.1) == [] and jump(0.1, 0.1) == ["9:9"] and jump(0.2, 0.2) == [] and jump(0.2, 0.2, 0.2) == ["9:9"]
    # the beginning of the expected unit, once the chain goes on as expected
    begun = [fire(1, "1:1", 0.1), fire(5, "1:2"), fire(9, "", 0.0, list("xxqrstuv"))]
    assert said(begun, early=0.5) == ["1:1", "1:2", "1:3"] and said(begun) == ["1:1", "1:2"]
    assert said(begun[:1] + begun[2:], early=0.5) == ["1:1"]


def test_trie_matcher():
    """Against the cost of one reference at a time, and a beam that keeps the cheapest."""
    from seqloom.functions.trie import Trie, TrieMatcher

    rng = random.Random(6)
    units = {f"1:{k}": rng.choices("abcd", k=rng.randrange(3, 9)) for k in range(30)}
    trie = Trie(units)
    for _ in range(20):
        given = rng.choices("abcde", k=rng.randrange(1, 8))
        m = TrieMatcher(trie, beam=10**6, restart=False)
        for token in given:
            m.step(token)
        for key, ref in units.items():
            cost = distances.stream_cost(ref, given)
            assert [m.cost[n] for n in trie.paths[key]] == cost[1:]
            partial = distances.partial_score(cost)
            if np.isfinite(partial[0]):
                assert abs(m.progress(key)[0] - partial[0]) < 1e-9
        ends = {k: m.cost[p[-1]] / len(p) for k, p in trie.paths.items() if np.isfinite(m.cost[p[-1]])}
        assert [round(c, 9) for _, c in m.candidates(3)] == [round(c, 9) for c in sorted(ends.values())[:3]]
    m = TrieMatcher(trie, beam=25)
    for token in units["1:7"]:
        m.step(token)
        assert np.isfinite(m.cost).sum() <= 25
    assert m.candidates(1)[0][1] == 0 and m.complete(m.margin()[0]) and m.partial_candidates(3)[0][1] == 0
    again = TrieMatcher(trie, beam=10**6)
    for token in list("dddd") + units["1:7"]:
        again.step(token)
    assert dict(again.candidates(30))["1:7"] == 0  # a unit may start at any token


def test_cold_start():
    refs = {k: list(k * 3) for k in ("1:1", "1:2#1", "1:2#2", "2:1#01")}
    said = lambda rows, **more: [k for k, *_ in play(Voter(refs, {}, {}, **more), rows)]
    assert said([fire(1, "1:1", 0.24)]) == [] and said([fire(1, "1:1", 0.24)], opening=0.25) == ["1:1"]
    assert said([fire(1, "2:1#01", 0.24)], opening=0.25) == ["2:1#01"] and said([fire(1, "1:2#1", 0.24)], opening=0.25) == []
    assert said([fire(1, "1:2#2", 0.2), fire(2, "1:2#2", 0.2)]) == ["1:2#2"]
    assert said([fire(1, "1:2#2", 0.2), fire(2, "1:2#2", 0.2)], ramp=12.0) == []
    assert said([fire(11, "1:2#2", 0.2), fire(12, "1:2#2", 0.2)], ramp=12.0) == ["1:2#2"]


def test_progress_and_provisional():
    rows = [{"parent": p, "place": k} for p, k in (("1:1", None), ("1:2", 1), ("1:2", 2), ("2:5", 1), ("1:3", None))]
    got = play(Progress({"1:1": 1, "1:2": 2, "1:3": 1, "2:5": 3}), rows)
    assert got == [("detect", "1:1", 1, 1, "1:2"), ("advance", "1:2", 1, 2, None), ("progress", "1:2", 2, 2, "1:3"), ("jump", "2:5", 1, 3, None), ("jump", "1:3", 1, 1, None)]
    rows = [{"key": k, "confirmed": c, "waits": w} for k, c, w in (("1:1", False, True), ("3:1", False, True), ("1:2", False, True), ("1:3", True, False), ("1:4", False, True))]
    assert play(Provisional(), rows) == [("1:2",)]


def test_live_windows():
    rng = random.Random(5)
    rows = [{"t": t, "token": rng.choice("abc")} for t in sorted(rng.uniform(0, 40) for _ in range(150))]
    stepper = LiveWindows((4.0, 10.0), 1.5)
    state, got = stepper.start(), []
    for row in rows:
        got += stepper.step(state, row)
        assert all(t >= row["t"] - 12.0 for t, _ in state["held"])
    got += stepper.finish(state)
    want = []
    for k in range(1, int(rows[-1]["t"] // 1.5) + 2):
        for w in (4.0, 10.0):
            inside = [r["token"] for r in rows if 1.5 * k - w <= r["t"] < 1.5 * k]
            want += [(1.5 * k, w, inside)] * (len(inside) >= 4)
    assert got == want


def test_prefix_detector():
    refs = {"1:1": list("abcdefgh"), "1:2": list("ijklmnop"), "1:3": list("qrstuvwx")}
    rows = [{"win": list(w)} for w in ("ab", "abc", "abcd", "abcdefgh", "ij", "ijk", "ijkl", "ab", "ab", "ab", "ab", "qr", "qrs", "qrst")]
    got = [(e, k) for e, k, *_ in play(PrefixDetector(refs, list(refs)), rows)]
    assert got == [("detect", "1:1"), ("release", "1:1"), ("advance", "1:2"), ("advance", "1:3")]  # no step back
    assert play(PrefixDetector(refs, list(refs)), [{"win": list("zzzzzzzzzzzzzzzzzzzz")}] * 9) == []


def test_gates():
    p = [0.1, 0.6, 0.4, 0.3, 0.3, 0.3, 0.6, 0.2, 0.2, 0.2, 0.2, 0.2]
    state, gate, got = SpeechGate(0.5, 0.15, 3).start(), SpeechGate(0.5, 0.15, 3), []
    for k, x in enumerate(p):
        got += [(k, e) for (e,) in gate.step(state, {"p": x})]
    assert got == [(1, "start"), (10, "end")]
    rows = [{"t": t, "event": e} for t, e in ((0.0, "silence"), (1.0, "commit"), (4.0, "silence"), (9.0, "silence"), (9.5, "emission"), (9.6, "silence"))]
    assert play(GatedReset(4.0), rows) == [(4.0,), (9.6,)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    sounds = [f"t{k}" for k in range(30)]
    units = {f"{s}:{a}": rng.choices(sounds, k=rng.randrange(14, 30)) for s in (1, 2) for a in range(1, 9)}
    return units, rng, sounds


def test_chain_of_a_planted_stream(spark, planted):
    units, rng, sounds = planted
    truth = {"one": ["1:2", "1:3", "1:4", "1:5"], "two": ["2:6", "2:7", "2:8"]}
    rows = []
    for stream, keys in truth.items():
        t = 0.0
        for key in keys:
            for token in units[key]:
                rows.append((stream, t, token if rng.random() > 0.05 else rng.choice(sounds)))
                t += 0.26
            t += 0.5
    tokens = spark.createDataFrame(rows, "stream string, t double, token string")
    detector = Detector(spark, units, config=Config(early_prefix=0.5))
    found = {}
    for r in detector.chains(tokens).orderBy("stream", "at").collect():
        found.setdefault(r["stream"], []).append(r["parent"])
    for stream, keys in truth.items():
        assert [k for k in found[stream] if k in keys] == keys
        assert len(found[stream]) <= len(keys) + 1
    fires = detector.fires(tokens).cache()
    assert fires.where("cost > 0.3").count() == 0
    barred = detector.with_blacklist(["1:3"]).fires(tokens)
    assert barred.where("key = '1:3'").count() == 0 and fires.where("key = '1:3'").count() > 0
    assert detector.with_blacklist(["1:3"]).with_page(["1:3"]).fires(tokens).where("key = '1:3'").count() > 0


def test_forced_alignment():
    rng = np.random.default_rng(3)
    for _ in range(20):
        frames, tokens = 6, rng.integers(1, 4, rng.integers(1, 4)).tolist()
        x = np.log(rng.dirichlet(np.ones(4), frames))
        best = None
        for path in itertools.product(range(4), repeat=frames):
            spoken = [a for k, a in enumerate(path) if a and (k == 0 or path[k - 1] != a)]
            if spoken == tokens:
                score = sum(x[t, a] for t, a in enumerate(path))
                best = max(best or (-np.inf,), (score, path))
        got = alignment.forced_alignment(x, tokens)
        if best is None:
            assert got is None
            continue
        spans, k = [], -1
        for t, a in enumerate(best[1]):
            if a and (t == 0 or best[1][t - 1] != a):
                spans.append([t, t])
            elif a:
                spans[-1][1] = t
        assert [[a, b] for a, b, _ in got] == spans
    assert alignment.forced_alignment(np.zeros((0, 4)), [1]) is None and alignment.forced_alignment(np.zeros((3, 4)), []) == []


def test_banded_alignment():
    rng = random.Random(4)
    for _ in range(30):
        ref, given = rng.choices("abc", k=rng.randrange(1, 12)), rng.choices("abc", k=rng.randrange(0, 20))
        cost, pairs = alignment.banded_alignment(ref, given)
        assert cost / len(ref) == distances.infix_norm(ref, given)
        assert all(ref[i] == given[j] for i, j in pairs) and pairs == sorted(pairs) and len(pairs) >= len(ref) - cost
    assert alignment.banded_alignment(list("abcd"), list("xxxxxxxxabcd"), least_band=1, share=0)[0] > 0


def test_log_mel():
    from seqloom.functions import audio

    rng = np.random.default_rng(1)
    x = rng.standard_normal(1000) * 0.1
    got = audio.log_mel(x)
    assert got.shape == (1000 // 160 + 1, 80)
    t = 3  # one frame by the definition of the transform
    padded = np.concatenate([x[200:0:-1], x, x[-2:-202:-1]])
    frame = padded[160 * t : 160 * t + 400] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
    power = [abs(sum(frame[n] * np.exp(-2j * np.pi * k * n / 400) for n in range(400))) ** 2 for k in range(201)]
    assert np.allclose(got[t], np.log(np.maximum(audio.mel_weights() @ np.array(power), 1e-10)))
    assert len(audio.load_16k(b"junk")) == 8000 and len(audio.load_16k(None)) == 8000


def test_decoded(spark):
    from seqloom.api import decoded

    rows = spark.createDataFrame([("a", 1.0, [0.1, 0.9]), ("a", 3.0, [0.2]), ("b", 0.0, [])], "stream string, t0 double, samples array<double>")
    got = decoded(rows, lambda x: [(f"{v:.1f}", k / 2) for k, v in enumerate(x)]).collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, "0.1"), ("a", 1.5, "0.9"), ("a", 3.0, "0.2")]


def test_command_line(capsys):
    from seqloom.__main__ import main

    assert main(["list"]) == 0 and "session_top_unit: " in capsys.readouterr().out
