"""State machines over one stream's rows, as pure steps shared by batch folds and streaming queries.

A stepper has ``start()`` (a JSON-able state), ``step(state, row)`` (changes the state, returns the output rows)
and ``finish(state)`` (what is still to say when the stream ends). Rows come as dicts, outputs leave as tuples
in the order of ``schema``. States are of fixed size, whatever a stream's length.
"""

from __future__ import annotations

from dataclasses import dataclass


class Stepper:
    schema = ""

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row: dict) -> list[tuple]:
        raise NotImplementedError

    def finish(self, state: dict) -> list[tuple]:
        return []


@dataclass
class Collapse(Stepper):
    """Greedy collapse whose last token is carried over chunk borders. Rows: token."""

    blank: str | None = None
    schema = "token string"

    def step(self, state, row):
        token, before = row["token"], state.get("token")
        state["token"] = token
        return [(token,)] if token != before and token != self.blank else []


@dataclass
class Commit(Stepper):
    """A leader commits after ``need`` sure rows in a row, another one replaces it after ``revise``.

    Rows: key (null: no leader), margin. A row without a leader or under ``threshold`` ends the run.
    """

    threshold: float = 0.15
    need: int = 5
    revise: int = 8
    schema = "key string"

    def step(self, state, row):
        key = row["key"] if row["margin"] >= self.threshold else None
        state["run"] = state.get("run", 0) + 1 if key == state.get("leader") else 1
        state["leader"] = key
        held = state.get("held")
        if key is None or key == held or state["run"] < (self.need if held is None else self.revise):
            return []
        state["held"] = key
        return [(key,)]


@dataclass
class Segmenter(Stepper):
    """T4: the best key of each window becomes detect, advance or jump events. Rows: key, cost.

    Windows over ``most_cost`` say nothing. The first sure key is detected, the successor of the current one
    advances at once, another key must be seen ``votes`` times before it jumps; the current key clears votes.
    ``successor``: key -> the next key in canonical order.
    """

    successor: dict
    most_cost: float = 0.3
    votes: int = 2
    schema = "event string, key string, cost double"

    def step(self, state, row):
        key, cost, now = row["key"], row["cost"], state.get("now")
        if key is None or cost > self.most_cost:
            return []
        seen = 0
        if now is None:
            event = "detect"
        elif key == now:
            event = None
        elif key == self.successor.get(now):
            event = "advance"
        else:
            seen = 1 + (state.get("seen", 0) if state.get("rival") == key else 0)
            event = "jump" if seen >= self.votes else None
        if event:
            state["now"], seen = key, 0
        state["rival"], state["seen"] = (key, seen) if seen else (None, 0)
        return [(event, key, cost)] if event else []


@dataclass
class Assemble(Stepper):
    """Emissions become a chain. Rows: parent, place (null: the whole parent).

    What continues the last confirmed unit is confirmed: its successor, or a later place of its parent. An
    earlier or equal place of that parent is a repeat and goes. Other units wait, at most ``depth`` of them; one
    that a later unit continues is confirmed together with it, the oldest goes when there are too many.
    ``successor``: "parent#place" -> the unit after it where that is another parent's.
    """

    successor: dict
    depth: int = 2
    schema = "parent string, place int"

    def follows(self, before: list, unit: list) -> bool:
        name = before[0] if before[1] is None else f"{before[0]}#{before[1]}"
        own = unit[0] if unit[1] is None else f"{unit[0]}#{unit[1]}"
        return self.successor.get(name) == own or (unit[0] == before[0] and (unit[1] or 0) > (before[1] or 0))

    def start(self):
        return {"last": None, "waiting": []}

    def step(self, state, row):
        unit, last = [row["parent"], row["place"]], state["last"]
        backed = [w for w in state["waiting"] if self.follows(w, unit)][-1:]
        if backed or (last and self.follows(last, unit)):
            state["last"], state["waiting"] = unit, []
            return [tuple(u) for u in (*backed, unit)]
        if not last or unit[0] != last[0]:
            state["waiting"] = [*state["waiting"], unit][-self.depth :]
        return []

    def finish(self, state):
        out = []
        for unit in state["waiting"]:
            if state["last"] and self.follows(state["last"], unit):
                state["last"] = unit
                out.append(tuple(unit))
        if not state["last"] and state["waiting"]:
            out.append(tuple(state["waiting"][0]))
        state["waiting"] = []
        return out


@dataclass
class Merge(Stepper):
    """The offers of two detectors become one line of events. Rows: sliding_key, sliding_cost, stream_key, stream_cost (null keys: no offer).

    What is among the last ``memory`` keys said is not said again. Of two new offers the successor of the last key
    wins, else the cheaper one, the sliding one on equal costs.
    """

    successor: dict
    memory: int = 6
    schema = "event string, key string, source string"

    def step(self, state, row):
        said = state.get("said", [])
        offers = [(row[f"{s}_cost"], s, row[f"{s}_key"]) for s in ("sliding", "stream") if row[f"{s}_key"] is not None and row[f"{s}_key"] not in said]
        if not offers:
            return []
        awaited = self.successor.get(said[-1]) if said else None
        _, source, key = min(offers, key=lambda o: (o[2] != awaited, o[0]))
        state["said"] = [*said, key][-self.memory :]
        return [("detect" if not said else "advance" if key == awaited else "jump", key, source)]


@dataclass
class Highlight(Stepper):
    """Detections settle; look-alikes wait until a neighbour or a choice tells them apart. Rows: action (detect, choose), key.

    ``twins``: key -> its look-alikes in canonical order, itself included; ``before``, ``after``: the neighbours of
    a key. A look-alike settles at once if just one of its group follows the last settled key; else it awaits its
    successor, if all of the group have different ones, or a choice. One output row an input row: what it settled,
    what is still open and why, and the last settled key.
    """

    twins: dict
    before: dict
    after: dict
    schema = "settled array<string>, options array<string>, reason string, active string"

    @staticmethod
    def only(group: list, neighbour: dict, key: str | None) -> str | None:
        found = [k for k in group if key is not None and neighbour.get(k) == key]
        return found[0] if len(found) == 1 else None

    def detect(self, state: dict, key: str) -> list:
        settled = []
        if state["reason"] == "await_successor":
            told = self.only(state["options"], self.after, key)
            settled, state["reason"] = ([told], None) if told else ([], "needs_choice")
        group = self.twins.get(key)
        sure = key if group is None else self.only(group, self.before, settled[-1] if settled else state["active"])
        if sure is not None:
            return [*settled, sure]
        ends = [self.after.get(k) for k in group]
        state["options"], state["reason"] = list(group), "needs_choice" if None in ends or len(set(ends)) < len(ends) else "await_successor"
        state["active"] = settled[-1] if settled else state["active"]
        state["open"] = True
        return settled

    def start(self):
        return {"options": [], "reason": None, "active": None}

    def step(self, state, row):
        key = row["key"]
        if key is None:
            settled = []
        elif row["action"] == "choose":
            settled = [key] if key in state["options"] else []
        else:
            settled = self.detect(state, key)
        if settled and not state.pop("open", False):
            state["options"], state["reason"], state["active"] = [], None, settled[-1]
        state.pop("open", None)
        return [(settled, state["options"], state["reason"], state["active"])]


@dataclass
class Batches(Stepper):
    """Rows in order go to batches of at most ``items`` rows whose padded size, rows times the longest, is at most ``budget``. Rows: n_chars."""

    items: int
    budget: int
    schema = "batch int, size bigint"

    def start(self):
        return {"batch": -1, "items": 0, "longest": 0}

    def step(self, state, row):
        size = row["n_chars"]
        longest = max(state["longest"], size)
        if state["batch"] < 0 or state["items"] >= self.items or (state["items"] + 1) * longest > self.budget:
            state["batch"], state["items"], longest = state["batch"] + 1, 0, size
        state["items"], state["longest"] = state["items"] + 1, longest
        return [(state["batch"], size)]


@dataclass
class SpeechGate(Stepper):
    """Opens at ``threshold``; closes once probabilities have been under threshold - ``slack`` for ``least`` rows without reaching the threshold.

    The lower bound is the decimal difference: 0.2 - 0.15 is 0.05, not the binary number above it. Rows: p."""

    threshold: float = 0.5
    slack: float = 0.15
    least: int = 3
    schema = "event string"

    def start(self):
        return {"open": False, "quiet": 0, "at": 0}

    def step(self, state, row):
        p, state["at"] = row["p"], state["at"] + 1
        if p >= self.threshold:
            opened, state["open"], state["quiet"] = not state["open"], True, 0
            return [("start",)] if opened else []
        if not state["open"] or p >= round(self.threshold - self.slack, 12):
            return []
        if not state["quiet"]:
            state["quiet"] = state["at"]
        elif state["at"] - state["quiet"] >= self.least:
            state["open"], state["quiet"] = False, 0
            return [("end",)]
        return []


def parent_of(unit: str) -> tuple[int, int]:
    """'s:a#k' -> (s, a)."""
    first, second = unit.split("#")[0].split(":")
    return int(first), int(second)


@dataclass
class Voter(Stepper):
    """Fires of many window widths, in order of time, become a chain of units. Rows: w1, key, cost; rows without a key carry ``win``,
    the window's tokens, and ask whether the expected unit has begun.

    A fire is passed over if its window hardly reaches past the last commit, if it is the unit just emitted, or if that unit was
    emitted (first) less than ``repeat`` seconds ago. Twins of the expected unit count as it. A unit needs ``votes_next``
    or ``votes_jump`` fires in a row; after ``streak_least`` expected commits a jump that is not near (the same first number, up
    to ``near`` further) needs one more; at ``strong`` cost one fire is enough, two for such a jump. ``early``: the share of the
    expected unit that must end the window for it to fire before it is over, only while the chain goes on as expected.
    At a cold start, both off by default: one fire at ``opening`` cost is enough for a unit that opens a first number, and
    units inside a parent must be cheaper for ``ramp`` seconds, by a factor that rises from ``ramp_from`` to 1.
    ``refs``: unit -> tokens, ``successor``: unit -> the next one, ``twins``: unit -> its look-alikes.
    """

    refs: dict
    successor: dict
    twins: dict
    votes_next: int = 1
    votes_jump: int = 2
    most_cost: float = 0.30
    strong: float = 0.15
    advance: float = 2.0
    overlap: float = 2.0
    repeat: float = 20.0
    streak_least: int = 3
    near: int = 2
    early: float | None = None
    opening: float = 0.0
    ramp: float = 0.0
    ramp_from: float = 0.5
    schema = "key string, w1 double, cost double"

    def start(self):
        return {"said": {}, "last": None, "expected": None, "rival": None, "votes": 0, "streak": 0, "taken": None}

    def begun(self, state: dict, row: dict) -> tuple | None:
        """(expected unit, cost) if its beginning stands at the window's end."""
        from seqloom.functions.distances import prefix_norm

        unit = state["expected"]
        if self.early is None or unit is None or state["streak"] < 1 or unit not in self.refs:
            return None
        ref = self.refs[unit]
        least = max(6, -int(-self.early * len(ref) // 1))
        cost = prefix_norm(ref, row["win"], least) if len(ref) >= least else float("inf")
        return (unit, cost) if cost <= self.most_cost else None

    def factor(self, state: dict, key: str, w1: float) -> float:
        """What the allowed cost is multiplied by."""
        inside = "#" in key and int(key.split("#")[1]) >= 2
        if not self.ramp or state["last"] is not None or not inside:
            return 1.0
        return min(1.0, self.ramp_from + (1 - self.ramp_from) * w1 / self.ramp)

    def is_near(self, unit: str, last: str | None) -> bool:
        if last is None:
            return True
        (s, a), (t, b) = parent_of(last), parent_of(unit)
        return s == t and 0 <= b - a <= self.near

    def step(self, state, row):
        key, cost, w1 = row["key"], row["cost"], row["w1"]
        if not key:
            found = self.begun(state, row)
            if found is None:
                return []
            key, cost = found
        elif cost > self.most_cost * self.factor(state, key, w1):
            return []
        early = state["taken"] is not None and w1 < state["taken"] + self.advance
        if early or key == state["last"] or (key in state["said"] and w1 - state["said"][key] < self.repeat):
            return []
        expected = state["expected"]
        if expected is not None and key != expected and (self.refs.get(key) == self.refs.get(expected, ()) or expected in self.twins.get(key, ())):
            key = expected
        goes_on = expected is not None and key == expected
        costly = state["streak"] >= self.streak_least and not goes_on and not self.is_near(key, state["last"])
        need = self.votes_next if goes_on else self.votes_jump + costly
        if cost <= self.strong:
            need = min(need, 1 + costly)
        opens = key.split("#")[1:] in ([], ["1"], ["01"]) and parent_of(key)[1] == 1 if self.opening else False
        if opens and state["last"] is None and cost <= self.opening:
            need = 1
        state["votes"] = state["votes"] + 1 if key == state["rival"] else 1
        state["rival"] = key
        if state["votes"] < need:
            return []
        state["streak"] = state["streak"] + 1 if goes_on else 0
        state["said"].setdefault(key, w1)
        state["last"], state["taken"], state["expected"] = key, w1 - self.overlap, self.successor.get(key)
        state["rival"], state["votes"] = None, 0
        return [(key, w1, cost)]


@dataclass
class PrefixDetector(Stepper):
    """A detector of the unit that a growing window begins. Rows: win (tokens so far).

    Units not shorter than ``least_share`` of the window are ranked by the cost of the window against their best prefix, less
    the bonus of the sequential context. The leader commits when it has led for ``hold`` rows (``hold_jump`` if it is no
    continuation) at a cost and progress that are plausible; a step back within a parent never does. ``refs``: unit -> tokens
    in lexicon order, which breaks ties; ``order``: units in canonical order.
    """

    refs: dict
    order: list
    hold: int = 3
    hold_jump: int = 5
    least_progress: float = 0.2
    most_cost: float = 0.75
    least_share: float = 0.6
    done: float = 0.85
    bonus: float = 0.22
    ahead: int = 2
    same: float = 0.10
    by_streak: float = 0.05
    cap: int = 4
    schema = "event string, key string, cost double, progress double, release boolean"

    def start(self):
        return {"leader": None, "run": 0, "held": None, "streak": 0, "released": False}

    def relation(self, held: str | None, unit: str) -> str:
        if held is None:
            return "cold"
        if unit == held:
            return "current"
        at = self.order.index(held)
        if at + 1 < len(self.order) and self.order[at + 1] == unit:
            return "continuation"
        (s, a), (t, b) = parent_of(held), parent_of(unit)
        return "backward" if s == t and b < a else "jump"

    def favour(self, state: dict, unit: str) -> float:
        """The sequential context's bonus: the next units, decaying and grown by the streak, then any of the same parent."""
        held = state["held"]
        if held is None:
            return 0.0
        gap = self.order.index(unit) - self.order.index(held)
        near = (self.bonus + self.by_streak * state["streak"]) * (1 - (gap - 1) / (self.ahead + 1)) if 1 <= gap <= self.ahead else 0.0
        return max(near, self.same if parent_of(unit)[0] == parent_of(held)[0] else 0.0)

    def step(self, state, row):
        from seqloom.functions.distances import prefix_align

        window, scored = row["win"], []
        for unit, ref in self.refs.items():
            if len(ref) >= self.least_share * len(window):
                cost, k = prefix_align(window, ref)
                scored.append((cost - self.favour(state, unit), unit, k / len(ref)))
        if not scored:
            return []
        cost, top, progress = min(scored, key=lambda x: x[0])
        state["run"] = state["run"] + 1 if top == state["leader"] else 1
        state["leader"] = top
        kind = self.relation(state["held"], top)
        need = self.hold_jump if kind == "jump" else self.hold
        plausible = progress >= self.least_progress and cost <= self.most_cost and kind != "backward"
        if plausible and state["run"] >= need and top != state["held"]:
            state["streak"] = min(self.cap, state["streak"] + 1) if kind == "continuation" else 0
            state["held"], state["run"] = top, 0
            state["released"] = progress >= self.done
            event = "detect" if kind == "cold" else "advance" if kind == "continuation" else "jump"
            return [(event, top, round(cost, 3), progress, state["released"])]
        own = next((p for _, u, p in scored if u == state["held"]), 0.0)
        if state["held"] is not None and not state["released"] and own >= 0.95:
            state["released"] = True
            return [("release", state["held"], None, own, True)]
        return []


@dataclass
class GatedReset(Stepper):
    """A silence resets only soon after something was said. Rows: t, event (commit, emission, silence)."""

    within: float = 4.0
    schema = "t double"

    def step(self, state, row):
        if row["event"] != "silence":
            state["said"] = row["t"]
            return []
        return [(row["t"],)] if "said" in state and row["t"] - state["said"] <= self.within else []


@dataclass
class Progress(Stepper):
    """Confirmed units become events of their parents, with what comes next. Rows: parent, place (null: the whole parent).

    A new parent is detected, advanced to (the next second number) or jumped to; a later place of the same one is progress.
    With a parent's last place the next parent of its first number is announced, once. ``places``: parent -> how many it has.
    """

    places: dict
    schema = "event string, parent string, place int, of int, up_next string"

    def step(self, state, row):
        parent, of = row["parent"], max(1, self.places.get(row["parent"], 1))
        place = max(1, row["place"] or 1)
        first, second = parent_of(parent)
        before = state.get("parent")
        if parent != before:
            event = "detect" if before is None else "advance" if (first, second - 1) == parent_of(before) else "jump"
            state["parent"], state["told"] = parent, False
        else:
            event = "progress"
        following = f"{first}:{second + 1}"
        tells = place >= of and not state["told"] and following in self.places
        state["told"] = state["told"] or tells
        return [(event, parent, place, of, following if tells else None)]


@dataclass
class Provisional(Stepper):
    """Before anything is confirmed, a unit that waits is shown once its first number stands behind enough of the last emissions. Rows: key, confirmed, waits."""

    votes: int = 2
    memory: int = 6
    schema = "key string"

    def step(self, state, row):
        first = parent_of(row["key"])[0]
        state["recent"] = [*state.get("recent", []), first][-self.memory :]
        state["sure"] = state.get("sure", False) or row["confirmed"]
        shown = row["waits"] and not state["sure"] and state["recent"].count(first) >= self.votes
        return [(row["key"],)] if shown else []


@dataclass
class LiveWindows(Stepper):
    """At every hop the tokens of the last ``widths`` seconds, from a state that holds the largest width and ``slack`` seconds more. Rows: t, token."""

    widths: tuple
    hop: float
    slack: float = 2.0
    least: int = 4
    schema = "w1 double, width double, win array<string>"

    def start(self):
        return {"held": [], "next": self.hop}

    def step(self, state, row):
        out = []
        while row["t"] >= state["next"]:
            out += self.windows(state, state["next"])
            state["next"] += self.hop
        state["held"].append([row["t"], row["token"]])
        oldest = row["t"] - max(self.widths) - self.slack
        state["held"] = [x for x in state["held"] if x[0] >= oldest]
        return out

    def windows(self, state: dict, now: float) -> list[tuple]:
        found = [(now, w, [x for t, x in state["held"] if now - w <= t < now]) for w in self.widths]
        return [x for x in found if len(x[2]) >= self.least]

    def finish(self, state):
        return self.windows(state, state["next"])
