"""Edit distances of one string against many at once, a column of each edit table in one machine word (Myers; Hyyrö for bands).

A word holds the vertical differences of a column: bit i of ``up`` (``down``) says that the cell of row i + 1 is one above (below) the
one over it. One array operation moves all tables of a block of units by one token.
"""

from __future__ import annotations

import numpy as np

MOST = 64


def letters_of(strings: list[str], size: int) -> np.ndarray:
    """(strings, size) code points, zero beyond a string's end."""
    return np.frombuffer("".join(s.ljust(size, "\0") for s in strings).encode("utf-32-le"), np.uint32).reshape(len(strings), size)


class Units:
    """Units of one length of at most 64 tokens, as bit patterns for every letter."""

    def __init__(self, refs: list[str]):
        self.n, self.size = len(refs), len(refs[0]) if refs else 0
        if self.size > MOST:
            raise ValueError(f"units of over {MOST} tokens")
        self.kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if self.size <= bits)
        held = letters_of(refs, self.size)
        weights = np.array([1 << i for i in range(self.size)], dtype=np.uint64)
        self.equal = {int(c): ((held == c) * weights).sum(1, dtype=np.uint64).astype(self.kind) for c in np.unique(held)}
        self.nowhere = np.zeros(self.n, self.kind)
        self.mask = self.kind((1 << self.size) - 1)
        self.spare = [np.empty(self.n, self.kind) for _ in range(4)]

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.full(self.n, self.mask), np.zeros(self.n, self.kind)

    def step(self, state: tuple[np.ndarray, np.ndarray], token: str, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
        """The next column; row 0 stays at 0 where an alignment may start ``anywhere``, else it grows."""
        up, down = state
        eq = self.equal.get(ord(token), self.nowhere)
        xv, xh, ph, mh = self.spare
        np.bitwise_or(eq, down, out=xv)
        np.bitwise_and(eq, up, out=xh)
        np.add(xh, up, out=xh)
        np.bitwise_xor(xh, up, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, up, out=ph)
        np.invert(ph, out=ph)
        np.bitwise_or(ph, down, out=ph)
        np.bitwise_and(up, xh, out=mh)
        np.add(ph, ph, out=ph)
        if not anywhere:
            np.bitwise_or(ph, self.kind(1), out=ph)
        np.add(mh, mh, out=mh)
        new = np.bitwise_or(xv, ph)
        np.invert(new, out=new)
        np.bitwise_or(mh, new, out=new)
        return new, np.bitwise_and(ph, xv)

    def at(self, state: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        """The cell of row ``rows`` less that of row 0."""
        mask = self.kind((1 << rows) - 1)
        return np.bitwise_count(state[0] & mask).view(np.int8) - np.bitwise_count(state[1] & mask).view(np.int8)


def columns(units: Units, windows: list[str], anywhere: bool, seen=None):
    """(window's place, states after each of its tokens, what ``seen`` made of each): beginnings that sorted windows share are computed once."""
    begun = units.start()
    states, marks, last = [begun], [seen(None, begun) if seen else None], ""
    for k in sorted(range(len(windows)), key=windows.__getitem__):
        window, shared = windows[k], 0
        while shared < min(len(last), len(window)) and last[shared] == window[shared]:
            shared += 1
        del states[shared + 1 :], marks[shared + 1 :]
        for token in window[shared:]:
            states.append(units.step(states[-1], token, anywhere))
            marks.append(seen(marks[-1], states[-1]) if seen else None)
        last = window
        yield k, states, marks


def edit_distances(units: Units, windows: list[str]):
    """(place, distances)."""
    for k, states, _ in columns(units, windows, False):
        yield k, units.at(states[-1], units.size) + np.int16(len(windows[k]))


def infix_distances(units: Units, windows: list[str]):
    """(place, distance of each unit to the nearest stretch of the window)."""
    least = lambda before, state: units.at(state, units.size) if before is None else np.minimum(before, units.at(state, units.size))
    for k, _, marks in columns(units, windows, True, least):
        yield k, marks[-1]


def prefix_align_distances(units: Units, windows: list[str]):
    """(place, distance of the window to the nearest beginning, of one token or more, of each unit)."""
    for k, states, _ in columns(units, windows, False):
        best = units.at(states[-1], 1)
        for i in range(2, units.size + 1):
            np.minimum(best, units.at(states[-1], i), out=best)
        yield k, best + np.int16(len(windows[k]))


def prefix_distances(units: Units, windows: list[str], least: int, slack: int = 2):
    """(place, codes 128 * distance + tokens of the unit's beginning, ``least`` or more, with the least distance over tokens), ends within ``slack`` of the window's."""
    lengths = np.arange(least, units.size + 1)
    ratio = np.arange(128)[:, None] / np.maximum(lengths, 1)
    # codes ordered by ratio: their ranks can be compared
    order = np.argsort(ratio.ravel(), kind="stable")
    rank = np.empty(ratio.size, np.int16)
    rank[order] = np.arange(ratio.size)
    rank = rank.reshape(ratio.shape)
    code = (np.arange(128)[:, None] * 128 + lengths).ravel()[order].astype(np.int16)

    def best_of(place) -> np.ndarray:
        best = None
        for c, i in enumerate(lengths.tolist()):
            found = rank[:, c][place(i)]
            best = found if best is None else np.minimum(best, found, out=best)
        return best

    if units.kind is np.uint8:  # all 65,536 columns at once, then one look-up a unit
        every = np.arange(1 << 16)
        known = best_of(lambda i: np.bitwise_count(every >> 8 & (1 << i) - 1).astype(int) - np.bitwise_count(every & (1 << i) - 1))
        seen = lambda _, state: known[state[0].astype(np.uint16) << 8 | state[1]]
    else:
        seen = lambda _, state: best_of(lambda i: units.at(state, i))
    for k, _, marks in columns(units, windows, True, seen):
        yield k, code[np.minimum.reduce(marks[-1 - slack :])]


class Codes:
    """Codes of any lengths, the shorter ones first, against one shorter code at a time.

    Only cells that an alignment within the cutoff can reach are computed: a band of diagonals, kept in one word that moves
    down a row a column. Where a band is wider than a word the plain tables are used."""

    def __init__(self, codes: list[str]):
        self.codes, self.sizes = codes, np.array([len(c) for c in codes], dtype=np.int64)
        longest = int(self.sizes[-1])
        words, held = longest // MOST + 2, letters_of(codes, longest)
        self.equal = {}
        for c in np.unique(held):
            found = np.zeros((len(codes), words * MOST), dtype=bool)
            found[:, :longest] = held == c
            self.equal[int(c)] = np.ascontiguousarray(np.packbits(found, axis=1, bitorder="little").view(np.uint64).T)
        self.nowhere = np.zeros((words, len(codes)), np.uint64)

    def near(self, text: str, first: int, tau: float) -> tuple[np.ndarray, np.ndarray]:
        """(places from ``first`` on, distances) of the codes, none shorter than ``text``, within floor(tau * their length)."""
        places, found = [], []
        pending = [(first, len(self.codes))]
        while pending:
            lo, hi = pending.pop()
            sizes = self.sizes[lo:hi]
            most, longer = np.floor(tau * sizes).astype(np.int64), sizes - len(text)
            fit = np.flatnonzero(longer <= most)
            if not len(fit):
                continue
            lo, hi, most, longer, sizes = lo + int(fit[0]), lo + int(fit[-1]) + 1, *(x[fit[0] : fit[-1] + 1] for x in (most, longer, sizes))
            spare = np.maximum(most - longer, 0) // 2
            below = int(spare.max())
            if int((longer + spare).max()) + below >= MOST or int(longer.max()) + below + len(text).bit_length() > MOST:
                if sizes[0] < sizes[-1]:
                    middle = lo + int(np.searchsorted(sizes, sizes[len(sizes) // 2], "left") or np.searchsorted(sizes, sizes[0], "right"))
                    pending += [(lo, middle), (middle, hi)]
                    continue
                from seqloom.functions.distances import batched_levenshtein

                dist = np.concatenate([batched_levenshtein([text] * len(some), some) for k in range(lo, hi, 1024) if (some := self.codes[k : min(k + 1024, hi)])])
            else:
                dist = self._band(text, lo, hi, below, longer)
            hits = np.flatnonzero(dist <= most)
            places.append(hits + lo)
            found.append(dist[hits])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _band(self, text: str, lo: int, hi: int, below: int, longer: np.ndarray) -> np.ndarray:
        """Distances (too large where over the cutoff): bit b of column j is row j - below + b; a distance counts the rises along the diagonal that ends in the last cell."""
        n, place = hi - lo, (longer + below).astype(np.uint64)
        last = np.uint64(1) << place
        up = np.full(n, (2**MOST - 1) << below & (2**MOST - 1), np.uint64)
        down, flat, eq, d0, hp, hn = (np.zeros(n, np.uint64) for _ in range(6))
        for j, token in enumerate(text):
            words, at = self.equal.get(ord(token), self.nowhere), j - below
            if at <= 0:
                np.left_shift(words[0, lo:hi], np.uint64(-at), out=eq)
            else:
                word, bit = divmod(at, MOST)
                np.right_shift(words[word, lo:hi], np.uint64(bit), out=eq)
                if bit:
                    np.left_shift(words[word + 1, lo:hi], np.uint64(MOST - bit), out=hp)
                    np.bitwise_or(eq, hp, out=eq)
            np.bitwise_and(eq, up, out=d0)
            np.add(d0, up, out=d0)
            np.bitwise_xor(d0, up, out=d0)
            np.bitwise_or(d0, eq, out=d0)
            np.bitwise_or(d0, down, out=d0)
            np.bitwise_or(d0, up, out=hp)
            np.invert(hp, out=hp)
            np.bitwise_or(hp, down, out=hp)
            np.bitwise_and(d0, up, out=hn)
            np.bitwise_and(d0, last, out=eq)
            np.add(flat, eq, out=flat)
            np.right_shift(d0, np.uint64(1), out=d0)
            np.bitwise_and(d0, hp, out=down)
            np.bitwise_or(d0, hp, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, hn, out=up)
        return self.sizes[lo:hi] - (flat >> place).astype(np.int64)
