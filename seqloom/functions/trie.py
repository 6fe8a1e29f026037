"""A matcher that reads tokens one by one against all units of a lexicon at once.

Units share the nodes of their common beginnings. A node's cost is that of having read its path so far; a step updates all nodes
by array operations: a token is read in place (insertion), moves to a child (match or substitution), and up to ``max_del`` tokens
of the lexicon may be skipped after it. Only the ``beam`` cheapest nodes stay active, earlier nodes first among equals.
"""

from __future__ import annotations

import numpy as np


class Trie:
    """Nodes in order of first insertion: ``above`` their parents, ``token`` what leads to them, ``depth``, and the units' ``ends`` and ``paths``."""

    def __init__(self, units: dict[str, list[str]]):
        self.codes: dict[str, int] = {}
        above, token, depth = [0], [-1], [0]
        children: dict[tuple[int, int], int] = {}
        self.paths: dict[str, list[int]] = {}
        for key, tokens in units.items():
            at, path = 0, []
            for t in tokens:
                code = self.codes.setdefault(t, len(self.codes))
                node = children.get((at, code))
                if node is None:
                    node = children[at, code] = len(above)
                    above.append(at)
                    token.append(code)
                    depth.append(depth[at] + 1)
                at = node
                path.append(node)
            self.paths[key] = path
        self.above, self.token, self.depth = np.array(above), np.array(token), np.array(depth)


class TrieMatcher:
    def __init__(self, trie: Trie, beam: int = 600, max_del: int = 2, restart: bool = True):
        self.trie, self.beam, self.max_del, self.restart = trie, beam, max_del, restart
        self.reset()

    def reset(self) -> None:
        self.cost = np.full(len(self.trie.above), np.inf)
        self.cost[0], self.steps = 0.0, 0

    def step(self, token: str) -> None:
        """Reads one token; a new unit may start at every token with ``restart``."""
        self.steps += 1
        if self.restart:
            self.cost[0] = 0.0
        code, above = self.trie.codes.get(token, -2), self.trie.above
        new = self.cost + 1
        new[1:] = np.minimum(new[1:], self.cost[above[1:]] + (self.trie.token[1:] != code))
        for _ in range(self.max_del):
            new[1:] = np.minimum(new[1:], new[above[1:]] + 1)
        active = np.flatnonzero(np.isfinite(new))
        if len(active) > self.beam:
            new[active[np.argsort(new[active], kind="stable")[self.beam :]]] = np.inf
        self.cost = new

    def candidates(self, k: int = 5) -> list[tuple[str, float]]:
        """(unit, cost over its length) of units whose end is active: by that, then by cost, then in lexicon order."""
        found = [(self.cost[p[-1]] / len(p), self.cost[p[-1]], key) for key, p in self.trie.paths.items() if p and np.isfinite(self.cost[p[-1]])]
        return [(key, norm) for norm, _, key in sorted(found, key=lambda x: x[:2])[:k]]

    def progress(self, key: str) -> tuple[float, float] | None:
        """(least cost over depth along a unit's path, deepest active share of it), or None while nothing of it is active."""
        path = self.trie.paths[key]
        active = [(d, self.cost[node] / d) for d, node in enumerate(path, 1) if np.isfinite(self.cost[node])]
        return (min(c for _, c in active), active[-1][0] / len(path)) if active else None

    def partial_candidates(self, k: int = 5, least: float = 0.0) -> list[tuple[str, float, float]]:
        """(unit, cost, progress) of all units that have begun: by rounded cost, then from high to low progress, then in lexicon order."""
        found = [(key, *p) for key in self.trie.paths if (p := self.progress(key)) and p[1] >= least]
        return sorted(found, key=lambda x: (round(x[1], 6), -x[2]))[:k]

    def margin(self) -> tuple[str | None, float]:
        """The best unit and how far the next one is behind; without one infinitely far."""
        best = self.candidates(2)
        if not best:
            return None, 0.0
        return best[0][0], best[1][1] - best[0][1] if len(best) > 1 else float("inf")

    def complete(self, key: str, most: float = 0.40, share: float = 0.7) -> bool:
        path = self.trie.paths[key]
        return bool(path) and self.cost[path[-1]] / len(path) <= most and self.steps >= share * len(path)
