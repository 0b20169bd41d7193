"""Automata over sets of terms: all terms in a text by one pass over it, whatever their number."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: States times this, plus a sign's code point, is the key of an arc.
SIGNS = 1 << 21


class Automaton:
    """A tree of terms with failure links. Each state is a prefix of some term; its failure link leads to the longest
    proper suffix of it that is a prefix too. Of each state the longest term that it ends with is kept, and the next
    shorter one is found by following links between such states.

    It is built once and travels as arrays; arcs become a dictionary where it is used."""

    def __init__(self, terms: Iterable[str]):
        arcs: dict[int, int] = {}
        depth, ends, signs, parents = [0], [0], [0], [0]
        for term in terms:
            state = 0
            for sign in term:
                key = state * SIGNS + ord(sign)
                following = arcs.get(key)
                if following is None:
                    following = arcs[key] = len(depth)
                    depth.append(depth[state] + 1)
                    ends.append(0)
                    signs.append(ord(sign))
                    parents.append(state)
                state = following
            if state:
                ends[state] = depth[state]
        fail, longest, shorter = [0] * len(depth), ends, [0] * len(depth)
        # shorter prefixes first, so that the links a state needs are there
        for state in np.argsort(np.array(depth), kind="stable").tolist()[1:]:
            link = 0
            if depth[state] > 1:
                link = fail[parents[state]]
                while (following := arcs.get(link * SIGNS + signs[state])) is None and link:
                    link = fail[link]
                link = following or 0
            fail[state] = link
            # where the next shorter term ends: the link itself if a term ends there, or what the link says
            shorter[state] = link if longest[link] else shorter[link]
        self.keys = np.fromiter(arcs, np.int64, len(arcs))
        self.targets = np.fromiter(arcs.values(), np.int32, len(arcs))
        self.fail, self.ends, self.shorter = np.array(fail, np.int32), np.array(longest, np.int32), np.array(shorter, np.int32)
        self._ready = None

    def __getstate__(self):
        return self.keys, self.targets, self.fail, self.ends, self.shorter

    def __setstate__(self, state):
        self.keys, self.targets, self.fail, self.ends, self.shorter = state
        self._ready = None

    def _tables(self):
        if self._ready is None:
            # where a state ends no term itself, the state of its longest term
            first = np.where(self.ends > 0, np.arange(len(self.ends)), self.shorter)
            self._ready = dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True)), self.fail.tolist(), self.ends.tolist(), self.shorter.tolist(), first.tolist()
        return self._ready

    def _states(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, state) of places where a term ends; the state is that of the longest one."""
        arcs, fail, _, _, first = self._tables()
        get, state, end = arcs.get, 0, 0
        for sign in map(ord, text):
            end += 1
            following = get(state * SIGNS + sign)
            while following is None and state:
                state = fail[state]
                following = get(state * SIGNS + sign)
            state = following or 0
            if first[state]:
                yield end, first[state]

    def every(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every occurrence of every term, by end and then from long to short."""
        _, _, ends, shorter, _ = self._tables()
        for end, state in self._states(text):
            while state:
                yield end - ends[state], end
                state = shorter[state]

    def uncovered(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the occurrences that no longer occurrence covers, in order. Of those that end together the
        longest stays, and it drops those before it that begin where it begins or later."""
        ends, kept = self._tables()[2], []
        for end, state in self._states(text):
            start = end - ends[state]
            while kept and kept[-1][0] >= start:
                kept.pop()
            kept.append((start, end))
        return kept
