"""Generalised suffix automata over integer sequences."""

from __future__ import annotations


class SuffixAutomaton:
    """Recognises every run of tokens of the sequences added; a state stands for runs that end at the same places."""

    __slots__ = ("next", "link", "length")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, p: int, q: int, token) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extend(self, last: int, token) -> int:
        """The state of the sequence that ``last`` stands for, one token longer. A new sequence begins at state 0."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(token)) is not None:
            return q if length[q] == length[last] + 1 else self._copy(last, q, token)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p != -1:
            q = nxt[p][token]
            link[new] = q if length[q] == length[p] + 1 else self._copy(p, q, token)
        return new

    def add(self, tokens) -> None:
        last = 0
        for t in tokens:
            last = self.extend(last, t)

    def step(self, state: int, matched: int, token) -> tuple[int, int]:
        """Matching statistics: the longest suffix read so far that occurs in the sequences, as (state, its length)."""
        nxt, link, length = self.next, self.link, self.length
        while True:
            q = nxt[state].get(token)
            if q is not None:
                return q, matched + 1
            state = link[state]
            if state == -1:
                return 0, 0
            matched = length[state]
