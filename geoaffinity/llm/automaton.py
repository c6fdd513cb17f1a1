"""Generalised suffix automata over token ids."""

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Recognises every run of consecutive tokens of the sequences added to it.

    State 0 is empty. ``length`` is a state's longest run, ``link`` the state of its longest
    suffix that occurs in more places.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for p's longest run plus token, apart from q's longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = own
            p = self.link[p]
        return own

    def add(self, tokens: Iterable[int]) -> list[int]:
        """Add a sequence; the states of its prefixes at the time (later splits keep these runs in them)."""
        edges, link, length, at, out = self.next, self.link, self.length, 0, []
        for token in tokens:
            q = edges[at].get(token)
            if q is not None:
                at = q if length[q] == length[at] + 1 else self._split(at, token, q)
            else:
                new, p = len(link), at
                edges.append({})
                length.append(length[at] + 1)
                link.append(0)
                while p >= 0:
                    q = edges[p].setdefault(token, new)
                    if q != new:
                        link[new] = q if length[q] == length[p] + 1 else self._split(p, token, q)
                        break
                    p = link[p]
                at = new
            out.append(at)
        return out

    def path(self, tokens: Iterable[int]) -> Iterable[int]:
        """The states of the prefixes of a sequence that was added, after all splits."""
        edges, at = self.next, 0
        for token in tokens:
            at = edges[at][token]
            yield at

    def holder(self, state: int, n: int) -> int:
        """The state of the last n tokens of ``state``'s longest run."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def follow(self, tokens: Sequence[int]) -> Iterable[tuple[int, int]]:
        """Matching statistics: after each token, the state and length of the longest
        suffix of what was read that occurs in the automaton."""
        edges, link, length = self.next, self.link, self.length
        at = size = 0
        for token in tokens:
            to = edges[at].get(token)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = edges[at].get(token)
            if to is not None:
                at, size = to, size + 1
            yield at, size
