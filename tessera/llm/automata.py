"""Probabilistic automata from example strings: states of a prefix tree that are statistically alike are merged."""

from __future__ import annotations

import math

#: Symbols are classes of characters; what stands for itself is what separates the parts of a format.
_CLASSES = {**{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "d" for c in "0123456789"}, **{c: "H" for c in "ABCDEF"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_WIDTH = {"h": 6, "l": 20, "d": 10, "H": 6, "U": 20}
#: Symbols there are: the five classes and + / _ . = -
ALPHABET = 11


def symbols(text: str) -> str:
    return "".join(_CLASSES.get(c, c) for c in text)


class Automaton:
    """A deterministic probabilistic automaton over symbols.

    States are merged red-blue: the frontier's next state joins the first accepted state that it agrees with, by the
    Hoeffding bound, in the share of strings that end and that go on by each symbol, and so for all states below both.
    """

    def __init__(self, strings: list[str], alpha: float = 0.02):
        self.next: list[dict[str, int]] = [{}]
        self.go: list[dict[str, int]] = [{}]
        self.end = [0]
        for text in sorted(strings):
            at = 0
            for c in symbols(text):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.go.append({})
                    self.end.append(0)
                self.go[at][c] = self.go[at].get(c, 0) + 1
                at = self.next[at][c]
            self.end[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _total(self, q: int) -> int:
        return self.end[q] + sum(self.go[q].values())

    def _alike(self, p: int, q: int) -> bool:
        work = [(p, q)]
        while work:
            p, q = work.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            far = self.bound * (n**-0.5 + m**-0.5)
            if abs(self.end[p] / n - self.end[q] / m) > far:
                return False
            for c in set(self.go[p]) | set(self.go[q]):
                if abs(self.go[p].get(c, 0) / n - self.go[q].get(c, 0) / m) > far:
                    return False
                if c in self.next[p] and c in self.next[q]:
                    work.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """The tree under q becomes part of p."""
        work = [(p, q)]
        while work:
            p, q = work.pop()
            self.end[p] += self.end[q]
            for c, n in self.go[q].items():
                self.go[p][c] = self.go[p].get(c, 0) + n
                if c in self.next[p]:
                    work.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = next(((p, c, q) for p in red for c, q in sorted(self.next[p].items()) if q not in known), None)
            if blue is None:
                break
            p, c, q = blue
            for r in red:
                if self._alike(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
        place = {q: k for k, q in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[q].items()} for q in red]
        self.go, self.end = [self.go[q] for q in red], [self.end[q] for q in red]

    def score(self, text: str) -> float:
        """Mean log2 probability of a character, end included; a symbol that no example had there is smoothed."""
        at, total = 0, 0.0
        for c, s in zip(text, symbols(text)):
            n = self._total(at)
            total += math.log2((self.go[at].get(s, 0) + 0.05) / (n + 0.05 * (ALPHABET + 1)) / _WIDTH.get(s, 1))
            at = self.next[at].get(s, at)
        n = self._total(at)
        total += math.log2((self.end[at] + 0.05) / (n + 0.05 * (ALPHABET + 1)))
        return total / (len(text) + 1)
