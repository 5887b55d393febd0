"""Grammar inference: probabilistic automata by state merging.

A prefix tree counts how often labelled strings pass and end at each state.
States whose outgoing frequencies are statistically compatible (Hoeffding's
bound, recursively) are merged, breadth first, against the states already
accepted; what remains is a deterministic automaton whose transition and
ending frequencies give the likelihood of any string.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Symbols of the automata: classes for letters and digits, others as such.
SYMBOLS = {c: k for k, members in (("0", "0123456789"), ("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("G", "GHIJKLMNOPQRSTUVWXYZ")) for c in members}
#: log2 of how many characters share a symbol: a class spreads its mass.
SPREAD = {"0": math.log2(10), "a": math.log2(6), "g": math.log2(20), "A": math.log2(6), "G": math.log2(20)}


def symbols(text: str) -> str:
    return "".join(SYMBOLS.get(c, c) for c in text)


@dataclass(frozen=True)
class Automaton:
    """Per state: symbol -> (next state, log2 probability), and the log2
    probability of ending there."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    floor: float = -12.0

    def score(self, text: str) -> float:
        """Mean log2 likelihood per character, ending included. A step that
        was never seen costs ``floor`` bits and restarts the automaton."""
        state, total = 0, 0.0
        for c in symbols(text):
            state, p = self.steps[state].get(c, (0, self.floor))
            total += p - SPREAD.get(c, 0.0)
        return (total + self.ends[state]) / (len(text) + 1)


class _Tree:
    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        self.total: list[int] = [0]

    def add(self, word: str, ends: bool = True) -> None:
        at = 0
        for c in word:
            self.total[at] += 1
            self.through[at][c] = self.through[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.through.append({})
                self.end.append(0)
                self.total.append(0)
            at = self.next[at][c]
        self.total[at] += ends
        self.end[at] += ends

    def follow(self, word: str, start: int) -> None:
        """Count what follows ``start`` characters of a word whose beginning
        was added; a step that is new leads to the root, as scoring does."""
        at = 0
        for c in word[:start]:
            at = self.next[at][c]
        for c in word[start:]:
            self.total[at] += 1
            self.through[at][c] = self.through[at].get(c, 0) + 1
            at = self.next[at].setdefault(c, 0)
        self.total[at] += 1
        self.end[at] += 1

    def compatible(self, a: int, b: int, bound: float) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            na, nb = self.total[a], self.total[b]
            if not na or not nb:
                continue
            allowed = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.end[a] / na - self.end[b] / nb) > allowed:
                return False
            for c in self.through[a].keys() | self.through[b].keys():
                if abs(self.through[a].get(c, 0) / na - self.through[b].get(c, 0) / nb) > allowed:
                    return False
            pairs += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the counts of b, a tree, into a and its successors."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.end[a] += self.end[b]
            self.total[a] += self.total[b]
            for c, n in self.through[b].items():
                self.through[a][c] = self.through[a].get(c, 0) + n
                if c in self.next[a]:
                    pairs.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]


def infer(words: list[str], alpha: float = 0.05, depth: int = 200) -> Automaton | None:
    """The automaton of the sorted sample ``words``; None without any. States
    come from the first ``depth`` characters of each word, which bounds the
    tree; frequencies from all of them."""
    if not words:
        return None
    tree, bound = _Tree(), math.sqrt(0.5 * math.log(2 / alpha))
    for w in sorted(words):
        tree.add(symbols(w[:depth]), len(w) <= depth)
    red, blue = [0], [(0, c) for c in sorted(tree.next[0])]
    while blue:
        parent, c = blue.pop(0)
        state = tree.next[parent][c]
        if state in red:
            continue
        for r in red:
            if tree.compatible(r, state, bound):
                tree.next[parent][c] = r
                tree.fold(r, state)
                # What hangs on r for the first time has to be judged, too.
                blue += [(q, d) for q in red for d in sorted(tree.next[q]) if tree.next[q][d] not in red and (q, d) not in blue]
                break
        else:
            red.append(state)
            blue += [(state, d) for d in sorted(tree.next[state])]
    for w in words:
        if len(w) > depth:
            tree.follow(symbols(w), depth)
    place = {s: i for i, s in enumerate(red)}
    steps, ends = [], []
    for s in red:
        n = tree.total[s] + 1
        steps.append({c: (place[tree.next[s][c]], math.log2(m / n)) for c, m in tree.through[s].items()})
        ends.append(math.log2((tree.end[s] + 0.5) / n))
    return Automaton(steps, ends)
