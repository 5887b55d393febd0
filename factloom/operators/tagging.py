"""Phrase tagging: which events a text names, and where.

One pass over batches of texts, without a shuffle. All phrases of a lexicon are
one automaton over words: states are the beginnings of phrases, and a failure
link leads from each to the longest other beginning that its end is, so every
word of a text is looked at once, whatever the number of phrases. Where the
words of a phrase first stand in a row, its own pattern finds its first match,
if what lies between them fits, too. Each phrase counts with its first match;
overlaps are resolved by a fold over the matches in order.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.sources.rules import Phrase, Rules

HIT = "struct<start:int,category:string,term:string,rule_id:string>"
HITS = f"array<{HIT}>"
MATCHES = "array<struct<start:int,length:int,seq:int,kind:string,category:string,rule_id:string,term:string>>"
HIT_TYPE = pa.struct([("start", pa.int32()), ("category", pa.string()), ("term", pa.string()), ("rule_id", pa.string())])
MATCH_TYPE = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("seq", pa.int32()), ("kind", pa.string()), ("category", pa.string()), ("rule_id", pa.string()), ("term", pa.string())])

WORD = re.compile("[a-z0-9]+")
#: Letters that match i and s where case is ignored, and are no ASCII letter
#: in lower case.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s"}


class Match(NamedTuple):
    start: int
    length: int
    seq: int
    kind: str
    category: str
    rule_id: str
    term: str


def words_of(text: str) -> list[str]:
    """The runs of ASCII letters and digits, in lower case; what matches such
    a letter without regard to case is one."""
    return WORD.findall(text.translate(ALIKE).lower() if not text.isascii() else text.lower())


def _pattern(phrase: str) -> re.Pattern:
    """The phrase between non-alphanumerics; blanks match any white space."""
    return re.compile(rf"(?<![A-Za-z0-9]){r'\s+'.join(map(re.escape, phrase.strip().split(' ')))}(?![A-Za-z0-9])", re.IGNORECASE)


class Lexicon:
    """Phrases, and the automaton over their words."""

    def __init__(self, phrases: Iterable[Phrase]):
        self.phrases = list(phrases)
        self.patterns = [_pattern(p.text) for p in self.phrases]
        spelt = [words_of(p.text) for p in self.phrases]
        self.wordless = [i for i, words in enumerate(spelt) if not words]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, words in enumerate(spelt):
            state = 0
            for word in words:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][word]
            if words:
                self.ends[state].append(i)
        self.vocabulary = {word for words in spelt for word in words}
        self.fail = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for word, to in self.next[state].items():
                self.fail[to] = self._step(self.fail[state], word)
                waiting.append(to)
            self.ends[state] += self.ends[self.fail[state]]

    def _step(self, state: int, word: str) -> int:
        while state and word not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(word, 0)

    def found(self, text: str, words: list[str]) -> Iterator[tuple[int, re.Match]]:
        """Each phrase that occurs, by its place in the list, with its first
        match; ``words`` are those of the text."""
        for i in self.wordless:
            if m := self.patterns[i].search(text):
                yield i, m
        state, last, known = 0, -2, set()
        for at in [i for i, word in enumerate(words) if word in self.vocabulary]:
            state, last = self._step(state if at == last + 1 else 0, words[at]), at
            for i in self.ends[state]:
                if i not in known:
                    known.add(i)
                    if m := self.patterns[i].search(text):
                        yield i, m

    def occur(self, text: str, words: list[str]) -> bool:
        """Whether any phrase does."""
        return next(self.found(text, words), None) is not None

    def matches(self, text: str, words: list[str] | None = None) -> list[Match]:
        """All phrases that occur, each at its first match, by ``seq``."""
        found = []
        for i, m in self.found(text, words_of(text) if words is None else words):
            p = self.phrases[i]
            found.append(Match(m.start(), m.end() - m.start(), p.seq, p.kind, p.category, p.rule_id, m[0]))
        return sorted(found, key=lambda m: m.seq)

    def hits(self, text: str, extended: bool, words: list[str] | None = None) -> list[Match]:
        """What ``hits`` says of one text."""
        found = self.matches(text, words)
        of = lambda kind: [m for m in found if m.kind == kind]
        first = sorted(of("category") or of("generic")[:1], key=lambda m: (m.start, -m.length))
        kept: list[Match] = []
        for m in first + (of("unmappable") + of("unclear") if extended else []):
            if all(m.start + m.length <= k.start or k.start + k.length <= m.start for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m.start, -m.length, m.seq))


#: One per Python worker and set of phrases.
@cache
def lexicon(phrases: tuple[Phrase, ...]) -> Lexicon:
    return Lexicon(phrases)


def _lists(lists: list[list], kind: pa.StructType) -> pa.ListArray:
    """Lists of named tuples as an Arrow array of lists of structs."""
    offsets = [0]
    for x in lists:
        offsets.append(offsets[-1] + len(x))
    fields = [pa.array([getattr(m, f.name) for x in lists for m in x], f.type) for f in kind]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def _plain(text: pa.Array) -> list[str]:
    return [t or "" for t in text.to_pylist()]


def matches(text: Column, rules: Rules) -> Column:
    """All phrases that occur, as MATCHES, one per phrase, at its first match.
    Null or empty text has none."""
    phrases = rules.phrases

    def found(text: pa.Array) -> pa.Array:
        of = lexicon(phrases).matches
        return _lists([of(t) for t in _plain(text)], MATCH_TYPE)

    return F.arrow_udf(found, MATCHES)(text)


def hits(text: Column, rules: Rules, extended: bool = True) -> Column:
    """The events a text names, in order of place: HITS.

    Category phrases, earliest and then longest first, keep what is disjoint;
    without any, the first generic cue of the list stands for them. If
    ``extended``, unmappable phrases and then unclear ones, in list order,
    are added where they overlap nothing. Null or empty text has none.
    """
    if not rules.phrases:
        return F.array().cast(HITS)
    phrases = rules.phrases

    def found(text: pa.Array) -> pa.Array:
        of = lexicon(phrases).hits
        return _lists([of(t, extended) for t in _plain(text)], HIT_TYPE)

    return F.arrow_udf(found, HITS)(text)


def reported_hits(text: Column, rules: Rules, extended: bool, number: str | None) -> Column:
    """``hits`` of a sentence that may report events: one with a word of
    occurrence, or with what matches ``number``, and without a word of other
    things. Any other has none."""
    phrases, plain = rules.phrases, lambda texts: tuple(Phrase(i, "", "", "", t) for i, t in enumerate(texts))
    occurrence, others = plain(rules.occurrence), plain(rules.non_event)

    def found(text: pa.Array) -> pa.Array:
        of, some, none = lexicon(phrases).hits, lexicon(occurrence).occur, lexicon(others).occur
        counted = re.compile(number, re.IGNORECASE).search if number else lambda _: False
        lists = []
        for t in _plain(text):
            words = words_of(t)
            lists.append(of(t, extended, words) if (some(t, words) or counted(t)) and not none(t, words) else [])
        return _lists(lists, HIT_TYPE)

    return F.arrow_udf(found, HITS)(text)


def hits_of_each(texts: Column, rules: Rules, extended: bool = True) -> Column:
    """``hits`` of every element of an array of texts."""
    if not rules.phrases:
        return F.transform(texts, lambda _: F.array().cast(HITS))
    phrases = rules.phrases

    def found(texts: pa.Array) -> pa.Array:
        of, lists = lexicon(phrases).hits, texts.to_pylist()
        offsets = [0]
        for x in lists:
            offsets.append(offsets[-1] + len(x or ()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _lists([of(t or "", extended) for x in lists for t in x or ()], HIT_TYPE))

    # Else the optimiser moves it into the conditions on its result, where
    # functions of arrays keep it from being taken out again.
    return F.arrow_udf(found, f"array<{HITS}>").asNondeterministic()(texts)
