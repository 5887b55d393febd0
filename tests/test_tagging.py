"""The automaton against a regular expression for each phrase."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators.tagging import Lexicon, words_of
from factloom.sources.rules import Phrase


def lexicon(texts):
    return Lexicon([Phrase(i, "category", "C", "R", t) for i, t in enumerate(texts)])


def plain(texts, text):
    """(place in the list, start, match) of each phrase's first match."""
    found = []
    for i, t in enumerate(texts):
        body = r"\s+".join(re.escape(part) for part in t.strip().split(" "))
        if m := re.search(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", text, re.IGNORECASE):
            found.append((i, m.start(), m[0]))
    return found


def tagged(texts, text):
    return [(m.seq, m.start, m.term) for m in lexicon(texts).matches(text)]


@pytest.mark.parametrize(
    "phrases, text",
    [
        (["deep infection", "infection", "deep", "infection rate"], "Deep  infections, deep\tinfection; INFECTION rate"),
        (["a b a c", "b a", "a c", "b a b"], "a b a b a c a b a c"),
        (["knee-pain", "knee pain", "pain (severe)", "pain"], "knee -pain knee- pain Knee-Pain pain (severe)"),
        (["(any) event", "5%", "%", "+ sign"], "of (any)  event: 5% and 15%, x+ sign % 5"),
        (["skin", "is", "kin"], "ſKIN İſ kın skinx xskin 1skin"),
        (["naïve case", "µg"], "NAÏVE CASE 5 μg µg"),
        (["one two three", "two three four", "three"], "one two two three one two three four"),
        (["same", "same", "Same"], "the SAME"),
    ],
)
def test_matches_equal_patterns(phrases, text):
    assert tagged(phrases, text) == plain(phrases, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c-d", "(e", "5%"]), min_size=1, max_size=4).map(" ".join), min_size=1, max_size=12), st.lists(st.sampled_from(["a", "B", "ab", "c", "-", "d", "c-d", "(E", "5%", "  ", " ", " ", " ", ".", "x"]), max_size=40).map("".join))
def test_any_phrases_in_any_text(phrases, text):
    assert tagged(phrases, text) == plain(phrases, text)
    assert lexicon(phrases).occur(text, words_of(text)) == bool(plain(phrases, text))


def test_every_word_is_looked_at_once_whatever_the_lexicon(monkeypatch):
    """Steps of the automaton: no more for 186 phrases than for 20."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    phrases = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3]))) for _ in range(186)]
    text = " ".join(rnd.choices(words, k=5_000))
    steps, step = [], Lexicon._step
    for some in (phrases[:20], phrases):
        made, count = lexicon(some), [0]

        def counted(self, state, word, count=count):
            count[0] += 1
            return step(self, state, word)

        with monkeypatch.context() as m:
            m.setattr(Lexicon, "_step", counted)
            assert [x.seq for x in made.matches(text)] == [i for i, *_ in plain(some, text)]
        steps.append(count[0])
    assert steps[1] <= 5_000


def test_texts_without_words_or_phrases():
    assert tagged(["a"], "") == [] and tagged([], "a b") == [] and tagged(["--"], "a -- b") == [(0, 2, "--")]
