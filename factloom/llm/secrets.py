"""Secret scans: exact patterns, and formats inferred from labelled ones.

The base patterns find assignments, access keys and hex keys. What they find
labels a bounded sample of credentials, from which a probabilistic automaton
per kind is inferred, as is one of tokens that no pattern claims. Every such
token of the least labelled length and more, whatever its characters, and every
remainder beside a claimed part is scored by each credential automaton against
that background; a clear format likelihood adds a span of kind ``grammar``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import Automaton, infer
from .common import Memo

#: The base patterns, the least length, the group it holds for.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

WORDS = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
SEPARATORS = "+/_.=-"
GRAMMAR = "grammar"
#: log2 likelihood per character with all of RUN's characters alike.
UNIFORM = -6.0
#: Fewer unclaimed tokens make no background.
LEAST_BACKGROUND = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of the base matches, in order. A
    key or hex match of the least length lies in a run that RUN finds, so
    the short runs of plain words are passed over."""
    return _scan(text)[0]


def _scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, int]], list[tuple[int, int]]]:
    """The base spans, the labelled values and their kinds (a value that is
    of two kinds is labelled twice), and the start and end of every token that
    no base span claims."""
    spans, values = [], set()
    lowered = text.lower()
    if any(w in lowered for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                spans.append((m.start(), 0, m.end()))
                values.add((m.start(2), m.end(2), 0))
    runs = [m.span() for m in RUN.finditer(text)]
    for start, end in runs:
        if end - start < LEAST["access"]:
            continue
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(text, start, end):
                if m.end() - m.start() >= LEAST[KINDS[kind]]:
                    spans.append((m.start(), kind, m.end()))
                    values.add((m.start(), m.end(), kind))
    spans.sort()
    return spans, [(text[s:e], k) for s, e, k in sorted(values)], _unclaimed(text, runs, spans) if spans else runs


def _unclaimed(text: str, runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans leave of the runs, without the separators that
    join a remainder to a span, if it is long enough."""
    claimed: list[list[int]] = []
    for s, _, e in spans:
        if claimed and s <= claimed[-1][1]:
            claimed[-1][1] = max(e, claimed[-1][1])
        else:
            claimed.append([s, e])
    rest, i = [], 0
    for start, end in runs:
        while i < len(claimed) and claimed[i][1] <= start:
            i += 1
        at, j = start, i
        while at < end:
            until, then = claimed[j] if j < len(claimed) and claimed[j][0] < end else (end, end)
            s, e = at, max(at, until)
            while at > start and s < e and text[s] in SEPARATORS:
                s += 1
            while until < end and s < e and text[e - 1] in SEPARATORS:
                e -= 1
            if e - s >= LEAST["assign"]:
                rest.append((s, e))
            at, j = then, j + 1
    return rest


@dataclass(frozen=True)
class Formats:
    """Inferred automata by kind, and that of unclaimed tokens."""

    by_kind: list[Automaton | None]
    background: Automaton | None
    margin: float = 0.5
    bits: float = 24.0

    def gain(self, value: str) -> float:
        """How many bits per character, the end counted as one, the likeliest
        format is ahead of the background and of even odds."""
        least = self.background.score(value) if self.background else UNIFORM
        return max((a.score(value) for a in self.by_kind if a), default=-99.0) - max(least, UNIFORM)

    def secret(self, value: str) -> bool:
        """Whether that is ``margin`` per character and ``bits`` in all, odds
        that a corpus of many tokens doesn't beat by chance."""
        gain = self.gain(value)
        return gain >= self.margin and gain * (len(value) + 1) >= self.bits


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """label (-1: unclaimed), h, value: of each task's distinct tokens those
    with the smallest hash, ``sample`` per label; the smallest of all are
    among them."""

    def run(batches):
        pools: dict[int, dict[str, int]] = {k: {} for k in (-1, 0, 1, 2)}
        limits = dict.fromkeys(pools, 1 << 64)

        def cut(label):
            kept = sorted(pools[label].items(), key=lambda x: (x[1], x[0]))[:sample]
            pools[label] = dict(kept)
            limits[label] = kept[-1][1] if len(kept) == sample else 1 << 64

        for batch in batches:
            for text in batch.column("text").to_pylist():
                _, values, rest = _scan(text or "")
                for label, tokens in ((-1, {text[s:e] for s, e in rest}), *((k, {v for v, kind in values if kind == k}) for k in (0, 1, 2))):
                    for v in tokens:
                        h = xxhash.xxh64_intdigest(v.encode(), 42)
                        if h <= limits[label]:
                            pools[label][v] = h
                    if len(pools[label]) > 4 * sample:
                        cut(label)
        for label in pools:
            cut(label)
            if pools[label]:
                values = list(pools[label])
                yield pa.record_batch([pa.array([label] * len(values), pa.int32()), pa.array([h - (1 << 63) for h in pools[label].values()], pa.int64()), pa.array(values, pa.string())], names=["label", "h", "value"])

    return _texts(docs).select("text").mapInArrow(run, "label int, h long, value string")


def learn(docs: DataFrame, sample: int = 300, alpha: float = 0.05) -> Formats:
    """Automata from at most ``sample`` distinct tokens per label, of any
    length: those with the smallest hash, whatever the size of the corpus."""
    order = Window.partitionBy("label").orderBy("h", "value")
    tokens = sampled(docs, sample).distinct()
    rows = tokens.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("label", "value").collect()
    values = {k: [r.value for r in rows if r.label == k] for k in (-1, 0, 1, 2)}
    return Formats([infer(values[k], alpha) for k in (0, 1, 2)], infer(values[-1], alpha) if len(values[-1]) >= LEAST_BACKGROUND else None)


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_assign, n_access, n_hex,
    base_sha256, spans, n_grammar.

    A span is ``kind:start:end`` of the whole match, in code points, end
    exclusive. Null text counts as empty: no span, the hash of nothing.
    Repeated rows get a row each, a null doc_id stays null, other columns are
    ignored. Without a labelled credential in the corpus only base spans are
    found. The documents are read twice, to learn and to score.
    """
    formats = formats or learn(docs)

    def run(batches):
        known = Memo(formats.secret)
        for batch in batches:
            counts, hashes, spans = [], [], []
            for text in batch.column("text").to_pylist():
                own, _, rest = _scan(text or "")
                more = [(s, 3, e) for s, e in rest if (known[text[s:e]] if e - s <= 64 else formats.secret(text[s:e]))]
                listed = lambda x: ",".join(f"{(*KINDS, GRAMMAR)[k]}:{s}:{e}" for s, k, e in sorted(x))
                counts.append([sum(k == i for _, k, _ in own + more) for i in range(4)])
                hashes.append(hashlib.sha256(listed(own).encode()).hexdigest())
                spans.append(listed(own + more))
            n = list(zip(*counts)) or [()] * 4
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(n[3], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")
