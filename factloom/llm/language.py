"""Language identification by error-correcting output codes.

Each language has a codeword; a binary n-gram classifier per bit tells the
languages with a 1 from those with a 0. Its weights are log ratios of n-gram
rates between the two sides, its output is scaled so that the sides' profiles
lie at +1 and -1. Decoding adds up a loss per bit, weighted by how far apart
the sides are, and picks the codeword with the least; when the runner-up is
nearly as near, the result is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 14
#: Letters and bytes beyond ASCII stay; all else is a word boundary.
FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text or ""))


def ngrams(text: str | None) -> np.ndarray:
    """Counts of the 2- and 3-byte grams of the folded text by hashed slot."""
    b = np.frombuffer(b" " + (text or "").lower().encode().translate(FOLD) + b" ", np.uint8)
    b = b[(b != 0x20) | np.r_[True, b[:-1] != 0x20]].astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = (two[:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(19)
    two = two * np.uint32(2246822519) >> np.uint32(19)
    return np.bincount(two, minlength=DIMENSIONS // 2), np.bincount(three, minlength=DIMENSIONS // 2)


def profile(text: str | None, cap: int = 1000) -> np.ndarray:
    """The counts, scaled down to ``cap`` n-grams, so that no document
    outweighs others, in units of 2^-16: integers, so that sums don't hang on
    order, and none is lost in texts of less than 10^8 n-grams."""
    counts = np.concatenate(ngrams(text))
    return np.rint(counts * (65_536 * min(1.0, cap / max(counts.sum(), 1)))).astype(np.int64)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of distinct -1/+1 codewords: all splits of up to five languages
    (the exhaustive code), else the best spread of 64 random codes of
    10*log2(n) bits and more."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1] * len(bits), *(np.where(bits >> i & 1, -1, 1) for i in range(n - 1))])
    random, best = np.random.default_rng(seed), None
    width = max(15, int(np.ceil(10 * np.log2(n))))
    for _ in range(64):
        code = random.choice([-1, 1], (n, width))
        code[0, np.abs(code.sum(0)) == n] *= -1
        distance = (width - code @ code.T) / 2 + np.eye(n) * width
        if best is None or distance.min() > best[0]:
            best = distance.min(), code
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMENSIONS x bits
    middle: np.ndarray
    half: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        rates = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        return (rates.astype(np.float32) @ self.weights - self.middle) / self.half

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of counts: the language's place, its score, ambiguous."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.zeros(len(counts), bool)
        agree = np.clip(self.margins(counts), -3, 3)[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -2 * agree) * (self.half / self.half.sum())).sum(2)
        # A profile halfway between two codewords has equal losses for both.
        likely = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        likely /= likely.sum(1, keepdims=True)
        order = np.sort(likely, 1)
        return loss.argmin(1), order[:, -1], order[:, -1] - order[:, -2] < 0.5


def train(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> Model:
    """Learn from every document (doc_id, text, lang) that is not held out
    and has a language and a letter. Executors send one row of sums per
    language and n-gram slot, added up before the shuffle."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + profile(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "slot", "n"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang").where("lang is not null and text is not null").where(~held_out(modulus, remainder)).select("text", "lang")
    totals = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for r in totals.toLocalIterator():
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.slot] = r.n
    return fit(found)


def fit(found: dict[str, np.ndarray]) -> Model | None:
    languages = sorted(found)
    if not languages:
        return None
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((DIMENSIONS, 1), np.float32), np.zeros(1), np.ones(1))
    rates = np.array([found[x] / 65_536 + 0.5 for x in languages])
    rates /= rates.sum(1, keepdims=True)
    sides = [np.array([rates[code[:, b] == s].mean(0) for b in range(code.shape[1])]) for s in (1, -1)]
    weights = (np.log(sides[0]) - np.log(sides[1])).T
    outputs = rates @ weights  # languages x bits
    high = np.array([outputs[code[:, b] == 1, b].mean() for b in range(code.shape[1])])
    low = np.array([outputs[code[:, b] == -1, b].mean() for b in range(code.shape[1])])
    return Model(languages, code, weights.astype(np.float32), (high + low) / 2, np.maximum((high - low) / 2, 1e-6))


def held_out(modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None, modulus: int = 4, remainder: int = 2, rows: int = 64) -> DataFrame:
    """Per document of ``docs`` (doc_id, text, lang): held_out, lang_pred,
    score (0 to 1), ambiguous.

    Without a model, one is trained on the rows that are not held out. Null
    text, or one without a letter, is ``und`` with score 0, as is all with
    nothing to learn from. Repeated rows get a row each; a null doc_id is not
    held out. Other columns are ignored, and neither lang, source nor id
    enters a prediction.
    """
    model = model or train(docs, modulus, remainder)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column("text").to_pylist()
                known = [bool(model) and has_letter(t) for t in texts]
                langs, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), [False] * len(texts)
                use = [i for i, k in enumerate(known) if k]
                if use:
                    best, score, close = model.decode(np.array([np.concatenate(ngrams(texts[i])) for i in use]))
                    for i, b, s, c in zip(use, best.tolist(), score.tolist(), close.tolist()):
                        langs[i], scores[i], unsure[i] = model.languages[b], s, c
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(scores), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").select("doc_id", held_out(modulus, remainder).alias("held_out"), "text")
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
