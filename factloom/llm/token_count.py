"""Token counts with overlap resynchronisation.

A text up to ``chunk`` characters goes to the library whole. A longer one is
encoded in overlapping chunks; neighbours are spliced at a position that both
prove to be a boundary between pre-tokens.

Why that is exact. The pre-tokeniser scans left to right and, without any
look-behind, restarts at each boundary, so what follows a boundary depends on
the text behind it alone. A left chunk whose start is a true boundary gives
true pre-tokens up to every boundary it reports before its cut, as a match
looks at most one character past its end. A right chunk starts anywhere, but
from the first boundary that it shares with the left one it scans the same
text from the same state. Added tokens are found in the raw text first; a cut
could hide one, so a common boundary must leave room for the longest of them
before the left chunk's cut. BPE merges stay within a pre-token. When the
overlap has no such boundary (a run of letters longer than it), the overlap
is doubled until it has or the left chunk reaches the end of the text.

The same proof lets shorter texts be cut at every space with other characters
than white space on both sides: a match never goes on over such a space, and
always may begin there. Each distinct piece is encoded once while it stays in
a bounded memo. A text with white space beside a space is encoded whole.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import LETTERS, Memo, byte_level, head_and_tail

#: Of a piece that cannot be counted apart; outweighs any sum of counts.
WHOLE = -(1 << 60)

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"


def memoryless(spec: dict) -> bool:
    """Whether the proof above covers this tokenizer: byte-level BPE without
    normaliser, prefix space, template, or added tokens that look around."""
    pre = spec["pre_tokenizer"] or {}
    return (
        spec["normalizer"] is None
        and pre.get("type") == "ByteLevel"
        and pre["use_regex"]
        and not pre["add_prefix_space"]
        and (spec["post_processor"] or {"type": "ByteLevel"})["type"] == "ByteLevel"
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )


class Counter:
    def __init__(self, path: str, chunk: int, overlap: int):
        if not 0 < overlap < chunk:
            raise ValueError("overlap must lie between 0 and chunk")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.chunk, self.overlap, self.splices = chunk, overlap, memoryless(spec)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.splices_at_spaces = self.splices and not any(b" " in a for a in self.added)
        self.model = self.tokenizer.model
        self.pieces, self.words = Memo(self._piece, 200_000), Memo(self._word, 400_000)
        self.room = max([1, *(len(t["content"]) for t in spec["added_tokens"])])

    def _tokens(self, text: bytes) -> int:
        return len(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False))

    def _word(self, word: bytes) -> int:
        """Letters behind a space are one pre-token, and the byte map is all
        that happens to it: it goes to the library's model at once."""
        if word[:1] == b" " and LETTERS(word[1:]):
            return len(self.model.tokenize(byte_level(word)))
        return self._tokens(word)

    def _piece(self, piece: bytes) -> int:
        """Tokens of a piece behind a space; WHOLE if that may not stand on
        its own."""
        text = piece.decode("utf-8")
        if not text or text[0].isspace() or text[-1].isspace():
            return WHOLE
        for added in self.added:
            if added in piece:
                return self._tokens(b" " + piece)
        head, tail = head_and_tail(piece)
        return self.words[b" " + head] + (self.words[tail] if tail else 0)

    def short(self, text: str) -> int:
        first, *rest = text.encode().split(b" ")
        if not self.splices_at_spaces or not rest:
            return self.whole([text])[0]
        n = sum(map(self.pieces.__getitem__, rest))
        if n < 0 or not first or self.pieces[first] < 0:
            return self.whole([text])[0]
        return n + self._tokens(first)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def boundaries(self, text: str, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the encoded chunk: where pre-tokens start, as positions in the
        document, and how many tokens come before each."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in e.word_ids])
        starts = np.array([o[0] for o in e.offsets])
        first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)])
        return np.r_[starts[first] + base, base + len(text)], np.r_[first, len(words)]

    def long(self, text: str) -> tuple[int, int]:
        """Tokens of one long text, and the chunks that were encoded."""
        done = start = 0  # start is a true boundary; done tokens lie before it
        n, encoded, overlap = len(text), 1, self.overlap
        end = min(n, self.chunk)
        left = self.boundaries(text[start:end], start)
        while end < n:
            next_start = max(start + 1, end - overlap)
            next_end = min(n, next_start + max(self.chunk, 2 * overlap))
            right = self.boundaries(text[next_start:next_end], next_start)
            encoded += 1
            safe = left[0][(left[0] > start) & (left[0] <= end - self.room)]
            common = np.intersect1d(safe, right[0][:-1])
            if not len(common):
                overlap *= 2
                end = min(n, end + overlap)
                left = self.boundaries(text[start:end], start)
                encoded += 1
                continue
            at = int(common[len(common) // 2])
            done += int(left[1][np.searchsorted(left[0], at)])
            i = int(np.searchsorted(right[0], at))
            left = right[0][i:], right[1][i:] - right[1][i]
            start, end, overlap = at, next_end, self.overlap
        return done + int(left[1][-1]), encoded

    def __call__(self, texts: list[str]) -> tuple[list[int], list[int]]:
        counts, chunks = [0] * len(texts), [1] * len(texts)
        for i, text in enumerate(texts):
            if self.splices and len(text) > self.chunk:
                counts[i], chunks[i] = self.long(text)
            else:
                counts[i] = self.short(text)
        return counts, chunks


#: One per Python worker, so that its memo outlives a task.
@cache
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 32_768, overlap: int = 1024, rows: int = 256) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text) as the library
    counts them: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``),
    n_chunks (encodings made).

    Narrow: no exchange, one row out per row in, repeated rows too. Null or
    empty text has 0 bytes and 0 tokens; a null doc_id stays null; other
    columns are ignored. ``rows`` texts at most are encoded at a time.
    """

    def run(batches):
        count = counter(tokenizer, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts, chunks = count(texts)
                sizes = [len(t.encode()) for t in texts]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts]), pa.array(chunks, pa.int32())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
