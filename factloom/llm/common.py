"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from factloom.operators.components import connected_components, frequent, lookup
from factloom.operators.written import appended, scratch
from factloom.operators.written import folder as shared_dir
from factloom.operators.written import write_to
from factloom.operators.written import written as materialize

__all__ = ["appended", "connected_components", "frequent", "lookup", "materialize", "scratch", "shared_dir", "write_to"]


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as a number of output shards."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, which bounds what a task
    holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes; null becomes empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [v or b"" for v in binary.to_pylist()]


class Memo(dict):
    """A dict that fills itself by ``make``. At ``limit`` entries it becomes
    the old generation, from which what is asked for again moves back, so that
    memory stays bounded and frequent keys stay known on any vocabulary."""

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: ASCII punctuation but the apostrophe, which may begin a contraction.
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)


#: Words of ASCII and Latin-1 letters alone, in UTF-8: one run of letters to
#: every pre-tokeniser used here, composed, and in lower case the second.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
LOWER_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch

#: The byte map of byte-level tokenizers: printable bytes stand for
#: themselves, the others for characters from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_MAP = {b: b for b in _PRINTED} | {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}


def byte_level(word: bytes) -> str:
    return word.decode("latin-1").translate(BYTE_MAP)


def head_and_tail(piece: bytes) -> tuple[bytes, bytes]:
    """``piece`` without and as its closing punctuation, where an ASCII or
    Latin-1 letter stands before that: there every pre-tokeniser used here,
    which matches runs of letters and runs of other signs apart, has a
    boundary."""
    head = piece.rstrip(PUNCTUATION)
    if head and len(head) < len(piece) and (head[-1:].isalpha() or LETTERS(head[-2:])):
        return head, piece[len(head) :]
    return piece, b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit lanes (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. Fewer than k
    words make one shingle of them all; none make an empty set."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(0x9E3779B97F4A7C15 * width % (1 << 64)))
    for i in range(width):
        h = mix64(h + word_hashes[i : n - width + 1 + i])
    return np.unique(h)
