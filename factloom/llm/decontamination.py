"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when at least ``containment`` of its
distinct k-word shingles occur there. An item of fewer than k words is one
shingle of them all, sought at that width: a document is the set of its k-word
shingles and of its shorter ones, of the widths that such items have, so the
item is found wherever its words follow one another. The items' shingles
together are the universe; a document is first reduced to its shingles in that universe, which
changes no containment and leaves a set that a short item can match. One pass
over the texts does that against a bit table of the universe, of a fixed size
however many items there are; few documents keep a shingle, and the search
proper reads those alone.

Items and reduced sets are both partitioned by size (powers of two): the wanted
containment is a Jaccard similarity of at least ``t*q / (q + x - t*q)`` of an
item of size q against a set of size x, so each pair of partitions has its own
number of one-value bands to miss such a pair with probability ``miss`` at
most. Candidates are verified by counting the exact shingles in common. Pairs
of partitions beyond ``max_bands`` are looked up exactly, shingle by shingle,
which leaves the bands of all others as they are.

Items are searched in blocks of at most ``block`` shingles, one block at a
time, so what goes to each task is bounded, too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, appended, materialize, mix64, shingle_set, slices

WORD = re.compile(r"[^\W_]+")
HITS = "doc_id long, text_hash long, item_id long, n_shared long, n_item long"


@dataclass(frozen=True)
class Search:
    k: int = 5
    containment: float = 0.8
    miss: float = 1e-9
    max_bands: int = 256
    block: int = 1 << 18
    seed: int = 3
    bits: int = 27


class Shingler:
    """Lower-cased words of letters and digits, so that case, punctuation and
    layout don't hide a copy."""

    def __init__(self, k: int):
        self.k, self.words = k, Memo(xxhash.xxh3_64_intdigest)

    def hashes(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.words.__getitem__, map(str.encode, words)), np.uint64, len(words))

    def item(self, text: str | None) -> tuple[np.ndarray, int]:
        """An item's shingles and their width, 0 without a word."""
        h = self.hashes(text)
        return shingle_set(h, self.k), min(self.k, len(h))

    def document(self, text: str | None, widths: Sequence[int]) -> np.ndarray:
        """The distinct shingles of the given widths."""
        h = self.hashes(text)
        sets = [shingle_set(h, w) for w in widths if w <= len(h)]
        return sets[0] if len(sets) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))


def size_class(n: int) -> int:
    """The class of a set of n shingles: class c holds up to 2**c."""
    return max(n - 1, 0).bit_length()


def bands_for(size: int, shortest: int, search: Search) -> int:
    """Bands that find an item of any length from ``shortest`` in a reduced
    set of up to ``size`` shingles; 0 if more than max_bands."""
    # Similarity grows with the item, up to an item as large as the set.
    shared = search.containment * shortest
    j = min(1.0, shared / max(shortest + size - shared, shared))
    n = 1 if j >= 1 else math.ceil(math.log(search.miss) / math.log(1 - j))
    return n if n <= search.max_bands else 0


def bands_of(part: int, kind: int, search: Search) -> int:
    """Bands of the pair of a partition of reduced sets and one of items."""
    return bands_for(1 << part, (1 << kind >> 1) + 1 if kind else 1, search)


@dataclass
class ItemIndex:
    """One block of items: universe (sorted), per item its set, and for each
    size partition of reduced sets a table of band keys, to which every size
    partition of items gives as many as the pair needs."""

    search: Search
    ids: list[int | None]
    sets: list[np.ndarray]
    universe: np.ndarray = field(init=False)

    def __post_init__(self):
        self.universe = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        random = np.random.default_rng(self.search.seed)
        self.salt = random.integers(0, 1 << 64, (self.search.max_bands, 1), np.uint64)
        self.kinds: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.kinds.setdefault(size_class(len(s)), []).append(i)
        self.tables: dict[int, tuple[int, np.ndarray, np.ndarray, list[int]]] = {}

    @cached_property
    def signatures(self) -> list[np.ndarray]:
        return [self.signature(s, self.search.max_bands) for s in self.sets]

    @cached_property
    def owners(self) -> dict[int, dict[int, list[int]]]:
        """Per partition of items, the items that hold a shingle."""
        found: dict[int, dict[int, list[int]]] = {}
        for kind, items in self.kinds.items():
            own = found.setdefault(kind, {})
            for i in items:
                for x in self.sets[i].tolist():
                    own.setdefault(x, []).append(i)
        return found

    def signature(self, shingles: np.ndarray, bands: int) -> np.ndarray:
        return mix64(shingles[None, :] ^ self.salt[:bands]).min(1)

    def table(self, size: int) -> tuple[int, np.ndarray, np.ndarray, list[int]]:
        """Of the partition of ``size``: the most bands of a pair, the keys of
        all items in order, the item behind each, and the partitions of items
        that are looked up instead."""
        part = size_class(size)
        if part not in self.tables:
            keys, owners, looked_up, most = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [], 0
            for kind, items in sorted(self.kinds.items()):
                fit = [i for i in items if math.ceil(self.search.containment * len(self.sets[i])) <= 1 << part]
                bands = bands_of(part, kind, self.search)
                if fit and bands:
                    keys += [self.band_keys(self.signatures[i][:bands]) for i in fit]
                    owners.append(np.repeat(np.array(fit, np.int32), bands))
                    most = max(most, bands)
                elif fit:
                    looked_up.append(kind)
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.tables[part] = most, flat[order], np.concatenate(owners)[order], looked_up
        return self.tables[part]

    @staticmethod
    def band_keys(signature: np.ndarray) -> np.ndarray:
        return mix64(signature + np.arange(len(signature), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def candidates(self, reduced: np.ndarray) -> set[int]:
        bands, keys, owners, looked_up = self.table(len(reduced))
        found: set[int] = set()
        if bands:
            own = self.band_keys(self.signature(reduced, bands))
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            found.update(i for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()) for i in owners[a:b].tolist())
        for kind in looked_up:
            own = self.owners[kind]
            found.update(i for x in reduced.tolist() for i in own.get(x, ()))
        return found

    def reduce(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.universe, shingles)
        at[at == len(self.universe)] = 0
        return shingles[self.universe[at] == shingles] if len(self.universe) else shingles[:0]

    def hits(self, shingles: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item, shared, size of item) of the items contained in the set."""
        reduced = self.reduce(shingles)
        if not len(reduced):
            return []
        found = []
        for i in sorted(self.candidates(reduced)):
            shared = len(np.intersect1d(reduced, self.sets[i], assume_unique=True))
            if shared >= self.search.containment * len(self.sets[i]) - 1e-9:
                found.append((self.ids[i], shared, len(self.sets[i])))
        return found


def item_sets(benchmark: DataFrame, search: Search, unnamed: bool) -> DataFrame:
    """item_id, width, shingles (array of long) of the items; those without a
    word are skipped, those without an id unless ``unnamed``, equal rows count
    once."""
    rows = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where(F.lit(unnamed) | F.col("item_id").isNotNull()).distinct()

    def run(batches):
        shingler = Shingler(search.k)
        for batch in slices(batches):
            found = [shingler.item(t) for t in batch.column("text").to_pylist()]
            yield _with_sets([batch.column("item_id"), pa.array([w for _, w in found], pa.int32())], ["item_id", "width"], [s for s, _ in found])

    return materialize(rows.mapInArrow(run, "item_id long, width int, shingles array<long>").where("width > 0"), "benchmark-items")


def _with_sets(columns: list[pa.Array], names: list[str], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
    flat = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
    return pa.record_batch([*columns, pa.ListArray.from_arrays(offsets, flat)], names=[*names, "shingles"])


def _sets(column: pa.ListArray) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def bit_table(items: DataFrame, search: Search) -> np.ndarray:
    """2**bits bits, of which every shingle of ``items`` sets one; the driver
    gets the words that are not zero, at most 2**(bits - 6) of them."""
    at = F.col("s").bitwiseAND((1 << search.bits) - 1)
    places = items.select(F.explode("shingles").alias("s")).select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(s & 63L as int))").alias("bit"))
    words = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (search.bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def reduced_sets(docs: DataFrame, items: DataFrame, search: Search) -> DataFrame:
    """doc_id, text_hash, shingles of the rows that keep one by the bit
    table. Texts are read here alone, once."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(items, search))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # k at most

    def run(batches):
        table, shingler = shared.value, Shingler(search.k)
        for batch in slices(batches):
            sets, some = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                s = shingler.document(text, widths)
                at = s & np.uint64((1 << search.bits) - 1)
                s = s[(table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                if len(s):
                    sets.append(s)
                    some.append(i)
            if some:
                yield _with_sets([batch.column(c).take(pa.array(some)) for c in ("doc_id", "text_hash")], ["doc_id", "text_hash"], sets)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    sets = materialize(narrow.mapInArrow(run, "doc_id long, text_hash long, shingles array<long>"), "benchmark-reduced")
    shared.destroy()
    return sets


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def item_blocks(items: DataFrame, block: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and sets of the items, at most ``block`` shingles at a time (or one
    item); the driver holds one block."""
    ids, sets, held = [], [], 0
    for row in items.toLocalIterator():
        if ids and held + len(row.shingles) > block:
            yield ids, sets
            ids, sets, held = [], [], 0
        ids.append(row.item_id)
        sets.append(np.array(row.shingles, np.int64).view(np.uint64))
        held += len(row.shingles)
    if ids:
        yield ids, sets


class _Block:
    """A block as it is broadcast; a worker makes its index once."""

    def __init__(self, search: Search, ids: list[int | None], sets: list[np.ndarray]):
        self.made = search, ids, sets

    @cached_property
    def index(self) -> ItemIndex:
        return ItemIndex(*self.made)


def found_items(docs: DataFrame, benchmark: DataFrame, search: Search, unnamed: bool = False) -> DataFrame:
    """A HITS row per (row of docs, item contained in it), written."""
    items = item_sets(benchmark, search, unnamed)
    reduced = reduced_sets(docs, items, search)

    def scan(shared):
        def run(batches):
            index = shared.value.index
            for batch in slices(batches):
                rows = []
                for doc_id, text, shingles in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), _sets(batch.column("shingles"))):
                    rows += [(doc_id, text, *hit) for hit in index.hits(shingles)]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "text_hash", "item_id", "n_shared", "n_item"])

        return reduced.mapInArrow(run, HITS)

    def parts() -> Iterator[DataFrame]:
        for block in item_blocks(items, search.block):
            shared = docs.sparkSession.sparkContext.broadcast(_Block(search, *block))
            yield scan(shared)
            shared.destroy()

    return appended(docs.sparkSession, parts(), HITS, "benchmark-hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """One row per (document, item) found: doc_id, item_id, n_shared, n_item,
    containment.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). An item of fewer
    than k words is one shingle of them all, found in documents of any length
    that hold these words in a row. Null and empty texts contain and
    are nothing; repeated documents give repeated rows, equal items count
    once, a repeated item_id with another text is searched on its own. An item
    whose item_id is null could not be named and gives no row, though
    clean_documents searches it. Other columns are ignored; empty tables give
    no rows. Texts are read once and not exchanged.
    """
    found = found_items(docs, benchmark, search)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns as they are. Items
    count whether their item_id is null or not."""
    found = found_items(docs, benchmark, search, unnamed=True).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & (text_hash(docs["text"]) == found["_t"])
    return docs.join(found, own, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN widths ON len(w) >= k)),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
