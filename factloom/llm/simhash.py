"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has a bit for every bit that is set in over half of
its shingles' hashes. Of all distinct fingerprints the Hamming distances to many
reference fingerprints, the pivots, are computed once. By the triangle
inequality, fingerprints at a few bits from each other are about as far from
every pivot, so a pair whose distances to any pivot differ by more is discarded
unseen, and what survives is verified.

Which pairs meet at all is read off the table as well, as comparing all rows
of it would grow with the square of their number. One pivot is random, and 64
are one bit away from it: their distances, less the first one's, change with
that bit alone. A family takes some of these 64, and its rows are the ones
whose differences are the same for all of them. The families are such that any
two fingerprints that link agree in one: they are unions of blocks, as many as
are left when every differing bit spoils another block. The more fingerprints
there are, the more blocks, so that a family's groups stay small.

Groups that are large nonetheless, as copies of copies make them, are dealt
into parts, and each pair of parts is a cell of its own. A cell gives a row per
member at most, its link to the first one of its component there, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, frequent, lookup, materialize, slices, utf8

#: Rows of a part of a group; a fingerprint that more than one row in SHARE
#: has is looked up apart.
PART, SHARE = 1024, 1000

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, k: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """The fingerprint of ``text``, unsigned; 0 where there is no word."""
    words = text.lower().split()  # on bytes: A-Z, and \x20\x09-\x0D
    n = max(1, len(words) - k + 1) if words else 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else iter([b" ".join(words)])
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, n, block):
        size = min(block, n - at)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed, size)), np.uint64, size)
        counts += np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + PLACES).ravel(), minlength=2048).reshape(8, 256)
    over = 2 * (counts @ BITS).ravel() > n
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a long)."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, k) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


@dataclass(frozen=True)
class Pivots:
    """A random fingerprint, the 64 at one bit from it, and ``far`` others."""

    far: int = 31
    seed: int = 5

    @property
    def references(self) -> np.ndarray:
        random = np.random.default_rng(self.seed).integers(0, 1 << 64, 1 + self.far, np.uint64)
        return np.concatenate([random[:1], random[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), random[1:]])

    def distances(self, fingerprints: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fingerprints[:, None] ^ self.references)


def families(count: int, distance: int, least: int = 16) -> list[np.ndarray]:
    """Sets of bits, one of which any two fingerprints at ``distance`` or less
    have in common: all but ``distance`` of some blocks. ``count``
    fingerprints that were random would come to ``least`` a group at most, as
    far as half of the bits allow that."""
    blocks = distance + 1
    while count > least << (64 * (blocks - distance) // blocks) and blocks < 2 * distance:
        blocks += 1
    parts = np.array_split(np.arange(64), blocks)
    return [np.concatenate(some) for some in combinations(parts, blocks - distance)]


def family_rows(nodes: DataFrame, pivots: Pivots, sets: list[np.ndarray]) -> DataFrame:
    """key (of a family and its differences), fingerprint, far (distances to
    the far pivots, a byte each): a row per fingerprint and family."""

    def run(batches):
        for batch in slices(batches, 4096):
            own = batch.column("fingerprint")
            table = pivots.distances(own.to_numpy().view(np.uint64))
            nearer = table[:, 1:65].astype(np.int64) < table[:, :1]  # the difference is 1 or -1
            keys = np.stack([nearer[:, s] @ (1 << np.arange(len(s), dtype=np.int64)) | f << 56 for f, s in enumerate(sets)], 1)
            offsets = pa.array(np.arange(0, keys.size + 1, len(sets), dtype=np.int32))
            far = pa.array([row.tobytes() for row in table[:, 65:]], pa.binary())
            yield pa.record_batch([own, far, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["fingerprint", "far", "keys"])

    table = nodes.select("fingerprint").mapInArrow(run, "fingerprint long, far binary, keys array<long>")
    return table.select(F.explode("keys").alias("key"), "fingerprint", "far")


def near_pairs(cell: np.ndarray, own: np.ndarray, far: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all rows of the same cell that link; rows are sorted
    by cell. Pairs are made step by step, all those so many rows apart."""
    end = np.searchsorted(cell, cell, "right")
    i, step = np.arange(len(cell)), 1
    while True:
        i = i[i + step < end[i]]
        if not len(i):
            return
        a, b = i, i + step
        for some in (slice(0, 4), slice(4, None)):
            alike = (np.abs(far[a, some] - far[b, some]) <= distance).all(1)
            a, b = a[alike], b[alike]
        linked = np.bitwise_count(own[a] ^ own[b]) <= distance
        yield a[linked], b[linked]
        step += 1


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per place the smallest one that links reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            return label
        for x in (a, b):
            np.minimum.at(label, label[x], least)
        label = label[label]


def cell_links(cells: DataFrame, distance: int) -> DataFrame:
    """a, b: in each cell (key, lo, hi) of ``cells``, every fingerprint that
    links with some other there, and the first one that links reach."""

    def links(table: pa.Table):
        places = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
        cell = np.cumsum(np.r_[False, (places[1:] != places[:-1]).any(1)])
        own = table.column("fingerprint").to_numpy().view(np.uint64)
        far = np.frombuffer(b"".join(table.column("far").to_pylist()), np.int8).reshape(len(own), -1)
        pairs = list(zip(*near_pairs(cell, own, far, distance)))
        a, b = (np.concatenate(x) for x in pairs) if pairs else (np.empty(0, int),) * 2
        first = smallest_reached(len(own), a, b)
        rows = np.flatnonzero(first != np.arange(len(own)))
        signed = own.view(np.int64)
        return pa.record_batch([pa.array(signed[rows]), pa.array(signed[first[rows]])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            # The last cell may go on in the next batch.
            last = np.ones(len(table), bool)
            for c in ("key", "lo", "hi"):
                values = table.column(c).to_numpy()
                last &= values == values[-1]
            whole = int(last.argmax())
            held = table.slice(whole).combine_chunks()
            if whole:
                yield links(table.slice(0, whole))
        if held is not None:
            yield links(held)

    place = ["key", "lo", "hi"]
    return cells.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def pivot_links(nodes: DataFrame, distance: int = 3, pivots: Pivots = Pivots()) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``nodes``: not all
    pairs at ``distance`` bits or less, but enough to connect them all."""
    rows = materialize(family_rows(nodes, pivots, families(nodes.count(), distance)), "simhash-rows")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = rows.join(groups, "key").withColumn("parts", F.ceil(F.col("n") / PART).cast("long"))
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    dealt = parts.select("key", "fingerprint", "far", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    cells = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fingerprint", "far")
    return cell_links(cells, distance)


def simhash_groups(docs: DataFrame, distance: int = 3, k: int = 3) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, fingerprint (16
    hexadecimal digits), component_id, the smallest doc_id that links between
    fingerprints at ``distance`` bits or less reach.

    Fewer than ``k`` words are one shingle; null, empty and wordless texts
    have the fingerprint zero, which links like any other. Rows that repeat an
    id get a row each. A null doc_id is a component's id only if all of its
    are null. Other columns are ignored; an empty table gives no rows.
    """
    signed = materialize(fingerprints(docs, k), "simhash-fingerprints")
    nodes = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes, "simhash-nodes")
    links = materialize(pivot_links(nodes, distance).distinct(), "simhash-links")
    labels = connected_components(links).toDF("fingerprint", "label")
    known = nodes.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    known = materialize(known, "simhash-labels")
    groups = materialize(known.groupBy("label").agg(F.min("smallest").alias("component_id")), "simhash-components")
    owners = lookup(known.select("fingerprint", "label", "n"), groups, "label", frequent(known, "label", SHARE))
    owners = materialize(owners.select("fingerprint", "component_id", "n"), "simhash-owners")
    hot = owners.where(F.col("n") > signed.count() // SHARE).select("fingerprint")
    found = lookup(signed, owners.drop("n"), "fingerprint", hot)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
