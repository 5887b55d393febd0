"""MinHash near-duplicates with min-max hashing.

A document is its set of distinct k-word shingles, as 64-bit hashes. Every
permutation gives two signature values, the smallest and the largest hash
under it, so half the hash evaluations serve as many bands. A band takes
minima only or maxima only, each from different permutations; its values are
then independent and match with probability J each.

Equal sets form a class, and one node stands for it. Nodes that share a band
are candidates, and a candidate is a link only if the full sets say so. A
bucket is not expanded into pairs: it is dealt into parts of about FAN nodes,
every member is compared with one representative of its part, and those with
the bucket's, which joins large groups at a cost linear in their size and
leaves no node with many more than FAN pairs. Components found so far count as
one, so what a sweep adds are links between them. Then only pairs across
components can change one. Members of buckets that still
hold several components are compared across them under an exact prefix
filter: in a fixed order of all shingles, similar sets must share one of their
first few. Shingles that a single component holds come first in that order,
rare ones next, so a text with more shingles of its own than a link allows is
compared with nothing, however many others surround it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, connected_components, frequent, lookup, materialize, mix64, scratch, shared_dir, shingle_set, slices, utf8, write_to

#: Nodes of a part of a bucket; a key that more than one row in SHARE holds
#: is looked up apart.
FAN, SHARE = 4096, 1000


@dataclass(frozen=True)
class Banding:
    """``per_band`` values a band, as many bands as leave a pair at exactly
    the threshold unseen with probability ``miss`` at most."""

    similarity: tuple[int, int] = (4, 5)
    k: int = 5
    per_band: int = 6
    miss: float = 1e-6
    seed: int = 1

    @property
    def bands(self) -> int:
        n = math.ceil(math.log(self.miss) / math.log(1 - (self.similarity[0] / self.similarity[1]) ** self.per_band))
        return n + n % 2

    @property
    def permutations(self) -> int:
        return self.bands // 2 * self.per_band


class Signer:
    """Shingle sets and band keys of texts."""

    def __init__(self, banding: Banding, block: int = 2048):
        self.banding, self.block = banding, block
        random = np.random.default_rng(banding.seed)
        self.add = random.integers(0, 1 << 64, (banding.permutations, 1), np.uint64)
        self.times = random.integers(0, 1 << 63, (banding.permutations, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = Memo(xxhash.xxh3_64_intdigest)

    def shingles(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # on bytes: A-Z, and \x20\x09-\x0D
        return shingle_set(np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)), self.banding.k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minima, then maxima, under each permutation."""
        least, most = None, None
        for at in range(0, len(shingles), self.block):
            h = (shingles[None, at : at + self.block] ^ self.add) * self.times
            lo, hi = h.min(1), h.max(1)
            least, most = (lo, hi) if least is None else (np.minimum(least, lo), np.maximum(most, hi))
        return np.concatenate([least, most])

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        values = self.signature(shingles).reshape(self.banding.bands, self.banding.per_band)
        h = np.arange(self.banding.bands, dtype=np.uint64)
        for i in range(self.banding.per_band):
            h = mix64(h * np.uint64(3) + values[:, i])
        return h.view(np.int64)


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()) or 1).view(np.int64)) if len(shingles) else 0


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def sign(docs: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (key of the set), bands."""

    def run(batches):
        signer = Signer(banding)
        for batch in slices(batches):
            sizes, nodes, keys, counts = [], [], [], []
            for text in utf8(batch.column("text")):
                s = signer.shingles(text)
                sizes.append(len(s))
                nodes.append(set_key(s))
                counts.append(banding.bands if len(s) else 0)
                if len(s):
                    keys.append(signer.band_keys(s))
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), bands], names=["doc_id", "text_hash", "n_shingles", "node", "bands"])

    return _identified(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, bands array<long>")


def sets_of(docs: DataFrame, signed: DataFrame, nodes: DataFrame, banding: Banding) -> DataFrame:
    """node, shingles (array of long) of the given nodes, from one document
    of each."""
    chosen = signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("d")).select("node", F.col("d.doc_id").alias("_d"), F.col("d.text_hash").alias("_t"))
    d = _identified(docs)
    texts = d.join(chosen, d["doc_id"].eqNullSafe(chosen["_d"]) & (d["text_hash"] == chosen["_t"])).select("node", "text")

    def run(batches):
        signer = Signer(banding)
        for part in slices(batches, 64):
            sets = [signer.shingles(t) for t in utf8(part.column("text"))]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.record_batch([part.column("node"), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b, and more) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    num, den = similarity
    sized = pairs.join(left, "a").join(right, "b").where(F.least(F.size("sa"), F.size("sb")) * den >= F.greatest(F.size("sa"), F.size("sb")) * num)
    common = sized.select(*pairs.columns, (F.size("sa") + F.size("sb")).cast("long").alias("both"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    return common.where(F.col("common") * den >= (F.col("both") - F.col("common")) * num).select(*pairs.columns)


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs (a, b) of ``nodes`` (node, label) with different labels that
    may be similar enough; every similar one is among them."""
    num, den = similarity
    tokens = nodes.join(sets, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    tokens = materialize(tokens, "near-tokens")
    across = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token", "df")
    ordered = tokens.join(across, "token").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # Places before ``free`` hold shingles of one component only.
    free = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    kept = ordered.withColumn("free", free).select("node", "label", "n", "free", F.posexplode(F.slice("shared", 1, F.greatest(F.lit(0), length - F.col("free")).cast("int"))).alias("i", "t"))
    prefix = materialize(kept.select(F.col("t.token").alias("token"), "node", "label", "n", (F.col("n") - F.col("free") - F.col("i")).alias("left")), "near-prefixes")
    a, b = (prefix.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "left"))) for x in "ab")
    # A link has so many shingles in common at least: more than are left in
    # either set from its first common one on cannot be.
    enough = F.least("left_a", "left_b") * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    found = a.join(b, "token").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & enough & sizes)
    return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("label_a").alias("la"), F.col("label_b").alias("lb"))


def star_pairs(members: DataFrame, sweep: int) -> DataFrame:
    """Pairs (a, b, la, lb) of different labels, of members (band, n, node,
    label): each with the representative of its part of the bucket, and those
    with the one of the bucket."""
    order = F.struct(F.xxhash64("node", F.lit(sweep)).alias("order"), "node", "label")
    parts = members.groupBy("band", "part").agg(F.min(order).alias("rep"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("n").alias("n"))
    parts = materialize(parts.where((F.col("lo") < F.col("hi")) | (F.col("n") > FAN)), "near-parts")
    own = members.join(parts.where("lo < hi").select("band", "part", "rep"), ["band", "part"])
    many = parts.where(F.col("n") > FAN)
    across = many.select("band", F.col("rep.node").alias("node"), F.col("rep.label").alias("label")).join(many.groupBy("band").agg(F.min("rep").alias("rep")), "band")
    rows = own.select("node", "label", "rep").union(across.select("node", "label", "rep")).where(F.col("label") != F.col("rep.label"))
    one, other = F.struct("node", "label"), F.struct("rep.node", "rep.label")
    sides = rows.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y"))
    return sides.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))


def mixed_members(members: DataFrame) -> DataFrame:
    """node, label of the members of buckets with more than one label."""
    parts = members.groupBy("band", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("n").alias("n"))
    parts = materialize(parts, "near-parts")
    many = parts.where(F.col("n") > FAN)
    mixed = many.groupBy("band").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most").select("band")
    keys = parts.where(F.col("n") <= FAN).where("lo < hi").select("band", "part").union(many.join(mixed, "band", "left_semi").select("band", "part"))
    return members.join(keys, ["band", "part"], "left_semi").select("node", "label").distinct()


def components_of(docs: DataFrame, signed: DataFrame, banding: Banding, sweeps: int = 3) -> DataFrame:
    """node, label: the component of each node that shares a band with one.

    ``sweeps`` passes compare bucket members with representatives, others in
    each pass; the pass after them does the rest, see prefix_pairs.
    """
    nodes = signed.where("n_shingles > 0").select("node", "bands").dropDuplicates(["node"])
    bands = nodes.select(F.explode("bands").alias("band"), "node")
    # Only buckets with two nodes or more ever matter again.
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialize(bands.join(shared, "band"), "near-buckets")
    labels = materialize(rows.select("node", F.col("node").alias("label")).distinct(), "near-labels")
    sets = materialize(sets_of(docs, signed, labels.select("node"), banding), "near-sets")
    if sets.count() > labels.count():  # rows that repeat id and text
        sets = materialize(sets.dropDuplicates(["node"]), "near-sets")
    tested: list[DataFrame] = []
    for sweep in range(sweeps + 1):
        part = F.pmod(F.xxhash64("node", F.lit(-1 - sweep)), F.ceil(F.col("n") / FAN))
        members = rows.join(labels, "node").withColumn("part", part)
        if sweep < sweeps:
            members = materialize(members, "near-members")
            pairs = star_pairs(members, sweep)
        else:
            pairs = prefix_pairs(mixed_members(members), sets, banding.similarity)
        pairs = pairs.distinct()
        for t in tested:
            pairs = pairs.join(t.select(F.col("a"), F.col("b")), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "near-pairs")
        if pairs.isEmpty():
            continue
        found = materialize(confirm(pairs, sets, banding.similarity).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "near-links")
        tested.append(pairs)
        if not found.isEmpty():
            joined = connected_components(found).toDF("label", "new")
            labels = lookup(labels, joined, "label", frequent(labels, "label"))
            labels = materialize(labels.select("node", F.coalesce("new", "label").alias("label")), "near-labels")
    return labels


def near_duplicates(docs: DataFrame, banding: Banding = Banding(), signed: DataFrame | None = None) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_shingles, component_id, kept
    and text_hash.

    component_id is the smallest doc_id reachable by links; kept says whether
    it is the document's own. Null, empty or wordless text has no shingle, is
    linked with nothing and kept. Rows that repeat an id and text are linked
    and get a row each. A null doc_id is a component's id only if all of its
    are null, of which then the text with the smallest hash is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    signed = materialize(sign(docs, banding), "near-signed") if signed is None else signed
    path = shared_dir(docs.sparkSession, "near-groups")
    with scratch(docs.sparkSession):
        groups = write_to(path, groups_of(signed, components_of(docs, signed, banding)))
    narrow = signed.select("doc_id", "text_hash", "n_shingles", "node")
    grouped = lookup(narrow.where("n_shingles > 0"), groups, "node", groups.where(F.col("n_node") > signed.count() // SHARE).select("node"))
    component = F.when(F.col("n").isNotNull(), F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("n").isNull(), True).when(F.col("smallest").isNull(), F.col("text_hash") == F.col("first")).otherwise(F.coalesce(F.col("doc_id") == F.col("smallest"), F.lit(False)))
    alone = narrow.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash")
    return grouped.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash").unionByName(alone)


def groups_of(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each node whose component has two documents or more: n_node, its
    documents, and of the component smallest (doc_id), first (text_hash), n."""
    info = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("smallest"), F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"))
    known = info.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialize(known, "near-info")
    groups = known.groupBy("label").agg(F.min("smallest").alias("smallest"), F.min("first").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("nodes")).where("n > 1")
    groups = materialize(groups, "near-components")
    rows = known.select("node", "label", F.col("n").alias("n_node"))
    hot = groups.where(F.col("nodes") > known.count() // SHARE).select("label")
    return lookup(rows, groups.drop("nodes"), "label", hot).where("n is not null").drop("label")


def unique_documents(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, columns as they are;
    of rows equal in id and text with a shingle, one."""
    found = materialize(near_duplicates(docs, banding), "near-decisions")
    text_hash = F.xxhash64(F.col("text").cast("string"))

    def same(rows: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(rows["_d"]) & (text_hash == rows["_t"])

    named = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "kept", "n_shingles")
    dropped = named.where("not kept").select("_d", "_t").distinct()
    repeated = materialize(named.where("kept and n_shingles > 0").groupBy("_d", "_t").count().where("count > 1").select("_d", "_t"), "near-repeated")
    kept = docs.join(dropped, same(dropped), "left_anti")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = docs.join(repeated, same(repeated), "left_semi").select(whole.alias("row"), F.col("doc_id").alias("id"), text_hash.alias("hash")).dropDuplicates(["id", "hash"]).select("row.*")
    return kept.join(repeated, same(repeated), "left_anti").unionByName(once)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(lowest.b, w.doc_id)) AS component_id, coalesce(lowest.b, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN lowest ON lowest.a = w.doc_id
"""
