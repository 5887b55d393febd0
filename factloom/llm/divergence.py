"""Source divergence audit: which terms a source uses more than its language
does, and how far the sources of a language are from one another.

One pass counts terms per language and source. What follows works on those
counts, in whole numbers throughout.

Pairs of sources are sparse. Terms that neither source has all have the same
two shares, the baselines, and count as one product. A term that one of them
has differs from that by a sum over the source's own counts, taken once per
baseline that any source of the language has; only terms that both have are
joined, and add what corrects the two sums.

The top of each group is found by radix selection: a histogram over the leading
bits of all values says in which bucket the k-th one lies, the next histogram
splits that bucket, and so on; rows equal to the k-th value are then split by
the leading bytes of their items. No group is sorted or gathered: what is left
to sort holds k rows and one bucket of bounded size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, utf8

#: Letters stay, A-Z in lower case; other ASCII characters become spaces. Bytes
#: from 0x80 on belong to characters that are letters here.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

SCALE = 1_000_000_000
GROUP = ["lang", "source"]


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``size``, cut at spaces only."""
    at = 0
    while at < len(data):
        cut = len(data)
        if at + size < cut:
            cut = data.rfind(b" ", at, at + size)
            cut = cut if cut >= 0 else data.find(b" ", at + size)
            cut = cut if cut >= 0 else len(data)
        yield data[at:cut]
        at = cut + 1


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")))


def count_terms(docs: DataFrame, limit: int = 200_000) -> DataFrame:
    """lang, source, term, count (occurrences), docs (documents that have
    it). A task holds the counts of at most about ``limit`` terms and groups
    and then passes them on, so memory doesn't follow the vocabulary."""

    def rows(held):
        flat = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in counts.items()]
        lang, source, term, counts, docs = zip(*flat) if flat else ([],) * 5
        held.clear()
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "count", "docs"])

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in slices(batches, 128):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text"))):
                counts, docs = held[lang, source]
                size -= len(counts)
                seen: set[bytes] = set()
                for piece in pieces(text.translate(TERMS)):
                    terms = piece.split()
                    counts.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(counts)
                if size > limit:
                    yield rows(held)
                    size = 0
        yield rows(held)

    return _named(docs).mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST({total} + {terms} AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q). Shares of a group add up to SCALE and a little,
    so neither this nor its sum over terms leaves a long."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def top_rows(rows: DataFrame, keys: list[str], k: int, bits: int = 12, spare: int = 4096) -> DataFrame:
    """The ``k`` first of each group of ``rows`` (keys, item string, value
    long >= 0; a written table), larger values first, then smaller items by
    UTF-8, with ``rank``. A group's row says where its k-th one can lie: rows
    of more than ``low`` are in, ``n`` rows are undecided, those from low on
    (or, among those equal to low, up to ``upto`` of the item's bytes).
    Buckets of at most ``spare`` rows are left to the last window.
    """
    most = rows.agg(F.max("value")).first()[0] or 0
    shift = max(most.bit_length(), 1)
    state = materialize(rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"), F.lit(1 << 62).alias("n"), F.lit(None).cast("binary").alias("upto")), "audit-bounds")
    undecided = (F.col("n") > spare) & (F.col("taken") + F.col("n") > k)

    def narrowed(buckets: DataFrame, ascending: bool, low: Column, upto: Column) -> DataFrame:
        """Each undecided group's bucket with its k-th row, by a histogram."""
        order = Window.partitionBy(*keys).orderBy("bucket" if ascending else F.desc("bucket"))
        sums = buckets.withColumn("before", F.sum("count").over(order) - F.col("count")).where(F.col("taken") + F.col("before") < k)
        last = sums.groupBy(*keys).agg(F.max_by(F.struct("bucket", "count", "before", "taken", "low"), "before").alias("b"))
        found = last.select(*keys, "b.*").select(*keys, low.alias("low"), (F.col("taken") + F.col("before")).alias("taken"), F.col("count").alias("n"), upto.alias("upto"))
        return materialize(state.where(~undecided).unionByName(found), "audit-bounds")

    def left() -> bool:
        return not state.where(undecided).isEmpty()

    while shift and left():
        width, shift = min(bits, shift), max(0, shift - bits)
        end = F.col("low") + F.lit(1 << (shift + width))
        inside = rows.join(state.where(undecided), keys).where((F.col("value") >= F.col("low")) & (F.col("value") < end))
        buckets = inside.groupBy(*keys, "low", "taken", F.shiftright("value", shift).alias("bucket")).count()
        state = narrowed(buckets, False, F.shiftleft("bucket", shift), F.lit(None).cast("binary"))
    length = 0
    while left():
        item, length = F.col("item").cast("binary"), length + 2
        ties = rows.join(state.where(undecided), keys).where((F.col("value") == F.col("low")) & (F.coalesce(F.substring(item, 1, length - 2), F.lit(b"")) == F.coalesce("upto", F.lit(b""))))
        buckets = ties.groupBy(*keys, "low", "taken", F.substring(item, 1, length).alias("bucket")).count()
        state = narrowed(buckets, True, F.col("low"), F.col("bucket"))
    first = F.substring(F.col("item").cast("binary"), F.lit(1), F.length("upto"))
    some = rows.join(state, keys).where((F.col("value") > F.col("low")) | ((F.col("value") == F.col("low")) & (F.col("upto").isNull() | (first <= F.col("upto")))))
    ranked = some.select(*keys, "item", "value", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value: the sum over
    all kept terms of the gap between the source's share and the item's, from
    ``rows`` (lang, source, term, p) and ``groups`` (lang, source, v, held,
    base: the share of a term that the source does not have)."""
    # What a source's own terms add against each baseline of the language.
    shares = rows.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("terms"))
    bases = groups.select("lang", F.col("base").alias("q")).distinct()
    sides = shares.join(bases, "lang").groupBy(*GROUP, "q").agg(F.sum(F.col("terms") * gap("p", "q")).alias("over"), F.sum(F.col("terms") * gap("q", "p")).alias("under"))
    sides = materialize(sides, "audit-sides")

    # Terms of both, each unordered pair of sources once.
    based = rows.join(groups.select(*GROUP, "base"), GROUP)
    a, b = (based.select("lang", "term", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "base"))) for x in "ab")
    correction = lambda x, y: gap(f"p_{x}", f"p_{y}") - gap(f"p_{x}", f"base_{y}") - gap(f"base_{x}", f"p_{y}") + gap(f"base_{x}", f"base_{y}")
    both = a.join(b, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(correction("a", "b")).alias("ab"), F.sum(correction("b", "a")).alias("ba"))
    both = materialize(both, "audit-common")
    common = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("both")).union(both.select("lang", "source_b", "source_a", "ba"))

    one = groups.select("lang", "source", "v", "held", "base")
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_t"), F.col("base").alias("base_t"))
    pairs = one.join(other, "lang").where("source <> item")
    own = sides.select(*GROUP, F.col("q").alias("base_t"), "over")
    theirs = sides.select("lang", F.col("source").alias("item"), F.col("q").alias("base"), "under")
    whole = pairs.join(own, [*GROUP, "base_t"], "left").join(theirs, ["lang", "item", "base"], "left").join(common, [*GROUP, "item"], "left")
    zero = F.lit(0).cast("long")
    neither = (F.col("v") - F.col("held") - F.col("held_t")) * gap("base", "base_t")
    value = F.when(F.col("v") == 0, zero).otherwise(neither + sum((F.coalesce(c, zero) for c in ("over", "under", "both")), zero))
    return whole.select(*GROUP, "item", value.alias("value"))


def divergence(docs: DataFrame, least_docs: int = 3, k: int = 200) -> DataFrame:
    """Per (lang, source) group of ``docs`` (text, lang, source): lang,
    source, part, item, value, rank.

    A language keeps the terms that ``least_docs`` of its documents have.
    Part ``term`` ranks the kept terms that the source uses more than its
    language, the ``k`` first of them; part ``pair`` ranks the language's other
    sources, all of them, by the divergence from each.

    Null text, lang and source count as empty. A row is a document, so rows
    that repeat count again. Texts without a term add a group that has no
    term part; a language's only source has no pair part; where no term is
    kept, pairs have the value 0. Ties go to the smaller item by UTF-8. Other
    columns are ignored; an empty table gives no rows.
    """
    counts = count_terms(docs).groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counts = materialize(counts, "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(kept, "audit-kept")
    langs = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang")), "audit-langs")
    held = materialize(counts.join(kept, ["lang", "term"]).select(*GROUP, "term", "count", "total"), "audit-held")

    sums = held.groupBy(*GROUP).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("held"))
    every = _named(docs.select(*GROUP, F.lit("").alias("text"))).select(*GROUP).distinct()
    groups = every.join(sums, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["n", "held", "v", "n_lang"])
    groups = materialize(groups.withColumn("base", F.when(F.col("v") > 0, share("0", "n", "v"))), "audit-groups")

    rows = held.join(groups.select(*GROUP, "n", "v", "n_lang"), GROUP).select(*GROUP, "term", share("count", "n", "v").alias("p"), share("total", "n_lang", "v").alias("q"))
    rows = materialize(rows, "audit-shares")
    scored = rows.where("p > q").select(*GROUP, F.col("term").alias("item"), gap("p", "q").alias("value"))
    terms = top_rows(materialize(scored, "audit-scores"), GROUP, k)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = pair_values(rows, groups).withColumn("rank", F.row_number().over(order))
    columns = (*GROUP, "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).union(terms.withColumn("part", F.lit("term")).select(*columns))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
occurrences AS (SELECT lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
size AS (SELECT lang, sum(n) AS total, count(*) AS v FROM l GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, count(*) OVER (PARTITION BY g.lang, g.source) AS v
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + (1000000000 * (n + 1)::HUGEINT) // (total + v)::HUGEINT)::HUGEINT AS p FROM dense),
q AS (SELECT lang, term, (1 + (1000000000 * (n + 1)::HUGEINT) // (total + v)::HUGEINT)::HUGEINT AS q FROM l JOIN size USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
