"""Mixing sources to target weights by capped water-filling.

All DataFrame operations. A source's target is ``min(cap, level * weight)``,
where ``cap`` is ``max_epochs`` times its size and ``level`` is the water
level at which the targets add up to ``share`` times all sizes; clamping and
resharing until none is above its cap ends at the same point. Each document
is repeated ``floor(target / size)`` times whole, and the fraction left is
drawn without replacement: documents in the order of a seeded hash, until
their words come nearest to it. That order is cut by one key per source, so
applying a mix is a lookup of a table with one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (3, 1, 2)
WORDS = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024


def seeded_hash(seed: int, doc_id: Column) -> Column:
    """60 bits of the md5 of ``seed|doc_id``; a null id hashes as ``null``."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, draw of each document."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), seeded_hash(seed, F.col("doc_id")).alias("draw"))


def water_fill(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds weight, target, copies, extra (words wanted beyond the copies) to
    ``sources`` (source, source_size). Windows here see one row per source."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("double")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_fill = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("wanted") - (F.sum("cap").over(by_fill) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(by_fill) - F.col("weight")))
    filled = (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    )
    copies = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    return filled.withColumn("copies", copies).select("source", "source_size", "weight", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("extra"))


def mixing_plan(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source of ``measured`` rows, with the last key ``cut`` of
    those that get one copy more (null: none does).

    The order of a source is built from hash buckets: their totals are summed
    before the shuffle, and rows are sorted within (source, bucket), so a
    source that holds a third of all rows is still spread over all tasks.
    Rows that agree in doc_id and size are taken together.
    """
    bucket = (F.col("draw") / F.lit(float(1 << 60)) * BUCKETS).cast("int")
    rows = sized.select("source", "draw", "doc_id", "size", bucket.alias("bucket"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = materialize(totals, "mix-totals")
    sources = water_fill(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select("source", "bucket", (F.sum("words").over(before) - F.col("words")).alias("start"), "words")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # Only the bucket in which the wanted words end needs its rows in order.
    ends = starts.join(sources, same(starts, sources)).where("extra > 0 and start < extra and start + words >= extra").select(starts["source"], "bucket", "start", "extra")
    inside = rows.join(ends, same(rows, ends) & (rows["bucket"] == ends["bucket"])).select(rows["source"], rows["bucket"], "draw", "doc_id", "size", "start", "extra")
    key = ["source", "bucket", "draw", "doc_id", "size"]
    upto = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("last", F.col("start") + F.sum("size").over(upto)).withColumn("unit", F.sum("size").over(Window.partitionBy(*key))).where("last - unit / 2 <= extra")
    cut = taken.groupBy("source").agg(F.max(F.struct("draw", "doc_id", "size")).alias("cut"))
    # No row of that bucket taken: the cut lies at the end of the one before.
    edge = ends.select("source", F.struct(F.ceil(F.col("bucket") * F.lit(float(1 << 60) / BUCKETS)).cast("long").alias("draw"), F.lit(None).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("size")).alias("edge"))
    plan = sources.join(edge, same(sources, edge), "left").select(sources["*"], "edge")
    return plan.join(cut, same(plan, cut), "left").select(plan["source"], "source_size", "weight", "target", "copies", F.coalesce("cut", "edge").alias("cut"))


def apply_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` rows (other columns kept) with source_size, target and
    repeats. ``plan`` is a written table; Spark broadcasts it when its files
    are below the session's threshold and else joins by source."""
    extra = F.coalesce(F.struct("draw", "doc_id", "size") <= F.col("cut"), F.lit(False)).cast("long")
    return sized.join(plan.select(F.col("source").alias("_source"), "source_size", "target", "copies", "cut"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("repeats", F.col("copies") + extra).drop("_source", "copies", "cut")


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Per document of ``docs`` (doc_id, source, text): size, source_size,
    target, repeats, taken (words the mix takes).

    Null text has size 0; null sources form a source of their own, ordered
    last; rows that repeat a doc_id and size in a source share their fate;
    other columns are ignored; an empty table gives no rows. Same seed, same
    mix.
    """
    sized = materialize(measured(docs, seed), "mix-sizes")
    plan = materialize(mixing_plan(sized, weights, share, max_epochs), "mix-plan")
    return apply_mix(sized, plan).select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``docs`` with every row as often as the mix repeats it, columns kept."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *["doc_id", "source", "text"])
    sized = measured(docs, seed)
    plan = materialize(mixing_plan(materialize(sized, "mix-sizes"), weights, share, max_epochs), "mix-plan")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = own.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), seeded_hash(seed, F.col("doc_id")).alias("draw"))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return apply_mix(rows, plan).where("repeats > 0").select("_row", repeats).select("_row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS draw FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
    CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS wanted FROM sources),
levels AS (
  SELECT *, (wanted - (sum(cap) OVER w - cap)) / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level FROM weighed
  WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
leveled AS (SELECT * REPLACE (max(CASE WHEN level * weight <= cap THEN level END) OVER () AS level) FROM levels),
targets AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM leveled),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS extra,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY draw, s.doc_id, s.size) AS last FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN extra > 0 AND last - size / 2 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM ordered
"""
