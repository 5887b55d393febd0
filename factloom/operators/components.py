"""Connected components over a table of links, and joins by frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.written import written


def frequent(rows: DataFrame, key: str, share: int = 1000) -> DataFrame | None:
    """The keys that more than ``share`` rows and one in ``share`` of a written
    table hold: fewer than ``share`` of them, whatever the input. None where
    the table is too small for any."""
    total = rows.count()
    return rows.groupBy(key).count().where(F.col("count") > total // share + share).select(key) if total > share else None


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has a row per ``key``.

    The keys of ``hot``, a table of bounded size as ``frequent`` gives it, are
    looked up in a broadcast; their rows are dealt evenly in the join by key,
    in which they find nothing, so no task gets all rows of a frequent key.
    """
    if hot is None:
        return rows.join(table, key, "left")
    values = [c for c in table.columns if c != key]
    own = table.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key).alias("_hot"), F.struct(*values).alias("_near"))
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns).bitwiseOR(1)).otherwise(0)
    marked = rows.join(F.broadcast(own), F.col(key) == F.col("_hot"), "left").withColumn("_spread", spread)
    rest = table.select(key, F.lit(0).cast("long").alias("_spread"), F.struct(*values).alias("_far"))
    found = marked.join(rest, [key, "_spread"], "left")
    return found.select(*rows.columns, *(F.coalesce(f"_near.{v}", f"_far.{v}").alias(v) for v in values))


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of long ids to (node, label), label being the smallest id
    of the component. Every node hangs under the smallest label around it,
    then under that one's own label, so long chains halve in each round; each
    round is written, so a lost executor costs one round at most. All rounds
    are joins and sums with map-side combining: no component is gathered, and
    nodes with many links and labels of many nodes are looked up apart."""
    both = written(links.union(links.select("b", "a")).toDF("u", "v").where("u <> v").distinct(), "component-links")
    hubs = frequent(both, "v")
    hubs = hubs and written(hubs, "component-hubs")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "component-labels")
    while True:
        around = lookup(both, labels.toDF("v", "l"), "v", hubs).groupBy("u").agg(F.min("l").alias("l"))
        nearer = labels.join(around, labels["node"] == around["u"]).select("node", "label", F.least("label", "l").alias("near"))
        nearer = written(nearer, "component-near")
        hung = lookup(nearer, labels.toDF("near", "head"), "near", frequent(nearer, "near"))
        hung = written(hung.select("node", "label", F.coalesce("head", "near").alias("next")), "component-labels")
        labels = hung.select("node", F.col("next").alias("label"))
        if hung.where("label <> next").isEmpty():
            return labels
