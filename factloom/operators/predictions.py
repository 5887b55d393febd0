"""Prediction records: their columns, first-wins distinct, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.numbering import with_place
from factloom.sources.rules import Rules

#: Internal name -> name in sinks, in the order of sinks.
COLUMNS = {
    "prediction_id": "Prediction ID", "article_id": "Article ID", "source_type": "Source Type", "evidence_location": "Evidence Location",
    "evidence_quote": "Evidence Quote", "raw_event_term": "Raw Event Term", "predicted_category": "Predicted Category", "arm": "Arm",
    "numerator": "Numerator", "denominator": "Denominator", "reported_percentage": "Reported Percentage", "count_unit": "Count Unit",
    "time_window": "Time Window", "serious": "Serious", "attribution": "Attribution", "poolability": "Poolability",
    "confidence": "Confidence", "rule_id": "Rule ID", "input_sha256": "Input SHA256",
}
KEY = ("article_id", "source_type", "evidence_location", "raw_event_term", "arm", "numerator", "denominator", "evidence_quote")


def poolability(numerator: Column, denominator: Column, percentage: Column, arm: Column, time: Column, version: str) -> Column:
    n, d, p, a = (c.isNotNull() for c in (numerator, denominator, percentage, arm))
    if version == "1.1":
        return F.when(n & d & a & time.isNotNull(), "Directly poolable").when(p & d, "Transformable").otherwise("Not poolable")
    return F.when(n & d & a, "Directly poolable").when(n | p, "Transformable").otherwise("Not poolable")


def predictions(facts: DataFrame, rules: Rules, version: str = "1.2") -> DataFrame:
    """Records of facts (article_id, source_type, location, quote, hit,
    numerator, denominator, percentage, arm, time, numeric_rule,
    input_sha256, name, emit_seq). Flags look at the whole quote; the record keeps
    its first ``quote_limit`` characters."""
    c = F.col
    some = c("numerator").isNotNull() | c("denominator").isNotNull() | c("percentage").isNotNull()
    sure = (c("hit.category") != "Unmappable") & (c("numeric_rule") != "NUM_NONE")
    flag = lambda pattern: F.when(c("quote").rlike(f"(?iU){pattern}"), "Yes").otherwise("Unclear")
    return facts.select(
        "article_id", "source_type", c("location").alias("evidence_location"), F.substring("quote", 1, rules.quote_limit).alias("evidence_quote"),
        c("hit.term").alias("raw_event_term"), c("hit.category").alias("predicted_category"), "arm", "numerator", "denominator",
        c("percentage").alias("reported_percentage"), F.when(some, "patients").otherwise("Unclear").alias("count_unit"), c("time").alias("time_window"),
        flag(T.SERIOUS).alias("serious"), flag(T.ATTRIBUTED).alias("attribution"),
        poolability(c("numerator"), c("denominator"), c("percentage"), c("arm"), c("time"), version).alias("poolability"),
        F.when(sure, "High").otherwise("Moderate").alias("confidence"), F.concat("hit.rule_id", F.lit("+"), "numeric_rule").alias("rule_id"), "input_sha256", "name", "emit_seq",
    )


def first_wins(records: DataFrame) -> DataFrame:
    """Of a file's records equal in KEY (text ignoring case and white space,
    nulls equal), the one emitted first. The key is hashed to two values, so the
    shuffle spreads any hot article over its records."""
    text = [F.lower(T.clean(F.col(k))) if k in ("raw_event_term", "arm", "evidence_quote") else F.col(k).cast("string") for k in (*KEY, "name")]
    key = F.sha2(F.to_json(F.array(*(F.coalesce(t, F.lit("\x00")) for t in text))), 256)
    order = Window.partitionBy("_key").orderBy("emit_seq", "rule_id", "predicted_category")
    return records.withColumn("_key", key).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_key", "_n")


def numbered(records: DataFrame, prefix: str = "AH12", order: tuple[str, ...] = ("article_id", "emit_seq")) -> DataFrame:
    """prediction_id: the prefix and each record's place, four digits or more."""
    place = F.col("_place")
    number = F.when(place < 10_000, F.lpad(place.cast("string"), 4, "0")).otherwise(place.cast("string"))
    return with_place(records, order, "_place").withColumn("prediction_id", F.concat(F.lit(f"{prefix}-"), number)).drop("_place")


def for_sink(records: DataFrame) -> DataFrame:
    """The records under their names and in their order in sinks."""
    return records.select(*(F.col(k).alias(v) for k, v in COLUMNS.items()))
