"""Facts from paragraphs: sentences, gates, tags, numbers, times, arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.tagging import reported_hits
from factloom.sources.rules import Rules

RESULT_NUMBER = r"\b\d+\s*(?:/|of|\(|patients?|cases?|subjects?)"


def file_name(rows: DataFrame) -> Column:
    return F.col("name") if "name" in rows.columns else F.lit(None).cast("string").alias("name")


def sentence_rows(nodes: DataFrame) -> DataFrame:
    """A row per sentence of nodes (article_id, node_seq, location, text,
    in_table, input_sha256, and name, if they are from files) that stand in no
    table, with sentence_seq."""
    return nodes.where(~F.coalesce("in_table", F.lit(False))).select(
        "article_id", "input_sha256", file_name(nodes), "node_seq", F.coalesce("location", F.lit("Body")).alias("location"), F.posexplode(T.sentences(F.col("text"))).alias("sentence_seq", "sentence")
    )


def section_allowed(location: Column, rules: Rules) -> Column:
    """Sections that may report events."""
    return ~T.contains_any(location, rules.sections_excluded) & T.contains_any(location, rules.sections_allowed)


def body_facts(nodes: DataFrame, rules: Rules, version: str = "1.2") -> DataFrame:
    """Facts of paragraphs, one per sentence and event it names.

    Version 1.2 wants a word of occurrence or a number and drops events
    without a number; 1.1 wants the word and keeps all. Null text has no
    sentence.
    """
    s, new = F.col("sentence"), version != "1.1"
    found = reported_hits(s, rules, new, RESULT_NUMBER if new else None)
    tagged = sentence_rows(nodes.where(section_allowed(F.coalesce("location", F.lit("Body")), rules))).select("*", F.posexplode(found).alias("hit_seq", "hit"))
    clauses = T.with_once(tagged, "clause", T.clause_of(s, F.col("hit.start")))
    counted = T.with_once(clauses, "numbers", T.clause_numbers(F.col("clause")))
    if new:
        whole = F.when(F.col("numbers.rule") == "NUM_NONE", T.sentence_numbers(s, F.col("hit.start"))).otherwise(F.col("numbers"))
        counted = T.with_once(counted, "numbers", whole).where("numbers.rule <> 'NUM_NONE'")
    arm = T.arm(s)
    if new:
        arm = F.when(s.rlike(f"(?iU){T.OVERALL_ARM}"), "Overall").otherwise(arm)
    zero = F.lit(0)
    return counted.select(
        "article_id", "input_sha256", "name", F.lit("Body").alias("source_type"), "location", s.alias("quote"), "hit", "numbers.numerator", "numbers.denominator", "numbers.percentage",
        F.col("numbers.rule").alias("numeric_rule"), arm.alias("arm"), T.first_time(s, rules.times).alias("time"),
        F.struct(zero.alias("branch"), F.col("node_seq").cast("int").alias("a"), F.col("sentence_seq").alias("b"), zero.alias("c"), F.col("hit_seq").alias("d")).alias("emit_seq"),
    )
