"""Documents to facts: the extraction pipeline end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.body import body_facts
from factloom.operators.predictions import first_wins, numbered, predictions
from factloom.operators.tables import table_facts
from factloom.operators.written import written
from factloom.sources import articles
from factloom.sources.rules import Rules, load_rules
from factloom.sources.sinks import guard_paths, write_predictions


def facts_of(nodes: DataFrame, tables: DataFrame | None, rules: Rules, version: str = "1.2") -> DataFrame:
    """Distinct prediction records of paragraph and table rows."""
    facts = body_facts(nodes, rules, version)
    if tables is not None:
        facts = facts.unionByName(table_facts(tables, rules, version))
    return first_wins(predictions(facts, rules, version))


def extract(spark: SparkSession, folder: str, rules: Rules, version: str = "1.2", prefix: str | None = None) -> DataFrame:
    """Numbered prediction records of a folder of article XML; files come in
    the order of their names. Each is read and parsed once."""
    guard_paths(folder)
    items = written(articles.parsed(articles.files(spark, folder)), "items")
    records = facts_of(articles.nodes(items), articles.tables(items), rules, version)
    return numbered(records, prefix or ("AH11" if version == "1.1" else "AH12"), ("name", "emit_seq"))


def run(spark: SparkSession, folder: str, rules_path: object, out: object, run_mode: str, version: str = "1.2") -> dict:
    """Extract a folder by a rule document and write the predictions beside
    their summary, which is returned. No path may look like reference
    material, nor ``out`` hold anything."""
    guard_paths(folder, rules_path, out)
    rules = load_rules(rules_path)
    n = articles.files(spark, folder).count()
    return write_predictions(extract(spark, folder, rules, version), out, "predictions", rules.version, run_mode, n)
