"""Body extraction on streams: every stage up to distinct is row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.operators.body import body_facts
from factloom.operators.predictions import predictions
from factloom.sources.rules import Rules


def stream_facts(nodes: DataFrame, rules: Rules) -> DataFrame:
    """Prediction records of a stream of paragraph rows (see body_facts),
    without state: duplicates and numbers are a matter of whole batches, to be
    settled in ``foreachBatch`` or downstream."""
    return predictions(body_facts(nodes, rules), rules)
