"""CSV and JSON inputs, all values as strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from factloom.operators.predictions import COLUMNS


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, quoted newlines and an optional byte-order mark.
    Missing values are "", as the selection rules have it. ``columns`` are
    those that must be there; without them the header decides."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', quote='"', inferSchema=False, nullValue="\x00", emptyValue="").csv(path)
    if missing := set(columns or ()) - set(rows.columns):
        raise ValueError(f"{path} has no column {sorted(missing)}")
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


def with_row_no(rows: DataFrame) -> DataFrame:
    """row_no grows with the order of a file's rows, so that of repeated keys
    the last can win."""
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A sink's array of records back under internal names; "" is null, and
    numbers are typed."""
    schema = S.StructType([S.StructField(v, S.StringType()) for v in COLUMNS.values()])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    kinds = {"numerator": "bigint", "denominator": "bigint", "reported_percentage": "double"}
    out = {k: F.nullif(F.col(f"`{v}`"), F.lit("")).alias(k) for k, v in COLUMNS.items()}
    return rows.select(*(F.nullif(F.col(f"`{COLUMNS[k]}`"), F.lit("")).try_cast(kinds[k]).alias(k) if k in kinds else c for k, c in out.items()))


ARTICLES = "article_id string, eligible string, harms_status string, publication_version string"
HARMS = (
    "event_id string, article_id string, evidence_quote_raw string, event_term_raw string, category_canonical string, numerator_value string, "
    "denominator_value string, arm_raw string, arm_canonical string, time_raw string, time_canonical string, poolability string"
)


def read_reference(spark: SparkSession, path: str, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """articles and harms of a reference document; ``status``, if given, is
    what its status must be."""
    whole = spark.read.schema(f"status string, articles array<struct<{_fields(ARTICLES)}>>, harms array<struct<{_fields(HARMS)}>>").json(path, multiLine=True)
    if status is not None:
        whole = whole.withColumn("_ok", F.when(F.col("status") == status, True).otherwise(F.raise_error(F.concat(F.lit("unexpected reference status: "), F.coalesce("status", F.lit("null")))).cast("boolean"))).where("_ok")
    return whole.select(F.inline("articles")), whole.select(F.inline("harms"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split() for f in ddl.split(", ")))
