"""Work queues: eligibility, seeded round-robin, capped selection."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.numbering import with_place, with_place_in
from factloom.operators.written import written

# Statuses in candidate lists.
ELIGIBLE = "ELIGIBLE_ALL_PREFREEZE_GATES"
AIP = "PUBLISHER_AIP_COMPLETE"


def last_by(rows: DataFrame, key: Column, order: str, *columns: str) -> DataFrame:
    """Of rows that share a key, the last in ``order``: key and columns."""
    latest = F.max_by(F.struct(*columns), order).alias("_row")
    return rows.groupBy(key.alias("_key")).agg(latest).select("_key", *(F.col(f"_row.{c}").alias(f"_{c}") for c in columns))


def audited(pool: DataFrame, pdf: DataFrame, enriched: DataFrame, seed: str) -> DataFrame:
    """The pool with host, family, final file, gates and selection_key.

    Lookups are by lower-case doi; of repeated dois in pdf and enriched the
    row with the largest ``row_no`` holds. Rows by the HTML route need no PDF
    audit. Missing values are "".
    """
    doi = F.lower(F.col("doi"))
    host = last_by(enriched, F.lower("doi"), "row_no", "oa_host")
    audit = last_by(pdf, F.lower("doi"), "row_no", "table_format_status", "normalized_file", "normalized_sha256")
    a = pool.withColumn("_doi", doi).join(host.withColumnRenamed("_key", "_doi"), "_doi", "left").join(audit.withColumnRenamed("_key", "_doi").withColumn("_found", F.lit(True)), "_doi", "left")
    html = F.col("source_route") == "AUTOMATED_PUBLISHER_HTML"
    pick = lambda own, other: F.when(html, F.col(own)).otherwise(F.coalesce(F.col(other), F.lit("")))
    gate = F.when(html, "PASS_PUBLISHER_HTML_STRUCTURAL_GATE").when(F.col("_found"), F.col("_table_format_status")).otherwise("MISSING_PDF_AUDIT")
    passes = (
        F.col("document_gate").startswith("PASS")
        & (F.col("old_20_plus_60_overlap_status") == "NO_EXACT_DOI_TITLE_OR_REGISTRY_OVERLAP")
        & F.col("trial_family_status").startswith("PASS")
        & F.col("format_gate_final").startswith("PASS")
        & F.col("publication_version").isin("VOR", AIP)
    )
    return (
        a.withColumn("oa_host", F.coalesce("_oa_host", F.lit("")))
        .withColumn("publisher_family", T.publisher_family(F.col("oa_host")))
        .withColumn("final_normalized_file", pick("normalized_file", "_normalized_file"))
        .withColumn("final_normalized_sha256", pick("normalized_sha256", "_normalized_sha256"))
        .withColumn("format_gate_final", gate)
        .withColumn("final_eligibility", F.when(F.coalesce(passes, F.lit(False)), ELIGIBLE).otherwise(F.concat(F.lit("EXCLUDE_FORMAT_OR_SOURCE_GATE:"), "format_gate_final")))
        .withColumn("selection_key", T.seeded_key(seed, F.col("source_candidate_id"), F.col("source_sha256")))
        .select(*pool.columns, "oa_host", "publisher_family", "final_normalized_file", "final_normalized_sha256", "format_gate_final", "final_eligibility", "selection_key")
    )


def round_robin(rows: DataFrame, seed: str, family: str = "publisher_family", key: str = "selection_key") -> DataFrame:
    """rows with turn (1-based place in their family by key) and family_key;
    (turn, family_key) is the order of a round-robin over families."""
    return with_place_in(rows, family, (key,), "turn").withColumn("family_key", T.seeded_key(seed, "family", F.col(family)))


def first_per_family(ordered: DataFrame, n: int = 5) -> DataFrame:
    """The first of each family, of the first n families to come."""
    return ordered.where("turn = 1").orderBy("family_key").limit(n)


def _behind(row: Row, order: list[str]) -> Column:
    """Whether a row comes after ``row`` in ``order``."""
    behind = F.lit(False)
    for c in reversed(order):
        behind = (F.col(c) > row[c]) | ((F.col(c) == row[c]) & behind)
    return behind


def capped(ordered: DataFrame, size: int = 50, family_cap: int = 20, journal_cap: int = 5, aip_cap: int = 5) -> DataFrame:
    """The rows that a pass in order selects: one is skipped once its family,
    journal or AIP status is at its cap, and the pass ends at ``size``; fewer
    is an error. ``ordered`` is a written table.

    The pass reads the first rows in order, four times as many as are wanted,
    and counts what it takes by family, journal and status. What is at its cap
    then stays so, so the next read leaves its rows out and goes on behind the
    last one seen; the first row of every read is taken, so there are ``size``
    reads at most, each of a few hundred rows, however long the list.
    """
    caps = {"publisher_family": family_cap, "journal": journal_cap, "aip": aip_cap}
    order = ["turn", "family_key", "source_candidate_id"]
    aip = F.coalesce(F.col("publication_version") == AIP, F.lit(False))
    rows = ordered.select(*order, *(F.coalesce(c, F.lit("")).alias(c) for c in ("publisher_family", "journal")), F.when(aip, "aip").alias("aip"))
    taken, counts, last = [], {c: Counter() for c in caps}, None
    while len(taken) < size:
        left = rows if last is None else rows.where(_behind(last, order))
        for c, cap in caps.items():
            if full := [v for v, n in counts[c].items() if n >= cap]:
                left = left.where(F.col(c).isNull() | ~F.col(c).isin(full))
        seen = left.orderBy(*order).limit(4 * size).collect()
        if not seen:
            raise ValueError(f"unable to select {size} under caps; selected {len(taken)}")
        for row in seen:
            if len(taken) < size and all(row[c] is None or counts[c][row[c]] < cap for c, cap in caps.items()):
                taken.append(row.source_candidate_id)
                for c in caps:
                    if row[c] is not None:
                        counts[c][row[c]] += 1
        last = seen[-1]
    return ordered.where(F.col("source_candidate_id").isin(taken))


def queue(eligible: DataFrame, seed: str, calibration: int = 5, size: int = 50, **caps: int) -> DataFrame:
    """queue_role (CALIBRATION, MAIN_EXTERNAL, RESERVE) and role_order before
    the columns of the eligible rows."""
    columns = eligible.columns
    ordered = written(round_robin(eligible, seed), "queue-order")
    first = first_per_family(ordered, calibration)
    rest = written(ordered.join(first.select("source_candidate_id"), "source_candidate_id", "left_anti"), "queue-rest")
    main = capped(rest, size, **caps)
    reserve = rest.join(main.select("source_candidate_id"), "source_candidate_id", "left_anti")
    order = ("turn", "family_key")
    place = F.row_number().over(Window.orderBy(*order))  # of a few rows
    parts = {"CALIBRATION": first.withColumn("role_order", place), "MAIN_EXTERNAL": main.withColumn("role_order", place), "RESERVE": with_place(reserve, order, "role_order")}
    return reduce(DataFrame.unionByName, (rows.select(F.lit(role).alias("queue_role"), F.col("role_order").cast("int").alias("role_order"), *columns) for role, rows in parts.items()))


def role_counts(queued: DataFrame) -> DataFrame:
    return queued.groupBy("queue_role").count()
