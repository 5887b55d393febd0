"""From candidate lists to the files of a frozen work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import selection
from factloom.operators.written import written
from factloom.sources.store import new_folder, write_csv, write_json

# Fixed value: the status of a queue that nobody has worked on.
SELECTED = "QUEUE_SELECTED_PREFREEZE_DO_NOT_ANNOTATE_OR_SCORE"


def write_queue(pool: DataFrame, pdf: DataFrame, enriched: DataFrame, folder: object, seed: str, calibration: int = 5, size: int = 50, **caps: int) -> dict:
    """Audit the pool, select the queue, and write eligibility_audit.csv,
    queue.csv, excluded.csv and summary.json into a new folder; the summary.

    pool, pdf and enriched as ``selection.audited`` takes them, each with
    row_no in the order of its file.
    """
    folder = new_folder(folder)
    audit = written(selection.audited(pool, pdf, enriched, seed), "audit")
    columns = [c for c in audit.columns if c != "row_no"]
    eligible = audit.where(F.col("final_eligibility") == selection.ELIGIBLE)
    queued = written(selection.queue(eligible, seed, calibration, size, **caps), "queue")
    role = F.array_position(F.array(*map(F.lit, ("CALIBRATION", "MAIN_EXTERNAL", "RESERVE"))), F.col("queue_role"))
    hashes = {
        "queue": write_csv(folder / "queue.csv", queued.withColumn("_role", role), "_role", "role_order", columns=["queue_role", "role_order", *columns]),
        "eligibility_audit": write_csv(folder / "eligibility_audit.csv", audit, "row_no", columns=columns),
        "excluded": write_csv(folder / "excluded.csv", audit.where(F.col("final_eligibility") != selection.ELIGIBLE), "row_no", columns=columns),
    }
    main = queued.where("queue_role = 'MAIN_EXTERNAL'")
    aip = F.col("publication_version") == selection.AIP
    totals = main.agg(F.count_if(aip).alias("aip"), F.count_if(~aip).alias("vor")).first()
    summary = {
        "status": SELECTED, "seed": seed, "input_candidates": pool.count(), "eligible": eligible.count(), "excluded": audit.count() - eligible.count(),
        "roles": {r.queue_role: r["count"] for r in selection.role_counts(queued).collect()},
        "main_publisher_families": {r.publisher_family: r["count"] for r in main.groupBy("publisher_family").count().orderBy("publisher_family").collect()},
        "main_journals_max": main.groupBy("journal").count().agg(F.max("count")).first()[0], "main_aip": totals.aip, "main_vor": totals.vor,
        "predictions_or_reference_labels_read": False, **{f"{name}_sha256": digest for name, digest in hashes.items()},
    }
    write_json(folder / "summary.json", summary)
    return summary
