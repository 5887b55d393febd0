"""Scoring of predictions against a reference, whole and by version."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluation as E
from factloom.operators.governance import REFERENCE_LOCKED, SCORED, check_lock, check_seal, now
from factloom.operators.written import written
from factloom.sources.store import Place, new_folder, sha256, write_csv, write_json, write_json_array
from factloom.sources.tabular import read_predictions, read_reference

VERSIONS = {"vor": "VOR", "aip": "PUBLISHER_AIP_COMPLETE"}


def evaluate(articles: DataFrame, gold: DataFrame, predicted: DataFrame, seed_label: str, replicates: int = E.REPLICATES) -> dict[str, DataFrame]:
    """matches, false_positives, false_negatives, events, bootstrap, fields
    and counts, each a table."""
    matches, *errors = E.outcomes(articles, gold, predicted)
    positives, negatives = (written(rows, "errors") for rows in errors)
    counts = E.article_counts(articles, matches, positives, negatives)
    return {
        "matches": matches, "false_positives": positives, "false_negatives": negatives, "counts": counts,
        "events": E.event_metrics(matches, positives, negatives), "bootstrap": E.bootstrap(counts, seed_label, replicates), "fields": E.field_metrics(matches, gold, predicted),
    }


def universe(articles: DataFrame, gold: DataFrame, predicted: DataFrame) -> dict:
    ids = E.eligible_ids(articles)
    return {
        "articles_total": articles.count(), "articles_included": ids.count(), "reference_events": gold.count(), "predictions_total": predicted.count(),
        "predictions_evaluated": predicted.join(ids, "article_id", "left_semi").count(), "predictions_from_excluded_articles": predicted.join(ids, "article_id", "left_anti").count(),
    }


def metrics(result: dict[str, DataFrame]) -> dict:
    """The metrics document of an evaluation: three rows of one line each."""
    one = lambda name: result[name].first().asDict(recursive=True)
    interval = lambda x: [x["low"], x["high"]]
    events = one("events")
    level = {k.upper() if k in ("tp", "fp", "fn") else k: interval(v) if k.endswith("_ci95") else v for k, v in events.items()}
    level["article_cluster_bootstrap_ci95"] = {"method": "article-cluster percentile bootstrap", **one("bootstrap")}
    fields = {k: {**v, "ci95": interval(v["ci95"])} for k, v in one("fields").items()}
    return {"event_level": level, "field_metrics_conditional_on_event_match": fields}


def score(articles: DataFrame, gold: DataFrame, predicted: DataFrame, folder: object, seed_label: str, replicates: int = E.REPLICATES) -> dict:
    """Normalise article ids, evaluate the whole and each version, and write
    metrics, matches, errors, crosswalk, article signals, audit and lock."""
    folder = new_folder(folder)
    own, missing = E.normalised(predicted, articles)
    write_json_array(folder / "prediction_subset.json", own, "prediction_id")
    write_csv(folder / "article_id_crosswalk.csv", E.crosswalk(predicted, articles), "sealed_article_id")
    parts = {"main": (articles, gold, own)} | {name: E.subset(articles, gold, own, version) for name, version in VERSIONS.items()}

    def part(name: str) -> dict:
        result = evaluate(*parts[name], seed_label, replicates)
        document = {"evaluation_universe": universe(*parts[name]), **metrics(result)}
        write_json(folder / f"{name}_metrics.json", document)
        write_csv(folder / f"{name}_matches.csv", E.flat_matches(result["matches"], *parts[name][1:]), "event_id")
        write_csv(folder / f"{name}_false_positives.csv", result["false_positives"], "prediction_id")
        write_csv(folder / f"{name}_false_negatives.csv", result["false_negatives"], "event_id")
        return document

    # Their jobs are many and small, and hang on nothing of one another.
    with ThreadPoolExecutor(len(parts)) as pool:
        out = dict(zip(parts, pool.map(part, parts)))
    hashes = {f"{name}_metrics.json": sha256(folder / f"{name}_metrics.json") for name in parts}
    excluded = articles.where(F.lower(F.trim("eligible")) != "yes").select("article_id")
    write_csv(folder / "main_predictions_from_excluded_articles.csv", own.join(excluded, "article_id", "left_semi"), "prediction_id")
    signals = E.article_signals(articles, own)
    write_csv(folder / "article_signal_classification.csv", signals, "article_id")
    out["articles"] = E.confusion(signals).first().asDict(recursive=True)
    write_json(folder / "article_signal_metrics.json", out["articles"])
    audit = {"status": "PASS", "execution_utc": now(), "derived_files": hashes, "main_articles_without_predictions": sorted(r.article_id for r in missing.toLocalIterator())}
    write_json(folder / "scoring_audit.json", audit)
    write_json(folder / "scoring_lock.json", {"status": SCORED, "locked_at": audit["execution_utc"], **{f"{k}_sha256": v for k, v in hashes.items()}, "execution_audit_sha256": sha256(folder / "scoring_audit.json")})
    return out


def score_locked(spark: SparkSession, reference: object, lock: object, predictions: object, seal: object, folder: object, seed_label: str, manifest: object = None, replicates: int = E.REPLICATES) -> dict:
    """Score sealed predictions against a locked reference, both files. The
    lock and the seal are checked before either is read, and a folder that
    exists is refused, so that a run can be made once."""
    check_lock(lock, reference)
    check_seal(seal, predictions, manifest)
    articles, gold = read_reference(spark, Place(reference).uri, REFERENCE_LOCKED)
    return score(articles, gold, read_predictions(spark, Place(predictions).uri), folder, seed_label, replicates)
