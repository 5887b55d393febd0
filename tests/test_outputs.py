"""Files that plans write, and PDF files by a tool that is handed in."""

import csv
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators.governance import REFERENCE_LOCKED, freeze, input_records, seal
from factloom.operators.predictions import COLUMNS
from factloom.plans import adapters, catalog, extraction, queueing, scoring
from factloom.plans import catalog_scoring as C
from factloom.plans.catalog_articles import ORDER_DOCUMENT, ORDER_RULES
from factloom.sources import coordinates, layout, pdf, sinks, store
from factloom.sources.articles import files, parsed
from factloom.sources.tabular import read_csv


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", b"one"), ("b.txt", None), ("c.txt", b"")], "name string, content binary")
    made = {r.name: (r.sha256, r.n_bytes) for r in sinks.write_files(rows, f"file://{tmp_path}/out").collect()}
    assert {p.name for p in (tmp_path / "out").iterdir()} == set(made) == {"a.txt", "b.txt", "c.txt"}
    assert (tmp_path / "out/a.txt").read_bytes() == b"one" and all(store.sha256(tmp_path / "out" / n) == h for n, (h, _) in made.items())
    again = sinks.write_files(rows.withColumn("content", F.lit(b"new")), f"file://{tmp_path}/out")
    assert again.count() == 3 and (tmp_path / "out/b.txt").read_bytes() == b"new"


def as_csv(rows, columns):
    text = io.StringIO(newline="")
    writer = csv.DictWriter(text, columns, extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    return text.getvalue().encode("utf-8-sig")


@pytest.mark.parametrize("n", [0, 1, 500])
def test_single_files_are_written_by_tasks(spark, tmp_path, n):
    """Byte for byte what one writer gives, from many pieces, in order."""
    rows = [(i * 7919 % 1009, 'a "q", \n é' * (i % 3), None if i % 4 else i / 3, i % 2 == 0, (i, None)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, t string, x double, b boolean, s struct<i:int,j:string>").repartition(7)
    plain = [{"k": k, "t": t, "x": "" if x is None else x, "b": b, "s": {"i": s[0], "j": s[1]}} for k, t, x, b, s in sorted(rows)]
    folder = tmp_path / "some place"
    folder.mkdir()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (count, array), (_, table) = store.write_ordered(df, ["k"], store.JsonArray(f"{folder}/a.json", tuple(df.columns)), store.CsvFile(f"{folder}/a.csv", ("t", "k", "x"), n == 0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert count == n and (folder / "a.json").read_text() == json.dumps(plain, ensure_ascii=False, indent=2) + "\n"
    assert (folder / "a.csv").read_bytes() == as_csv(plain, ["t", "k", "x"])
    assert (array, table) == (store.sha256(folder / "a.json"), store.sha256(f"file://{folder}/a.csv")) and len(list(folder.iterdir())) == 2
    assert store.write_csv(folder / "none.csv", df.where("false"), "k") == hashlib.sha256(b"").hexdigest() and (folder / "none.csv").read_bytes() == b""


def test_files_are_copied_and_hashed_by_tasks(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b").write_bytes(b"")
    copied = store.copy_files({"one": tmp_path / "a", "two": f"file://{tmp_path}/b"}, store.Place(tmp_path / "to"))
    assert copied == {"one": store.sha256(tmp_path / "a"), "two": hashlib.sha256(b"").hexdigest()} and (tmp_path / "to/one").read_bytes() == b"x" * 3_000_000
    assert store.hashes({"one": tmp_path / "to/one", "none": tmp_path / "none"}) == {"one": copied["one"], "none": None} and store.hashes({}) == {}
    with pytest.raises(Exception):
        store.copy_files({"none": tmp_path / "none"}, store.Place(tmp_path / "to"))


def test_scoring_wants_a_lock_and_a_seal(spark, tmp_path):
    """Checked before anything is read; then a run, once."""
    harm = {"event_id": "G1", "article_id": "AH-S2C-001", "evidence_quote_raw": "alpha beta gamma", "event_term_raw": "alpha", "category_canonical": "C", "numerator_value": "2"}
    document = {"status": REFERENCE_LOCKED, "articles": [{"article_id": "AH-S2C-001", "eligible": "yes", "harms_status": "Yes", "publication_version": "VOR"}], "harms": [harm]}
    paths = {n: tmp_path / f"{n}.json" for n in ("reference", "lock", "predictions", "seal")}
    store.write_json(paths["reference"], document)
    values = {"prediction_id": "P1", "article_id": "AH-S2C-001_x", "evidence_quote": "alpha beta gamma", "raw_event_term": "alpha", "predicted_category": "C", "numerator": 2}
    store.write_json(paths["predictions"], [{v: values.get(k, "") for k, v in COLUMNS.items()}])
    seal(paths["predictions"], [], paths["seal"])
    run = lambda out: scoring.score_locked(spark, paths["reference"], paths["lock"], paths["predictions"], paths["seal"], out, "label", replicates=20)
    store.write_json(paths["lock"], {"status": REFERENCE_LOCKED, "files": {"reference.json": "0"}})
    with pytest.raises(ValueError, match="locked"):
        run(tmp_path / "early")
    store.write_json(paths["lock"], {"status": REFERENCE_LOCKED, "files": {"reference.json": store.sha256(paths["reference"])}})
    out = run(tmp_path / "out")
    assert out["main"]["event_level"]["TP"] == 1 and out["main"]["event_level"]["recall"] == 1.0 and out["aip"]["event_level"]["TP"] == 0
    with pytest.raises(FileExistsError):
        run(tmp_path / "out")
    paths["predictions"].write_text("[]")
    with pytest.raises(ValueError, match="sealed"):
        run(tmp_path / "late")
    assert not (tmp_path / "early").exists() and not (tmp_path / "late").exists()


def test_extraction_refuses_reference_paths(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(ORDER_DOCUMENT))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nxml").write_text("<article><body><sec><title>Results</title><p>Water damage occurred in 2 of 9 patients.</p></sec></body></article>")
    with pytest.raises(PermissionError):
        extraction.extract(spark, f"file://{tmp_path}/Reference_Standard", None)
    with pytest.raises(PermissionError):
        extraction.run(spark, f"file://{tmp_path}/in", tmp_path / "rules.json", tmp_path / "final_reference", "development")
    summary = extraction.run(spark, f"file://{tmp_path}/in", tmp_path / "rules.json", tmp_path / "out", "external-blind")
    assert (summary["predictions"], summary["xml_files"], summary["development_only"]) == (1, 1, False)
    with pytest.raises(FileExistsError):
        extraction.run(spark, f"file://{tmp_path}/in", tmp_path / "rules.json", tmp_path / "out", "external-blind")


def test_files_equal_in_id_and_content_stay_apart(spark, tmp_path):
    for name in ("AH-P01_a", "AH-P01_b"):
        (tmp_path / f"{name}.nxml").write_text("<article><body><sec><title>Results</title><p>Loss was observed in 2 cases.</p><p>Loss was observed in 2 cases.</p></sec></body></article>")
    rows = extraction.extract(spark, f"file://{tmp_path}", ORDER_RULES).orderBy("prediction_id").collect()
    assert [(r.prediction_id, r.name) for r in rows] == [("AH12-0001", "AH-P01_a.nxml"), ("AH12-0002", "AH-P01_b.nxml")]


def test_predictions_beyond_four_digits_are_in_order(spark, tmp_path):
    ids = [f"AH12-{n:04d}" for n in (10_001, 9_999, 1, 10_000)]
    rows = spark.createDataFrame([(i,) for i in ids], "prediction_id string").select("prediction_id", *(F.lit("x").alias(c) for c in COLUMNS if c != "prediction_id"))
    sinks.write_predictions(rows, tmp_path / "out", "p", "v", "development", 1)
    assert [r["Prediction ID"] for r in json.loads((tmp_path / "out/p.json").read_text())] == ["AH12-0001", "AH12-9999", "AH12-10000", "AH12-10001"]


def test_queue_files(spark, tmp_path):
    pool, pdf_audit, hosts = C._pool(spark, "/root/testdata/sf0.01")
    summary = queueing.write_queue(pool, pdf_audit, hosts, tmp_path / "queue", "seed")
    assert summary["roles"]["CALIBRATION"] == 5 and summary["main_aip"] + summary["main_vor"] == 50 == sum(summary["main_publisher_families"].values())
    assert summary["input_candidates"] == summary["eligible"] + summary["excluded"] and summary["main_journals_max"] <= 5 and summary["main_aip"] <= 5
    rows = read_csv(spark, f"file://{tmp_path}/queue/queue.csv").collect()
    assert rows[0].queue_role == "CALIBRATION" and [int(r.role_order) for r in rows[5:55]] == list(range(1, 51)) and "row_no" not in rows[0]
    assert json.loads((tmp_path / "queue/summary.json").read_text()) == summary
    with pytest.raises(FileExistsError):
        queueing.write_queue(pool, pdf_audit, hosts, tmp_path / "queue", "seed")


def test_manifest_records_every_input(spark, tmp_path):
    (tmp_path / "x.nxml").write_text("x")
    (tmp_path / "y.nxml").write_text("y")
    inputs = {"x.nxml": tmp_path / "x.nxml", "y.nxml": tmp_path / "y.nxml"}
    columns = "source_candidate_id string, doi string, queue_role string, role_order int, publication_version string, publisher_family string, journal string, final_normalized_file string, final_normalized_sha256 string, source_sha256 string"
    row = lambda i, file, digest: (f"C{i}", "10/x", "MAIN", i, "VOR", "F", "J", file, digest, "s")
    good = [row(2, "y.nxml", store.sha256(tmp_path / "y.nxml")), row(1, "x.nxml", store.sha256(tmp_path / "x.nxml"))]
    manifest = freeze(tmp_path / "capsule", inputs, {}, spark.createDataFrame(good, columns), {"MAIN": 2})
    assert manifest["input_count"] == 2 and [r["input_file"] for r in manifest["inputs"]] == ["x.nxml", "y.nxml"] and manifest["queue_roles"] == {"MAIN": 2}
    for bad, error in (([row(1, "z.nxml", "")], FileNotFoundError), ([row(1, "x.nxml", "0")], ValueError), ([good[0], good[0]], ValueError)):
        with pytest.raises(error):
            input_records(spark.createDataFrame(bad, columns), inputs)


def test_normalised_articles_are_written(spark, tmp_path):
    main = spark.createDataFrame([("10/a", "success", "a.html", '<h1 class="article-title">T</h1><section data-title="Results">' + "<p>x</p>" * 5 + "</section>")], "doi string, download_status string, local_file string, html string")
    made = adapters.html_articles(main, spark.createDataFrame([], "doi string, status string, local_file string, html string"))
    summary = adapters.write_normalised(made, f"file://{tmp_path}/nxml", tmp_path / "audit")
    assert summary["normalized_articles"] == 1 and summary["structural_status"] == {"PASS": 1} and (tmp_path / "audit/summary.json").exists()
    assert parsed(files(spark, f"file://{tmp_path}/nxml")).count() == 5 and (tmp_path / "nxml/AH-S2C-001_10_a.nxml").exists()


def test_pdf_files_by_a_tool_handed_in(spark, tmp_path):
    (tmp_path / "AH-V001_x.pdf").write_bytes(b"lead\n\nResults\nsome")
    found = pdf.files(spark, f"file://{tmp_path}")
    said = pdf.texts(found, lambda content: content.decode(), lambda content: "Table 1\n  Variable   Group\n  early   2\n  late   3")
    assert [(r.section, r.text) for r in layout.plain_sections(said).orderBy("section_seq").collect()] == [("Article body", "lead"), ("Results", "some")]
    assert layout.parsed_layout(said).count() == 1

    def read(content):
        word = lambda text, x0, top: {"text": text, "x0": x0, "x1": x0 + 9.0, "top": top, "bottom": top + 8.0}
        yield {"width": 600.0, "height": 800.0, "words": [], "edges": []}
        yield {"width": 600.0, "height": 800.0, "words": [word("Table", 50.0, 90.0), word("2", 62.0, 90.0), word("a", 60.0, 130.0), word("b", 200.0, 130.0), word("c", 60.0, 150.0), word("7", 200.0, 150.0)], "edges": [{"x0": 40.0, "x1": 300.0, "top": t} for t in (110.0, 180.0)]}

    pages = pdf.pages(found, read)
    assert [r.page for r in pages.orderBy("page").collect()] == [1, 2]
    table = coordinates.coordinate_tables(pages).first()
    assert (table.article_id, table.page, table.label, table.grid) == ("AH-V001", 2, "Table 2", [["a", "b"], ["c", "7"]])
    with pytest.raises(Exception):
        pdf.pdftotext("no-such-command")(b"")


@pytest.mark.parametrize("name", ["pdf_texts", "pdf_tables"])
def test_files_of_one_article_are_all_read(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, f"Supplier {k}", k % 25) for k in (7, 1007, 2007, 12)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    found = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(found) == sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["pdf_texts", "pdf_tables"])
def test_files_of_equal_keys_and_odd_names_are_all_read(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    said = [(7, "same"), (7, "same"), (7, "other"), (8, None), (9, ""), (10, " a  b "), (11, "a\nb"), (12, "x\n\nReferences\ny"), (13, "a\fb"), (14, "o\ufb03ce\xad\u2028\xa0\x01"), (15, "100% ~+%41"), (-5, "n"), (2**40, "big"), (None, "no key")]
    spark.createDataFrame([(k, n, 3) for k, n in said], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    found = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(found, key=repr) == sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall(), key=repr)
