"""Queues against a plain sequential version."""

import hashlib
import random

import pytest

from factloom.operators import selection as S
from factloom.operators.governance import check_lock, check_roles, check_seal, file_hashes, freeze, mismatches, same_rows, seal, verify
from factloom.operators.numbering import with_place, with_place_in
from factloom.sources.store import sha256, write_json
from factloom.sources.tabular import read_csv, with_row_no

SEED = "seed"


def candidates(n, seed=1, journals=9):
    rnd = random.Random(seed)
    return [(f"c{i}", rnd.choice("ABCDEF"), f"j{rnd.randrange(journals)}", rnd.choice(["VOR", "VOR", S.AIP]), hashlib.sha256(f"{SEED}|c{i}".encode()).hexdigest()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "source_candidate_id string, publisher_family string, journal string, publication_version string, selection_key string")


def sequential(rows, size, caps):
    families = {}
    for r in sorted(rows, key=lambda r: r[4]):
        families.setdefault(r[1], []).append(r)
    order = sorted(families, key=lambda f: hashlib.sha256(f"{SEED}|family|{f}".encode()).hexdigest())
    robin = [families[f][i] for i in range(max(map(len, families.values()))) for f in order if i < len(families[f])]
    first = [families[f][0] for f in order][:5]
    rest, main = [r for r in robin if r not in first], []
    for r in rest:
        if len(main) < size and sum(m[1] == r[1] for m in main) < caps["family_cap"] and sum(m[2] == r[2] for m in main) < caps["journal_cap"] and not (r[3] == S.AIP and sum(m[3] == S.AIP for m in main) >= caps["aip_cap"]):
            main.append(r)
    return {"CALIBRATION": first, "MAIN_EXTERNAL": main, "RESERVE": [r for r in rest if r not in main]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_queue(spark, seed):
    rows, caps = candidates(150, seed), {"family_cap": 6, "journal_cap": 4, "aip_cap": 5}
    got = {}
    for r in S.queue(frame(spark, rows), SEED, size=25, **caps).orderBy("queue_role", "role_order").collect():
        got.setdefault(r.queue_role, []).append(r.source_candidate_id)
    assert got == {k: [r[0] for r in v] for k, v in sequential(rows, 25, caps).items()}


def test_too_few(spark):
    with pytest.raises(Exception, match="unable to select"):
        S.queue(frame(spark, candidates(20, journals=2)), SEED).collect()


def test_a_long_list_is_read_from_its_front(spark, monkeypatch):
    """Thousands of journals, one family of most rows, caps that bind: as the
    pass over all rows, by reads of a few hundred."""
    rnd = random.Random(11)
    rows = [(f"c{i}", "big" if rnd.random() < 0.8 else f"f{rnd.randrange(4)}", f"j{rnd.choice([0, 1, rnd.randrange(3000)])}", rnd.choice([S.AIP, "VOR"]), f"{rnd.random():.12f}") for i in range(6000)]
    caps, reads = {"family_cap": 20, "journal_cap": 2, "aip_cap": 3}, []
    df = frame(spark, rows)
    collect = type(df).collect
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: reads.append(len(out := collect(self))) or out)
        queued = S.queue(df, SEED, size=25, **caps)
    assert reads and max(reads) <= 100 and len(reads) <= 25
    got = {}
    for r in queued.orderBy("queue_role", "role_order").collect():
        got.setdefault(r.queue_role, []).append(r.source_candidate_id)
    assert got == {k: [r[0] for r in v] for k, v in sequential(rows, 25, caps).items()}


def test_places(spark):
    """Of all rows and in groups, one of which has most; ties, nulls, none."""
    rows = [("g" if i % 10 else None, i % 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    assert [r.place for r in with_place(df, ("a", "b")).orderBy("a", "b").collect()] == list(range(1, 501))
    got = with_place_in(df, "g", ("a", "b")).orderBy("a", "b").collect()
    for g in ("g", None):
        assert [r.place for r in got if r.g == g] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert with_place(df.where("false"), ("a",)).collect() == [] and with_place_in(df.where("false"), "g", ("a",)).collect() == []


def test_audit(spark, tmp_path):
    (tmp_path / "pool.csv").write_text(
        "﻿source_candidate_id,doi,title,journal,source_route,normalized_file,normalized_sha256,document_gate,old_20_plus_60_overlap_status,trial_family_status,publication_version,source_sha256\r\n"
        '1,10/A,"two\nlines",J,AUTOMATED_PUBLISHER_HTML,f,h,PASS,NO_EXACT_DOI_TITLE_OR_REGISTRY_OVERLAP,PASS_X,VOR,s\r\n'
        "2,10/b,t,J,MANUAL_PUBLISHER_PDF,,,PASS,NO_EXACT_DOI_TITLE_OR_REGISTRY_OVERLAP,PASS,VOR,s\r\n"
        "3,10/c,t,J,MANUAL_PUBLISHER_PDF,,,PASS,NO_EXACT_DOI_TITLE_OR_REGISTRY_OVERLAP,PASS,VOR,s\r\n",
        encoding="utf-8",
    )
    pool = read_csv(spark, str(tmp_path / "pool.csv"), ["doi"])
    assert pool.columns[0] == "source_candidate_id" and pool.first().title == "two\nlines"
    pdf = spark.createDataFrame([("10/B", "REVIEW", "x", "y", 1), ("10/b", "PASS_COORDINATE_TABLES", "n", "m", 2)], "doi string, table_format_status string, normalized_file string, normalized_sha256 string, row_no long")
    host = spark.createDataFrame([("10/a", "BioMed Central", 1)], "doi string, oa_host string, row_no long")
    rows = {r.source_candidate_id: r for r in S.audited(pool, pdf, host, SEED).collect()}
    assert (rows["1"].publisher_family, rows["1"].final_eligibility, rows["1"].final_normalized_file) == ("Springer Nature", S.ELIGIBLE, "f")
    assert (rows["2"].publisher_family, rows["2"].format_gate_final, rows["2"].final_normalized_file) == ("Independent/Unresolved", "PASS_COORDINATE_TABLES", "n")
    assert rows["3"].final_eligibility == "EXCLUDE_FORMAT_OR_SOURCE_GATE:MISSING_PDF_AUDIT"
    assert rows["1"].selection_key == hashlib.sha256(b"seed|1|s").hexdigest()
    assert with_row_no(pool).columns[-1] == "row_no"
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "pool.csv"), ["none"])


def test_capsule(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.json"
    a.write_text("x")
    b.write_text("[1, 2]")
    q = spark.createDataFrame([("MAIN",), ("MAIN",)], "queue_role string")
    manifest = freeze(tmp_path / "capsule", {"a.txt": a}, {"b.json": b}, q, {"MAIN": 2})
    assert manifest["files"]["inputs/a.txt"] == sha256(a)
    with pytest.raises(ValueError):
        check_roles(q, {"MAIN": 3})
    with pytest.raises(FileExistsError):
        freeze(tmp_path / "capsule", {}, {})
    found = file_hashes(spark, f"file://{tmp_path}/capsule/inputs")
    expected = spark.createDataFrame([("a.txt", sha256(a)), ("c.txt", "0")], "name string, sha256 string")
    assert [r.name for r in mismatches(expected, found).collect()] == ["c.txt"]
    document = seal(b, [a], tmp_path / "seal.json")
    assert document["prediction_count"] == 2 and check_seal(tmp_path / "seal.json", b, a) == document
    b.write_text("[1]")
    with pytest.raises(ValueError, match="sealed"):
        check_seal(tmp_path / "seal.json", b)
    write_json(tmp_path / "lock.json", {"status": "FINAL_LOCKED_BEFORE_PREDICTION_ACCESS", "files": {"a.txt": sha256(a)}})
    assert check_lock(tmp_path / "lock.json", a)
    with pytest.raises(ValueError):
        check_lock(tmp_path / "lock.json", b)
    rerun = lambda capsule, out: (out / "r.txt").write_text((capsule / "inputs/a.txt").read_text())
    assert verify(tmp_path / "capsule", rerun, {"r.txt": sha256(a)}, tmp_path / "v1")["status"] == "PASS"
    (tmp_path / "capsule/inputs/a.txt").write_text("y")
    assert verify(tmp_path / "capsule", rerun, {"r.txt": sha256(a)}, tmp_path / "v2")["status"] == "FAIL"
    one = spark.range(3)
    assert same_rows(one, spark.range(3)) and not same_rows(one, one.union(one))
