"""Articles to records: whole small files, then assertions on rows."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators.body import body_facts
from factloom.operators.tagging import hits
from factloom.plans.extraction import extract
from factloom.sources import sinks
from factloom.sources.rules import from_document, load_rules
from factloom.sources.tabular import read_predictions

DOCUMENT = {
    "rules_version": "test",
    "categories": [
        {"category": "Infection", "rule_id": "R1", "patterns": ["infection", "deep infection"]},
        {"category": "Bleeding", "rule_id": "R2", "patterns": ["haematoma", "bleeding"]},
        {"category": "Clot", "rule_id": "R3", "patterns": ["dvt", "vein thrombosis"]},
        {"category": "Numbness", "rule_id": "R4", "patterns": ["numbness"]},
    ],
    "generic_reporting_cues": ["adverse events", "complications"],
    "unmappable_event_patterns": ["skin ulcer", "wound infection"],
    "unclear_event_patterns": ["other events"],
    "body_allowed_section_patterns": ["result"],
    "body_excluded_section_patterns": ["method"],
    "strong_occurrence_patterns": ["occurred", "developed", "observed", "none"],
    "non_event_patterns": ["risk of"],
    "zero_cell_tokens": ["-", "0"],
    "missing_cell_tokens": ["na"],
    "arm_noise_patterns": ["total"],
    "table_safety_context_patterns": ["adverse", "complication"],
    "table_excluded_context_patterns_v1_2": ["baseline", "score"],
    "table_non_event_row_patterns": ["mean"],
    "table_statistical_column_patterns": ["p value"],
    "time_patterns_v1_1": [r"\b\d+\s*(?:days|weeks)\b", r"\bwithin\s+\d+\s*(?:days|weeks)\b"],
    "quote_character_limit": 60,
}
RULES = from_document(DOCUMENT)


def article(*parts, section="Results"):
    return f"<article><body><sec><title>{section}</title>{''.join(parts)}</sec></body></article>"


def wrap(caption, *rows, head="th"):
    cell = lambda c, tag: f"<{tag}>{c}</{tag}>" if isinstance(c, str) else f"<{tag} {c[1]}>{c[0]}</{tag}>"
    body = "".join(f"<tr>{''.join(cell(c, head if i == 0 else 'td') for c in r)}</tr>" for i, r in enumerate(rows))
    return f"<table-wrap><label>Table 1</label><caption><p>{caption}</p></caption><table>{body}</table></table-wrap>"


@pytest.fixture()
def run(spark, tmp_path):
    def extracted(*texts, version="1.2", names=None):
        for i, text in enumerate(texts):
            (tmp_path / f"{(names or 'abcdef')[i]}.nxml").write_text(text, encoding="utf-8")
        return extract(spark, f"file://{tmp_path}", RULES, version).orderBy("prediction_id").collect()

    return extracted


def counts(rows):
    return [(r.raw_event_term, r.arm, r.numerator, r.denominator) for r in rows]


def tagged(spark, text, **more):
    return [(h.start, h.category, h.term) for h in spark.range(1).select(hits(F.lit(text), RULES, **more).alias("h")).first().h]


def test_longest_first_and_disjoint(spark):
    assert tagged(spark, "A deep  infection, then bleeding") == [(2, "Infection", "deep  infection"), (24, "Bleeding", "bleeding")]


def test_generic_cue_only_without_category(spark):
    assert tagged(spark, "Complications and adverse events") == [(18, "Unmappable", "adverse events")]
    assert tagged(spark, "complications: dvt") == [(15, "Clot", "dvt")]


def test_unmappable_where_nothing_overlaps(spark):
    assert tagged(spark, "wound infection; skin ulcer; other events") == [(6, "Infection", "infection"), (17, "Unmappable", "skin ulcer"), (29, "Unclear", "other events")]
    assert tagged(spark, "skin ulcer", extended=False) == []
    assert tagged(spark, "") == [] and tagged(spark, None) == []


def test_offsets_are_code_points(spark):
    assert tagged(spark, "😀 dvt") == [(2, "Clot", "dvt")]


def test_body_gates(run):
    rows = run(
        article("<p>Deep infection occurred in 3 of 20 patients. The risk of dvt occurred in 2 cases. Bleeding was seen somewhere.</p>"),
        article("<p>Deep infection occurred in 3 of 20 patients.</p>", section="Methods"),
    )
    assert counts(rows) == [("Deep infection", None, 3, 20)]
    assert rows[0].prediction_id == "AH12-0001" and rows[0].article_id == "a" and rows[0].poolability == "Transformable"


def test_list_zero_and_overall(run):
    rows = run(article("<p>No infection, haematoma or dvt was observed in either group.</p>"))
    assert counts(rows) == [(t, "Overall", 0, None) for t in ("infection", "haematoma", "dvt")]


def test_paragraphs_in_tables_are_no_body(run):
    assert run(article(wrap("Baseline", ["Event", "A"], ["infection", "3"]))) == []


def test_spans_headers_and_dedup(run):
    t = wrap("Adverse events within 2 weeks", [("Event", 'rowspan="2"'), ("Group A (n=20)", 'colspan="2"')], ["early", "late"], ["infection", "3 (15%)", "-"], ["odd thing", "1", "NA"], ["mean age", "4", "5"])
    rows = run(article(t, t))
    assert [(r.raw_event_term, r.numerator, r.denominator, r.time_window) for r in rows] == [("early", 1, 20, "2 weeks")][:0] + [
        ("infection", 3, 20, "within 2 weeks"), ("infection", 0, 20, "within 2 weeks"), ("odd thing", 1, 20, "within 2 weeks"),
    ]


def test_mixed_table_opens_under_a_safety_subheading(run):
    t = wrap("Baseline and complications", ["x", "A (n=9)"], ["odd", "1"], ["Adverse events", "Adverse events"], ["odd", "2"])
    assert [r.numerator for r in run(article(t))] == [2]


def test_statistics_sizes_and_complements(run):
    t = wrap("Complications", ["Event", "1:2:3", "A", "B", "C", "P value"], ["dvt", "34:32:33", "3", "1", "0", "0.03"])
    assert [(r.numerator, r.denominator) for r in run(article(t))] == [(3, 34), (1, 32), (0, 33)]
    t = wrap("Complications", ["Event", "A (n=56)"], ["dvt", "28:28"], ["bleeding", "3.2 ± 1"])
    assert [(r.numerator, r.denominator, r.rule_id) for r in run(article(t))] == [(28, 56, "R3+TABLE_COUNT_COMPLEMENT")]


def test_transposed(run):
    t = wrap("Complications", ["Group", "n", "DVT", "Bleeding"], ["A", "10", "1", "2"], ["B", "12", "3", "-"], ["P value", "", "0.1", "0.2"])
    assert counts(run(article(t))) == [("DVT", "Group A", 1, 10), ("Bleeding", "Group A", 2, 10), ("DVT", "Group B", 3, 12), ("Bleeding", "Group B", 0, 12)]


def test_caption_event_with_time_rows(run):
    t = wrap("Area of numbness, complications", ["Time", "A (n=31)"], ["2 weeks", "5"])
    assert [(r.raw_event_term, r.numerator, r.time_window) for r in run(article(t))] == [("numbness", 5, "2 weeks")]


def test_first_version(run):
    t = wrap("numbness", ["Time", "A (n=31)"], ["2 weeks", "24.42 ± 3.52"])
    rows = run(article("<p>Infection occurred somewhere here.</p>", t), version="1.1")
    assert [(r.prediction_id, r.numerator, r.denominator, r.poolability) for r in rows] == [("AH11-0001", None, None, "Not poolable"), ("AH11-0002", None, 31, "Not poolable")]


def test_quote_limit_and_flags(run):
    rows = run(article("<p>Infection occurred in 2 patients and in the end this was surely related to it, a serious adverse event.</p>"))
    assert len(rows[0].evidence_quote) == 60 and (rows[0].serious, rows[0].attribution) == ("Yes", "Yes")


def test_numbering_follows_names(run):
    p = article("<p>Infection occurred in 2 patients.</p>")
    assert [r.article_id for r in run(p, p, p, names=["b", "AH-P01_z", "c"])] == ["AH-P01", "b", "c"]


def test_no_files(spark, tmp_path):
    with pytest.raises(Exception):
        extract(spark, f"file://{tmp_path}", RULES).count()


def test_rules_inherit(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "over.json").write_text(json.dumps({"base_rules_file": "base.json", "rules_version": "2", "additional_category_patterns": {"Clot": ["embolus", "dvt"]}}))
    rules = load_rules(tmp_path / "over.json")
    assert rules.version == "2" and [p.text for p in rules.phrases if p.category == "Clot"] == ["dvt", "vein thrombosis", "embolus"]
    with pytest.raises(KeyError):
        from_document({**DOCUMENT, "additional_category_patterns": {"None": ["x"]}})


def test_sinks_round_trip(spark, run, tmp_path):
    run(article("<p>Infection occurred in 2 patients.</p>"))
    records = extract(spark, f"file://{tmp_path}", RULES)
    summary = sinks.write_predictions(records, tmp_path / "out", "predictions", "test", "development", 1)
    assert summary["predictions"] == 1
    data = json.loads((tmp_path / "out/predictions.json").read_text())
    assert data[0]["Numerator"] == 2 and data[0]["Denominator"] == ""
    assert (tmp_path / "out/predictions.csv").read_bytes().startswith(b"\xef\xbb\xbfPrediction ID,")
    back = read_predictions(spark, str(tmp_path / "out/predictions.json")).first()
    assert (back.numerator, back.denominator, back.article_id) == (2, None, "a")
    with pytest.raises(FileExistsError):
        sinks.write_predictions(records, tmp_path / "out", "predictions", "test", "development", 1)
    with pytest.raises(PermissionError):
        sinks.guard_paths("/x/Final_Reference/y")


def test_conditions_reach_the_scan(spark, tmp_path):
    """Costly columns are nodes of their own: a condition on the article goes
    below them, and no random number keeps them in place."""
    rows = [(f"A{i}", "", 0, "Results", "Infection occurred in 2 of 9 patients.", False) for i in range(4)]
    spark.createDataFrame(rows, "article_id string, input_sha256 string, node_seq int, location string, text string, in_table boolean").write.parquet(str(tmp_path / "nodes"))
    facts = body_facts(spark.read.parquet(str(tmp_path / "nodes")), RULES).where("article_id = 'A1'")
    plan = facts._jdf.queryExecution().toString()
    assert "EqualTo(article_id,A1)" in plan.split("PushedFilters")[1].split("\n")[0] and "rand(" not in plan
    assert [(r.article_id, r.numerator, r.denominator) for r in facts.collect()] == [("A1", 2, 9)]
