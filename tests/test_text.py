"""Text functions on the cases that fix their behaviour."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first().v


L = F.lit


def numbers(value, column):
    r = value(column)
    return r.numerator, r.denominator, r.percentage, r.rule


def test_clean_takes_unicode_white_space(value):
    assert value(T.clean(L("  a  \n b "))) == "a b"
    assert value(T.clean(L(None).cast("string"))) == ""


def test_pdf_clean(value):
    assert value(T.pdf_clean(L("of­ﬁce\x01  ﬂow"))) == "office flow"


@pytest.mark.parametrize("text, found", [("patients studied", False), ("two died.", True), ("prepared", False), ("a PE occurred", True), ("PE", True)])
def test_phrases_are_bounded(value, text, found):
    assert value(T.has_phrase(L(text), ["died", "pe "])) is found


def test_substrings_are_not(value):
    assert value(T.contains_any(L("from here"), ["ROM"])) is True
    assert value(T.contains_any(L("x"), [])) is False


def test_sentences(value):
    assert value(T.sentences(L("One here. Two there!  3 more? ok no. End"))) == ["One here.", "Two there!", "3 more? ok no."]
    assert value(T.sentences(L("0 patients here. 1 patient seen 1"))) == ["0 patients here.", "1 patient seen 1"]
    assert value(T.sentences(L(None).cast("string"))) == []


def test_earliest_time_wins_and_ties_go_to_the_earlier_pattern(value):
    patterns = [r"\b\d+ weeks\b", r"\bwithin \d+ weeks\b", r"\bpacu\b"]
    assert value(T.first_time(L("seen within 2 weeks, in PACU"), patterns)) == "within 2 weeks"
    assert value(T.first_time(L("2 weeks"), [r"\d+ weeks", r"\d+"])) == "2 weeks"
    assert value(T.first_time(L("never"), patterns)) is None


def test_arm(value):
    assert value(T.arm(L("Seen: low dose group later"))) == "low dose group"
    assert value(T.arm(L("Group B had none"))) == "Group B"
    assert value(T.arm(L("no arm here"))) is None


def test_number_is_bound_to_its_clause(value):
    s = "One of 9 fell, 3/20 had bleeding; 5 patients (12.5%) had pain"
    assert numbers(value, T.clause_numbers(T.clause_of(L(s), L(s.index("bleeding"))))) == (3, 20, None, "NUM_RATIO_CLAUSE")
    assert numbers(value, T.clause_numbers(T.clause_of(L(s), L(s.index("pain"))))) == (5, None, 0.125, "NUM_COUNT_PCT_CLAUSE")


@pytest.mark.parametrize(
    "clause, expected",
    [
        ("seven cases of it", (7, None, None, "NUM_WORD_CLAUSE")),
        ("4 knees", (4, None, None, "NUM_COUNT_CLAUSE")),
        ("none at all", (0, None, None, "NUM_ZERO_CLAUSE")),
        ("about 2.5 %", (None, None, 0.025, "NUM_PCT_ONLY")),
        ("some", (None, None, None, "NUM_NONE")),
        ("99999999999999999999 patients", (None, None, None, "NUM_COUNT_CLAUSE")),
    ],
)
def test_clause_rules(value, clause, expected):
    assert numbers(value, T.clause_numbers(L(clause))) == expected


def test_sentence_fallbacks(value):
    s = "No ulcer, hematoma or infection was observed"
    assert numbers(value, T.sentence_numbers(L(s), L(s.index("infection")))) == (0, None, None, "NUM_LIST_ZERO")
    s = "There was two mild deep infections"
    assert numbers(value, T.sentence_numbers(L(s), L(s.index("infections")))) == (2, None, None, "NUM_WORD_BEFORE_TERM")
    s = "stroke: 0/72"
    assert numbers(value, T.sentence_numbers(L(s), L(0))) == (0, 72, None, "NUM_RATIO_LOCAL")


@pytest.mark.parametrize(
    "header, arm, size, time",
    [("Control (n = 20)", "Control", 20, None), ("Group B (100)", "Group B", 100, None), ("Low (100)", "Low (100)", None, None), ("2 weeks", None, None, "2 weeks"), ("Total", None, None, None)],
)
def test_headers(value, header, arm, size, time):
    r = value(T.header_fields(L(header), [r"\b\d+ weeks\b"], ["total"]))
    assert (r.arm, r.denominator, r.time) == (arm, size, time)


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("NA", (None, None, None, "TABLE_MISSING")),
        ("–", (0, None, None, "TABLE_ZERO")),
        ("3/20", (3, None, 20.0, "TABLE_RATIO")),
        ("3 (15%)", (3, None, 0.15, "TABLE_COUNT_PCT")),
        (" 12 ", (12, None, None, "TABLE_COUNT")),
        ("7.5 %", (None, None, 0.075, "TABLE_PCT")),
        ("24.42 ± 3.52", (None, None, None, "TABLE_DESCRIPTIVE_NUMERIC")),
        ("good", (None, None, None, "TABLE_NONNUMERIC")),
    ],
)
def test_cells(value, cell, expected):
    assert numbers(value, T.cell_value(L(cell), ["na"], ["-", "–"])) == expected


def test_strict_ratio(value):
    assert numbers(value, T.cell_value(L("3/20"), [], [], ratio_as_percentage=False)) == (3, 20, None, "TABLE_RATIO")


def test_complements_and_sizes(value):
    assert value(T.complement_count(L("28:28"), L(56))) == 28
    assert value(T.complement_count(L("28:28"), L(55))) is None
    assert value(T.group_sizes(L("34:32 ∶ 33"))) == [34, 32, 33]
    assert value(T.group_sizes(L("34"))) == []


def test_statistical_and_repeated(value):
    assert [value(T.is_statistical_header(L(x), ["95% ci"])) for x in ("P value", "p **", "", "95% CI", "Group P")] == [True, True, True, True, False]
    assert [value(T.is_repeated_row(F.array(*map(L, r)))) for r in (["a", "A "], ["a", ""], ["a", "b"])] == [True, False, False]


def test_comparisons(value):
    assert sorted(value(T.tokens(L("Studies of the glass infections")))) == ["glass", "infection", "study"]
    assert value(T.term_similarity(L("Deep vein"), L("deep-vein"))) == 1.0
    assert value(T.term_similarity(L("vein"), L("deep vein"))) == 0.85
    assert value(T.term_similarity(L(""), L("x"))) == 0.0
    assert value(T.jaccard(L("alpha beta"), L("beta gamma"))) == pytest.approx(1 / 3)
    assert [value(T.numeric_equal(L(a), L(b))) for a, b in (("3", "3.0"), ("", "3"), ("x", "X"), ("3", "4"))] == [True, None, True, False]
    pairs = [("5d", "5"), ("5f", "5"), ("5D", "5d"), ("1_000", "1000"), ("1e3", "+1000."), (" .5", "0.5"), ("nan", "nan"), ("inf", "Infinity"), ("5L", "5"), ("1__0", "10"), ("0x5", "5")]
    assert [value(T.numeric_equal(L(a), L(b))) for a, b in pairs] == [False, False, True, True, True, True, False, False, False, False, False]


def test_tokens(value):
    words = "the Patients of 5 studies, glasses; dies ties classes boss gas % mms a" + " of to" * 3
    assert value(T.tokens(L(words))) == ["study", "glasse", "dies", "ties", "classe", "boss", "gas", "mms"]
    assert value(T.tokens(L(""))) == [] and value(T.tokens(L(None).cast("string"))) == []


def test_canonical_forms(value):
    assert value(T.canonical_arm(L("Both groups combined (n = 30)"))) == "overall"
    assert value(T.canonical_arm(L("Control Group"))) == "control"
    assert value(T.canonical_time(L("within 2 wks and 3–4 mo, hospital stay"))) == "2 weeks | 3-4 months | in-hospital"
    assert value(T.canonical_time(L(None).cast("string"))) == ""


def test_ids(value, spark):
    assert value(T.article_id_of(L("AH-P99_x.nxml"))) == "AH-P99"
    assert value(T.article_id_of(L("a.b.nxml"))) == "a.b"
    assert value(T.short_article_id(L("AH-S2C-012_10_1"))) == "AH-S2C-012"
    with pytest.raises(Exception, match="unrecognised"):
        value(T.short_article_id(L("AH-X")))


def test_layout_lines(value):
    assert value(T.display_compact(L("M AT E R I A L S"))) == "MATERIALS"
    assert [value(T.heading_name(L(x))) for x in ("3. Results", "RESULTS and more", "the results", "R E F E R E N C E S")] == ["Results", "Results", None, "References"]
    assert [value(T.table_label(L(x))) for x in ("TA B L E 2", "Tab. iv notes", "tables 2")] == ["TA B L E 2", "Tab. iv notes", None]
    assert value(T.clean_caption(L("left column sentence goes here Baseline data, Outcomes"))) == "Outcomes"
    assert value(T.split_columns(L("  a b   c  d "))) == ["a b", "c", "d"]
