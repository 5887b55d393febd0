"""Text functions as Column expressions; nothing here runs Python on rows.

A missing value is null inside the engine and "" only in sinks, so 0 stays a
value. Regular expressions carry ``U`` where the source semantics are Unicode
ones (white space, digits, word boundaries) and ``i`` where case is ignored.
Offsets are code points from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the rule language has it: Unicode's, and four separators.
WHITE = r"(?U)[\s\x1C-\x1F]+"

NUMBERS = "struct<numerator:bigint,denominator:bigint,percentage:double,rule:string>"

# ---- fixed values: patterns, words and names that results depend on ----

NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
UNITS = r"(?:patients?|participants?|subjects?|cases?|knees?)"
RATIO = r"\b(\d+)\s*(?:/|of|out of)\s*(\d+)\b"
ARM_PATTERNS = (
    r"\b(?:the\s+)?([A-Za-z][A-Za-z0-9+/-]{0,20}(?:\s+[A-Za-z][A-Za-z0-9+/-]{0,20}){0,3}\s+group)\b",
    r"\b(group\s+[A-Za-z0-9]+)\b",
    r"\b(intervention|control|placebo)\s+(?:arm|group)\b",
)
OVERALL_ARM = r"\b(?:both|either|all)\s+(?:groups?|arms?)\b"
LIST_ZERO = r"\b(?:no|none|neither)\b.{0,500}\b(?:observed|detected|reported|occurred|found|encountered|recorded|noted|suffered\s+from)\b"
SERIOUS = r"\b(?:serious adverse events?|SAEs?)\b"
ATTRIBUTED = r"\b(?:related to|attributable to|caused by|due to)\b"
STOPWORDS = (
    "a an the and or of to in on for with without from by at as is was were are be been being this that these those "
    "patient patients participant participants group groups postoperative postoperatively after before during study "
    "trial reported reports reporting"
).split()
ARM_ALIASES = (
    ("both groups combined", "overall"),
    ("all groups combined", "overall"),
    ("either group", "overall"),
    ("combined", "overall"),
    ("total", "overall"),
    ("overall", "overall"),
    ("control group", "control"),
    ("control arm", "control"),
)
TIME_UNITS = {
    "h": "hours",
    "hr": "hours",
    "hrs": "hours",
    "hour": "hours",
    "hours": "hours",
    "d": "days",
    "day": "days",
    "days": "days",
    "w": "weeks",
    "wk": "weeks",
    "wks": "weeks",
    "week": "weeks",
    "weeks": "weeks",
    "mo": "months",
    "mos": "months",
    "month": "months",
    "months": "months",
    "y": "years",
    "yr": "years",
    "yrs": "years",
    "year": "years",
    "years": "years",
}
TIME_PAIR = r"(\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?)\s*(hours?|hrs?|h|days?|d|weeks?|wks?|wk|w|months?|mos?|years?|yrs?|yr|y)\b"
COUNT_PERCENT = rf"\b(\d+)\s*{UNITS}?\s*\((\d+(?:\.\d+)?)\s*%\)"
COUNT = rf"\b(\d+)\s+{UNITS}\b"
WORD_COUNT = rf"\b({'|'.join(NUMBER_WORDS)})\s+{UNITS}\b"
PERCENT = r"\b(\d+(?:\.\d+)?)\s*%"
ZERO = r"\b(?:no|none|zero)\b"
THERE_WAS_NO = r"\bthere\s+(?:was|were|are)\s+no\b"
WORD_BEFORE = rf"\b({'|'.join(NUMBER_WORDS)})\s+[A-Za-z-]+(?:\s+[A-Za-z-]+){{0,3}}\s*$"
HEADER_SIZE = r"\(?\s*[nN]\s*=\s*\d+\s*\)?"
HEADER_NOISE = r"\b(?:p\s*[- ]?value|no\.?|number|%)\b"
SIZE = r"\bn\s*=\s*(\d+)\b"
BARE_SIZE = r"\(\s*(\d+)\s*\)\s*$"
GROUP_WORD = r"\b(?:group|arm)\b"
CELL_RATIO = r"\b(\d+)\s*/\s*(\d+)\b"
CELL_COUNT_PERCENT = r"\b(\d+)\s*\((\d+(?:\.\d+)?)\s*%?\)"
COMPLEMENT = r"^(\d+)\s*[:∶]\s*(\d+)$"
SIZES = r"^\d+(?:\s*[∶:]\s*\d+){1,8}$"
P_VALUE = r"^p(?:\s*[- ]?value)?(?:\s*\*+)?$"


# ---- white space and phrases ----


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, however often it is used. For
    what is used inside arrays; elsewhere common subexpressions are computed
    once by generated code, and arrays would take them out of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` as a column that is computed once, in a node of
    its own: the only element of an array that is taken apart. A condition on
    it stays above that node, where the optimiser would else compute the value
    in the condition as well; conditions on other columns go below."""
    others = [F.col(f"`{c}`") for c in rows.columns if c != name]
    return rows.select(*others, F.explode(F.array(value)).alias(name))


def clean(text: Column) -> Column:
    """White space collapsed to single blanks and stripped; null is ""."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def pdf_clean(text: Column) -> Column:
    """As clean, without soft hyphens, f-ligatures and what XML forbids."""
    text = F.coalesce(text, F.lit(""))
    for old, new in (("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return clean(F.regexp_replace(text, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", ""))


def strip(text: Column, characters: str = r" |:\-") -> Column:
    return F.regexp_replace(text, f"^[{characters}]+|[{characters}]+$", "")


def literal(phrase: str) -> str:
    """A Java pattern for the phrase: blanks match any white space."""
    return "".join(r"[\s\x1C-\x1F]+" if c == " " else c if c.isalnum() else f"\\{c}" for c in phrase.strip())


def bounded(*phrases: str) -> str:
    """A pattern for any of the phrases between non-alphanumerics."""
    return rf"(?iU)(?<![A-Za-z0-9])(?:{'|'.join(map(literal, phrases))})(?![A-Za-z0-9])"


def has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike(bounded(*phrases)) if phrases else F.lit(False)


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether any part occurs anywhere, inside words too, ignoring case."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.lower(text), F.lit(part.lower()))
    return found


def search(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match ignoring case; null if there is none, or
    nothing in it."""
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(""))


def sentences(text: Column) -> Column:
    """The sentences of a text: split behind . ! ? before a capital or digit,
    eight characters at least."""
    parts = F.transform(F.split(clean(text), r"(?<=[.!?]) (?=[A-Z0-9])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= 8)


# ---- times, arms, numbers of a sentence ----


def first_time(text: Column, patterns: Sequence[str]) -> Column:
    """The earliest match of any pattern, the earlier pattern on a tie, which
    is what an alternation finds; null if none matches."""
    if not patterns:
        return F.lit(None).cast("string")
    return clean_or_null(search(text, "|".join(f"(?:{p})" for p in patterns)))


def clean_or_null(text: Column) -> Column:
    return F.nullif(clean(text), F.lit(""))


def arm(text: Column) -> Column:
    """The arm a sentence names, by the first pattern that matches."""
    return F.coalesce(*(clean_or_null(search(text, p, 1)) for p in ARM_PATTERNS))


def clause_of(sentence: Column, start: Column) -> Column:
    """What lies between the nearest , or ; on either side of ``start``."""
    left = F.regexp_extract(F.substring(sentence, F.lit(1), start), "[^;,]*$", 0)
    right = F.regexp_extract(F.substring(sentence, start + 2, F.length(sentence)), "^[^;,]*", 0)
    return F.concat(left, F.substring(sentence, start + 1, F.lit(1)), right)


def numbers(numerator: Column | int | None, denominator: Column | None, percentage: Column | None, rule: str) -> Column:
    values = [(numerator, "bigint", "numerator"), (denominator, "bigint", "denominator"), (percentage, "double", "percentage")]
    columns = [(v if isinstance(v, Column) else F.lit(v)).try_cast(t).alias(n) for v, t, n in values]
    return F.struct(*columns, F.lit(rule).alias("rule"))


def fraction(percent: Column) -> Column:
    return percent.try_cast("double") / 100


def word_value(word: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(word))


def clause_numbers(clause: Column) -> Column:
    """Counts and percentage of a clause, by the first rule that applies."""
    has = lambda p: clause.rlike(f"(?iU){p}")
    return (
        F.when(has(RATIO), numbers(search(clause, RATIO, 1), search(clause, RATIO, 2), None, "NUM_RATIO_CLAUSE"))
        .when(has(COUNT_PERCENT), numbers(search(clause, COUNT_PERCENT, 1), None, fraction(search(clause, COUNT_PERCENT, 2)), "NUM_COUNT_PCT_CLAUSE"))
        .when(has(COUNT), numbers(search(clause, COUNT, 1), None, None, "NUM_COUNT_CLAUSE"))
        .when(has(WORD_COUNT), numbers(word_value(search(clause, WORD_COUNT, 1)), None, None, "NUM_WORD_CLAUSE"))
        .when(has(ZERO), numbers(0, None, None, "NUM_ZERO_CLAUSE"))
        .when(has(PERCENT), numbers(None, None, fraction(search(clause, PERCENT, 1)), "NUM_PCT_ONLY"))
        .otherwise(numbers(None, None, None, "NUM_NONE"))
    )


def sentence_numbers(sentence: Column, start: Column) -> Column:
    """Numbers where the clause has none: a zero for a whole list, a number
    word before the term, a ratio beside it."""
    piece = lambda a, b: F.substring(sentence, a + 1, b - a)
    before = piece(F.greatest(F.lit(0), start - 80), start)
    near = piece(F.greatest(F.lit(0), start - 20), start + 120)
    return (
        F.when(sentence.rlike(f"(?iU){LIST_ZERO}") | sentence.rlike(f"(?iU){THERE_WAS_NO}"), numbers(0, None, None, "NUM_LIST_ZERO"))
        .when(before.rlike(f"(?iU){WORD_BEFORE}"), numbers(word_value(search(before, WORD_BEFORE, 1)), None, None, "NUM_WORD_BEFORE_TERM"))
        .when(near.rlike(f"(?iU){RATIO}"), numbers(search(near, RATIO, 1), search(near, RATIO, 2), None, "NUM_RATIO_LOCAL"))
        .otherwise(numbers(None, None, None, "NUM_NONE"))
    )


# ---- table headers and cells ----


def header_fields(header: Column, time_patterns: Sequence[str], noise: Sequence[str], bare_sizes: bool = True) -> Column:
    """struct<arm, denominator, time> of a column header."""
    rest = F.regexp_replace(header, f"(?U){HEADER_SIZE}", "")
    name = clean(strip(F.regexp_replace(rest, f"(?iU){HEADER_NOISE}", "")))
    size = search(header, SIZE, 1).try_cast("bigint")
    time = first_time(header, time_patterns)
    idle = F.coalesce(F.lower(name) == F.lower(time), F.lit(False))
    if noise:
        idle = idle | F.lower(name).isin(*noise)
    arm = F.when(idle, F.lit(None)).otherwise(F.nullif(name, F.lit("")))
    if bare_sizes:
        bare = size.isNull() & header.rlike(f"(?iU){GROUP_WORD}") & header.rlike(f"(?U){BARE_SIZE}")
        arm = F.when(bare, clean_or_null(strip(F.regexp_replace(header, f"(?U){BARE_SIZE}", "")))).otherwise(arm)
        size = F.when(bare, search(header, BARE_SIZE, 1).try_cast("bigint")).otherwise(size)
    return F.struct(arm.alias("arm"), size.alias("denominator"), time.alias("time"))


def cell_value(value: Column, missing: Sequence[str], zero: Sequence[str], ratio_as_percentage: bool = True) -> Column:
    """Numbers of a table cell. In ``a/b``, b comes out as the percentage, as
    the scored results have it; ``ratio_as_percentage=False`` makes it the
    denominator."""
    value = clean(value)
    has = lambda p: value.rlike(f"(?U){p}")
    second = search(value, CELL_RATIO, 2)
    listed = lambda words: F.lower(value).isin(*words) if words else F.lit(False)
    return (
        F.when(listed(missing), numbers(None, None, None, "TABLE_MISSING"))
        .when(listed(zero), numbers(0, None, None, "TABLE_ZERO"))
        .when(has(CELL_RATIO), numbers(search(value, CELL_RATIO, 1), *((None, second) if ratio_as_percentage else (second, None)), "TABLE_RATIO"))
        .when(has(CELL_COUNT_PERCENT), numbers(search(value, CELL_COUNT_PERCENT, 1), None, fraction(search(value, CELL_COUNT_PERCENT, 2)), "TABLE_COUNT_PCT"))
        .when(has(r"^\d+$"), numbers(value, None, None, "TABLE_COUNT"))
        .when(has(PERCENT), numbers(None, None, fraction(search(value, PERCENT, 1)), "TABLE_PCT"))
        .when(has(r"\d"), numbers(None, None, None, "TABLE_DESCRIPTIVE_NUMERIC"))
        .otherwise(numbers(None, None, None, "TABLE_NONNUMERIC"))
    )


def complement_count(value: Column, denominator: Column) -> Column:
    """a of ``a:b`` where a and b add up to the denominator; else null."""
    a, b = (search(clean(value), COMPLEMENT, i).try_cast("bigint") for i in (1, 2))
    return F.when(a + b == denominator, a)


def group_sizes(value: Column) -> Column:
    """The sizes of a ``34:32:33`` cell; empty for any other."""
    value = clean(value)
    sizes = F.transform(F.split(value, r"(?U)\s*[∶:]\s*"), lambda x: x.try_cast("bigint"))
    return F.when(value.rlike(f"(?U){SIZES}"), sizes).otherwise(F.array().cast("array<bigint>"))


def is_sizes_header(header: Column) -> Column:
    return clean(header).rlike(f"(?U){SIZES}")


def is_statistical_header(header: Column, patterns: Sequence[str]) -> Column:
    name = strip(F.lower(clean(header)))
    return (name == "") | name.rlike(f"(?iU){P_VALUE}") | contains_any(name, patterns)


def is_repeated_row(row: Column) -> Column:
    """Two or more filled cells that say the same, ignoring case."""
    filled = F.filter(F.transform(row, clean), lambda v: v != "")
    return (F.size(filled) >= 2) & (F.size(F.array_distinct(F.transform(filled, F.lower))) == 1)


# ---- comparing records ----


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9%]+", " "))


def tokens(text: Column) -> Column:
    """The distinct content words of a text, plurals cut."""
    words = F.array_except(F.split(norm(text), " "), F.array(*map(F.lit, STOPWORDS)))
    long = lambda w: F.length(w) >= 5
    single = lambda w: F.when(long(w) & F.endswith(w, F.lit("ies")), F.concat(F.left(w, F.length(w) - 3), F.lit("y"))).when(long(w) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.left(w, F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), single))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def term_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.85 if one holds the other, else the words' Jaccard."""
    return similarity_of(norm(a), norm(b), jaccard(a, b))


def similarity_of(x: Column, y: Column, words: Column) -> Column:
    """term_similarity of two normal forms whose words' Jaccard is known."""
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.85).otherwise(words)


def number_of(text: Column) -> Column:
    """The double a text stands for, with blanks around it or underscores
    between digits; null for any other, such as ``5d``."""
    plain = F.regexp_replace(F.trim(text), r"(?<=\d)_(?=\d)", "")
    return F.when(plain.rlike(r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"), plain.try_cast("double"))


def numeric_equal(a: Column, b: Column) -> Column:
    """Whether two values are the same number, or the same text where either
    is none; null if either is missing or blank."""
    a, b = F.trim(a.cast("string")), F.trim(b.cast("string"))
    return F.when((a != "") & (b != ""), F.coalesce(F.abs(number_of(a) - number_of(b)) < 1e-9, norm(a) == norm(b)))


def canonical_arm(arm: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(arm, F.lit(""))))
    for old, new in ARM_ALIASES:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(?U)\(\s*(?:n\s*=\s*)?\d+\s*\)", "")
    text = F.regexp_replace(text, r"(?U)\b(?:group|arm)\b", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def canonical_time(time: Column) -> Column:
    """All number and unit pairs, and the hospital periods, in order."""
    text = F.translate(F.lower(F.trim(F.coalesce(time, F.lit("")))), "–—", "--")
    units = F.create_map(*(F.lit(x) for kv in TIME_UNITS.items() for x in kv))
    pattern = F.lit(f"(?U){TIME_PAIR}")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("n"), F.regexp_extract_all(text, pattern, 2).alias("u"))
    named = F.transform(pairs, lambda p: F.concat(F.regexp_replace(p["n"], WHITE, ""), F.lit(" "), units[p["u"]]))
    stay = F.when(F.contains(text, F.lit("in-hospital")) | F.contains(text, F.lit("hospital stay")), "in-hospital")
    around = F.when(F.contains(text, F.lit("perioperative")) | F.contains(text, F.lit("peri-operative")), "perioperative")
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat(named, F.array(stay, around))))), " | ")


def seeded_key(seed: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


ARTICLE_ID = r"AH-(?:P\d{2}|V\d{3})"


def article_id_of(name: Column, pattern: str = ARTICLE_ID) -> Column:
    """The id in a file name, or the name without its last suffix."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(name, f"({pattern})", 1), F.lit("")), stem)


def short_article_id(article: Column, pattern: str = r"^(AH-S2[A-Z]-\d{3,})(?:_|$)") -> Column:
    """The leading id of a long one; an id of another form is an error. Numbers
    have three digits at least: those of over 999 articles have more."""
    short = F.regexp_extract(F.trim(article), pattern, 1)
    return F.when(short != "", short).otherwise(F.raise_error(F.concat(F.lit("unrecognised article id: "), F.coalesce(article, F.lit("null")))))


# ---- lines of layout text ----

# Fixed values that results depend on: patterns, cues and heading names.
TABLE_START = r"(?:table|tab\.)\s+([0-9]+|[ivxlcdm]+)\b"
CAPTION_CUES = (
    r"\b(?:Baseline|Demographic|Operative|Postoperative|Preoperative|Comparison|Clinical|Radiographic|Functional|Adverse"
    r"|Complications?|Outcomes?|Characteristics?)\b"
)
HEADER_SIGNALS = ("variable", "group", "treatment", "control", "p value", "p-value", "outcome", "characteristic")
HEADINGS = {
    "introduction": "Introduction",
    "background": "Introduction",
    "materials and methods": "Methods",
    "patients and methods": "Methods",
    "methods": "Methods",
    "methodology": "Methods",
    "results": "Results",
    "discussion": "Discussion",
    "conclusion": "Conclusions",
    "conclusions": "Conclusions",
    "references": "References",
}
COMPACT_METHODS = ("materialsandmethods", "patientsandmethods", "methods", "methodology")


def display_compact(text: Column) -> Column:
    """Spaced capitals drawn together where four letters in five are capital."""


    def compact(text: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
        capitals = F.length(F.regexp_replace(text, r"\P{Lu}", ""))
        return F.when((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) >= 0.8), F.regexp_replace(text, WHITE, "")).otherwise(text)

    return let(pdf_clean(text), compact)


def table_label(line: Column) -> Column:
    """The cleaned line if a table begins there; else null."""
    spaced = line.rlike(rf"(?iU)^\s*{TABLE_START}") | display_compact(line).rlike(r"(?iU)^(?:table|tab\.)([0-9]+|[ivxlcdm]+)\b")
    return F.when(spaced, pdf_clean(line))


def heading_name(line: Column) -> Column:
    """The section a heading line opens; else null."""
    text = F.regexp_replace(F.regexp_replace(pdf_clean(line), r"^\s*[|]\s*", ""), r"(?iU)^\s*(?:\d+|[ivxlcdm]+)\s*[|.):-]\s*", "")
    return let(F.regexp_replace(F.lower(display_compact(text)), "[:.]+$", ""), _heading_name)


def _heading_name(text: Column) -> Column:
    short = F.length(text) <= 40
    result = F.when(F.regexp_replace(text, "[^a-z]", "").isin(*COMPACT_METHODS), "Methods")
    for start, name in (("results", "Results"), ("discussion", "Discussion"), ("conclusion", "Conclusions")):
        result = result.when(text.startswith(start) & short, name)
    return result.otherwise(F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))[text])


def clean_caption(caption: Column) -> Column:
    """The caption from its last cue on, if that is over 20 characters in."""
    return let(pdf_clean(caption), _from_last_cue)


def _from_last_cue(text: Column) -> Column:
    start = F.length(F.regexp_extract(text, f"(?iU)^([\\s\\S]*){CAPTION_CUES}", 1))
    return F.when(text.rlike(f"(?iU){CAPTION_CUES}") & (start > 20), F.substring(text, start + 1, F.length(text))).otherwise(text)


def split_columns(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), r"(?U)\s{2,}"), pdf_clean), lambda c: c != "")


# ---- names of hosts ----

# Host names and the families they count to.
FAMILIES = {
    "BioMed Central": "Springer Nature",
    "Nature Portfolio": "Springer Nature",
    "Springer Nature": "Springer Nature",
    "Springer Science+Business Media": "Springer Nature",
    "Elsevier BV": "Elsevier",
    "Dove Medical Press": "Taylor & Francis/Informa",
    "Wolters Kluwer": "Wolters Kluwer",
    "Lippincott Williams & Wilkins": "Wolters Kluwer",
    "Hindawi Publishing Corporation": "Wiley",
    "Wiley": "Wiley",
    "SAGE Publishing": "SAGE",
    "Multidisciplinary Digital Publishing Institute": "MDPI",
    "British Editorial Society of Bone & Joint Surgery": "BESBJS",
    "Foundation for Rehabilitation Information": "Foundation for Rehabilitation Information",
}


def publisher_family(host: Column) -> Column:
    host = F.trim(F.coalesce(host, F.lit("")))
    known = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    return F.coalesce(known[host], F.nullif(host, F.lit("")), F.lit("Independent/Unresolved"))
