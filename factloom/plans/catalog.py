"""All queries of the library by name, and their SQL where SQL can say it.

The tables hold invented prose and sales, no articles, so each query gives
its operator text made of their columns, or a small lexicon of words that
occur in them. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import evaluation as E
from factloom.operators import selection
from factloom.operators.body import body_facts, sentence_rows
from factloom.operators.predictions import COLUMNS, first_wins, numbered, predictions
from factloom.operators.tables import table_facts
from factloom.operators.tagging import hits, matches
from factloom.plans import adapters
from factloom.sources import coordinates, html, layout, sinks
from factloom.sources.rules import Rules, from_document

SEED = "factloom-queue"

#: Words that occur in the documents, as an event lexicon.
DOCUMENT_RULES: Rules = from_document(
    {
        "rules_version": "documents-1",
        "categories": [
            {"category": "Article", "rule_id": "C01", "patterns": ["the", "der", "la", "el"]},
            {"category": "Pair", "rule_id": "C02", "patterns": ["of the", "de la", "in der", "is the"]},
            {"category": "Noise", "rule_id": "C03", "patterns": ["trash", "worthless", "disgusting", "idiot", "moron"]},
            {"category": "Key", "rule_id": "C04", "patterns": ["token"]},
        ],
        "generic_reporting_cues": ["and", "und", "et", "y"],
        "unmappable_event_patterns": ["from", "with", "mit", "avec"],
        "unclear_event_patterns": ["that", "this", "eine"],
        "body_allowed_section_patterns": ["body"],
        "strong_occurrence_patterns": ["the", "was", "is", "no", "none", "der", "la", "el", "token"],
        "non_event_patterns": ["be"],
        "time_patterns_v1_1": [r"\b\d+(?:[-–]\d+)?\s*(?:hours?|days?|weeks?|months?|years?)\b"],
        "zero_cell_tokens": ["-", "none"],
        "missing_cell_tokens": ["na", "nr"],
        "table_safety_context_patterns": ["order"],
        "table_statistical_column_patterns": ["p value"],
        "quote_character_limit": 200,
    }
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One with fewer splits than there are cores, as a small file of
    one row group is, is dealt out anew: what is computed per row would run on
    one core otherwise. Tables of many splits are read as they are."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("D%09d", "doc_id").alias("article_id"), F.lit(0).alias("node_seq"), F.lit("Body").alias("location"), "text", F.lit(False).alias("in_table"), F.sha2("text", 256).alias("input_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- text ----

CLEAN_SQL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(rf"""
WITH s AS (SELECT doc_id, string_split(regexp_replace({CLEAN_SQL}, '([.!?]) ([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: length(x) >= 8) AS parts FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_seq, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM k)
""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_seq", "sentence"))


_PHRASE_ROWS = ", ".join(f"({p.seq}, '{p.kind}', '{p.category}', '{p.rule_id}', '{p.text}')" for p in DOCUMENT_RULES.phrases)


@query(rf"""
WITH p(seq, kind, category, rule_id, phrase) AS (VALUES {_PHRASE_ROWS}),
m AS (SELECT doc_id, seq, category, text, '(?is)^((?:.*?[^A-Za-z0-9])??)(' || replace(phrase, ' ', '\s+') || ')(?:[^A-Za-z0-9]|$)' AS rx FROM documents, p)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, category, regexp_extract(text, rx, 2) AS term, CAST(length(regexp_extract(text, rx, 1)) AS INTEGER) AS start
FROM m WHERE regexp_matches(text, rx)
""")
def phrase_matches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(matches(F.col("text"), DOCUMENT_RULES)).alias("m"))
    return d.select("doc_id", "m.seq", "m.category", "m.term", "m.start")


SENTENCES_SQL = rf"""
s AS (SELECT doc_id, string_split(regexp_replace({CLEAN_SQL}, '([.!?]) ([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: length(x) >= 8) AS parts FROM s),
sentences AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_seq, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM k))
"""


HITS_SQL = rf"""
WITH p(seq, kind, category, rule_id, phrase) AS (VALUES {_PHRASE_ROWS}), {SENTENCES_SQL},
m AS (SELECT *, '(?is)^((?:.*?[^A-Za-z0-9])??)(' || replace(phrase, ' ', '\s+') || ')(?:[^A-Za-z0-9]|$)' AS rx FROM sentences, p),
f AS (SELECT doc_id, sentence_seq, seq, kind, category, rule_id, regexp_extract(sentence, rx, 2) AS term, length(regexp_extract(sentence, rx, 1)) AS start FROM m WHERE regexp_matches(sentence, rx)),
o AS (SELECT *, count(*) FILTER (kind = 'category') OVER (PARTITION BY doc_id, sentence_seq) AS n, row_number() OVER (PARTITION BY doc_id, sentence_seq, kind ORDER BY seq) AS nth FROM f),
l AS (SELECT doc_id, sentence_seq, list([{{'start': start, 'short': -length(term), 'seq': seq, 'category': category, 'term': term, 'rule_id': rule_id}}]
  ORDER BY CASE kind WHEN 'unmappable' THEN 1 WHEN 'unclear' THEN 2 ELSE 0 END, CASE WHEN kind IN ('unmappable', 'unclear') THEN seq ELSE start END, -length(term), seq) AS found FROM o WHERE kind <> 'generic' OR (n = 0 AND nth = 1) GROUP BY ALL),
r AS (SELECT doc_id, sentence_seq, list_sort(list_reduce(found, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: greatest(y.start, x[1].start) < least(y.start - y.short, x[1].start - x[1].short))) > 0 THEN kept ELSE list_concat(kept, x) END)) AS kept FROM l),
hits AS (SELECT doc_id, sentence_seq, CAST(i - 1 AS INTEGER) AS hit_seq, CAST(kept[i].start AS INTEGER) AS start, kept[i].category AS category, kept[i].term AS term, kept[i].rule_id AS rule_id FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM r))
"""


@query(HITS_SQL + "SELECT printf('D%09d', doc_id) AS article_id, sentence_seq, hit_seq, start, category, term, rule_id FROM hits")
def event_hits(spark, sf_dir):
    """Disjoint hits per sentence, in SQL a fold over its ordered matches."""
    s = sentence_rows(document_nodes(spark, sf_dir)).withColumn("hits", hits(F.col("sentence"), DOCUMENT_RULES))
    return s.select("article_id", "sentence_seq", F.posexplode("hits").alias("hit_seq", "h")).select("article_id", "sentence_seq", "hit_seq", "h.start", "h.category", "h.term", "h.rule_id")


def _unicode(pattern: str) -> str:
    """The pattern ignoring case, its word boundaries spelt out, as RE2's are
    those of ASCII; a group around it would take in what bounds it."""
    return "(?i)" + pattern.replace(r"^\b", "").replace(r"\b$", r"(?:$|[^\p{L}\p{N}_])").replace(r"\b.{0,500}\b", r"[^\p{L}\p{N}_](?:.{0,499}[^\p{L}\p{N}_])?").replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(", 1).replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")


def _has_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{_unicode(pattern)}')"


def _group_sql(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{_unicode(pattern)}', {group}), '')"


def _phrases_sql(phrases: tuple[str, ...]) -> str:
    return "regexp_matches(sentence, '(?i)(?:^|[^A-Za-z0-9])(?:" + "|".join(phrases) + ")(?:[^A-Za-z0-9]|$)')"


_ARM_SQL = ", ".join(f"trim(regexp_replace({_group_sql('sentence', p)}, '\\s+', ' ', 'g'))" for p in T.ARM_PATTERNS[:2]) + f", {_group_sql('sentence', T.ARM_PATTERNS[2])}"
_WORD_SQL = "list_position([" + ", ".join(f"'{w}'" for w in T.NUMBER_WORDS) + "], lower({0}))"
FACTS_SQL = (
    HITS_SQL
    + f""",
gated AS (SELECT h.*, sentence FROM hits h JOIN sentences USING (doc_id, sentence_seq) WHERE NOT {_phrases_sql(DOCUMENT_RULES.non_event)} AND ({_phrases_sql(DOCUMENT_RULES.occurrence)} OR {_has_sql("sentence", r"\b(\d+)\s*(?:/|of|\(|patients?|cases?|subjects?)")})),
pieces AS (SELECT *, regexp_extract(substr(sentence, 1, start), '[^;,]*$') || substr(sentence, start + 1, 1) || regexp_extract(substr(sentence, start + 2), '^[^;,]*') AS clause,
  substr(sentence, greatest(0, start - 80) + 1, start - greatest(0, start - 80)) AS before, substr(sentence, greatest(0, start - 20) + 1, start + 120 - greatest(0, start - 20)) AS near FROM gated),
ruled AS (SELECT *, CASE WHEN {_has_sql("clause", T.RATIO)} THEN 'NUM_RATIO_CLAUSE' WHEN {_has_sql("clause", T.COUNT_PERCENT)} THEN 'NUM_COUNT_PCT_CLAUSE' WHEN {_has_sql("clause", T.COUNT)} THEN 'NUM_COUNT_CLAUSE' WHEN {_has_sql("clause", T.WORD_COUNT)} THEN 'NUM_WORD_CLAUSE'
  WHEN {_has_sql("clause", T.ZERO)} THEN 'NUM_ZERO_CLAUSE' WHEN {_has_sql("clause", T.PERCENT)} THEN 'NUM_PCT_ONLY' WHEN {_has_sql("sentence", T.LIST_ZERO)} OR {_has_sql("sentence", r"\b(there)\s+(?:was|were|are)\s+no\b")} THEN 'NUM_LIST_ZERO'
  WHEN {_has_sql("before", T.WORD_BEFORE)} THEN 'NUM_WORD_BEFORE_TERM' WHEN {_has_sql("near", T.RATIO)} THEN 'NUM_RATIO_LOCAL' ELSE 'NUM_NONE' END AS rule FROM pieces),
counted AS (SELECT *, TRY_CAST(CASE rule WHEN 'NUM_RATIO_CLAUSE' THEN {_group_sql("clause", T.RATIO)} WHEN 'NUM_COUNT_PCT_CLAUSE' THEN {_group_sql("clause", T.COUNT_PERCENT)} WHEN 'NUM_COUNT_CLAUSE' THEN {_group_sql("clause", T.COUNT)} WHEN 'NUM_RATIO_LOCAL' THEN {_group_sql("near", T.RATIO)}
    WHEN 'NUM_WORD_CLAUSE' THEN CAST({_WORD_SQL.format(_group_sql("clause", T.WORD_COUNT))} AS VARCHAR) WHEN 'NUM_WORD_BEFORE_TERM' THEN CAST({_WORD_SQL.format(_group_sql("before", T.WORD_BEFORE))} AS VARCHAR) WHEN 'NUM_ZERO_CLAUSE' THEN '0' WHEN 'NUM_LIST_ZERO' THEN '0' END AS BIGINT) AS numerator,
  TRY_CAST(CASE rule WHEN 'NUM_RATIO_CLAUSE' THEN {_group_sql("clause", T.RATIO, 2)} WHEN 'NUM_RATIO_LOCAL' THEN {_group_sql("near", T.RATIO, 2)} END AS BIGINT) AS denominator,
  TRY_CAST(CASE rule WHEN 'NUM_COUNT_PCT_CLAUSE' THEN {_group_sql("clause", T.COUNT_PERCENT, 2)} WHEN 'NUM_PCT_ONLY' THEN {_group_sql("clause", T.PERCENT)} END AS DOUBLE) / 100 AS reported_percentage,
  CASE WHEN {_has_sql("sentence", T.OVERALL_ARM)} THEN 'Overall' ELSE coalesce({_ARM_SQL}) END AS arm, {_group_sql("sentence", r"\b(\d+(?:[-–]\d+)?\s*(?:hours?|days?|weeks?|months?|years?))\b")} AS time_window,
  CASE WHEN {_has_sql("sentence", T.SERIOUS)} THEN 'Yes' ELSE 'Unclear' END AS serious, CASE WHEN {_has_sql("sentence", T.ATTRIBUTED)} THEN 'Yes' ELSE 'Unclear' END AS attribution, left(sentence, 200) AS quote FROM ruled WHERE rule <> 'NUM_NONE'),
firsts AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))), lower(arm), numerator, denominator, lower(quote) ORDER BY sentence_seq, hit_seq) = 1)
SELECT printf('DOC-%04d', row_number() OVER (ORDER BY doc_id, sentence_seq, hit_seq)) AS prediction_id, printf('D%09d', doc_id) AS article_id, 'Body' AS source_type, 'Body' AS evidence_location, quote AS evidence_quote, term AS raw_event_term, category AS predicted_category, arm, numerator, denominator,
  reported_percentage, CASE WHEN coalesce(numerator, denominator, reported_percentage) IS NULL THEN 'Unclear' ELSE 'patients' END AS count_unit, time_window, serious, attribution,
  CASE WHEN numerator IS NOT NULL AND denominator IS NOT NULL AND arm IS NOT NULL THEN 'Directly poolable' WHEN numerator IS NOT NULL OR reported_percentage IS NOT NULL THEN 'Transformable' ELSE 'Not poolable' END AS poolability,
  CASE WHEN category <> 'Unmappable' THEN 'High' ELSE 'Moderate' END AS confidence, rule_id || '+' || rule AS rule_id, sha256(text) AS input_sha256
FROM firsts JOIN (SELECT doc_id, text FROM documents) USING (doc_id)
"""
)


@query(FACTS_SQL)
def facts(spark, sf_dir):
    """The flagship: documents to distinct, numbered prediction records."""
    records = first_wins(predictions(body_facts(document_nodes(spark, sf_dir), DOCUMENT_RULES), DOCUMENT_RULES))
    return numbered(records, "DOC").select(*COLUMNS)


@query("""
SELECT o_orderkey, CASE WHEN k = 0 THEN CAST(o_custkey AS BIGINT) WHEN k = 1 THEN CAST(o_custkey AS BIGINT) WHEN k = 2 THEN CAST(3 AS BIGINT) WHEN k = 3 THEN CAST(0 AS BIGINT) WHEN k = 4 THEN CAST(o_custkey AS BIGINT) END AS numerator,
  CASE WHEN k = 0 THEN CAST(o_orderkey AS BIGINT) END AS denominator,
  CASE WHEN k = 1 THEN 12.5::DOUBLE / 100 WHEN k = 5 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 END AS percentage,
  CASE k WHEN 0 THEN 'NUM_RATIO_CLAUSE' WHEN 1 THEN 'NUM_COUNT_PCT_CLAUSE' WHEN 2 THEN 'NUM_WORD_CLAUSE' WHEN 3 THEN 'NUM_ZERO_CLAUSE' WHEN 4 THEN 'NUM_COUNT_CLAUSE' WHEN 5 THEN 'NUM_PCT_ONLY' ELSE 'NUM_NONE' END AS rule
FROM (SELECT *, o_orderkey % 7 AS k FROM orders)
""")
def clause_numbers(spark, sf_dir):
    """Numbers of the clause around a term; clauses beside it hold others."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    parts = [F.concat(c, F.lit(" of "), F.col("o_orderkey").cast("string"), F.lit(" ")), F.concat(c, F.lit(" patients (12.5%) ")), F.lit("Three knees "), F.lit("no "), F.concat(c, F.lit(" cases ")), F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("% ")), F.lit("some ")]
    middle = parts[-1]
    for i, p in enumerate(parts[:-1]):
        middle = F.when(k == i, p).otherwise(middle)
    head = F.lit("In 7 of 9 centres, ")
    s = o.select("o_orderkey", F.length(F.concat(head, middle)).alias("start"), F.concat(head, middle, F.lit("delays, 5 cases elsewhere; none late")).alias("s"))
    return s.select("o_orderkey", T.clause_numbers(T.clause_of(F.col("s"), F.col("start"))).alias("n")).select("o_orderkey", "n.*")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'within ' || o_custkey || ' days' WHEN 1 THEN o_custkey || ' weeks' WHEN 2 THEN 'hospital stay' END AS time_window,
  CASE o_orderkey % 4 WHEN 0 THEN 'group ' || o_custkey WHEN 1 THEN 'low dose group' WHEN 2 THEN 'control group' END AS arm FROM orders
""")
def times_and_arms(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    s = F.when(k == 0, F.concat(F.lit("Seen: group "), c, F.lit(" within "), c, F.lit(" days, 9 weeks"))).when(k == 1, F.concat(F.lit("It was 4 low dose group, "), c, F.lit(" weeks"))).when(k == 2, F.lit("77 control group: hospital  stay")).otherwise(F.lit("nothing at all"))
    patterns = [r"\b\d+\s*(?:days|weeks)\b", r"\bhospital\s+stay\b", r"\bwithin\s+\d+\s*(?:days|weeks)\b"]
    return o.select("o_orderkey", T.first_time(s, patterns).alias("time_window"), T.arm(s).alias("arm"))


ARM_SQL = r"""
WITH r AS (SELECT o_orderkey, lower(CASE o_orderkey % 6 WHEN 0 THEN 'Both groups combined' WHEN 1 THEN 'Control Group (n = ' || o_custkey || ')' WHEN 2 THEN 'Arm ' || o_custkey WHEN 3 THEN 'Total' WHEN 4 THEN 'Group-B (' || o_custkey || ')' ELSE 'either group' END) AS t FROM orders),
a AS (SELECT o_orderkey, replace(replace(replace(replace(replace(replace(replace(t, 'both groups combined', 'overall'), 'all groups combined', 'overall'), 'either group', 'overall'), 'combined', 'overall'), 'total', 'overall'), 'control group', 'control'), 'control arm', 'control') AS t FROM r)
SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '\(\s*(?:n\s*=\s*)?\d+\s*\)', '', 'g'), '\b(?:group|arm)\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS arm FROM a
"""


@query(ARM_SQL)
def arm_canonical(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    s = F.when(k == 0, "Both groups combined").when(k == 1, F.concat(F.lit("Control Group (n = "), c, F.lit(")"))).when(k == 2, F.concat(F.lit("Arm "), c)).when(k == 3, "Total").when(k == 4, F.concat(F.lit("Group-B ("), c, F.lit(")"))).otherwise("either group")
    return o.select("o_orderkey", T.canonical_arm(s).alias("arm"))


@query(r"""
WITH r AS (SELECT o_orderkey, lower('Within ' || (o_custkey % 90) || CASE o_orderkey % 3 WHEN 0 THEN ' hrs' WHEN 1 THEN ' wk' ELSE 'd' END || ' and 3 - 6 mo, ' || CASE WHEN o_orderkey % 5 = 0 THEN 'Hospital stay' ELSE 'perioperative' END) AS t FROM orders),
p AS (SELECT o_orderkey, t, regexp_extract_all(t, '(\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?)\s*(hours?|hrs?|h|days?|d|weeks?|wks?|wk|w|months?|mos?|years?|yrs?|yr|y)\b', 1) AS n,
  regexp_extract_all(t, '(\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?)\s*(hours?|hrs?|h|days?|d|weeks?|wks?|wk|w|months?|mos?|years?|yrs?|yr|y)\b', 2) AS u FROM r),
f AS (SELECT o_orderkey, list_concat(list_transform(range(1, len(n) + 1), lambda i: regexp_replace(n[i], '\s+', '', 'g') || ' ' || CASE u[i][1] WHEN 'h' THEN 'hours' WHEN 'd' THEN 'days' WHEN 'w' THEN 'weeks' WHEN 'm' THEN 'months' ELSE 'years' END),
  CASE WHEN contains(t, 'hospital stay') THEN ['in-hospital'] ELSE ['perioperative'] END) AS all_times FROM p)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(all_times)), ' | ') AS time_window FROM f
""")
def time_canonical(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), (F.col("o_custkey") % 90).cast("string")
    unit = F.when(F.col("o_orderkey") % 3 == 0, " hrs").when(F.col("o_orderkey") % 3 == 1, " wk").otherwise("d")
    stay = F.when(F.col("o_orderkey") % 5 == 0, "Hospital stay").otherwise("perioperative")
    return o.select("o_orderkey", T.canonical_time(F.concat(F.lit("Within "), c, unit, F.lit(" and 3 – 6 mo, "), stay)).alias("time_window"))


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)
NORM_SQL = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9%]+', ' ', 'g'))"
TOKENS_SQL = (
    "list_distinct(list_transform(list_filter(string_split({0}, ' '), lambda t: length(t) > 1 AND t NOT IN (" + STOP_SQL + ")), lambda t: CASE WHEN length(t) > 4 AND t LIKE '%ies' "
    "THEN t[:length(t) - 3] || 'y' WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:length(t) - 1] ELSE t END))"
)
SIMILARITY_SQL = rf"""
WITH n AS (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, {NORM_SQL.format("a.p_name || ' ' || a.p_type")} AS a, {NORM_SQL.format("b.p_name || ' ' || b.p_type")} AS b
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
t AS (SELECT *, {TOKENS_SQL.format("a")} AS ta, {TOKENS_SQL.format("b")} AS tb FROM n),
j AS (SELECT *, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN CAST(len(list_intersect(ta, tb)) AS DOUBLE) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) ELSE 0.0::DOUBLE END AS jaccard FROM t)
SELECT a_key, b_key, jaccard, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.85::DOUBLE ELSE jaccard END AS similarity FROM j
"""


@query(SIMILARITY_SQL)
def term_similarity(spark, sf_dir):
    """Parts of one brand and size; word sets are made before the join."""
    name = F.concat_ws(" ", "p_name", "p_type")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", T.norm(name).alias("name"), T.tokens(name).alias("words"))
    a, b = (p.withColumnsRenamed({"p_partkey": f"{x}_key", "name": f"{x}_name", "words": f"{x}_words"}) for x in "ab")
    j = a.join(b, ["p_brand", "p_size"]).where("a_key < b_key").withColumn("jaccard", T.set_jaccard(F.col("a_words"), F.col("b_words")))
    return j.select("a_key", "b_key", "jaccard", T.similarity_of(F.col("a_name"), F.col("b_name"), F.col("jaccard")).alias("similarity"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_custkey % 2 = 0 WHEN o_orderkey % 5 = 2 THEN TRUE ELSE FALSE END AS equal FROM orders
""")
def numeric_equality(spark, sf_dir):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    a = F.when(k == 0, " ").when(k == 2, "Not-Reported").otherwise(c)
    b = F.when(k == 1, F.concat((F.col("o_custkey") + F.col("o_custkey") % 2).cast("string"), F.lit(".0"))).when(k == 2, "not reported").when(k == 3, "unknown").otherwise(F.concat(c, F.lit("1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.numeric_equal(a, b).alias("equal"))


# ---- cells, headers, tables ----


@query("""
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN q WHEN 1 THEN q WHEN 2 THEN q WHEN 4 THEN 0 END AS numerator, CAST(NULL AS BIGINT) AS denominator,
  CASE k WHEN 0 THEN CAST(l_linenumber AS DOUBLE) / 100 WHEN 1 THEN CAST(l_linenumber AS DOUBLE) WHEN 3 THEN CAST(q AS DOUBLE) / 100 END AS percentage,
  CASE k WHEN 0 THEN 'TABLE_COUNT_PCT' WHEN 1 THEN 'TABLE_RATIO' WHEN 2 THEN 'TABLE_COUNT' WHEN 3 THEN 'TABLE_PCT' WHEN 4 THEN 'TABLE_ZERO' WHEN 5 THEN 'TABLE_MISSING' WHEN 6 THEN 'TABLE_DESCRIPTIVE_NUMERIC' ELSE 'TABLE_NONNUMERIC' END AS rule
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 8 AS k FROM lineitem)
""")
def cell_values(spark, sf_dir):
    k, q, n = F.col("l_orderkey") % 8, F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber").cast("string")
    forms = [F.concat(q, F.lit(" ("), n, F.lit("%)")), F.concat(q, F.lit(" / "), n), F.concat(F.lit(" "), q), F.concat(q, F.lit(" %")), F.lit("None"), F.lit("NR"), F.concat(q, F.lit(".5 ± "), n), F.lit("as before")]
    value = forms[-1]
    for i, f in enumerate(forms[:-1]):
        value = F.when(k == i, f).otherwise(value)
    cell = T.cell_value(value, DOCUMENT_RULES.missing_cells, DOCUMENT_RULES.zero_cells)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN q END AS complement, CASE WHEN l_orderkey % 3 = 0 THEN [q, l_linenumber, q + 1] ELSE [] END AS sizes,
  CASE l_orderkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Group ' || l_linenumber END AS arm, CASE l_orderkey % 4 WHEN 0 THEN q WHEN 1 THEN q END AS size,
  CASE l_orderkey % 4 WHEN 2 THEN l_linenumber || ' weeks' END AS time_window, l_orderkey % 4 = 3 AS statistical
FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
""")
def header_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").cast("bigint").alias("q"))
    q, n, k = F.col("q").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_orderkey") % 4
    header = F.when(k == 0, F.concat(F.lit("Low | (n = "), q, F.lit(")"))).when(k == 1, F.concat(F.lit("Group "), n, F.lit(" ("), q, F.lit(")"))).when(k == 2, F.concat(n, F.lit(" weeks"))).otherwise("p-value")
    rest = F.when(F.col("l_orderkey") % 2 == 0, F.lit(9)).otherwise(F.lit(8))
    fields = T.header_fields(header, DOCUMENT_RULES.times, [])
    three = F.when(F.col("l_orderkey") % 3 == 0, F.concat_ws(":", q, n, (F.col("q") + 1).cast("string"))).otherwise(F.concat_ws(";", q, n))
    return li.withColumn("fields", fields).select(
        "l_orderkey", "l_linenumber", T.complement_count(F.concat(q, F.lit(" : "), rest.cast("string")), F.col("q") + 9).alias("complement"), T.group_sizes(three).alias("sizes"),
        "fields.arm", F.col("fields.denominator").alias("size"), F.col("fields.time").alias("time_window"), T.is_statistical_header(header, ["p value"]).alias("statistical"),
    )


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small table per customer nation: orders by priority and status."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    cells = F.array(F.concat(F.lit("the "), F.col("o_orderpriority")), *(F.coalesce(F.col(s).cast("string"), F.lit("-")) for s in "FOP"))
    rows = o.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(cells)).alias("rows"))
    head = F.array(F.lit("Priority"), *(F.lit(f"Group {s} (n={n})") for s, n in (("F", 900), ("O", 800), ("P", 70))))
    return rows.select(
        F.format_string("N%02d", "c_nationkey").alias("article_id"), F.lit("").alias("input_sha256"), F.lit(0).alias("table_seq"), F.lit("Table 1").alias("label"), F.lit("Order counts within 3 weeks").alias("caption"),
        F.lit(1).alias("header_rows"), F.concat(F.array(head), "rows").alias("grid"),
    )


@query("""
WITH o AS (SELECT c_nationkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM o), s(arm, size) AS (VALUES ('F', 900), ('O', 800), ('P', 70))
SELECT printf('N%02d', c_nationkey) AS article_id, 'the' AS term, 'Group ' || arm AS arm, CAST(coalesce(n, 0) AS BIGINT) AS numerator, CAST(size AS BIGINT) AS denominator, '3 weeks' AS time_window,
  'C01+' || CASE WHEN n IS NULL THEN 'TABLE_ZERO' ELSE 'TABLE_COUNT' END AS rule_id, 'Directly poolable' AS poolability, o_orderpriority
FROM k CROSS JOIN s LEFT JOIN o ON o.c_nationkey = k.c_nationkey AND o.o_orderpriority = k.o_orderpriority AND o.o_orderstatus = s.arm
""".replace("c_nationkey)", "k.c_nationkey)").replace("SELECT printf('N%02d', c_nationkey)", "SELECT printf('N%02d', k.c_nationkey)").replace("poolability, o_orderpriority", "poolability, k.o_orderpriority").replace("DISTINCT k.", "DISTINCT "))
def table_records(spark, sf_dir):
    """Cells of order tables as records: unpivot, headers, counts, sizes."""
    r = predictions(table_facts(_grids(spark, sf_dir), DOCUMENT_RULES), DOCUMENT_RULES)
    priority = F.regexp_extract("evidence_quote", r"^the ([^|]*) \|", 1)
    return r.select("article_id", F.col("raw_event_term").alias("term"), "arm", "numerator", "denominator", "time_window", "rule_id", "poolability", priority.alias("o_orderpriority"))


@query("""
WITH o AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS a, count(*) FILTER (l_tax > 0.05) AS b FROM lineitem GROUP BY ALL)
SELECT l_linestatus AS article_id, 'Group ' || l_returnflag AS arm, 'worthless' AS raw_event_term, a AS numerator, n AS denominator, 'C03+TABLE_COUNT' AS rule_id, 'Directly poolable' AS poolability FROM o
UNION ALL SELECT l_linestatus, 'Group ' || l_returnflag, 'trash', b, n, 'C03+TABLE_COUNT', 'Directly poolable' FROM o
""")
def transposed_records(spark, sf_dir):
    """Tables with groups in rows and events in columns."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).cast("string").alias("n"), F.count_if(F.col("l_discount") > 0.05).cast("string").alias("a"), F.count_if(F.col("l_tax") > 0.05).cast("string").alias("b"))
    rows = o.groupBy("l_linestatus").agg(F.array_sort(F.collect_list(F.array("l_returnflag", "n", "a", "b"))).alias("rows"))
    head = F.array(F.lit("Group"), F.lit("n"), F.lit("worthless"), F.lit("trash"))
    grids = rows.select(F.col("l_linestatus").alias("article_id"), F.lit("").alias("input_sha256"), F.lit(0).alias("table_seq"), F.lit("Table 2").alias("label"), F.lit("Order flags").alias("caption"), F.lit(1).alias("header_rows"), F.concat(F.array(head), "rows").alias("grid"))
    return predictions(table_facts(grids, DOCUMENT_RULES), DOCUMENT_RULES).select("article_id", "arm", "raw_event_term", "numerator", "denominator", "rule_id", "poolability")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS active FROM events
""")
def forward_fill(spark, sf_dir):
    """The last purchase up to each event of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("active"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1
""")
def first_wins_distinct(spark, sf_dir):
    """Records of a part and supplier, in different cases and white space;
    the one emitted first stays."""
    quote = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "  OF").otherwise(" of"), F.lit(" it"))
    li = table(spark, sf_dir, "lineitem").select(
        "*", F.col("l_suppkey").cast("string").alias("article_id"), F.lit("Table").alias("source_type"), F.lit("").alias("evidence_location"), F.lit("it").alias("raw_event_term"), F.lit(None).cast("string").alias("arm"), F.col("l_partkey").alias("numerator"),
        F.lit(None).cast("bigint").alias("denominator"), quote.alias("evidence_quote"), F.lit("").alias("name"), F.struct("l_orderkey", "l_linenumber").alias("emit_seq"), F.lit("").alias("rule_id"), F.lit("").alias("predicted_category"),
    )
    return first_wins(li).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# ---- joins and sets ----


@query("""
WITH last AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) SELECT c_custkey, coalesce(p, '') AS priority FROM customer LEFT JOIN last ON c_custkey = o_custkey
""")
def last_wins_lookup(spark, sf_dir):
    last = selection.last_by(table(spark, sf_dir, "orders"), F.col("o_custkey"), "o_orderkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer")
    return c.join(last, c["c_custkey"] == last["_key"], "left").select("c_custkey", F.coalesce("_o_orderpriority", F.lit("")).alias("priority"))


@query("""
SELECT o_orderkey, 'evaluated' AS kind FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT o_orderkey, 'excluded' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def semi_and_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    articles = c.select(F.col("c_custkey").cast("string").alias("article_id"), F.when(F.col("c_acctbal") > 0, " Yes").otherwise("no").alias("eligible"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("article_id"))
    ids = E.eligible_ids(articles)
    return o.join(ids, "article_id", "left_semi").select("o_orderkey", F.lit("evaluated").alias("kind")).unionByName(o.join(ids, "article_id", "left_anti").select("o_orderkey", F.lit("excluded").alias("kind")))


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey").distinct().join(s, "n_nationkey", "left_anti")


@query("SELECT r_regionkey AS key, r_name AS name, NULL::INTEGER AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_by_name(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return sinks.union_rows(r, n)


@query("""
SELECT o_orderkey, 'AH-S2' || substr(o_orderpriority, 1, 1) AS given, CASE WHEN o_orderkey % 2 = 0 THEN 'AH-V' || printf('%03d', o_custkey % 1000) ELSE 'order_' || o_orderkey || '.part' END AS article_id,
  'AH-S2C-' || printf('%03d', o_custkey % 1000) AS short_id, sha256('factloom-queue|' || o_orderkey || '|' || o_orderstatus) AS selection_key, sha256(o_orderpriority) AS digest FROM orders
""")
def ids_and_keys(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("trial_AH-V"), n, F.lit("_x.nxml"))).otherwise(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".part.nxml")))
    return o.select(
        "o_orderkey", F.concat(F.lit("AH-S2"), F.substring("o_orderpriority", 1, 1)).alias("given"), T.article_id_of(name).alias("article_id"), T.short_article_id(F.concat(F.lit("AH-S2C-"), n, F.lit("_doi"))).alias("short_id"),
        T.seeded_key(SEED, F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("selection_key"), F.sha2("o_orderpriority", 256).alias("digest"),
    )


# ---- selection ----

ROBIN_SQL = """
SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('factloom-queue|' || s_suppkey || '|' || s_name)) AS INTEGER) AS turn,
  sha256('factloom-queue|family|' || s_nationkey) AS family_key FROM supplier
"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("selection_key", T.seeded_key(SEED, F.col("s_suppkey").cast("string"), F.col("s_name")))
    return selection.round_robin(s, SEED, family="s_nationkey")


@query(ROBIN_SQL)
def round_robin(spark, sf_dir):
    return _suppliers(spark, sf_dir).select("s_suppkey", "s_nationkey", "turn", "family_key")


@query(f"SELECT s_suppkey, s_nationkey FROM ({ROBIN_SQL}) WHERE turn = 1 ORDER BY family_key LIMIT 5")
def first_per_family(spark, sf_dir):
    return selection.first_per_family(_suppliers(spark, sf_dir)).select("s_suppkey", "s_nationkey")


@query("SELECT c_custkey, c_mktsegment AS queue_role, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('factloom-queue|' || c_custkey)) AS INTEGER) AS role_order FROM customer")
def role_order(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy(T.seeded_key(SEED, F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("queue_role"), F.row_number().over(w).alias("role_order"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("source_candidate_id"), F.col("p_brand").alias("publisher_family"), F.col("p_type").alias("journal"), F.when(F.col("p_size") % 4 == 0, selection.AIP).otherwise("VOR").alias("publication_version"),
        T.seeded_key(SEED, F.col("p_partkey").cast("string")).alias("selection_key"),
    )


def queue_sql(base: str, size: int) -> str:
    """The queue, as ``queued``, of ``a`` (source_candidate_id, good,
    publisher_family, journal, publication_version, selection_key, ...) that
    the CTEs ``base`` end with; the pass under caps is one step per row."""
    columns = "source_candidate_id, publisher_family, journal, publication_version, selection_key"
    return (
        base
        + f""",
robin AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY publisher_family ORDER BY selection_key) AS turn, sha256('{SEED}|family|' || publisher_family) AS family_key FROM a WHERE good),
first AS (SELECT *, row_number() OVER (ORDER BY family_key) AS role_order FROM robin WHERE turn = 1 QUALIFY row_number() OVER (ORDER BY family_key) <= 5),
rest AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY turn, family_key) AS i FROM robin WHERE source_candidate_id NOT IN (SELECT source_candidate_id FROM first)),
pass AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS families, CAST([] AS VARCHAR[]) AS journals, 0 AS aip, FALSE AS taken
  UNION ALL SELECT s.i, CASE WHEN s.ok THEN list_append(families, publisher_family) ELSE families END, CASE WHEN s.ok THEN list_append(journals, journal) ELSE journals END, s.aip + CASE WHEN s.ok AND is_aip THEN 1 ELSE 0 END, s.ok FROM (
    SELECT r.i, families, journals, aip, publisher_family, journal, publication_version = 'PUBLISHER_AIP_COMPLETE' AS is_aip, len(families) < {size} AND len(list_filter(families, lambda x: x = publisher_family)) < 20 AND len(list_filter(journals, lambda x: x = journal)) < 5
      AND NOT (publication_version = 'PUBLISHER_AIP_COMPLETE' AND aip >= 5) AS ok FROM pass JOIN rest r ON r.i = pass.i + 1) s),
main AS (SELECT i FROM pass WHERE taken),
queued AS (SELECT 'CALIBRATION' AS queue_role, CAST(role_order AS INTEGER) AS role_order, {columns} FROM first
  UNION ALL SELECT 'MAIN_EXTERNAL', CAST(row_number() OVER (ORDER BY i) AS INTEGER), {columns} FROM rest WHERE i IN (FROM main) UNION ALL SELECT 'RESERVE', CAST(row_number() OVER (ORDER BY i) AS INTEGER), {columns} FROM rest WHERE i NOT IN (FROM main))
"""
    )


CANDIDATES_SQL = f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT CAST(p_partkey AS VARCHAR) AS source_candidate_id, TRUE AS good, p_brand AS publisher_family, p_type AS journal, CASE WHEN p_size % 4 = 0 THEN 'PUBLISHER_AIP_COMPLETE' ELSE 'VOR' END AS publication_version, sha256('{SEED}|' || p_partkey) AS selection_key FROM part)
"""


@query(queue_sql(CANDIDATES_SQL, 25) + "SELECT * FROM queued")
def capped_queue(spark, sf_dir):
    """Calibration, main set under caps, reserves. Of the six journals here
    the cap of five admits 30, so 50 is out of reach."""
    return selection.queue(_candidates(spark, sf_dir), SEED, size=25)


@query("SELECT host, CASE host WHEN 'Wiley' THEN 'Wiley' WHEN 'Nature Portfolio' THEN 'Springer Nature' WHEN '' THEN 'Independent/Unresolved' ELSE host END AS family, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Wiley' WHEN 1 THEN 'Nature Portfolio' WHEN 2 THEN '' ELSE o_orderpriority END AS host FROM orders) GROUP BY ALL")
def host_families(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    host = F.when(k == 0, "Wiley").when(k == 1, "Nature Portfolio").when(k == 2, "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).select("host", T.publisher_family(F.col("host")).alias("family"), "n")


# ---- evaluation ----


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers' parts as reference events and as predictions, by nation."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    article = F.col("o_custkey").cast("string").alias("article_id")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    g = li.where("l_linenumber % 2 = 1").select(key.alias("event_id"), article, F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("evidence_quote_raw"), F.col("p_name").alias("event_term_raw"), F.col("p_brand").alias("category_canonical"))
    p = li.where("l_linenumber % 2 = 0").select(key.alias("prediction_id"), article, F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("evidence_quote"), F.col("p_name").alias("raw_event_term"), F.col("p_brand").alias("predicted_category"))
    return g, p


@query(rf"""
WITH RECURSIVE lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS article_id, l_linenumber, l_orderkey || '-' || l_linenumber AS id, p_name, p_brand, {NORM_SQL.format("concat_ws(' ', p_name, p_type, p_brand)")} AS quote, {NORM_SQL.format("p_name")} AS term
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
sets AS MATERIALIZED (SELECT *, {TOKENS_SQL.format("quote")} AS qt, {TOKENS_SQL.format("term")} AS tt FROM lines),
pairs AS MATERIALIZED (SELECT g.article_id, g.id AS event_id, p.id AS prediction_id, g.p_brand = p.p_brand AS category_exact, CASE WHEN len(g.qt) > 0 AND len(p.qt) > 0 THEN CAST(len(list_intersect(g.qt, p.qt)) AS DOUBLE) / (len(g.qt) + len(p.qt) - len(list_intersect(g.qt, p.qt))) ELSE 0.0::DOUBLE END AS quote_jaccard,
  CASE WHEN g.term = '' OR p.term = '' THEN 0.0::DOUBLE WHEN g.term = p.term THEN 1.0::DOUBLE WHEN contains(g.term, p.term) OR contains(p.term, g.term) THEN 0.85::DOUBLE WHEN len(g.tt) > 0 AND len(p.tt) > 0 THEN CAST(len(list_intersect(g.tt, p.tt)) AS DOUBLE) / (len(g.tt) + len(p.tt) - len(list_intersect(g.tt, p.tt))) ELSE 0.0::DOUBLE END AS term_similarity
  FROM sets g JOIN sets p USING (article_id) WHERE g.l_linenumber % 2 = 1 AND p.l_linenumber % 2 = 0),
edges AS MATERIALIZED (SELECT *, CASE WHEN quote_jaccard >= 0.5 AND (term_similarity >= 0.5 OR category_exact) THEN 'route_1' ELSE 'route_2' END AS route, 0.6::DOUBLE * quote_jaccard + 0.3::DOUBLE * term_similarity + 0.1::DOUBLE * CAST(category_exact AS DOUBLE) AS rank_score
  FROM pairs WHERE (quote_jaccard >= 0.5 AND (term_similarity >= 0.5 OR category_exact)) OR (term_similarity >= 0.85 AND quote_jaccard >= 0.15)),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY rank_score DESC, quote_jaccard DESC, term_similarity DESC, event_id, prediction_id) AS i FROM edges),
pass AS (
  SELECT article_id, i, [event_id] AS events, [prediction_id] AS predictions, TRUE AS taken FROM ordered WHERE i = 1
  UNION ALL SELECT o.article_id, o.i, CASE WHEN list_contains(events, event_id) OR list_contains(predictions, prediction_id) THEN events ELSE list_append(events, event_id) END,
    CASE WHEN list_contains(events, event_id) OR list_contains(predictions, prediction_id) THEN predictions ELSE list_append(predictions, prediction_id) END, NOT (list_contains(events, event_id) OR list_contains(predictions, prediction_id))
  FROM pass JOIN ordered o ON o.article_id = pass.article_id AND o.i = pass.i + 1)
SELECT article_id, event_id, prediction_id, quote_jaccard, term_similarity, category_exact, route, rank_score FROM ordered JOIN (SELECT article_id, i FROM pass WHERE taken) USING (article_id, i)
""")
def greedy_match(spark, sf_dir):
    """One-to-one matches; in SQL one step per edge of an article."""
    return E.greedy(E.edges(*_sides(spark, sf_dir)))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    articles = d.select(F.col("doc_id").cast("string").alias("article_id"), F.lit("yes").alias("eligible"), F.col("source").alias("publication_version"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("harms_status"))
    return E.article_signals(articles, d.where("n_chars >= 1000").select(F.col("doc_id").cast("string").alias("article_id")))


SIGNALS_SQL = "SELECT doc_id, source, quality = 1 AS g, n_chars >= 1000 AS p FROM documents JOIN labels USING (doc_id)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS article_id, g AS gold_positive, p AS predicted_positive, CASE WHEN g AND p THEN 'TP' WHEN p THEN 'FP' WHEN g THEN 'FN' ELSE 'TN' END AS classification FROM ({SIGNALS_SQL})")
def article_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("article_id", "gold_positive", "predicted_positive", "classification")


def _wilson_sql(a: str, n: str, name: str) -> str:
    p, z = f"(CAST({a} AS DOUBLE) / {n})", "1.959963984540054::DOUBLE"
    centre, half, shrink = f"({p} + {z} * {z} / (CAST({n} AS DOUBLE) * 2))", f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (CAST({n} AS DOUBLE) * 4)) / {n}))", f"(1 + {z} * {z} / {n})"
    return f"round(greatest(0.0::DOUBLE, {centre} / {shrink} - {half} / {shrink}), 12) AS {name}_low, round(least(1.0::DOUBLE, {centre} / {shrink} + {half} / {shrink}), 12) AS {name}_high"


@query(f"""
WITH c AS (SELECT count(*) AS articles, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM ({SIGNALS_SQL}))
SELECT articles, tp, fp, fn, tn, round(CAST(tp AS DOUBLE) / (tp + fn), 12) AS sensitivity, round(CAST(tn AS DOUBLE) / (tn + fp), 12) AS specificity, round(CAST(tp AS DOUBLE) / (tp + fp), 12) AS precision,
  round(CAST(tp + tn AS DOUBLE) / articles, 12) AS accuracy, round(2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn), 12) AS f1, {_wilson_sql("tp", "(tp + fn)", "sensitivity")}, {_wilson_sql("tp + tn", "articles", "accuracy")} FROM c
""")
def confusion_matrix(spark, sf_dir):
    c = E.confusion(_signals(spark, sf_dir))
    rounded = lambda x, name: F.round(x, 12).alias(name)
    bounds = [rounded(c[f"{m}_ci95"][b], f"{m}_{b}") for m in ("sensitivity", "accuracy") for b in ("low", "high")]
    return c.select("articles", "tp", "fp", "fn", "tn", *(rounded(c[m], m) for m in ("sensitivity", "specificity", "precision", "accuracy", "f1")), *bounds)


@query(f"""
SELECT source, count(*) FILTER (g AND p) AS correct, count(*) FILTER (p) AS eligible, round(CAST(count(*) FILTER (g AND p) AS DOUBLE) / nullif(count(*) FILTER (p), 0), 12) AS accuracy FROM ({SIGNALS_SQL}) GROUP BY source
""")
def accuracy_by_group(spark, sf_dir):
    s = _signals(spark, sf_dir).groupBy(F.col("publication_version").alias("source")).agg(F.count_if(F.col("gold_positive") & F.col("predicted_positive")).alias("correct"), F.count_if("predicted_positive").alias("eligible"))
    rated = s.select("source", E.accuracy(F.col("correct"), F.col("eligible")).alias("a"))
    return rated.select("source", "a.correct", "a.eligible", F.round("a.accuracy", 12).alias("accuracy"))


@query("SELECT source, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.025), 6) AS low, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.975), 6) AS high FROM documents GROUP BY source")
def percentiles(spark, sf_dir):
    p = table(spark, sf_dir, "documents").groupBy("source").agg(F.percentile("n_chars", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return p.select("source", F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


# The Mersenne Twister's words, shifts and masks.
WORDS, SHIFTED, MATRIX = 624, 397, 2567483615
UPPER, LOWER = 2147483648, 2147483647
TEMPER_B, TEMPER_C = 2636928640, 4022730752


def bootstrap_sql(counts: str, label: str, replicates: int = E.REPLICATES) -> str:
    """The intervals of the cluster bootstrap over ``counts`` (article_id, tp,
    fp, fn), in SQL: a recursion over the generator's states from the seeded
    one on, whose words are tempered, cut to the bits of a place, filtered,
    numbered, and dealt to replicates in order."""
    key = ", ".join(map(str, E.seeded(label)["state"]["key"]))
    new = lambda a, b: f"xor((({a} & {UPPER}) | ({b} & {LOWER})) >> 1, CASE WHEN {b} & 1 = 1 THEN {MATRIX}::UBIGINT ELSE 0::UBIGINT END)"
    # A state's words depend on older ones, or on new ones of the part before.
    part = lambda first, last, other: f"list_transform(range({first}, {last + 1}), lambda k: xor({new('mt[k]', 'mt[k + 1]')}, {other}))"
    n, m = WORDS, WORDS - SHIFTED
    low_high = ((0.025, "low"), (0.975, "high"))
    return f"""
WITH RECURSIVE counts AS ({counts}),
p AS (SELECT count(*) AS n, length(bin(count(*))) AS bits, {replicates} AS replicates FROM counts),
twists AS (
  SELECT 0 AS i, [{key}]::UBIGINT[] AS mt
  UNION ALL SELECT i + 1, list_concat(list_concat(a, b), list_append(c, xor({new(f"mt[{n}]", "a[1]")}, b[{SHIFTED - m}])))
  FROM (SELECT *, {part(2 * m + 1, n - 1, f"b[k - {2 * m}]")} AS c FROM (SELECT *, {part(m + 1, 2 * m, f"a[k - {m}]")} AS b FROM (SELECT *, {part(1, m, f"mt[k + {SHIFTED}]")} AS a FROM twists)))
  WHERE i < (SELECT 2 + replicates * (1 << bits) * 21 // (20 * {n}) FROM p)),
words AS (SELECT i, generate_subscripts(mt, 1) AS j, unnest(mt) AS w FROM twists WHERE i > 0),
first AS (SELECT i, j, xor(w, w >> 11) AS w FROM words), second AS (SELECT i, j, xor(w, (w << 7) & {TEMPER_B}) AS w FROM first),
third AS (SELECT i, j, xor(w, (w << 15) & {TEMPER_C}) AS w FROM second), tempered AS (SELECT i, j, xor(w, w >> 18) AS w FROM third),
places AS (SELECT w >> (32 - bits) AS place, row_number() OVER (ORDER BY i, j) - 1 AS k, n, replicates FROM tempered, p WHERE w >> (32 - bits) < n),
sums AS (
  SELECT k // n AS replicate, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn
  FROM places JOIN (SELECT row_number() OVER (ORDER BY article_id) - 1 AS place, tp, fp, fn FROM counts) USING (place) WHERE k < n * replicates GROUP BY ALL),
rated AS (SELECT CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM sums),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN precision * recall * 2 / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM rated)
SELECT {", ".join(f"round(quantile_cont({x}, {q}), 12) AS {x}_{b}" for x in ("precision", "recall", "f1") for q, b in low_high)} FROM f
"""


SOURCE_COUNTS_SQL = f"SELECT source AS article_id, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM ({SIGNALS_SQL}) GROUP BY source"


@query(bootstrap_sql(SOURCE_COUNTS_SQL, "documents"))
def bootstrap_intervals(spark, sf_dir):
    """Cluster bootstrap over sources; its draws are a seeded sequence."""
    s = _signals(spark, sf_dir)
    counts = s.groupBy(F.col("publication_version").alias("article_id")).agg(*(F.count_if(F.col("classification") == k).alias(k.lower()) for k in ("TP", "FP", "FN")))
    b = E.bootstrap(counts, "documents")
    return b.select(*(F.round(F.col(m)[i], 12).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for i, n in enumerate(("low", "high"))))


@query("SELECT o_orderstatus AS status, o_orderpriority AS format_status, count(*) AS articles, sum(o_custkey)::BIGINT AS tables FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    """Orders as normalised articles, by both of their statuses."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("format_status"), F.col("o_custkey").cast("long").alias("table_count"))
    return adapters.audit_summary(o, "status", "format_status")


# ---- pages and layout ----


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.format_string("P%09d", "page_id").alias("article_id"), "html")


PAGES_SQL = r"""
WITH a AS (SELECT page_id, list_transform(string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:], lambda x: regexp_replace(regexp_replace(x, '</p>.*$', '', 's'), '<[^>]*>', ' ', 'g')) AS parts FROM pages),
b AS (SELECT page_id, list_transform(parts, lambda x: replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS parts FROM a),
c AS (SELECT page_id, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
"""


@query(PAGES_SQL + "SELECT printf('P%09d', page_id) AS article_id, 'p' AS kind, CAST(i - 1 AS INTEGER) AS seq, 'Article body' AS location, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)")
def html_paragraphs(spark, sf_dir):
    return html.parsed_pages(_pages(spark, sf_dir)).select("article_id", "kind", "seq", "location", "text")


@query(PAGES_SQL + "SELECT 'REVIEW' AS structural_status, count(*) AS n, CAST(sum(len(parts)) AS BIGINT) AS paragraphs FROM c")
def html_status(spark, sf_dir):
    return html.page_diagnostics(_pages(spark, sf_dir)).groupBy("structural_status").agg(F.count(F.lit(1)).alias("n"), F.sum("paragraph_count").alias("paragraphs"))


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN 'Methods' WHEN 1 THEN 'Results' WHEN 3 THEN 'References' END AS heading, CASE k WHEN 2 THEN 'Table ' || o_custkey || ' counts' END AS label,
  CASE k WHEN 4 THEN ['a b', CAST(o_custkey AS VARCHAR)] ELSE [line] END AS cells, CASE k WHEN 5 THEN 'Outcomes of ' || o_custkey ELSE line END AS caption
FROM (SELECT *, CASE k WHEN 0 THEN '2. Materials and Methods' WHEN 1 THEN 'RESULTS:' WHEN 2 THEN 'Table ' || o_custkey || ' counts' WHEN 3 THEN 'References' WHEN 4 THEN 'a b ' || o_custkey ELSE 'some words of the left column Outcomes of ' || o_custkey END AS line FROM (SELECT *, o_orderkey % 6 AS k FROM orders))
""")
def layout_lines(spark, sf_dir):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    line = (
        F.when(k == 0, "2. Materials and Methods").when(k == 1, "RESULTS:").when(k == 2, F.concat(F.lit("Table "), c, F.lit(" counts"))).when(k == 3, "References")
        .when(k == 4, F.concat(F.lit("  a b   "), c)).otherwise(F.concat(F.lit("some words of the left column Outcomes of "), c))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return o.select("o_orderkey", T.heading_name(F.col("line")).alias("heading"), T.table_label(F.col("line")).alias("label"), T.split_columns(F.col("line")).alias("cells"), T.clean_caption(F.col("line")).alias("caption"))


@query(r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS article_id, list_transform(string_split_regex(text, '\r\n|[\n\r\v\f\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS lines FROM documents),
j AS (SELECT article_id, array_to_string(list_transform(list_filter(lines, lambda x: NOT regexp_full_match(x, '\d{1,4}')), lambda x: CASE WHEN x = '' THEN chr(1) ELSE x END), ' ') AS said FROM d),
p AS (SELECT article_id, list_filter(list_transform(string_split(said, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS t FROM j),
i AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM p)
SELECT article_id, 'Introduction' AS section, 0 AS section_seq, CAST(i - 1 AS INTEGER) AS paragraph_seq, t[i] AS text FROM i UNION ALL SELECT article_id, 'Results', 1, CAST(len(t) + i - 1 AS INTEGER), t[i] FROM i
""")
def plain_text_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.concat(F.lit("Introduction\n"), "text", F.lit("\n\nResults\n\n"), "text", F.lit("\n17\nReferences\nlast")).alias("text"))
    return layout.plain_sections(d)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS article_id, 0 AS table_seq, 1 AS page, 'Table 1' AS label, 'Outcomes' AS caption, 1 AS header_rows, 'Variable,Group A,Group B;early,' || o_custkey || ',7;late,2,9' AS cells FROM orders
""")
def layout_text_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("article_id"), F.concat(F.lit("Table 1\nOutcomes\n  Variable   Group A   Group B\n  early   "), F.col("o_custkey").cast("string"), F.lit("   7\n  late   2   9\n\n\nmore")).alias("layout_text"))
    cells = F.array_join(F.transform("grid", lambda r: F.array_join(r, ",")), ";")
    return layout.parsed_layout(o).select("article_id", "table_seq", "page", "label", "caption", "header_rows", cells.alias("cells"))


@query("""
WITH RECURSIVE w AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS text, l_quantity * 4 AS x0, l_quantity * 4 + 3 AS x1, l_discount * 100 + l_linenumber * 0.7::DOUBLE AS top FROM lineitem),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY top, x0, text) AS i FROM w),
runs AS (SELECT l_orderkey, i, top AS first, 0 AS line FROM o WHERE i = 1
  UNION ALL SELECT o.l_orderkey, o.i, CASE WHEN abs(first - top) > 2.2::DOUBLE THEN top ELSE first END, line + CASE WHEN abs(first - top) > 2.2::DOUBLE THEN 1 ELSE 0 END FROM runs JOIN o ON o.l_orderkey = runs.l_orderkey AND o.i = runs.i + 1),
p AS MATERIALIZED (SELECT l_orderkey, line, text, x0, x1, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY x0, i) AS place FROM runs JOIN o USING (l_orderkey, i)),
c AS (SELECT l_orderkey, line, place, x1 AS reach, 0 AS cell FROM p WHERE place = 1
  UNION ALL SELECT p.l_orderkey, p.line, p.place, greatest(reach, x1), cell + CASE WHEN x0 - reach >= 12 THEN 1 ELSE 0 END FROM c JOIN p ON p.l_orderkey = c.l_orderkey AND p.line = c.line AND p.place = c.place + 1),
j AS (SELECT l_orderkey, line, cell, string_agg(text, ' ' ORDER BY place) AS said FROM c JOIN p USING (l_orderkey, line, place) GROUP BY ALL)
SELECT l_orderkey, line, list(said ORDER BY cell) AS cells FROM j GROUP BY ALL
""")
def word_clusters(spark, sf_dir):
    """Line items as words of a page: their lines, and the lines' cells."""
    li = table(spark, sf_dir, "lineitem")
    word = F.struct(F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") * 4).alias("x0"), (F.col("l_quantity") * 4 + 3).alias("x1"), (F.col("l_discount") * 100 + F.col("l_linenumber") * 0.7).alias("top"), (F.col("l_discount") * 100 + 9).alias("bottom"))
    pages = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return pages.select("l_orderkey", F.posexplode(coordinates.word_cells(F.col("words"))).alias("line", "cells"))
