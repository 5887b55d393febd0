"""Facts from table grids.

A grid (rows of equal width, the first ``header_rows`` of them headers) is
turned into one row per data row and event column by array functions alone:
what a row needs of its table (headers, subheadings above it) is computed in
place, so no exchange and no window over a table is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.body import file_name
from factloom.operators.tagging import HITS, hits, hits_of_each
from factloom.sources.rules import Rules

SKIPPED = ("TABLE_MISSING", "TABLE_NONNUMERIC")


def merged_headers(grid: Column, header_rows: Column) -> Column:
    """Per column, its distinct filled header cells joined by `` | ``."""
    top = F.slice(grid, 1, header_rows)
    cells = lambda c: F.array_distinct(F.filter(F.transform(top, lambda r: F.get(r, c)), lambda v: v != ""))
    return F.transform(F.sequence(F.lit(0), F.size(grid[0]) - 1), lambda c: T.clean(F.array_join(cells(c), " | ")))


def _event_row(term: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("start"), F.lit("Unmappable").alias("category"), term.alias("term"), F.lit("TABLE_SAFETY_ROW").alias("rule_id"))).cast(HITS)


def _location() -> Column:
    return T.clean(F.concat_ws(" ", "label", "caption", F.lit("row"), (F.col("row_no")).cast("string"), F.lit("column"), (F.col("col") + 1).cast("string")))


def _prepared(tables: DataFrame, rules: Rules, extended: bool) -> DataFrame:
    rows = F.greatest(F.coalesce("header_rows", F.lit(0)), F.lit(1))
    base = tables.where("size(grid) > 0 and size(grid[0]) > 0").select(
        "article_id", "input_sha256", file_name(tables), "table_seq", F.coalesce("label", F.lit("Table")).alias("label"), F.coalesce("caption", F.lit("")).alias("caption"), "grid", rows.cast("int").alias("header_rows")
    )
    return base.withColumn("headers", merged_headers(F.col("grid"), F.col("header_rows"))).withColumn("caption_hits", hits(F.col("caption"), rules, extended)).withColumn("caption_time", T.first_time(F.col("caption"), rules.times))


def _data_rows(tables: DataFrame) -> DataFrame:
    """A row per data row: row (cells), row_no (1-based in the grid), and the
    subheading that is active there. A row carries its table's subheadings
    alone, not the grid."""
    body = F.slice("grid", F.col("header_rows") + 1, F.greatest(F.size("grid") - F.col("header_rows"), F.lit(0)))
    marked = F.transform(body, lambda r, i: F.struct(i.alias("i"), r.alias("row"), T.is_repeated_row(r).alias("repeated")))
    marks = F.transform(F.filter("marked", lambda m: m["repeated"]), lambda m: F.struct(m["i"].alias("i"), m["row"][0].alias("text")))
    found = tables.withColumn("marked", marked).withColumn("marks", marks).drop("grid")
    rows = found.select("*", F.explode("marked").alias("m")).drop("marked")
    above = F.array_max(F.filter("marks", lambda x: x["i"] < F.col("m.i")))
    names = [c for c in tables.columns if c != "grid"]
    return rows.select(*names, F.col("m.row").alias("row"), (F.col("m.i") + F.col("header_rows") + 1).alias("row_no"), F.col("m.repeated").alias("repeated"), F.coalesce(above["text"], F.lit("")).alias("active"))


def _valued(cells: DataFrame, rules: Rules) -> DataFrame:
    """Cells (value, ...) that say something, with their numbers."""
    numbers = T.cell_value(F.col("value"), rules.missing_cells, rules.zero_cells)
    return T.with_once(cells, "numbers", numbers).where(~F.col("numbers.rule").isin(*SKIPPED))


def _facts(rows: DataFrame) -> DataFrame:
    one = F.lit(1)
    return rows.select(
        "article_id", "input_sha256", "name", F.lit("Table").alias("source_type"), _location().alias("location"), "quote", "hit", "numerator", "denominator", "percentage", "numeric_rule", "arm", "time",
        F.struct(one.alias("branch"), F.col("table_seq").cast("int").alias("a"), F.col("row_no").alias("b"), F.col("col").alias("c"), F.col("hit_seq").alias("d")).alias("emit_seq"),
    )


def _transposed(tables: DataFrame, rules: Rules) -> DataFrame:
    """Tables with groups in rows and events in columns."""
    size_col = F.try_element_at(F.filter(F.transform("headers", lambda h, i: F.when(T.clean(h).rlike(r"(?iU)^(?:n|number|sample size|patients?)$"), i)), lambda i: i.isNotNull()), F.lit(1))
    rows = _data_rows(tables.withColumn("size_col", size_col))
    group = T.clean(F.col("row")[0])
    size = F.when(T.clean(F.get("row", F.col("size_col"))).rlike(r"(?U)^\d+$"), T.clean(F.get("row", F.col("size_col"))).try_cast("bigint"))
    named = (
        rows.where((group != "") & ~group.rlike(r"(?iU)^p(?:\s*[- ]?value)?$"))
        .withColumn("arm", F.when(group.rlike("^[A-Za-z0-9]$"), F.concat(F.lit("Group "), group)).otherwise(group))
        .withColumn("denominator", size)
        .select("*", F.explode("event_columns").alias("e"))
        .select("*", F.col("e.col").alias("col"), F.col("e.hits").alias("hits"))
        .withColumn("value", F.get("row", F.col("col")))
    )
    named = _valued(named, rules).where(F.col("numbers.rule") != "TABLE_DESCRIPTIVE_NUMERIC")
    quote = F.concat(F.get("headers", F.col("col")), F.lit(" | "), "arm", F.lit(" | "), "arm", F.lit(": "), "value")
    return _facts(
        named.withColumn("quote", quote)
        .select("*", F.posexplode("hits").alias("hit_seq", "hit"))
        .select("*", "numbers.numerator", "numbers.percentage", F.col("numbers.rule").alias("numeric_rule"), F.col("caption_time").alias("time"))
    )


def _plain(tables: DataFrame, rules: Rules) -> DataFrame:
    """Tables with events in rows and groups in columns."""
    text = F.col("event_text")
    rows = _data_rows(tables).where("not repeated").withColumn("event_text", T.clean(F.col("row")[0])).where("event_text <> ''")
    rows = rows.withColumn("row_time", T.first_time(text, rules.times)).withColumn("row_hits", hits(text, rules))
    by_caption = (F.size("caption_hits") > 0) & F.col("row_time").isNotNull()
    open_table = (F.col("safety") & ~F.col("mixed")) | T.contains_any(F.col("active"), rules.table_safety)
    unknown = (F.size("row_hits") == 0) & open_table & ~T.contains_any(text, rules.row_non_event)
    rows = rows.withColumn("by_caption", by_caption).withColumn("hits", F.when(by_caption, F.col("caption_hits")).when(unknown, _event_row(text)).otherwise(F.col("row_hits"))).where("size(hits) > 0")
    columns = F.filter(F.transform("headers", lambda h, i: F.struct(i.alias("col"), h.alias("header"))), lambda c: c["col"] > 0)
    sizes = F.transform(F.filter(columns, lambda c: T.is_sizes_header(c["header"])), lambda c: T.group_sizes(F.get("row", c["col"])))
    sizes = F.coalesce(F.try_element_at(F.filter(sizes, lambda s: F.size(s) > 0), F.lit(1)), F.array().cast("array<bigint>"))
    groups = F.filter(columns, lambda c: ~T.is_sizes_header(c["header"]) & ~T.is_statistical_header(c["header"], rules.statistical))
    cells = rows.withColumn("sizes", sizes).select("*", F.posexplode(groups).alias("position", "g")).select("*", F.col("g.col").alias("col"), F.col("g.header").alias("header"))
    cells = _valued(cells.withColumn("value", F.get("row", F.col("col"))), rules)
    cells = cells.withColumn("fields", T.header_fields(F.col("header"), rules.times, rules.arm_noise)).withColumn("denominator", F.coalesce("fields.denominator", F.get("sizes", F.col("position"))))
    described = F.col("numbers.rule") == "TABLE_DESCRIPTIVE_NUMERIC"
    complement = T.complement_count(F.col("value"), F.col("denominator"))
    cells = cells.withColumn("complement", F.when(described, complement)).where(~described | F.col("complement").isNotNull())
    time = F.coalesce(F.when(F.col("by_caption"), F.col("row_time")), F.col("fields.time"), F.col("row_time"), F.col("caption_time"))
    return _facts(
        cells.withColumn("quote", _quote())
        .select("*", F.posexplode("hits").alias("hit_seq", "hit"))
        .select(
            "*", F.coalesce("complement", "numbers.numerator").alias("numerator"), "numbers.percentage", F.col("fields.arm").alias("arm"), time.alias("time"),
            F.when(described, "TABLE_COUNT_COMPLEMENT").otherwise(F.col("numbers.rule")).alias("numeric_rule"),
        )
    )


def _quote() -> Column:
    head = F.when(F.col("by_caption"), F.col("caption")).otherwise(F.col("event_text"))
    second = F.when(F.col("by_caption"), F.col("event_text")).otherwise(F.col("header"))
    return F.concat(head, F.lit(" | "), second, F.lit(" | "), "header", F.lit(": "), "value")


def table_facts(tables: DataFrame, rules: Rules, version: str = "1.2") -> DataFrame:
    """Facts of tables (article_id, table_seq, label, caption, header_rows,
    grid, input_sha256, and name, if they are from files). Tables without a cell have none; null label and
    caption count as ``Table`` and empty."""
    if version == "1.1":
        return _first_version(tables, rules)
    prepared = _prepared(tables, rules, True)
    safety, excluded = T.contains_any(F.col("caption"), rules.table_safety), T.contains_any(F.col("caption"), rules.table_excluded)
    used = prepared.withColumn("safety", safety).withColumn("mixed", safety & excluded).where(safety | ~excluded)
    events = F.filter(F.transform("header_hits", lambda h, i: F.struct(i.alias("col"), h.alias("hits"))), lambda e: (e["col"] > 0) & (F.size(e["hits"]) > 0))
    sized = F.exists("headers", lambda h: T.clean(h).rlike(r"(?iU)^(?:n|number|sample size|patients?)$"))
    group_rows = F.size(F.filter(F.slice("grid", F.col("header_rows") + 1, F.size("grid")), lambda r: T.clean(r[0]).rlike(r"(?iU)^(?:group\s*)?[A-Za-z0-9-]+$")))
    used = used.withColumn("header_hits", hits_of_each(F.col("headers"), rules)).withColumn("event_columns", events).drop("header_hits")
    used = used.withColumn("transposed", (F.size("event_columns") >= 2) & sized & (group_rows >= 2))
    return _transposed(used.where("transposed"), rules).unionByName(_plain(used.where("not transposed"), rules))


def _first_version(tables: DataFrame, rules: Rules) -> DataFrame:
    """Version 1.1: any event or generic cue in the caption opens all rows,
    and every column is a group."""
    prepared = _prepared(tables, rules, False)
    text = F.col("event_text")
    rows = _data_rows(prepared).withColumn("event_text", F.col("row")[0]).withColumn("row_time", T.first_time(text, rules.times)).withColumn("row_hits", hits(text, rules, False))
    by_caption = (F.size("caption_hits") > 0) & F.col("row_time").isNotNull()
    opened = T.has_phrase(F.col("caption"), rules.generic_cues) | (F.size("caption_hits") > 0)
    unknown = (F.size("row_hits") == 0) & opened & (text != "")
    rows = rows.withColumn("by_caption", by_caption).withColumn("hits", F.when(by_caption, F.col("caption_hits")).when(unknown, _event_row(text)).otherwise(F.col("row_hits"))).where("size(hits) > 0")
    cells = rows.select("*", F.posexplode("headers").alias("col", "header")).where("col > 0").withColumn("value", F.get("row", F.col("col")))
    cells = _valued(cells, rules)
    cells = cells.withColumn("fields", T.header_fields(F.col("header"), rules.times, rules.arm_noise, bare_sizes=False)).withColumn("quote", _quote())
    time = F.coalesce(F.when(F.col("by_caption"), F.col("row_time")), F.col("fields.time"))
    return _facts(
        cells.select("*", F.posexplode("hits").alias("hit_seq", "hit"))
        .select("*", "numbers.numerator", "fields.denominator", "numbers.percentage", F.col("fields.arm").alias("arm"), time.alias("time"), F.col("numbers.rule").alias("numeric_rule"))
    )
