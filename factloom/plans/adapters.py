"""Publisher pages and PDF text to minimal article XML, with audits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.numbering import with_place
from factloom.operators.written import written
from factloom.sources import html, layout
from factloom.sources.sinks import article_xml, write_files
from factloom.sources.store import new_folder, write_csv, write_json


def slug(doi: Column) -> Column:
    return F.regexp_replace(doi, "[^A-Za-z0-9]+", "_")


def usable_pages(downloads: DataFrame) -> DataFrame:
    """Downloads (doi, download_status, local_file, ...) that succeeded as
    HTML, with candidate_id by the order of their doi."""
    good = downloads.where((F.col("download_status") == "success") & F.col("local_file").endswith(".html"))
    return with_place(good, ("doi", "local_file"), "_place").withColumn("candidate_id", F.format_string("AH-S2C-%03d", "_place")).drop("_place")


def html_articles(downloads: DataFrame, table_pages: DataFrame) -> DataFrame:
    """candidate_id, doi, file name, xml and audit columns of usable pages.

    downloads has html beside its audit columns; table_pages are doi, status,
    local_file, html, of which successful ones belong to the article of their
    doi, in the order of their files. PASS takes a title, results and five
    paragraphs, else it is REVIEW.
    """
    pages = usable_pages(downloads)
    more = table_pages.where("status = 'success'").select(F.col("doi"), "local_file", F.col("html").alias("t"))
    grouped = more.groupBy("doi").agg(F.array_sort(F.collect_list(F.struct("local_file", "t"))).alias("tables")).select("doi", F.col("tables.t").alias("tables"))
    rows = pages.join(grouped, "doi", "left").select("candidate_id", "doi", "local_file", "html", "tables")
    kinds = [("title", pa.string()), ("section_count", pa.int32()), ("paragraph_count", pa.int32()), ("table_count", pa.int32()), ("has_results", pa.bool_()), ("source_table_pages", pa.int32()), ("xml", pa.binary())]

    def run(batches):
        for batch in batches:
            out = [_html_article(page or "", tables or []) for page, tables in zip(batch.column("html").to_pylist(), batch.column("tables").to_pylist())]
            columns = [pa.array([o[name] for o in out], kind) for name, kind in kinds]
            yield pa.record_batch([batch.column(c) for c in ("candidate_id", "doi", "local_file")] + columns, names=["candidate_id", "doi", "local_file", *(n for n, _ in kinds)])

    schema = "candidate_id string, doi string, local_file string, title string, section_count int, paragraph_count int, table_count int, has_results boolean, source_table_pages int, xml binary"
    good = (F.col("title") != "") & F.col("has_results") & (F.col("paragraph_count") >= 5)
    made = rows.mapInArrow(run, schema)
    return made.withColumn("normalized_file", F.concat("candidate_id", F.lit("_"), slug(F.col("doi")), F.lit(".nxml"))).withColumn("normalized_sha256", F.sha2("xml", 256)).withColumn("structural_status", F.when(good, "PASS").otherwise("REVIEW"))


def _html_article(page: str, table_pages: list[str]) -> dict:
    info, paragraphs, links = html.page_items(page)
    sections: dict[str, list[str]] = {name: [] for name in info["sections"]}
    for p in paragraphs:
        sections.setdefault(p["location"], []).append(p["text"])
    tables = [t for content in table_pages for t in html.page_tables(content or "")]
    return {**info, "table_count": len(tables), "source_table_pages": len(table_pages), "xml": article_xml(info["title"], sections.items(), tables)}


def text_articles(pool: DataFrame, texts: DataFrame, tables: DataFrame) -> DataFrame:
    """source_candidate_id, doi, file name, xml and audit columns of the
    pool's PDF rows.

    pool: source_candidate_id, doi, title, source_route. texts: article_id,
    text (plain). tables: article_id, page, label, caption, header_rows, grid,
    from coordinates or layout. PASS takes five paragraphs and results; the
    tables' format passes with one table.
    """
    asked = pool.where("source_route = 'MANUAL_PUBLISHER_PDF'").select(F.col("source_candidate_id").alias("article_id"), "doi", "title")
    paragraphs = layout.plain_sections(texts.select("article_id", "text")).where("section <> 'References'")
    p = paragraphs.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("section_seq", "paragraph_seq", "section", "text"))).alias("paragraphs"))
    t = tables.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("page", "label", "caption", "header_rows", "grid"))).alias("tables"))
    rows = asked.join(p, "article_id", "left").join(t, "article_id", "left")
    kinds = [("section_count", pa.int32()), ("paragraph_count", pa.int32()), ("table_count", pa.int32()), ("table_row_count", pa.int32()), ("has_results", pa.bool_()), ("xml", pa.binary())]

    def run(batches):
        for batch in batches:
            out = [_text_article(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("title", "doi", "paragraphs", "tables")))]
            columns = [pa.array([o[name] for o in out], kind) for name, kind in kinds]
            yield pa.record_batch([batch.column("article_id"), batch.column("doi"), *columns], names=["source_candidate_id", "doi", *(n for n, _ in kinds)])

    made = rows.mapInArrow(run, "source_candidate_id string, doi string, section_count int, paragraph_count int, table_count int, table_row_count int, has_results boolean, xml binary")
    return (
        made.withColumn("normalized_file", F.concat("source_candidate_id", F.lit("_"), slug(F.col("doi")), F.lit(".nxml")))
        .withColumn("normalized_sha256", F.sha2("xml", 256))
        .withColumn("structural_status", F.when((F.col("paragraph_count") >= 5) & F.col("has_results"), "PASS").otherwise("REVIEW"))
        .withColumn("table_format_status", F.when(F.col("table_count") >= 1, "PASS_COORDINATE_TABLES").otherwise("REVIEW_NO_RELIABLE_TABLE"))
    )


def _text_article(title: str | None, doi: str | None, paragraphs: list[dict] | None, tables: list[dict] | None) -> dict:
    sections: dict[str, list[str]] = {}
    for p in paragraphs or []:
        sections.setdefault(p["section"], []).append(p["text"])
    tables = tables or []
    return {
        "section_count": len(sections), "paragraph_count": len(paragraphs or []), "table_count": len(tables), "table_row_count": sum(len(t["grid"]) for t in tables),
        "has_results": "Results" in sections, "xml": article_xml(title or "", sections.items(), tables, doi or ""),
    }


def audit_summary(articles: DataFrame, *statuses: str) -> DataFrame:
    """Counts by the status columns, and the tables among them."""
    return articles.groupBy(*(statuses or ("structural_status",))).agg(F.count(F.lit(1)).alias("articles"), F.sum("table_count").alias("tables"))


def write_normalised(articles: DataFrame, folder: str, audit: object, *statuses: str) -> dict:
    """Write the xml of ``articles`` (normalized_file, xml, ...) into
    ``folder``, a file each, by the tasks, and into a new folder ``audit`` the
    rows without xml (audit.csv) and their summary (summary.json), which is
    returned. ``statuses`` are the status columns that are counted."""
    out, rows = new_folder(audit), written(articles, "normalised")
    files = write_files(rows.select(F.col("normalized_file").alias("name"), F.col("xml").alias("content")), folder)
    wrong = rows.join(files, (F.col("normalized_file") == F.col("name")) & (F.col("normalized_sha256") == F.col("sha256")), "left_anti").count()
    if wrong:
        raise OSError(f"{wrong} files are not what was made")
    digest = write_csv(out / "audit.csv", rows.drop("xml"), "normalized_file")
    summary = {"normalized_articles": files.count(), "total_tables": rows.agg(F.coalesce(F.sum("table_count"), F.lit(0))).first()[0]}
    for status in statuses or ("structural_status",):
        summary[status] = {r[status]: r["count"] for r in rows.groupBy(status).count().orderBy(status).collect()}
    summary |= {"label_free": True, "audit_sha256": digest}
    write_json(out / "summary.json", summary)
    return summary
