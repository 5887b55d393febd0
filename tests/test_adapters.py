"""Pages and PDF text to article XML and back."""

from factloom.plans import adapters
from factloom.sources.articles import items_of

PAGE = '<h1 class="article-title">T</h1><section data-title="Results">' + "".join(f"<p>p{i}</p>" for i in range(5)) + '<a href="/a/tables/1">t</a></section>'


def test_html_articles(spark):
    downloads = spark.createDataFrame(
        [("10.1/b", "success", "b.html", PAGE), ("10.1/a", "success", "a.html", "<main><p>x</p></main>"), ("10.1/c", "failed", "c.html", PAGE), ("10.1/d", "success", "d.pdf", None)],
        "doi string, download_status string, local_file string, html string",
    )
    tables = spark.createDataFrame([("10.1/b", "success", "t1", "<h1>Cap</h1><table><tr><th>a<tr><td>1</table>"), ("10.1/b", "failed", "t2", "<table></table>")], "doi string, status string, local_file string, html string")
    rows = adapters.html_articles(downloads, tables).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.normalized_file, r.structural_status, r.table_count) for r in rows] == [
        ("AH-S2C-001", "AH-S2C-001_10_1_a.nxml", "REVIEW", 0), ("AH-S2C-002", "AH-S2C-002_10_1_b.nxml", "PASS", 1),
    ]
    items = list(items_of(bytes(rows[1].xml)))
    assert [i["kind"] for i in items].count("table") == 1 and [i["text"] for i in items if i["kind"] == "p" and not i["in_table"]] == [f"p{i}" for i in range(5)]
    counts = {r.structural_status: r.articles for r in adapters.audit_summary(adapters.html_articles(downloads, tables)).collect()}
    assert counts == {"PASS": 1, "REVIEW": 1}


def test_text_articles(spark):
    pool = spark.createDataFrame([("C1", "10/x", "T", "MANUAL_PUBLISHER_PDF"), ("C2", "10/y", None, "MANUAL_PUBLISHER_PDF"), ("C3", "10/z", "T", "AUTOMATED_PUBLISHER_HTML")], "source_candidate_id string, doi string, title string, source_route string")
    texts = spark.createDataFrame([("C1", "lead\n\nResults\n" + "\n\n".join(f"p{i}" for i in range(5)) + "\nReferences\nno")], "article_id string, text string")
    tables = spark.createDataFrame([("C1", 2, "Table 1", "c", 1, [["a", "b"], ["1", "2"]])], "article_id string, page int, label string, caption string, header_rows int, grid array<array<string>>")
    rows = adapters.text_articles(pool, texts, tables).orderBy("source_candidate_id").collect()
    assert [(r.source_candidate_id, r.paragraph_count, r.table_row_count, r.structural_status, r.table_format_status) for r in rows] == [
        ("C1", 6, 2, "PASS", "PASS_COORDINATE_TABLES"), ("C2", 0, 0, "REVIEW", "REVIEW_NO_RELIABLE_TABLE"),
    ]
    items = list(items_of(bytes(rows[0].xml)))
    assert [(i["location"], i["text"]) for i in items if i["kind"] == "p" and not i["in_table"]][0] == ("Article body", "lead")
