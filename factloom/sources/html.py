"""Web pages: to the same paragraph and table rows as article XML.

The standard library's tokenizer feeds a small recovering tree builder (void
elements, implied ends of p, li, tr, td, th, unmatched end tags). One page at
a time is held, in the parse alone.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.articles import ITEM_SCHEMA, ITEMS, as_batches, grid_of

#: Sections that hold no content of the article.
EXCLUDED = (
    "inline recommendations",
    "references",
    "author information",
    "additional information",
    "rights and permissions",
    "about this article",
    "related content",
    "acknowledgements",
    "funding",
    "ethics declarations",
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A start tag ends these open elements, unless one of the fences is nearer.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.open = [self.root]

    def _close(self, names: set[str], fences: set[str]) -> None:
        """End the outermost open element of ``names`` inside the fences."""
        outermost = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in fences:
                break
            if self.open[i].tag in names:
                outermost = i
        if outermost:
            del self.open[outermost:]

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "html":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        at = self.open[-1]
        if at.tag in ("script", "style"):
            return
        if len(at):
            at[-1].tail = (at[-1].tail or "") + data
        else:
            at.text = (at.text or "") + data


def tree(html: str) -> ET.Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def text_of(node: ET.Element) -> str:
    return " ".join(" ".join(node.itertext()).split())


def walk(root: ET.Element) -> Iterator[tuple[ET.Element, tuple[ET.Element, ...]]]:
    """All elements in document order with their ancestors."""
    stack: list[tuple[ET.Element, tuple[ET.Element, ...]]] = [(root, ())]
    while stack:
        node, above = stack.pop()
        yield node, above
        stack += [(c, (*above, node)) for c in reversed(node)]


def section_of(node: ET.Element, above: tuple[ET.Element, ...]) -> ET.Element | None:
    return next((n for n in (node, *reversed(above)) if n.tag == "section" and n.get("data-title")), None)


def title_of(section: ET.Element | None) -> str:
    return " ".join(section.get("data-title").split()) if section is not None else "Results"


def page_items(html: str) -> tuple[dict, list[dict], list[str]]:
    """Diagnostics, paragraph rows and the sections of table links.

    A paragraph belongs to its nearest titled section. A page without a
    usable one has a single ``Article body``: the paragraphs in main or
    article.
    """
    heading, links, sections, found, loose = None, [], [], [], []
    for node, above in walk(tree(html)):
        if node.tag == "h1" and heading is None and (node.get("data-test") == "article-title" or "article-title" in node.get("class", "")):
            heading = text_of(node)
        elif node.tag == "a" and "/tables/" in node.get("href", ""):
            links.append(title_of(section_of(node, above)))
        elif node.tag == "section" and node.get("data-title"):
            name = title_of(node)
            if name and name.lower() not in EXCLUDED:
                sections.append(name)
        elif node.tag == "p" and (text := text_of(node)):
            section = section_of(node, above)
            if section is not None and (name := title_of(section)) and name.lower() not in EXCLUDED:
                found.append((name, text))
            if any(n.tag in ("main", "article") for n in above):
                loose.append(("Article body", text))
    rows = found if sections else loose
    distinct = list(dict.fromkeys(sections)) or ["Article body"]
    info = {"title": heading or "", "section_count": len(distinct), "paragraph_count": len(rows), "has_results": any(s.lower() == "results" for s in distinct), "sections": distinct}
    return info, [{"kind": "p", "location": s, "text": t, "in_table": False} for s, t in rows], links


def page_tables(html: str) -> list[dict]:
    """Table rows of a page; the first figcaption, caption or h1 is the
    caption of all."""
    caption, tables = None, []
    for node, _ in walk(tree(html)):
        if node.tag in ("figcaption", "caption", "h1") and caption is None:
            caption = text_of(node)
        if node.tag == "table":
            tables.append(node)
    out = []
    for table in tables:
        rows = [[(text_of(c), c.tag == "th", _span(c, "rowspan"), _span(c, "colspan")) for c in r if c.tag in ("td", "th")] for r, _ in walk(table) if r.tag == "tr"]
        grid, headers = grid_of(rows)
        out.append({"kind": "table", "label": "Table", "caption": caption or "", "header_rows": headers, "grid": grid})
    return out


def _span(cell: ET.Element, name: str) -> int:
    value = cell.get(name, "1")
    return int(value) if value.isdigit() and int(value) > 0 else 1


def sections_for_tables(links: list[str], sections: list[str], n: int) -> list[str]:
    """The section of each of n table pages: that of the link in the same
    place, Results where there is none or the section is unknown."""
    wanted = [links[i] if i < len(links) else "Results" for i in range(n)]
    return [w if w in sections or "Results" not in sections else "Results" for w in wanted]


def parsed_pages(pages: DataFrame, table_pages: DataFrame | None = None) -> DataFrame:
    """Paragraph and table rows of pages (article_id, html), in ITEMS form.

    table_pages (article_id, path, html) hold full-size tables; those of an
    article come in the order of their paths and stand in the sections of its
    links, place by place. Null html has no item.
    """
    if table_pages is None:
        source = pages.select("article_id", F.coalesce("html", F.lit("")).alias("html"), F.array().cast("array<string>").alias("more"))
    else:
        grouped = table_pages.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("path", "html"))).alias("t")).select("article_id", F.col("t.html").alias("more"))
        source = pages.select("article_id", F.coalesce("html", F.lit("")).alias("html")).join(grouped, "article_id", "left")

    def rows(batches):
        for batch in batches:
            for article, html, digest, more in zip(*(batch.column(c).to_pylist() for c in ("article_id", "html", "input_sha256", "more"))):
                base = {"article_id": article, "input_sha256": digest}
                info, paragraphs, links = page_items(html)
                for i, item in enumerate(paragraphs):
                    yield {**base, "seq": i, **item}
                own, n = page_tables(html) if not more else [], 0
                places = sections_for_tables(links, info["sections"], len(more or []))
                for place, table in [("Results", t) for t in own] + [(p, t) for p, page in zip(places, more or []) for t in page_tables(page)]:
                    yield {**base, "seq": n, "location": place, **table}
                    n += 1

    keyed = source.select("article_id", "html", F.sha2("html", 256).alias("input_sha256"), "more")
    return keyed.mapInArrow(lambda batches: as_batches(rows(batches), ITEM_SCHEMA), ITEMS)


DIAGNOSTICS = "article_id string, title string, section_count int, paragraph_count int, has_results boolean, structural_status string"


def page_diagnostics(pages: DataFrame, least: int = 5) -> DataFrame:
    """Per page of (article_id, html): counts, and PASS for a titled page with
    results and ``least`` paragraphs, else REVIEW."""
    schema = pa.schema([("article_id", pa.string()), ("title", pa.string()), ("section_count", pa.int32()), ("paragraph_count", pa.int32()), ("has_results", pa.bool_()), ("structural_status", pa.string())])

    def rows(batches):
        for batch in batches:
            for article, html in zip(batch.column("article_id").to_pylist(), batch.column("html").to_pylist()):
                info, _, _ = page_items(html or "")
                good = info["title"] and info["has_results"] and info["paragraph_count"] >= least
                yield {"article_id": article, **{k: info[k] for k in ("title", "section_count", "paragraph_count", "has_results")}, "structural_status": "PASS" if good else "REVIEW"}

    return pages.select("article_id", "html").mapInArrow(lambda b: as_batches(rows(b), schema), DIAGNOSTICS)
