"""Extracted PDF text: sections, and tables by layout.

Text and word extraction themselves lie outside; inputs are columns: plain
text, or layout text (pages parted by form feeds). ``coordinates`` has the
tables of words and edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.functions import text as T
from factloom.sources.articles import as_batches

# ---- lines ----


def clean_text(text: str) -> str:
    """As ``T.pdf_clean``."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    text = text.translate({0x00AD: None, 0xFB01: "fi", 0xFB02: "fl"})
    return " ".join("".join(c for c in text if c in "\t\n\r" or 0x20 <= ord(c) <= 0xD7FF or 0xE000 <= ord(c) <= 0xFFFD or ord(c) >= 0x10000).split())


#: What ``clean_text`` takes out or replaces, but for what ends lines.
_UNCLEAN = re.compile("[^\t-\r\x1C-\x1E\x20-\xAC\xAE-\uD7FF\uE000-\uFB00\uFB03-\uFFFD\U00010000-\U0010FFFF]")
_NUMBERING = re.compile(r"\s*(?:\d+|[ivxlcdm]+)\s*[|.):-]\s*", re.I)
_METHODS = re.compile("|".join("[^a-z]*".join(["", *name, ""]) for name in T.COMPACT_METHODS))
_STARTS = {"results": "Results", "discussion": "Discussion", "conclusion": "Conclusions"}
#: A heading begins so, its letters spaced or not.
_MAYBE = re.compile("|".join(" *".join(name.replace(" ", "")) for name in (*_STARTS, *T.HEADINGS)))


def _drawn_together(text: str) -> str:
    """As ``T.display_compact`` of a clean text."""
    letters = [c for c in text if c.isalpha()]
    return text.replace(" ", "") if letters and sum(map(str.isupper, letters)) / len(letters) >= 0.8 else text


def heading_of(text: str) -> str | None:
    """As ``T.heading_name`` of a clean line. Few lines begin as a heading
    does; the others are not looked at closely."""
    if text.startswith("|"):
        text = text[1:].lstrip(" ")
    text = text[m.end() :] if (m := _NUMBERING.match(text)) else text
    low = text.lower()
    if _METHODS.fullmatch(low):
        return "Methods"
    if not _MAYBE.match(low):
        return None
    low = _drawn_together(text).lower().rstrip(":.")
    short = next((name for start, name in _STARTS.items() if low.startswith(start)), None) if len(low) <= 40 else None
    return short or T.HEADINGS.get(low)


# ---- plain text to sections ----

#: Characters of text in a batch of rows that a task hands on.
BATCH_CHARACTERS = 1 << 22


def paragraphs(text: str) -> Iterator[tuple[str, str]]:
    """Section and text of each paragraph."""
    section, held, is_clean = "Article body", [], not _UNCLEAN.search(text)
    for line in text.splitlines():
        said = " ".join(line.split()) if is_clean else clean_text(line)
        heading = heading_of(said) if said else None
        if said and not heading:
            if not (len(said) <= 4 and re.fullmatch(r"\d{1,4}", said)):
                held.append(said)
            continue
        if held:
            yield section, " ".join(held)
        section, held = heading or section, []
        if heading == "References":
            return
    if held:
        yield section, " ".join(held)


def plain_sections(texts: DataFrame) -> DataFrame:
    """article_id, section, section_seq, paragraph_seq, text of texts
    (article_id, text).

    A heading opens its section (again, if it comes twice), an empty line ends
    a paragraph, page numbers are left out, and References ends the text. One
    pass over the lines of a text; sections are in the order of first use.
    """

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                order: dict[str, int] = {}
                for seq, (section, said) in enumerate(paragraphs(batch.column("text")[i].as_py() or "")):
                    held.append((i, section, order.setdefault(section, len(order)), seq, said))
                    size += len(said)
                    if size >= BATCH_CHARACTERS:
                        yield rows(batch, held)
                        held, size = [], 0
            if held:
                yield rows(batch, held)

    def rows(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*held)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.record_batch([batch.column("article_id").take(pa.array(at, pa.int32())), *map(pa.array, columns, kinds)], names=["article_id", "section", "section_seq", "paragraph_seq", "text"])

    article = texts.schema["article_id"].dataType.simpleString()
    return texts.select("article_id", "text").mapInArrow(run, f"article_id {article}, section string, section_seq int, paragraph_seq int, text string")


# ---- layout text to tables ----

def _cells(line: str) -> list[str]:
    return [c for c in map(clean_text, re.split(r"\s{2,}", line.strip())) if c]


def _compact(line: str) -> str:
    text = clean_text(line)
    letters = [c for c in text if c.isalpha()]
    return "".join(text.split()) if letters and sum(map(str.isupper, letters)) >= 0.8 * len(letters) else text


def _is_label(line: str) -> bool:
    return bool(re.match(rf"\s*{T.TABLE_START}", line, re.I) or re.match(r"(?:table|tab\.)([0-9]+|[ivxlcdm]+)\b", _compact(line), re.I))


def _digits(cells: list[str]) -> int:
    return sum(bool(re.search(r"\d", c)) for c in cells)


def _is_header(cells: list[str]) -> bool:
    joined = " ".join(cells).lower()
    return any(s in joined for s in T.HEADER_SIGNALS)


def _is_prose(cells: list[str]) -> bool:
    return len(cells) == 2 and min(len(c.split()) for c in cells) >= 8 and not _digits(cells)


def caption_from(text: str) -> str:
    """As ``T.clean_caption``."""
    text = clean_text(text)
    starts = [m.start() for m in re.finditer(T.CAPTION_CUES, text, re.I)]
    return text[starts[-1] :] if starts and starts[-1] > 20 else text


def _block(lines: list[str], at: int) -> tuple[list[str], int]:
    """The lines of a table whose label stands before ``at``, and where to go
    on. Once a row of cells has come, a label, a heading, prose in columns or
    two empty lines end it."""
    held, rows, empty = [], False, 0
    while at < len(lines):
        text, cells = clean_text(lines[at]), _cells(lines[at])
        if rows and (_is_label(lines[at]) or text.lower() in T.HEADINGS or _is_prose(cells)):
            break
        rows = rows or len(cells) >= 2
        empty = empty + 1 if not text and rows else 0
        if empty == 2:
            break
        held.append(lines[at])
        at += 1
    return held, at


def _rows(block: list[str]) -> tuple[str, list[list[str]]]:
    """Caption and rows of a block. A line of one cell among the rows goes on
    with the first cell of the row before."""
    caption, rows = [], []
    for line in block:
        cells = _cells(line)
        if len(cells) >= 2:
            rows.append(cells)
        elif cells and rows:
            rows[-1][0] += f" {cells[0]}"
        elif cells:
            caption.append(cells[0])
    return caption_from(" ".join(caption)), rows


def layout_tables(text: str) -> Iterator[dict]:
    """Tables of fixed-width text: label, caption, page, header_rows, grid."""
    for page, content in enumerate(text.split("\f"), 1):
        lines, at = content.splitlines(), 0
        while at < len(lines):
            if not _is_label(lines[at]):
                at += 1
                continue
            label = clean_text(lines[at])
            block, at = _block(lines, at + 1)
            caption, rows = _rows(block)
            if len(rows) < 2:
                continue
            # Another column of the page may stand before the table.
            if cut := next(filter(None, map(_first_cue, rows[:4])), 0):
                rows = [r[cut:] for r in rows if len(r) > cut]
            if not any(map(_is_header, rows[:4])) and sum(_digits(r) >= 2 for r in rows) < 2:
                continue
            width = max(map(len, rows))
            two = len(rows) > 1 and "n =" in " ".join(rows[1]).lower()
            yield {"label": label, "caption": caption, "page": page, "header_rows": 2 if two else 1, "grid": [r + [""] * (width - len(r)) for r in rows]}


def _first_cue(row: list[str]) -> int:
    """Where the row names a variable, outcome or characteristic; 0 if not."""
    return next((i for i, c in enumerate(row) if re.search(r"\b(?:variable|outcome|characteristic)\b", c, re.I)), 0)


TABLES = "article_id string, table_seq int, page int, label string, caption string, header_rows int, grid array<array<string>>"
TABLE_SCHEMA = pa.schema([("article_id", pa.string()), ("table_seq", pa.int32()), ("page", pa.int32()), ("label", pa.string()), ("caption", pa.string()), ("header_rows", pa.int32()), ("grid", pa.list_(pa.list_(pa.string())))])


def parsed_layout(texts: DataFrame) -> DataFrame:
    """Tables of texts (article_id, layout_text), one text at a time."""

    def rows(batches):
        for batch in batches:
            for article, text in zip(batch.column("article_id").to_pylist(), batch.column("layout_text").to_pylist()):
                for i, table in enumerate(layout_tables(text or "")):
                    yield {"article_id": article, "table_seq": i, **table}

    return texts.select("article_id", "layout_text").mapInArrow(lambda b: as_batches(rows(b), TABLE_SCHEMA), TABLES)
