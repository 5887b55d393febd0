"""Words and ruled lines of PDF pages to tables.

One pass over Arrow batches of pages, without a shuffle. The words of a batch
are sorted at once by page, top and place, and swept page by page: a baseline
ends where the next word lies too far below its first one. Rules are swept the
same way, and cells end at the gaps between the words of a line, so a page
costs as much as it has words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import inf
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.layout import caption_from, clean_text

BASELINE, RULE, GAP = 2.2, 1.5, 12.0
BOX = ("x0", "top", "x1", "bottom")
TABLE = "label string, caption string, header_rows int, grid array<array<string>>, box struct<x0:double,top:double,x1:double,bottom:double>"
TABLE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.struct([(c, pa.float64()) for c in BOX])]

MENTION, NUMBER = re.compile("[^A-Za-z.]").sub, re.compile("[^0-9A-Za-z]").sub
NUMBERED = re.compile("[0-9]+|[ivxlcdm]+", re.IGNORECASE).fullmatch


class Word(NamedTuple):
    x0: float
    x1: float
    top: float
    bottom: float
    text: str


class Edge(NamedTuple):
    x0: float
    x1: float
    top: float

    @property
    def span(self) -> float:
        return self.x1 - self.x0


def items_of(column: pa.ListArray, kind: type) -> list[list]:
    """The words or edges of each page of a batch, from a column of lists of
    structs, in order of top and x0. Those without a place are left out."""
    values, offsets = column.values, column.offsets.to_numpy()
    places = {c: values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in kind._fields if c != "text"}
    page, kept = np.repeat(np.arange(len(column)), np.diff(offsets)), np.arange(offsets[0], offsets[-1])
    whole = ~np.any([np.isnan(p[kept]) for p in places.values()], axis=0)
    kept, page = kept[whole], page[whole]
    order = np.lexsort((places["x0"][kept], places["top"][kept], page))
    kept, page = kept[order], page[order]
    parts = [p[kept].tolist() for p in places.values()]
    if kind is Word:
        parts.append([clean_text(t or "") for t in values.field("text").take(pa.array(kept)).to_pylist()])
    found, starts = list(map(kind, *parts)), np.searchsorted(page, np.arange(len(column) + 1)).tolist()
    return [found[i:j] for i, j in zip(starts, starts[1:])]


def runs(items: list, tolerance: float) -> Iterator[list]:
    """Of items sorted by top, the runs that begin where one lies further
    than ``tolerance`` below the first of the run before."""
    begin = 0
    for i in range(1, len(items) + 1):
        if i == len(items) or items[i].top - items[begin].top > tolerance:
            yield items[begin:i]
            begin = i


def lines(words: list[Word]) -> list[list[Word]]:
    """Words by baseline, each line by x0."""
    return [sorted(run, key=lambda w: w.x0) for run in runs(words, BASELINE)]


def rules_of(edges: list[Edge]) -> list[Edge]:
    """Horizontal edges drawn together: the ends, and the mean top."""
    return [Edge(min(e.x0 for e in run), max(e.x1 for e in run), reduce(add, (e.top for e in run)) / len(run)) for run in runs(edges, RULE)]


def cells(line: list[Word]) -> list[str]:
    """The cells of a line: a new one begins GAP behind all that came before.
    Blank cells are left out."""
    found, right = [], -inf
    for w in line:
        if w.x0 - right >= GAP:
            found.append([])
        found[-1].append(w.text)
        right = max(right, w.x1)
    joined = (clean_text(" ".join(c)) for c in found)
    return [c for c in joined if c]


def mentions(line: list[Word]) -> Iterator[tuple[float, str]]:
    """Where a line says Table N: x0 and the number."""
    for i, word in enumerate(line):
        if MENTION("", word.text).lower() in ("table", "tab."):
            number = NUMBER("", line[i + 1].text if i + 1 < len(line) else "")
            if NUMBERED(number):
                yield word.x0, number


def box_of(x0: float, top: float, bottom: float, rules: list[Edge], width: float, height: float) -> tuple[float, ...] | None:
    """The ruled box under a mention: x0, top, x1, bottom; None if none. Its
    head is the long rule next to the mention, below it if there is one; its
    foot the last rule that is aligned with the head."""
    least = min(150.0, width * 0.25)
    near = [e for e in rules if e.span >= least and top - 8 <= e.top <= bottom + 125 and e.x0 - 20 <= x0 <= e.x1 + 20]
    near = [e for e in near if e.top >= bottom - 1] or near
    if not near:
        return None
    head = min(near, key=lambda e: (abs(e.top - bottom), e.top, e.x0, e.x1))
    aligned = [e.top for e in rules if head.top - 2 <= e.top <= min(height - 5, head.top + 620) and abs(e.x0 - head.x0) <= 18 and abs(e.x1 - head.x1) <= 18 and e.span >= head.span * 0.8]
    if len(aligned) < 2 or max(aligned) - head.top < 18:
        return None
    return head.x0, head.top, head.x1, max(aligned)


def page_tables(words: list[Word], edges: list[Edge], width: float, height: float) -> Iterator[tuple]:
    """label, caption, header rows, grid and box of a page's tables."""
    rules, known = rules_of(edges), set()
    for line in lines(words):
        for x0, number in mentions(line):
            box = box_of(x0, min(w.top for w in line), max(w.bottom for w in line), rules, width, height)
            key = box and tuple(round(c, 1) for c in box)
            if not box or key in known:
                continue
            known.add(key)
            left, top, right, bottom = box
            inside = [w for w in words if w.x0 >= left and w.x1 <= right and w.top >= top + 0.5 and w.bottom <= bottom - 0.5]
            rows = [r for r in map(cells, lines(inside)) if r]
            if sum(len(r) >= 2 for r in rows) < 2 or not any(re.search(r"\d", c) for r in rows for c in r):
                continue
            said = re.search(rf"\btable\s+{number}\b([\s\S]*)$", " ".join(w.text for w in line), re.IGNORECASE)
            wide = max(map(len, rows))
            yield f"Table {number}", caption_from(said[1] if said else ""), 1, [r + [""] * (wide - len(r)) for r in rows], dict(zip(BOX, box))


def word_cells(words: Column) -> Column:
    """The lines of an array of words (text, x0, x1, top, bottom), each as
    its cells. Null has none."""

    def found(column: pa.Array) -> pa.Array:
        return pa.array([list(map(cells, lines(page))) for page in items_of(column, Word)], pa.list_(pa.list_(pa.string())))

    return F.arrow_udf(found, "array<array<string>>")(words)


def coordinate_tables(pages: DataFrame) -> DataFrame:
    """Ruled tables of pages (article_id, page, width, height, words: array of
    text, x0, x1, top, bottom, edges: array of x0, x1, top), a row each:
    article_id, page, label, caption, header_rows, grid, box.

    The words that lie inside a box make its rows; a table has two rows of two
    cells or more and one with a digit. A box that is mentioned twice on a
    page counts once, by its first mention. Pages without words or edges, or
    where either is null, have no table; words and edges without a place are
    left out.
    """
    names = ["label", "caption", "header_rows", "grid", "box"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pages = zip(items_of(batch.column("words"), Word), items_of(batch.column("edges"), Edge), batch.column("width").to_pylist(), batch.column("height").to_pylist())
            found = [(i, *table) for i, page in enumerate(pages) for table in page_tables(*page)]
            page, *columns = zip(*found) if found else ([],) * 6
            own = pa.array(page, pa.int64())
            yield pa.record_batch([batch.column("article_id").take(own), batch.column("page").take(own), *map(pa.array, columns, TABLE_TYPES)], names=["article_id", "page", *names])

    narrow = pages.select("article_id", "page", F.col("width").cast("double"), F.col("height").cast("double"), "words", "edges").where("width IS NOT NULL AND height IS NOT NULL AND size(words) > 0 AND size(edges) > 0")
    kinds = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in ("article_id", "page"))
    return narrow.mapInArrow(run, f"{kinds}, {TABLE}")
