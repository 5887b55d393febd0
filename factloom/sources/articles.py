"""Article XML: files to paragraph and table rows.

``binaryFile`` keeps listing, pruning and hashing in Spark; only the parse
itself, which needs mixed content in document order, runs in Python, one file
at a time.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T

ITEMS = (
    "article_id string, input_sha256 string, name string, kind string, seq int, location string, text string, in_table boolean, "
    "label string, caption string, header_rows int, grid array<array<string>>"
)


def files(spark: SparkSession, folder: str, suffix: str = "nxml") -> DataFrame:
    """path, name, content, article_id, input_sha256 of a folder's files (not
    of folders below). No such file is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "false").load(folder)
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no .{suffix} files in {folder}")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return found.select("path", name.alias("name"), "content", T.article_id_of(name).alias("article_id"), F.sha2("content", 256).alias("input_sha256"))


def local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def node_text(node: ET.Element) -> str:
    return " ".join(" ".join(node.itertext()).split())


def child_text(node: ET.Element, name: str) -> str | None:
    return next((node_text(c) for c in node if local(c.tag) == name), None)


def grid_of(rows: list[list[tuple[str, bool, int, int]]]) -> tuple[list[list[str]], int]:
    """A rectangular grid of rows of cells (text, is header, rowspan,
    colspan), and how many rows hold header cells alone."""
    grid, down, headers = [], {}, 0
    for cells in rows:
        out: list[str] = []

        def carried(out=out):
            while (held := down.get(len(out))) is not None:
                place, (text, left) = len(out), held
                out.append(text)
                if left > 1:
                    down[place] = text, left - 1
                else:
                    del down[place]

        headers += bool(cells) and all(c[1] for c in cells)
        for text, _, tall, wide in cells:
            carried()
            for _ in range(wide):
                if tall > 1:
                    down[len(out)] = text, tall - 1
                out.append(text)
        carried()
        grid.append(out)
    width = max(map(len, grid), default=0)
    return [r + [""] * (width - len(r)) for r in grid], headers


def table_of(wrap: ET.Element) -> dict:
    rows = [
        [(node_text(c), local(c.tag) == "th", int(c.get("rowspan", "1")), int(c.get("colspan", "1"))) for c in row if local(c.tag) in ("td", "th")]
        for row in wrap.iter()
        if local(row.tag) == "tr"
    ]
    grid, headers = grid_of(rows)
    return {"kind": "table", "label": child_text(wrap, "label"), "caption": child_text(wrap, "caption"), "header_rows": headers, "grid": grid}


def items_of(content: bytes) -> Iterator[dict]:
    """Paragraphs and tables in document order. A paragraph's location is the
    path of section titles above it."""
    stack: list[tuple[ET.Element, tuple[str, ...], bool]] = [(ET.fromstring(content), (), False)]
    while stack:
        node, path, in_table = stack.pop()
        name = local(node.tag)
        if name == "p":
            yield {"kind": "p", "location": " > ".join(path) or "Body", "text": node_text(node), "in_table": in_table}
        if name == "table-wrap":
            in_table = True
            yield table_of(node)
        if name == "sec" and (title := child_text(node, "title")):
            path = (*path, title)
        stack += [(c, path, in_table) for c in reversed(node)]


def as_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


ITEM_SCHEMA = pa.schema(
    [("article_id", pa.string()), ("input_sha256", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("seq", pa.int32()), ("location", pa.string()), ("text", pa.string()), ("in_table", pa.bool_())]
    + [("label", pa.string()), ("caption", pa.string()), ("header_rows", pa.int32()), ("grid", pa.list_(pa.list_(pa.string())))]
)


def parsed(found: DataFrame, parse=items_of) -> DataFrame:
    """Paragraph and table rows of files (article_id, input_sha256, name,
    content), parsed once. ``seq`` numbers a file's items of either kind."""

    def rows(batches):
        for batch in batches:
            for article, digest, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                n = {"p": 0, "table": 0}
                for item in parse(content):
                    yield {"article_id": article, "input_sha256": digest, "name": name, "seq": n[item["kind"]], **item}
                    n[item["kind"]] += 1

    return found.select("article_id", "input_sha256", "name", "content").mapInArrow(lambda batches: as_batches(rows(batches), ITEM_SCHEMA), ITEMS)


def nodes(items: DataFrame) -> DataFrame:
    return items.where("kind = 'p'").select("article_id", "input_sha256", "name", F.col("seq").alias("node_seq"), "location", "text", "in_table")


def tables(items: DataFrame) -> DataFrame:
    return items.where("kind = 'table'").select("article_id", "input_sha256", "name", F.col("seq").alias("table_seq"), "label", "caption", "header_rows", "grid")
