"""PDF files to text, and to words and ruled lines of their pages.

Reading a PDF needs a tool that is no part of this library, so it is handed in
as a function of the file's bytes, which runs in the tasks. ``pdftotext`` and
``pdf_pages`` make such functions of two public tools where they are
installed.
"""

from __future__ import annotations

import io
import subprocess
import tempfile
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.sources.articles import as_batches

WORD = "struct<text:string,x0:double,x1:double,top:double,bottom:double>"
EDGE = "struct<x0:double,x1:double,top:double>"
PAGES = f"article_id string, page int, width double, height double, words array<{WORD}>, edges array<{EDGE}>"
_word = pa.struct([("text", pa.string()), *((n, pa.float64()) for n in ("x0", "x1", "top", "bottom"))])
_edge = pa.struct([(n, pa.float64()) for n in ("x0", "x1", "top")])
PAGE_SCHEMA = pa.schema([("article_id", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("words", pa.list_(_word)), ("edges", pa.list_(_edge))])


def files(spark: SparkSession, folder: str, pattern: str = T.ARTICLE_ID) -> DataFrame:
    """article_id, name, content, sha256 of a folder's PDF files; ``pattern``
    is that of the id in a name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return found.select(T.article_id_of(name, pattern).alias("article_id"), name.alias("name"), "content", F.sha2("content", 256).alias("sha256"))


def pdftotext(binary: str = "pdftotext", layout: bool = False) -> Callable[[bytes], str]:
    """The text of a file by the command of that name; ``layout`` keeps the
    places of words, with form feeds between pages."""

    def text(content: bytes) -> str:
        with tempfile.NamedTemporaryFile(suffix=".pdf") as file:
            file.write(content)
            file.flush()
            done = subprocess.run([binary, *(["-layout"] if layout else []), file.name, "-"], check=True, capture_output=True)
        return done.stdout.decode("utf-8", "replace")

    return text


def pdf_pages(content: bytes) -> Iterable[dict]:
    """width, height, words and horizontal edges of each page, by the package
    pdfplumber, if it is there."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as document:
        for page in document.pages:
            words = [{k: w[k] for k in ("text", "x0", "x1", "top", "bottom")} for w in page.extract_words()]
            edges = [{k: e[k] for k in ("x0", "x1", "top")} for e in page.edges if e.get("orientation") == "h"]
            yield {"width": page.width, "height": page.height, "words": words, "edges": edges}


def texts(found: DataFrame, plain: Callable[[bytes], str], layout: Callable[[bytes], str]) -> DataFrame:
    """article_id, text, layout_text of files (article_id, content): inputs of
    ``layout.plain_sections`` and ``layout.parsed_layout``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py() or b""
                yield pa.record_batch([batch.column("article_id").slice(i, 1), pa.array([plain(content)], pa.string()), pa.array([layout(content)], pa.string())], names=["article_id", "text", "layout_text"])

    return found.select("article_id", "content").mapInArrow(run, "article_id string, text string, layout_text string")


def pages(found: DataFrame, read: Callable[[bytes], Iterable[dict]] = pdf_pages) -> DataFrame:
    """The PAGES of files (article_id, content), counted from 1: inputs of
    ``coordinates.coordinate_tables``."""

    def rows(batches):
        for batch in batches:
            for article, content in zip(batch.column("article_id").to_pylist(), batch.column("content").to_pylist()):
                for n, page in enumerate(read(content or b""), 1):
                    yield {"article_id": article, "page": n, **page}

    return found.select("article_id", "content").mapInArrow(lambda b: as_batches(rows(b), PAGE_SCHEMA, 50), PAGES)
