"""Files on any store: small documents, and single files written by tasks.

A single file of ordered rows is written in pieces. The order is dealt to
ranges, each task writes its range as it will stand in the file into the shared
folder, and one more task joins the pieces by copying bytes, hashing them as it
goes. No row passes through the driver, and pieces of lost or repeated tasks
are never read, as a task reports its piece only when that is whole.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession

from factloom.operators.written import folder, written

CHUNK = 1 << 20


class Place:
    """A file or folder: a path of the local file system, or a URI of any
    store that pyarrow knows. On a cluster it must be one that all executors
    see."""

    def __init__(self, path: object):
        path = str(path)
        self.uri = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.uri.rstrip('/')}/{name}")

    def __str__(self) -> str:
        return self.uri

    def __fspath__(self) -> str:
        return self.at[1]

    @property
    def at(self) -> tuple[pafs.FileSystem, str]:
        if self.uri.startswith("file:"):  # names may hold what a URI must escape
            return pafs.LocalFileSystem(), self.uri.removeprefix("file://").removeprefix("file:")
        return pafs.FileSystem.from_uri(self.uri)

    @property
    def name(self) -> str:
        return self.uri.rstrip("/").rsplit("/", 1)[1]

    @property
    def parent(self) -> Place:
        return Place(self.uri.rstrip("/").rsplit("/", 1)[0])

    def exists(self) -> bool:
        fs, path = self.at
        return fs.get_file_info(path).type != pafs.FileType.NotFound

    def is_empty_folder(self) -> bool:
        fs, path = self.at
        return fs.get_file_info(path).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(path))

    def make(self) -> Place:
        fs, path = self.at
        fs.create_dir(path, recursive=True)
        return self

    def chunks(self) -> Iterator[bytes]:
        fs, path = self.at
        with fs.open_input_stream(path, compression=None) as file:
            while part := file.read(CHUNK):
                yield part

    def read(self) -> bytes:
        return b"".join(self.chunks())

    def read_text(self) -> str:
        return self.read().decode()

    def write_text(self, text: str) -> None:
        self.write([text.encode()])

    def write(self, chunks: Iterable[bytes]) -> tuple[str, int]:
        """Write the file under a name of its own and move it here when it is
        whole: its SHA-256 and bytes."""
        fs, path = self.at
        digest, size, part = hashlib.sha256(), 0, f"{path}._{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as file:
            for chunk in chunks:
                file.write(chunk)
                digest.update(chunk)
                size += len(chunk)
        fs.move(part, path)
        return digest.hexdigest(), size


def sha256(path: object) -> str:
    digest = hashlib.sha256()
    for chunk in Place(path).chunks():
        digest.update(chunk)
    return digest.hexdigest()


def _by_tasks(files: dict[str, Place], of: Callable[[str, Place], str | None]) -> dict[str, str | None]:
    """What ``of`` says of each file (name, place), asked by the tasks."""
    if not files:
        return {}
    spark = SparkSession.active()

    def run(batches):
        for batch in batches:
            names, places = batch.column("name").to_pylist(), batch.column("uri").to_pylist()
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([of(n, Place(u)) for n, u in zip(names, places)], pa.string())], names=["name", "said"])

    rows = spark.createDataFrame([(n, Place(f).uri) for n, f in files.items()], "name string, uri string").repartition(min(len(files), spark.sparkContext.defaultParallelism))
    return {r.name: r.said for r in rows.mapInArrow(run, "name string, said string").collect()}


def hashes(files: dict[str, object]) -> dict[str, str | None]:
    """The SHA-256 of each file, None where there is none."""
    return _by_tasks(files, lambda _, place: sha256(place) if place.exists() else None)


def copy_files(files: dict[str, object], folder: Place) -> dict[str, str]:
    """Copy each file into the folder under its name: their SHA-256. One that
    changes meanwhile is an error."""
    uri = folder.make().uri

    def copied(name: str, place: Place) -> str:
        digest, _ = (Place(uri) / name).write(place.chunks())
        if sha256(Place(uri) / name) != digest or sha256(place) != digest:
            raise OSError(f"{name} changed while it was copied")
        return digest

    return _by_tasks(files, copied)


def new_folder(path: object, allow_empty: bool = False) -> Place:
    """Make the folder; one that exists (and, if ``allow_empty``, holds
    anything) is refused."""
    place = Place(path)
    if place.exists() and not (allow_empty and place.is_empty_folder()):
        raise FileExistsError(f"refusing to overwrite {place}")
    return place.make()


def write_json(path: object, payload: object) -> None:
    Place(path).write([(json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode()])


def read_json(path: object) -> object:
    return json.loads(Place(path).read())


@dataclass(frozen=True)
class JsonArray:
    """One array, indented by 2."""

    path: str
    columns: tuple[str, ...]

    def body(self, rows: list[dict]) -> bytes:
        """Each row behind the comma that parts it from the one before."""
        return "".join(",\n  " + json.dumps(r, ensure_ascii=False, indent=2).replace("\n", "\n  ") for r in rows).encode()

    def whole(self, rows: int, pieces: Iterator[bytes]) -> Iterator[bytes]:
        if not rows:
            yield b"[]\n"
            return
        yield b"["
        yield next(pieces)[1:]
        yield from pieces
        yield b"\n]\n"


@dataclass(frozen=True)
class CsvFile:
    """UTF-8 with a byte-order mark and CRLF. Without rows the file is empty,
    or the header alone if ``headed``."""

    path: str
    columns: tuple[str, ...]
    headed: bool = False

    def body(self, rows: list[dict]) -> bytes:
        text = io.StringIO(newline="")
        csv.DictWriter(text, self.columns).writerows(rows)
        return text.getvalue().encode()

    def whole(self, rows: int, pieces: Iterator[bytes]) -> Iterator[bytes]:
        if rows or self.headed:
            yield "﻿".encode() + self.body([dict(zip(self.columns, self.columns))])
        yield from pieces


def write_ordered(rows: DataFrame, order: Iterable[Column | str], *files: JsonArray | CsvFile) -> list[tuple[int, str]]:
    """The rows in their order to each file, nulls as "": of each file the
    number of rows and its SHA-256."""
    spark, order = rows.sparkSession, list(order)
    parts = folder(spark, "pieces")

    def dealt(batches):
        part, fs, root = TaskContext.get().partitionId(), *Place(parts).at
        fs.create_dir(root, recursive=True)
        names = [f"{part:08d}-{uuid.uuid4().hex}-{i}" for i in range(len(files))]
        outputs, n = [fs.open_output_stream(posixpath.join(root, name), compression=None) for name in names], 0
        for batch in batches:
            found = [{k: "" if v is None else v for k, v in r.items()} for r in batch.to_pylist()]
            n += len(found)
            for file, output in zip(files, outputs):
                output.write(file.body([{c: r[c] for c in file.columns} for r in found]))
        for output in outputs:
            output.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.string()))], names=["part", "rows", "names"])

    def joined(batches):
        held = [r for batch in batches for r in batch.to_pylist()]  # a row a piece
        held, n = sorted((r for r in held if r["rows"]), key=lambda r: r["part"]), sum(r["rows"] for r in held)
        for i, file in enumerate(files):
            pieces = (chunk for r in held for chunk in (Place(parts) / r["names"][i]).chunks())
            digest, _ = Place(file.path).write(file.whole(n, pieces))
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([digest])], names=["file", "rows", "sha256"])

    ranges = written(rows, "file-rows").repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = written(ranges.mapInArrow(dealt, "part int, rows long, names array<string>"), "file-pieces")
    return [(r.rows, r.sha256) for r in manifest.repartition(1).mapInArrow(joined, "file int, rows long, sha256 string").orderBy("file").collect()]


def write_json_array(path: object, rows: DataFrame, *order: Column | str) -> str:
    """The rows as one array, in their order; its SHA-256."""
    return write_ordered(rows, order, JsonArray(Place(path).uri, tuple(rows.columns)))[0][1]


def write_csv(path: object, rows: DataFrame, *order: Column | str, columns: list[str] | None = None) -> str:
    """The rows, or of them ``columns``, as CSV in their order; its SHA-256.
    Without a row the file is empty, or the header of ``columns``."""
    return write_ordered(rows, order, CsvFile(Place(path).uri, tuple(columns or rows.columns), columns is not None))[0][1]
