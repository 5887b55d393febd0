"""Intermediate tables that outlive executors, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Folders handed out inside the innermost ``scratch`` of this context; a
#: thread begins outside of any, so queries of other threads don't meet here.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


@cache
def _of_application(spark: SparkSession, root: str) -> str:
    path = f"{root.rstrip('/')}/factloom-{spark.sparkContext.applicationId}"

    def clear():
        # The JVM may be gone by then; what is left is named by application.
        with suppress(Exception):
            remove(spark, path)

    atexit.register(clear)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, in one folder per
    application that is removed when the driver's process ends. Where the
    setting is absent, a local master gets a temporary folder of its own, and
    any other an error: executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{_of_application(spark, root or _own_folder())}/{name}-{uuid.uuid4().hex}"
    if (inside := _made.get()) is not None:
        inside.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, keep: str = "\0") -> Iterator[None]:
    """Folders made inside, by this thread, are removed at the end, but those
    whose name begins with ``keep``, which then count as made around it. What
    is needed later must be written to one made before."""
    around, inside = _made.get(), []
    token = _made.set(inside)
    try:
        yield
    finally:
        _made.reset(token)
        for path in inside:
            if not path.rsplit("/", 1)[1].startswith(keep):
                remove(spark, path)
            elif around is not None:
                around.append(path)


def write_to(path: str, df: DataFrame, compression: str = "zstd") -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: it is computed
    once, and a lost executor takes nothing with it."""
    return write_to(folder(df.sparkSession, name), df)


def appended(spark: SparkSession, parts: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """The rows of all ``parts``, one table, written part by part: what a part
    holds on to can go once the next is asked for."""
    path, some = folder(spark, name), False
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
        some = True
    return spark.read.schema(schema).parquet(path) if some else spark.createDataFrame([], schema)
