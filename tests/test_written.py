"""Intermediate folders: where they lie and when they go."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from factloom.operators import written as W


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_scratch_removes_what_was_made_inside(spark):
    outer = W.written(spark.range(3), "outer")
    with W.scratch(spark, keep="kept"):
        gone, kept = W.folder(spark, "gone"), W.folder(spark, "kept")
        W.write_to(gone, outer)
        W.write_to(kept, outer)
    assert not os.path.exists(local(gone)) and os.path.exists(local(kept)) and outer.count() == 3
    assert spark.sparkContext.applicationId in gone


def test_threads_keep_their_own_folders(spark):
    """What one thread writes while another is inside scratch stays."""
    written = {}

    def other():
        written["table"] = W.written(spark.range(5), "other")

    with W.scratch(spark):
        mine = W.folder(spark, "mine")
        W.write_to(mine, spark.range(2))
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert written["table"].count() == 5 and not os.path.exists(local(mine))


def test_nested_scratch_hands_on_what_it_keeps(spark):
    with W.scratch(spark):
        with W.scratch(spark, keep="kept"):
            kept = W.folder(spark, "kept")
            W.write_to(kept, spark.range(2))
        assert os.path.exists(local(kept))
    assert not os.path.exists(local(kept))


def test_parts_are_one_table(spark):
    parts = (spark.range(i, i + 2).withColumn("x", F.lit(i)) for i in range(3))
    assert W.appended(spark, parts, "id long, x int", "parts").count() == 6
    assert W.appended(spark, [], "id long, x int", "parts").collect() == []


def test_no_folder_of_its_own_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        W.folder(Session(), "x")
