"""Streams, and the driver's entry module with and without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.plans import catalog
from factloom.plans.extraction import facts_of
from factloom.streaming import stream_facts

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    text = ["The token was lost in 3 cases. It was the 7 of 9 trash here.", "La token es de 2 cases. 5 patients, 12% trash is the end."]
    rows = [(f"A{i}", "", i, "Body", t, False) for i, t in enumerate(text)]
    nodes = spark.createDataFrame(rows, "article_id string, input_sha256 string, node_seq int, location string, text string, in_table boolean")
    nodes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(nodes.schema).parquet(str(tmp_path / "in"))
    run = stream_facts(stream, catalog.DOCUMENT_RULES).writeStream.format("memory").queryName("facts_out").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    batch = facts_of(nodes, None, catalog.DOCUMENT_RULES)
    assert batch.count() > 0
    assert sorted(map(str, spark.table("facts_out").select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "prediction_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    """The entry module works where the subpackage and pipeline are gone."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'facts' in q and not any(n.startswith('op') for n in q), list(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_hits_equal_a_plain_version(spark):
    """The fold over matches, against a loop, on random texts."""
    import random
    import re

    from factloom.operators.tagging import hits

    rules, rnd = catalog.DOCUMENT_RULES, random.Random(6)
    words = [p.text for p in rules.phrases] + ["x", "of", "other", "Thea", ",", "is"]
    texts = [" ".join(w.upper() if rnd.random() < 0.2 else w for w in rnd.choices(words, k=rnd.randrange(12))) for _ in range(300)]

    def plain(text):
        def first(kind):
            for p in rules.phrases:
                if p.kind == kind and (m := re.search(rf"(?<![A-Za-z0-9]){re.escape(p.text).replace(chr(92) + ' ', chr(92) + 's+')}(?![A-Za-z0-9])", text, re.I)):
                    yield m.start(), p.category, m[0], p.rule_id

        kept = []

        def add(found):
            for h in found:
                if all(h[0] + len(h[2]) <= k[0] or k[0] + len(k[2]) <= h[0] for k in kept):
                    kept.append(h)

        base = list(first("category")) or list(first("generic"))[:1]
        add(sorted(base, key=lambda h: (h[0], -len(h[2]))))
        add(first("unmappable"))
        add(first("unclear"))
        return sorted(kept)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", hits(F.col("t"), rules).alias("h")).collect()
    assert len(rows) == 300
    for r in rows:
        assert [tuple(h) for h in r.h] == plain(r.t), r.t


@pytest.mark.parametrize("module", ["xxhash", "tokenizers", "public_tokenizers"])
def test_imports_without_packages_of_the_optional_part(module):
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'facts' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_broken_module_of_the_library_is_not_hidden():
    code = "import sys; sys.modules['factloom.operators.written'] = None; import __spark_entry__"
    assert b"factloom.operators.written" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).stderr
