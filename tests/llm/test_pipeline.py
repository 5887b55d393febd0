"""All stages of the pipeline against plain versions, and on awkward rows."""

import random
import threading
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from factloom.llm import mixing, near_duplicates, token_output  # noqa: E402

from .brute import SCHEMA, awkward, components  # noqa: E402
from .test_filters import plain_hits, plain_quality, prose  # noqa: E402


def corpus(seed=3):
    """Good and bad prose, near and exact copies, benchmark passages."""
    rnd = random.Random(seed)
    items = [(i, " ".join("".join(rnd.choices("bcdfgaeiou", k=6)) for _ in range(rnd.choice([6, 20])))) for i in range(8)]
    texts, good = [], []
    for i in range(160):
        g = i % 4 > 0
        t = prose(rnd, g)
        if i % 9 == 1:
            t = t + " " + items[rnd.randrange(8)][1] + " " + prose(rnd, g)
        texts.append(t)
        good.append(int(g))
    for _ in range(60):
        i = rnd.randrange(160)
        w = texts[i].split(" ")
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = "other"
        texts.append(" ".join(w))
        good.append(good[i])
    docs = [(i, t, "en", rnd.choice("aaab"), len(t)) for i, t in enumerate(texts)]
    return docs, [(i, g, 0) for i, g in enumerate(good)], items


def written(spark, tmp_path, docs, labels, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, labels, items = corpus()
    folder = written(spark, tmp_path, spark.createDataFrame(docs, SCHEMA), labels, items)
    kept, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def step(name):
        rows = stages[name](spark, kept, folder)
        assert name == "token_output" or rows.columns == kept.columns
        return rows.persist()

    now = {d[0]: d for d in docs}
    scores = plain_quality([(i, d[1]) for i, d in now.items()], [(i, q) for i, q, _ in labels])
    now = {i: d for i, d in now.items() if scores[i] >= 0.5}
    kept = step("quality")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(now) and 0 < len(now) < len(docs)

    order = sorted(now)
    groups = components([(i, now[i][1]) for i in order], 5, 4, 5)
    now = {i: now[i] for at, i in enumerate(order) if groups[at] == i}
    kept = step("near_duplicates")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(now) and len(now) < len(order)

    bad = {h[0] for h in plain_hits([(i, d[1]) for i, d in now.items()], items, 5, 0.8)}
    now = {i: d for i, d in now.items() if i not in bad}
    kept = step("decontamination")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(now) and bad

    con = duckdb.connect()
    documents = spark.createDataFrame(list(now.values()), SCHEMA).toPandas()  # noqa: F841
    copies = Counter({i: taken // size for i, size, _, _, taken in con.sql(mixing.ORACLE).fetchall() if size})
    kept = step("mixing")
    assert Counter(r.doc_id for r in kept.collect()) == +copies and max(copies.values()) == 2

    whole, start, expected = Tokenizer.from_file(corpus_pipeline.TOKENIZER), 0, []
    for i in sorted(copies.elements()):
        ids = whole.encode(now[i][1], add_special_tokens=False).ids + [corpus_pipeline.END_ID]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, step("token_output").collect()), key=lambda r: r[1]) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1]) == expected


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    docs, labels, items = corpus()
    some = spark.createDataFrame(docs, SCHEMA).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    folder = written(spark, tmp_path, some, [*labels, (None, 1, 0), (1002, None, None)], [*items, (None, "a b c"), (1, None), (2, "")])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) > 50 and all(r.n_tokens > 0 for r in rows)


def test_an_empty_corpus(spark, tmp_path):
    folder = written(spark, tmp_path, awkward(spark).where("false"), [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_queries_of_two_threads_at_once(spark):
    """What one removes of its own is not the other's."""
    docs, _, _ = corpus(5)
    df, found, failed = spark.createDataFrame(docs, SCHEMA), {}, []

    def run(name, f):
        try:
            found[name] = [sorted(map(tuple, f(df).collect())) for _ in range(2)]
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    tokens = lambda d: token_output.read_documents(token_output.write_sequences(d, corpus_pipeline.TOKENIZER, 2))
    jobs = {"near": lambda d: near_duplicates.near_duplicates(d).select("doc_id", "component_id"), "tokens": tokens}
    threads = [threading.Thread(target=run, args=job) for job in jobs.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and all(a == b and len(a) == len(docs) for a, b in found.values())
