"""Token files and counts against the library on whole texts."""

import json
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from factloom.llm import token_count, token_output  # noqa: E402

from .brute import SCHEMA, awkward  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", "́", "Σ", "İ", " ", "  ", "\n", "\x1c", "\x85", "1", "23", "!", "'s", "'ll", "<|endoftext|>", "<|end", "日本", " ", "word", "Foo!!", "x.", "😀", "\t", "(q)", "Été", "été,", "größe.", "ÀÿÖ!", "a×b", "ñ÷", "naïve", "œuvre", "ß", "<|ENDOFTEXT|>x", "<|Endoftext|>9", "y<|STARTOFTEXT|>", "<|StartOfText|>"]


def texts(seed, n=400, length=60):
    rnd = random.Random(seed)
    yield from ("".join(rnd.choices(PARTS, k=rnd.randrange(length))) for _ in range(n))
    yield from (" ".join(rnd.choices(PARTS, k=20)) for _ in range(n))
    yield from ("x" * rnd.randrange(300) + "".join(rnd.choices(PARTS, k=30)) for _ in range(n // 4))


def test_word_encoder_equals_whole_texts():
    encode, whole = token_output.WordEncoder(WORD, "uint16"), Tokenizer.from_file(WORD)
    assert encode.by_word
    for t in texts(1):
        assert np.frombuffer(encode(t.encode()), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_a_tokenizer_that_keeps_case(tmp_path):
    spec = json.loads(Path(WORD).read_text())
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(spec))
    encode, whole = token_output.WordEncoder(str(path), "uint16"), Tokenizer.from_file(str(path))
    assert encode.by_word and not encode.lowers
    for t in texts(4, 100):
        assert np.frombuffer(encode(t.encode()), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_added_tokens_sought_in_normalised_text_take_whole_texts(tmp_path):
    spec = json.loads(Path(WORD).read_text())
    spec["added_tokens"][0]["normalized"] = True
    assert not token_output.drops_white_space(spec)


def test_a_repeated_id_is_dealt_by_its_texts(spark):
    df = spark.createDataFrame([(7, f"{i} words of a text", None, None, None) for i in range(90)], SCHEMA)
    manifest = token_output.write_sequences(df, WORD, 2, shards=3)
    assert manifest.count() == 3 and max(r.n_docs for r in manifest.collect()) < 60


def test_other_tokenizers_get_whole_texts():
    encode, whole = token_output.WordEncoder(BYTE, "uint16"), Tokenizer.from_file(BYTE)
    assert not encode.by_word
    for t in texts(2, 50):
        assert np.frombuffer(encode(t.encode()), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(17, 5), (60, 16), (200, 40), (10_000, 100)])
def test_spliced_counts_equal_whole_texts(chunk, overlap):
    count, whole = token_count.Counter(BYTE, chunk, overlap), Tokenizer.from_file(BYTE)
    for t in texts(3):
        assert count([t])[0] == [len(whole.encode(t, add_special_tokens=False))]


def test_overlap_widens_over_one_long_word():
    count, t = token_count.Counter(BYTE, 100, 10), "x" * 5_000 + " end"
    n, encodings = count.long(t)
    assert n == len(Tokenizer.from_file(BYTE).encode(t)) and encodings > 5


def test_counts_of_awkward_documents(spark):
    whole = Tokenizer.from_file(BYTE)
    rows = token_count.count_tokens(awkward(spark), BYTE, limit=3, chunk=1000, overlap=100).collect()
    docs = awkward(spark).select("doc_id", "text").collect()
    expected = sorted((str(d.doc_id), len((d.text or "").encode()), len(whole.encode(d.text or "", add_special_tokens=False))) for d in docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 3) for r in rows)
    assert token_count.count_tokens(awkward(spark).where("false"), BYTE).collect() == []


def test_files_hold_the_documents_in_order(spark):
    whole = Tokenizer.from_file(WORD)
    manifest = token_output.write_sequences(awkward(spark), WORD, 2, length=16, rows=4, shards=3)
    start, expected = 0, []
    for d in sorted(awkward(spark).select("doc_id", "text").collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or "")):
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [2]
        expected.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = sorted(map(tuple, token_output.read_documents(manifest).collect()), key=lambda r: r[1])
    assert rows == expected
    shards = manifest.orderBy("shard").collect()
    assert sum(s.n_tokens for s in shards) == start
    ids = []
    for s in shards:
        for r in range(s.n_sequences):
            row, mask = token_output.sequence(s.path, r, 4)
            assert len(row) == 16 and (r == s.n_sequences - 1 or mask.all())
            ids += row[mask].tolist()
    assert len(ids) == start and zlib.crc32(np.array(ids[expected[0][1] : expected[0][2]], "<u4").tobytes()) == expected[0][3]


@pytest.mark.parametrize("length, rows", [(8, 4), (13, 3), (1024, 40)])
def test_random_access_is_a_view(spark, length, rows):
    """Ids and packed masks are views, and a row's mask is its own bits."""
    df = spark.createDataFrame([(1, "some words " * 300, "en", "s", 1)], SCHEMA)
    path = token_output.write_sequences(df, WORD, 2, length=length, rows=rows, shards=1).first().path
    table, shard = token_output.open_shard(path)[0].read_all(), token_output.Shard(path, rows)
    for row, (ids, mask) in enumerate(zip(table.column("ids").to_pylist(), table.column("mask").to_pylist())):
        got = token_output.sequence(path, row, rows)
        assert got[0].tolist() == ids and got[1].tolist() == mask and got[1].dtype == bool
        bits, _ = shard.mask_bits(row)
        assert not got[0].flags.owndata and got[0].dtype == np.uint16 and not bits.flags.owndata and len(bits) <= length // 8 + 2
    assert not mask[-1] or length == 8
    first, again = (token_output.sequence(path, 0, rows)[0].__array_interface__["data"][0] for _ in range(2))
    assert first == again


def test_no_documents_no_shards(spark):
    manifest = token_output.write_sequences(awkward(spark).where("false"), WORD, 2)
    assert manifest.collect() == [] and token_output.read_documents(manifest).collect() == []
