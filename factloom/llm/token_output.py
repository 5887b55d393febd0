"""Token-ID output: equal-length sequences in Arrow files.

Each shard is an Arrow IPC file: the stream format with a footer, so any
record batch is found by its index and mapped without a copy. A batch has
``ids`` (fixed-size list of the smallest unsigned type that holds the
vocabulary) and ``mask`` (fixed-size list of bool, false only on the padding
behind a shard's last token). Batches are never compressed, as a compressed
buffer cannot be mapped. Beside each stands ``*.docs.arrow`` with the
documents of the shard in order: ``doc_id``, ``n_tokens``.

Shards are ranges of ``doc_id``, then of text, so the files in shard order hold all tokens
in ascending order of documents, and a document's global start is the sum of
the shards before plus its place in its own.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from array import array
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import LOWER_LETTERS, Memo, byte_level, head_and_tail, materialize, parallelism, shared_dir, utf8

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct piece between
    white space once while it stays in a bounded memo.

    That is exact where the tokenizer drops white space: its normaliser works
    character by character or on combining sequences, none of which reaches
    over white space, and its pre-tokeniser gives pieces without any. Closing
    punctuation is known apart from its word, and common words in lower case
    where the normaliser lowers all. Pieces that hold an added token's string
    in any case, and any text for another tokenizer, are encoded as they are.
    """

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word, self.lowers = drops_white_space(spec), any(n["type"] == "Lowercase" for n in parts_of(spec["normalizer"], "normalizers"))
        added = b"|".join(re.escape(t["content"].encode()) for t in spec["added_tokens"])
        self.added = re.compile(added or b"(?!)", re.IGNORECASE).search
        self.model = self.tokenizer.model
        self.pieces, self.words = Memo(self._piece, 300_000), Memo(self._word, 300_000)

    def _encode(self, text: bytes) -> bytes:
        return array(self.dtype.char, self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        """A word of lower-case letters is one pre-token that the normaliser
        leaves as it is, so it goes to the library's model at once."""
        if LOWER_LETTERS(word):
            return array(self.dtype.char, [t.id for t in self.model.tokenize(byte_level(word))]).tobytes()
        return self._encode(word)

    def _piece(self, piece: bytes) -> bytes:
        if self.added(piece):
            return self._encode(piece)
        head, tail = head_and_tail(piece)
        lower = head.lower()
        ids = self.words[lower if self.lowers and (lower.isascii() or LOWER_LETTERS(lower)) else head]
        return ids + self.words[tail] if tail else ids

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._encode(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))


#: One per Python worker, so that its memo outlives a task.
@cache
def encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


def parts_of(part: dict | None, many: str) -> list[dict]:
    """The members of a sequence, or the part itself; none without one."""
    return (part or {}).get(many, [part] if part else [])


def drops_white_space(spec: dict) -> bool:
    """Whether pieces between ASCII white space are encoded on their own: a
    removing split whose pattern matches no white space, no added token with
    white space in it, sought in normalised text or taken from its
    surroundings, no template."""
    pre = parts_of(spec["pre_tokenizer"], "pretokenizers")
    split = pre[0] if pre else {}
    pattern = str(split.get("pattern", {}).get("Regex", ""))
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
        and all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in parts_of(spec["normalizer"], "normalizers"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        and spec["post_processor"] is None
    )


class SequenceWriter:
    """Packs ids into rows of ``length`` and writes them batch by batch."""

    def __init__(self, sink, length: int, rows: int, dtype: np.dtype):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.n_held, self.n_sequences = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        if self.n_held >= self.length * self.rows:
            self._flush(self.n_held // (self.length * self.rows) * self.rows)

    def _flush(self, rows: int, padded: int = 0) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        used = rows * self.length - padded
        self.held, self.n_held = [ids[used:].tobytes()], len(ids) - used
        full = np.pad(ids[:used], (0, padded))
        mask = np.arange(len(full)) < used
        for at in range(0, rows, self.rows):
            cut = slice(at * self.length, (at + self.rows) * self.length)
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), self.length) for x in (full, mask)], schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        if self.n_held:
            rows = -(-self.n_held // self.length)
            self._flush(rows, rows * self.length - self.n_held)
        self.writer.close()


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = 1024, rows: int = 256, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id long, text string) into shards below ``folder``.

    Returns the manifest, one row per shard that has documents: shard, path,
    n_docs, n_tokens, n_sequences. Null text counts as empty; an empty text is
    its end id alone. A null doc_id sorts first; rows that repeat a doc_id
    follow one another, ordered by text. Other columns are ignored. An empty
    table gives no shard.

    A task writes under a name of its own attempt and reports it only when
    both files are closed, so files of lost or repeated tasks are never read.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-sequences")
    shards = shards or parallelism(spark)
    dtype = "uint16" if max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) <= 1 << 16 else "uint32"

    def run(batches):
        encode = encoder(tokenizer, dtype)
        end = np.array([end_id], dtype).tobytes()
        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        docs_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        sinks, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sinks is None:
                fs.create_dir(root, recursive=True)
                sinks = [fs.open_output_stream(posixpath.join(root, f"{name}.{kind}")) for kind in ("arrow", "docs.arrow")]
                sequences = SequenceWriter(sinks[0], length, rows, dtype)
                index = pa.ipc.new_file(sinks[1], docs_schema)
            counts = []
            for text in utf8(batch.column("text")):
                ids = encode(text) + end
                sequences.add(ids)
                counts.append(len(ids) // np.dtype(dtype).itemsize)
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64())], schema=docs_schema))
            n_docs, n_tokens = n_docs + len(counts), n_tokens + sum(counts)
        if sinks:
            sequences.close()
            index.close()
            for s in sinks:
                s.close()
            row = [shard, f"{folder}/{name}", n_docs, n_tokens, sequences.n_sequences]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 3))], names=["shard", "path", "n_docs", "n_tokens", "n_sequences"])

    # A doc_id that repeats is split by how its texts begin.
    begins = F.substring("text", 1, 16)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(shards, "doc_id", begins).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def open_shard(path: str):
    """Both readers of a shard, memory-mapped where the store is local."""
    fs, root = pafs.FileSystem.from_uri(path)
    local = isinstance(fs, pafs.LocalFileSystem)
    return [pa.ipc.open_file(pa.memory_map(p) if local else fs.open_input_file(p)) for p in (f"{root}.arrow", f"{root}.docs.arrow")]


class Shard:
    """Random access to the sequences of a shard. Files are opened once, and
    ids and packed mask bits are views of the mapped file."""

    def __init__(self, path: str, rows: int = 256):
        self.rows, self.reader = rows, open_shard(path)[0]
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = lru_cache(4)(self.reader.get_batch)

    def _values(self, row: int, name: str) -> tuple[pa.Array, int]:
        return self.batch(row // self.rows).column(name).values, row % self.rows * self.length

    def ids(self, row: int) -> np.ndarray:
        values, at = self._values(row, "ids")
        return values.to_numpy()[at : at + self.length]

    def mask_bits(self, row: int) -> tuple[np.ndarray, int]:
        """The bytes that hold the row's mask, least bits first, and the bit
        of the first one at which it begins."""
        values, at = self._values(row, "mask")
        at += values.offset
        return np.frombuffer(values.buffers()[1], np.uint8)[at // 8 : -(-(at + self.length) // 8)], at % 8

    def mask(self, row: int) -> np.ndarray:
        """The row's mask, a boolean each: only its own bits are unpacked."""
        held, begin = self.mask_bits(row)
        return np.unpackbits(held, bitorder="little")[begin : begin + self.length].view(bool)


_shard = lru_cache(64)(Shard)


def sequence(path: str, row: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the mapped file) and mask of a row of the shard, whose
    reader stays open for the next."""
    shard = _shard(path, rows)
    return shard.ids(row), shard.mask(row)


def _documents_of(path: str, start: int):
    """The shard's documents from global place ``start`` on, with the crc32
    of their ids, batch by batch."""
    sequences, index = open_shard(path)
    at, part, left = 0, np.empty(0, np.uint16), 0
    for i in range(index.num_record_batches):
        docs = index.get_batch(i)
        counts = docs.column("n_tokens").to_numpy()
        crcs = np.zeros(len(counts), np.int64)
        for d, n in enumerate(counts.tolist()):
            crc = 0
            while n:
                if not left:
                    batch = sequences.get_batch(at)
                    part, at = batch.column("ids").values.to_numpy(), at + 1
                    left = len(part)
                take = min(n, left)
                crc = zlib.crc32(part[len(part) - left : len(part) - left + take].astype("<u4"), crc)
                n, left = n - take, left - take
            crcs[d] = crc
        starts = start + np.cumsum(counts) - counts
        start += int(counts.sum())
        yield pa.record_batch([docs.column("doc_id"), pa.array(starts), docs.column("n_tokens"), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start,
    n_tokens, ids_crc32. One task per shard; what crosses shards is a running
    sum over the manifest, which has one row per shard."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                yield from _documents_of(path, start)

    placed = manifest.select("shard", "path", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("start"))
    return placed.repartition(parallelism(manifest.sparkSession), "shard").select("path", "start").mapInArrow(run, READ)
