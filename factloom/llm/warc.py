"""WARC archives, and a normaliser for monolithically compressed ones.

Writers emit one gzip stream over a whole file, as careless crawlers do. The
normaliser inflates such a stream once, record by record, rewrites each record
as a gzip member of its own and writes a sidecar index (Arrow IPC) of member
offsets, after which any record is read by one seek. Both passes hold one
block of a record at a time, never a whole file.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, parallelism, shared_dir

BLOCK = 1 << 18
SHARDS = "path string, n_records long"
INDEX = pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target", pa.string())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
SHARE = 1000
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    value = (record or "").removeprefix("<urn:page:").rstrip(">")
    return int(value) if re.fullmatch(r"-?\d+", value) else None


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to given) carries the HTTP head alone."""
    block = http_head(len(payload)) + (b"" if refers_to is not None else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(stream):
    """Blocks of plain bytes of a gzip stream of one or more members."""
    inflate = zlib.decompressobj(31)
    fresh = True
    while data := stream.read(BLOCK):
        while data:
            part = inflate.decompress(data, 4 * BLOCK)
            fresh = False
            if part:
                yield part
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, fresh = inflate.unused_data, zlib.decompressobj(31), True
    if not fresh:
        raise EOFError("the gzip stream ends within a member")


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records_of(blocks):
    """For each record of a plain WARC stream: its header fields and an
    iterator of all its bytes, which must be exhausted before the next."""
    held = b""

    def more():
        nonlocal held
        part = next(blocks, None)
        if part is not None:
            held += part
        return part is not None

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise EOFError("the archive ends within a header")
                return
        head = held[: at + 4]
        fields = header_fields(head[:-4])
        held = held[at + 4 :]

        def body(head=head, left=int(fields["content-length"]) + 4):
            nonlocal held
            yield head
            while left:
                if not held and not more():
                    raise EOFError("the archive ends within a record")
                part, held = held[:left], held[left:]
                left -= len(part)
                yield part

        yield fields, body()


def normalise(source, sink, level: int = 6) -> pa.Table:
    """Rewrite the gzip stream ``source`` into ``sink``, a member a record;
    returns the offset index."""
    rows, offset = [], 0
    for fields, parts in records_of(inflated(source)):
        deflate, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in parts:
            length += sink.write(deflate.compress(part))
        length += sink.write(deflate.flush())
        rows.append((offset, length, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri")))
        offset += length
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, INDEX)], schema=INDEX)


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to of ``pages`` (page_id, url,
    html): of equal payloads of ``least`` bytes or more, all but the one with
    the smallest page_id refer to it. Digests that more than one page in SHARE
    has, fewer than SHARE of them, are looked up apart (see ``lookup``)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    counted = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = materialize(counted, "warc-first")
    # A short payload has a key of its own, so that those rows are dealt evenly.
    key = F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    hot = first.where(F.col("n") > pages.count() // SHARE).select(F.col("digest").alias("key"))
    joined = lookup(own.withColumn("key", key), first.select(F.col("digest").alias("key"), "first"), "key", hot)
    return joined.select("page_id", "url", "payload", "digest", F.expr("nullif(first, page_id)").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """One monolithic archive per task that has records: path, n_records. A
    file is reported only once closed, under a name of its attempt."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        name, sink, n = f"raw-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink, deflate = fs.open_output_stream(posixpath.join(root, name), compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                sink.write(deflate.compress(record(page_id, url, payload or b"", digest, refers_to)))
                n += 1
        if sink:
            sink.write(deflate.flush())
            sink.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return materialize(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, SHARDS), "warc-raw")


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalise each archive of ``archives`` (path) into ``folder``, with a
    sidecar ``.idx``: path, n_records. One task per archive."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                (fs, source), (to, root) = pafs.FileSystem.from_uri(path), pafs.FileSystem.from_uri(folder)
                to.create_dir(root, recursive=True)
                name = f"{posixpath.basename(source).removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                with fs.open_input_stream(source, compression=None) as stream, to.open_output_stream(posixpath.join(root, name), compression=None) as sink:
                    index = normalise(stream, sink, level)
                with to.open_output_stream(posixpath.join(root, f"{name}.idx")) as sink, pa.ipc.new_file(sink, INDEX) as writer:
                    writer.write_table(index)
                yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "n_records"])

    spread = archives.select("path").repartition(parallelism(archives.sparkSession), "path")
    return materialize(spread.mapInArrow(run, SHARDS), "warc-archives")


def read_member(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record at an offset of the index."""
    stream.seek(offset)
    plain = zlib.decompress(stream.read(length), 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = header_fields(head)
    return fields, rest[: int(fields["content-length"])]


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, through the index: page_id, payload_bytes,
    payload_digest, record_type, refers_to. The digest of a response is
    computed from its payload and must be the one in its header."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, root = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(f"{root}.idx") as file:
                    index = pa.ipc.open_file(file).read_all()
                with fs.open_input_file(root) as stream:
                    for part in index.to_batches(max_chunksize=1000):
                        rows = [_row(*read_member(stream, o, n)) for o, n in zip(part.column("offset").to_pylist(), part.column("length").to_pylist())]
                        types = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("path").repartition(parallelism(archives.sparkSession), "path").mapInArrow(run, READ)


def _row(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is not what its header says")
    return page_of(fields["warc-record-id"]), n, digest, kind, page_of(fields.get("warc-refers-to"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and return the
    normalised archives (path, n_records).

    Null html is an empty payload, a null url ``about:blank``. A page_id that
    repeats gives a record a row; rows equal in id and payload are all
    responses. A null page_id is never referred to. Other columns are
    ignored; an empty table gives no archive.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return normalise_archives(write_archives(with_revisits(pages), f"{folder}/raw"), f"{folder}/records")


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM f
"""
