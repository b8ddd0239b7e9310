"""Operator 8, a deterministic sharded WARC writer and its reader.

Pages are ordered by page_id and payload digest over shards of even size, whose bounds come from a sample by hash, so the same
pages give the same files byte for byte, and a page_id that many rows share is spread by their digests. A shard is one sorted
stream: records are compressed one by one, a file is closed once it reaches its size, headers and digests are made anew from
the payload. Files get temporary names that name the attempt and are renamed when complete. The manifest is a table of the
files that count, written by the tasks that wrote them and moved to its place last, so neither the list of files nor a
record ever comes to the driver. A lost executor leaves at most a temporary file.

Of equal payloads of SHARED bytes or more the page with the largest page_id is written in full and the others refer to it.
Which page that is is found on digests alone; its id joins the pages as a small mark in the same sorted stream, so payloads are
shuffled once.

Defined cases: a null html is an empty payload, and pages under SHARED bytes are always written in full; of rows that repeat
the largest page_id and payload the first is written in full, and each record has an id of its own; a null page_id comes first in
order, and as the smallest id; a null url gives an empty target; an empty table gives a manifest without files; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup, shared_dir, table

SHARED = 1000
FILE_BYTES = 16 << 20
#: Uncompressed payload bytes of a shard, on average; keys in the sample that gives the bounds, in all and for each shard.
SHARD_BYTES, SAMPLE, SAMPLE_PER_SHARD = 64 << 20, 20_000, 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_FILES = "file string, records long, bytes long, sha256 string"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, body_ok boolean"


def record_id(page_id: int | None, digest: str, nth: int = 0) -> str:
    """The id of the nth record of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}' + (f'/{nth}' if nth else ''))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int = 0) -> bytes:
    """One compressed member: a response with the payload, or a revisit that has headers only."""
    sha1 = hashlib.sha1(payload)
    digest = base64.b32encode(sha1.digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c > " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _filesystem(uri: str):  # noqa: ANN202
    """File system and path of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class ShardWriter:
    """Rolling files of one shard."""

    def __init__(self, folder: str, shard: int, attempt: str, limit: int) -> None:
        self.fs, self.folder = _filesystem(folder)
        self.shard, self.attempt, self.limit = shard, attempt, limit
        self.serial, self.out, self.files = 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.serial:05d}.warc.gz"
            self.temporary = posixpath.join(self.folder, f".{self.name}.{self.attempt}")
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, posixpath.join(self.folder, self.name))
            self.files.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.serial = None, self.serial + 1


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, key, mark first; a mark tells which page its payload is written with."""
    from pyspark import TaskContext

    context = TaskContext.get()
    attempt = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
    writer: ShardWriter | None = None
    key, marked, keeper, nth = None, False, None, 0
    files: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*files, strict=True)) or [(), (), (), ()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "records", "bytes", "sha256"])

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for r in batch.slice(at, 64).to_pylist():
                if writer is None or writer.shard != r["shard"]:
                    if writer is not None:
                        writer.close()
                        files += writer.files
                    writer = ShardWriter(folder, r["shard"], attempt, limit)
                if (r["key"], r["digest"]) != key:
                    key, marked, keeper, nth = (r["key"], r["digest"]), False, None, 0
                if r["mark"]:
                    marked, keeper = True, r["keeper"]
                    continue
                payload = (r["html"] or "").encode()
                writer.write(record(r["page_id"], r["url"], payload, keeper, marked and (keeper != r["page_id"] or nth > 0), nth))
                nth += 1
    if writer is not None:
        writer.close()
        files += writer.files
    yield flush()


def sort_key(page_id: F.Column, digest: F.Column) -> F.Column:
    """A text that sorts as (page_id, nulls first, then digest): fixed width, so shards can be cut anywhere between two of them."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("")), F.lit("/"), F.substring(digest, 1, 16))


def shared_payloads(spark: SparkSession, digests: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, digest, keeper of the pages (page_id, digest, bytes) whose payload of SHARED bytes or more occurs more than once."""
    rows = digests.where(F.col("bytes") >= SHARED).select("page_id", "digest")
    groups = scratch.save(rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")), "groups")
    found = lookup(rows, groups, "digest", "n", rows.count())
    return found.where("n > 1").select("page_id", "digest", "keeper").distinct()


def shard_bounds(digests: DataFrame, shards: int, total: int) -> np.ndarray:
    """Up to shards - 1 keys from a sample by hash, which has about SAMPLE keys or SAMPLE_PER_SHARD for each shard."""
    share = min(1.0, max(SAMPLE, SAMPLE_PER_SHARD * shards) / max(1, total))
    key = sort_key(F.col("page_id"), F.col("digest"))
    sample = digests.select(key.alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    keys = np.sort(sample.toPandas()["key"].to_numpy().astype("S33"))
    return np.unique(keys[len(keys) * np.arange(1, shards) // shards]) if len(keys) else keys


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the archives of pages (page_id, url, html) and their manifest into a new shared folder."""
    scratch = Scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = scratch.save(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")), "digests")
    total, size = digests.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, -(-size // shard_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 512)))
    bounds = shard_bounds(digests, shards, total)
    # a bound for every SHARD_BYTES of pages, searched by halves
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy().astype("S33"), side="right").astype(np.int32))

    marks = scratch.save(shared_payloads(spark, digests, scratch), "marks")
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.lit(None).cast("long").alias("keeper"), F.lit(False).alias("mark"))
    rows = rows.unionByName(marks.select("page_id", none.alias("url"), none.alias("html"), "digest", "keeper", F.lit(True).alias("mark")))
    rows = rows.withColumn("key", sort_key(F.col("page_id"), F.col("digest")))
    rows = rows.withColumn("shard", shard_of("key")).repartitionById(len(bounds) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", "key", "digest", F.col("mark").desc(), "url")
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    temporary = f".manifest-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda b: _write_shards(b, folder, file_bytes), _FILES).write.parquet(posixpath.join(folder, temporary))
    fs.move(posixpath.join(path, temporary), posixpath.join(path, "manifest"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, records, bytes, sha256 of the archives that count."""
    return spark.read.schema(_FILES).parquet(posixpath.join(folder, "manifest"))


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The decompressed members of an archive, one at a time."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or stream.read(1 << 16)
            rest = b""
            if not data:
                if parts:
                    raise EOFError("an archive ends within a record")
                return
            parts.append(z.decompress(data))
        rest = z.unused_data
        yield b"".join(parts)


def _parse(stream: pa.NativeFile) -> Iterator[tuple]:
    for raw in _members(stream):
        head, _, body = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = body[: int(fields["Content-Length"])]
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
        revisit = fields["WARC-Type"] == "revisit"
        ok = hashlib.sha1(block).digest() == base64.b32decode(fields["WARC-Block-Digest"].removeprefix("sha1:"))
        size = int(fields["X-Payload-Length"])
        if not revisit:
            payload = block.partition(b"\r\n\r\n")[2]
            ok, size = ok and hashlib.sha1(payload).digest() == digest, len(payload)
        number = lambda x: int(x) if x else None
        yield number(fields["X-Page-Id"]), size, digest.hex(), fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id")), ok


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives that the manifest lists; body_ok tells whether its digests hold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                own, at = _filesystem(folder)
                with own.open_input_stream(posixpath.join(at, name), compression=None) as f:
                    records = _parse(f)
                    while rows := list(itertools.islice(records, 1024)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    listed = manifest(spark, folder).select("file")
    return listed.repartition(max(1, min(listed.count(), 10_000)), "file").mapInArrow(task, _READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark, table(spark, sf_dir, "pages"), folder)
    read = read_warc(spark, folder)
    return read.select("page_id", "payload_bytes", F.when(F.col("body_ok"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM g
"""
