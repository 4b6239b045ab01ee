"""A deterministic, sharded WARC writer, and its reader.

Records are cut into ranges of their id, one partition each, and sorted. A task writes gzip members,
one per record, and rolls its file when the compressed size passes a limit. Lengths, digests, ids
and dates of all headers are made anew from the payload, so the same rows give the same bytes on
every run. Files are written under temporary names and published with a manifest (``files``).

Of records with equal payloads that with the smallest id holds the payload; the others are revisit
records that refer to it. The digests are computed and grouped without the payloads; what refers to
what travels as narrow marker rows that sort right before their page, so payloads are shuffled once.

Defined results: a null payload counts as empty; a null id sorts first and reads back as null, and
its record can refer but is never referred to unless all of its group are null; rows that repeat an
id and payload are revisits of the first of them; a missing url becomes a urn. Control characters in
urls are percent-encoded. Columns other than id, url and payload are not written. An empty table
gives an empty manifest and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.files import ShardFiles, file_system, in_shards, range_shards, read_files, write_files
from millrace.llm.text import partitions, rank_among
from millrace.util import col

RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload_matches boolean, file string")
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload_matches", pa.bool_()), ("file", pa.string())])

# Fixed values of the format.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def _safe(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """The bytes of one record, not yet compressed. ``refers_to``: (id,) of the response, or None."""
    own = digest(payload)
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to else http + payload
    head = [
        _VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, own)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url, page_id)}", f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to:
        head += [f"WARC-Refers-To: {_record_id(refers_to[0], own)}", f"WARC-Profile: {_PROFILE}",
                 f"X-Refers-To-Page: {'' if refers_to[0] is None else refers_to[0]}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(file_bytes: int, least_bytes: int, date: str, level: int) -> Callable:
    def at(root: str):
        def write(batches):
            files = ShardFiles(root, ".warc.gz")
            shard, part, page, marks, written = None, 0, None, {}, set()
            for batch in batches:
                columns = [batch.column(n) for n in ("_shard", "id", "url", "payload", "refers",
                                                     "mark")]
                for i in range(batch.num_rows):
                    s, page_id, url, payload, refers, mark = (c[i].as_py() for c in columns)
                    if (s, page_id) != page:
                        page, marks, written = (s, page_id), {}, set()
                    if mark is not None:
                        marks[mark] = refers
                        continue
                    if s != shard:
                        files.close()
                        shard, part = s, 0
                    payload = (payload or "").encode()
                    key = hashlib.sha1(payload).hexdigest()
                    target = None
                    if len(payload) >= least_bytes:
                        if key in marks:
                            target = (marks[key],)
                        elif key in written:
                            target = (page_id,)
                        written.add(key)
                    if files.stream is None:
                        files.open(shard, part)
                    data = _member(record(page_id, url, payload, target, date), level)
                    if files.write(data) >= file_bytes:
                        files.close()
                        part += 1
            files.close()
            yield from files.report()
        return write
    return at


def write_warc(pages: DataFrame, root: str, identifier: str = "page_id", url: str = "url",
               payload: str = "html", least_bytes: int = 0, shards: int | None = None,
               file_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6
               ) -> DataFrame:
    """Write one record per row below ``root``; return the manifest."""
    spark = pages.sparkSession
    shards = shards or partitions(spark)
    body = F.coalesce(col(payload), F.lit(""))
    keyed = pages.select(col(identifier).alias("id"), F.sha1(F.encode(body, "utf-8")).alias("sha"),
                         F.octet_length(body).alias("n")).where(F.col("n") >= least_bytes)
    groups = (keyed.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1).select("sha", "first"))
    # A digest may hold a third of all rows: both sides are narrow, and adaptive execution splits it.
    marks = (keyed.join(groups, "sha").where(~F.col("id").eqNullSafe(F.col("first")))
             .select("id", F.lit(None).cast("string").alias("url"),
                     F.lit(None).cast("string").alias("payload"), F.col("first").alias("refers"),
                     F.col("sha").alias("mark")).distinct())
    records = pages.select(col(identifier).alias("id"), col(url).cast("string").alias("url"),
                           col(payload).alias("payload"), F.lit(None).cast("bigint").alias("refers"),
                           F.lit(None).cast("string").alias("mark"))
    _, limits = range_shards(pages, identifier, shards)
    points = F.lit(limits).cast("array<bigint>") if limits else F.array().cast("array<bigint>")
    placed = records.unionByName(marks).withColumn("_shard", F.coalesce(
        rank_among(points, F.col("id"), len(limits)), F.lit(0)).cast("int"))
    ordered = in_shards(placed, shards, F.col("id").asc_nulls_first(),
                        F.col("mark").asc_nulls_last(), F.xxhash64("payload"), "url")
    return write_files(spark, root, ordered, _writer(file_bytes, least_bytes, date, level))


def _headers(stream) -> dict[str, str] | None:
    first = stream.readline()
    if not first:
        return None
    if first.strip().decode() != _VERSION:
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return _fields(stream)


def _fields(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    return found


def records(stream):
    """The (headers, block) of each record of an uncompressed stream."""
    while (head := _headers(stream)) is not None:
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def _reader(root: str) -> Callable:
    def number(text: str):
        return int(text) if text else None

    def one(head: dict, block: bytes, name: str) -> dict:
        if head["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"{name}: a block does not match its digest")
        inner = io.BytesIO(block)
        inner.readline()
        http = _fields(inner)
        payload = inner.read()
        told = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        whole = not revisit
        return {"page_id": number(head["x-page-id"]), "url": head["warc-target-uri"],
                "record_type": head["warc-type"],
                "refers_to": number(head["x-refers-to-page"]) if revisit else None,
                "payload_bytes": len(payload) if whole else int(http["content-length"]),
                "payload_digest": digest(payload) if whole else told,
                "payload_matches": digest(payload) == told if whole else None, "file": name}

    def read(batches):
        system, base = file_system(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with (system.open_input_stream(f"{base}/{name}") as raw,
                      gzip.GzipFile(fileobj=raw) as plain):
                    buffered = io.BufferedReader(plain, 1 << 20)
                    for head, block in records(buffered):
                        rows.append(one(head, block, name))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
    return read


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """One row per record of the published files, with the digest found in its payload."""
    return read_files(spark, root, _reader, RECORDS)
