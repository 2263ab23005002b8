"""WARC archives as a table of record chunks.

A record's bytes are rows (archive, record_id, chunk_no, data): chunk 0 is its header
block, the payload follows in chunks of at most ``chunk_bytes``, and the last chunk is
the two line breaks that end a record. Data of a record's rows in chunk order, records
after one another, are a valid WARC/1.1 file. Each payload chunk carries the running
SHA-1 up to its end, so that a reader checks a record while it streams and never holds
a whole payload; the writer slices one cell and copies one chunk at a time.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest
id is a response and the others revisit it; smaller ones are all responses.

Defined results: a null payload is empty, a null id is written as no id and read back
as null (where all ids of equal payloads are null, all are responses). Rows that repeat
an id with its payload are all responses. An empty table gives no records. Text that is
not valid UTF-16 cannot occur in Spark strings; payloads are their UTF-8.
"""

from __future__ import annotations

import hashlib
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, left_join_sized, quoted, table, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

CHUNK_BYTES = 1 << 18
CHUNKS = "archive int, record_id string, chunk_no long, data binary, running_sha1 string"
RECORDS = "record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
EMPTY_SHA1 = hashlib.sha1(b"").hexdigest()
#: Fixed values of the WARC/1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"
#: Bytes of a batch of chunk rows on its way to the writer.
BATCH_BYTES = 4 << 20


def header_block(record_id: str, page_id, uri, kind: str, refers_to, length: int, payload_bytes: int, digest: str) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", RECORD_DATE)]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in uri if c >= " ")))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(payload_bytes))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(length))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    lines = bytes(block).decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def record_chunks(archive, row_no, page_id, uri, payload, digest, refers_to, chunk_bytes):
    """The chunk rows of one record."""
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{row_no}')}"
    kind = "response" if refers_to is None else "revisit"
    size = len(payload)
    body = payload if kind == "response" else payload[:0]
    yield archive, record_id, 0, header_block(record_id, page_id, uri, kind, refers_to, len(body), size, digest), None
    sha1, no = hashlib.sha1(), 1
    for start in range(0, len(body), chunk_bytes):
        piece = body[start : start + chunk_bytes]
        sha1.update(piece)
        yield archive, record_id, no, bytes(piece), sha1.hexdigest()
        no += 1
    yield archive, record_id, no, b"\r\n\r\n", None


def _batches(rows, schema: pa.Schema, weigh):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def mark_revisits(pages: DataFrame, scratch: Scratch, min_revisit: int = 1000, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (row_no, page_id, uri, payload, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(quoted(payload_col), F.lit(""))
    uri = quoted(uri_col).cast("string") if uri_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row_no"), quoted(id_col).cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    twins = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    twins = scratch.write(twins, "twins")
    marked = left_join_sized(rows, twins, ["digest", "size"], 96, F.col("row_no"), broadcast_bytes)
    return marked.select("row_no", "page_id", "uri", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def to_chunks(marked: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    schema = pa.schema([("archive", pa.int32()), ("record_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("running_sha1", pa.string())])

    def rows(batches):
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId()
        for b in batches:
            row_no, page_id, uri, digest, refers_to = (b.column(c) for c in ("row_no", "page_id", "uri", "digest", "refers_to"))
            payload = b.column("payload").cast(pa.large_binary())
            for i in range(b.num_rows):
                view = memoryview(payload[i].as_buffer() or b"")
                yield from record_chunks(archive, row_no[i].as_py(), page_id[i].as_py(), uri[i].as_py(), view, digest[i].as_py(), refers_to[i].as_py(), chunk_bytes)

    def write(batches):
        yield from _batches(rows(batches), schema, lambda row: len(row[3]) + 100)

    return marked.select("row_no", "page_id", "uri", "payload", "digest", "refers_to").mapInArrow(trimmed(write), CHUNKS)


def read_records(rows):
    """Records of (record_id, chunk_no, data, running_sha1) rows in order, one at a time in memory but its chunks.

    Raises where chunks are missing, a length is wrong or a digest does not match.
    """
    current, head, sha1, seen, following = None, {}, None, 0, 0

    def ended():
        length, digest = int(head["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
        kind = head["warc-type"]
        if seen != length + 4 or kind == "response" and sha1.hexdigest() != digest:
            raise ValueError(f"{current}: {seen - 4} of {length} bytes, SHA-1 {sha1.hexdigest()}, {digest} expected")
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        return current, None if page is None else int(page), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, kind, None if refers is None else int(refers)

    for record_id, chunk_no, data, running in rows:
        if record_id != current:
            if current is not None:
                yield ended()
            current, head, sha1, seen, following = record_id, parse_header(data), hashlib.sha1(), 0, 1
            if chunk_no:
                raise ValueError(f"{record_id} starts at chunk {chunk_no}")
            continue
        if chunk_no != following:
            raise ValueError(f"{record_id}: chunk {chunk_no} follows {following - 1}")
        following += 1
        seen += len(data)
        if running is not None:
            sha1.update(data)
            if sha1.hexdigest() != running:
                raise ValueError(f"{record_id}: chunk {chunk_no} is damaged")
    if current is not None:
        yield ended()


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, its payload checked against its digest."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        def rows():
            for b in batches:
                ids, nos, data, running = (b.column(c) for c in ("record_id", "chunk_no", "data", "running_sha1"))
                data = data.cast(pa.large_binary())
                for i in range(b.num_rows):
                    yield ids[i].as_py(), nos[i].as_py(), memoryview(data[i].as_buffer()), running[i].as_py()

        yield from _batches(read_records(rows()), schema, lambda row: 200)

    ordered = chunks.select("record_id", "chunk_no", "data", "running_sha1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(trimmed(read), RECORDS)


def write_archives(pages: DataFrame, min_revisit: int = 1000, chunk_bytes: int = CHUNK_BYTES, **columns) -> DataFrame:
    """Write the chunk table of ``pages`` to the shared folder and return it as read back."""
    scratch = Scratch(pages.sparkSession, "warc")
    return scratch.write(to_chunks(mark_revisits(pages, scratch, min_revisit, **columns), chunk_bytes), "chunks")


def op7_warc(spark, sf_dir):
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLES = {
    "op7_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, octet_length(encode(html)) AS n, html, max(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to FROM q"""
}
