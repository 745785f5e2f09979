"""WARC archives: written with an index, read back by coalesced byte ranges of the selected records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import partitions, scratch_path, stored, table

#: A task begins another archive beyond FILE_BYTES. Reads of one archive are merged over gaps of up to GAP bytes
#: into ranges of up to RANGE bytes; SPAN bytes of an archive are one task's unit of work.
FILE_BYTES, GAP, RANGE, SPAN = 256 << 20, 64 << 10, 4 << 20, 16 << 20
INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"
#: Fixed by the format's published standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:kinfold:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record; with refers_to a revisit, which carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}"]),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if field["WARC-Type"] == "response" else None
    name = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and digest(payload) != name:
        raise ValueError(f"the payload of {field['WARC-Record-ID']} does not have its digest")
    ident = lambda key: int(x) if (x := field.get(key, "").strip("<>").removeprefix(_URN)) else None
    return {"page_id": ident("WARC-Record-ID"), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"], "payload_digest": name, "refers_to": ident("WARC-Refers-To"), "payload": payload}


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    # a repeated task writes other names; only what its index rows name is ever read
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                payload = html or b""
                data = gzip.compress(record(page_id, url, payload, refers_to), 1, mtime=0)
                out.write(data)
                rows.append({"file": f"{root}/{name}", "offset": at, "length": len(data), "url": url, "payload_digest": digest(payload), "page_id": page_id, "record_type": "response" if refers_to is None else "revisit"})
                at += len(data)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
        if out is not None:
            out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Writes a record for every row of pages(page_id, url, html, ...) to archives under root (a folder that all
    executors share; by default in the session's) and returns the stored index: file, offset, length, url,
    payload_digest, page_id, record_type.

    Of pages with equal payloads of at least min_revisit_bytes bytes, that with the largest page_id becomes a
    response and the others revisits of it. Null or empty html is an empty payload. Rows that share the largest
    page_id are all responses; a null page_id counts as smaller than any other, and if a group has no other, all of
    it are responses. A null url leaves the field out. Other columns are ignored.
    """
    root = root or scratch_path(spark, "warc")
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("sha", F.sha1("html"))
    kept = own.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marked = own.join(kept, "sha", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    ready = marked.select("page_id", "url", "html", "refers_to")
    return stored(spark, ready.mapInArrow(_write(root), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    opened, source = "", None

    def load(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        nonlocal opened, source
        file, first, _ = rows[0]
        if file != opened:
            if source is not None:
                source.close()
            store, path = fs.FileSystem.from_uri(file)
            opened, source = file, store.open_input_file(path)
        data = source.read_at(rows[-1][1] + rows[-1][2] - first, first)
        return pa.RecordBatch.from_pylist([parse(gzip.decompress(data[at - first : at - first + n])) for _, at, n in rows], schema)

    run: list[tuple[str, int, int]] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + GAP or row[1] + row[2] - run[0][1] > RANGE):
                yield load(run)
                run = []
            run.append(row)
    if run:
        yield load(run)
    if source is not None:
        source.close()


def read_records(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The records that rows of the index select: page_id, url, record_type, payload_digest, refers_to, payload
    (null for revisits). Rows are sorted by place, and near ones of an archive are read in one range."""
    spans = index.select("file", "offset", "length").repartition(partitions(spark), "file", F.floor(F.col("offset") / SPAN))
    return spans.sortWithinPartitions("file", "offset").mapInArrow(_read, RECORDS)


def with_lengths(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records(..., own_bytes), a revisit's
    payload_bytes being those of the response that it refers to."""
    first = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("first_bytes"))
    return records.join(first, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("own_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark, table(spark, sf_dir, "pages"))
    own = stored(spark, read_records(spark, index).withColumn("own_bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "warc-read")
    return with_lengths(own)


OP10_SQL = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as x from p),
b as (select *, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (((('0x' || substr(x || '00', ((5 * i) // 4) + 1, 3))::bigint) >> (7 - ((5 * i) % 4))) & 31)::int + 1, 1)), '') as payload_digest,
      max(page_id) over (partition by x) as top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to from b
"""
