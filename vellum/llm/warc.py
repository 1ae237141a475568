"""WARC archives: written with an index of their records, read back by byte ranges.

Each record is a gzip member of its own, as usual in .warc.gz files; offset and length in the
index are those of the member.

Archives go through a file system that pyarrow opens from the shared folder's address, one file
per task attempt. The index rows come back through Spark, and only a committed attempt's rows
are in the index; a file that a lost attempt left is named by no row and never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_or_empty

#: Fixed, so that the same pages give the same archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Ranges that lie so near are read at once, up to so many bytes.
GAP, BLOCK = 64 << 10, 8 << 20
#: Bytes of the selected records that a task reads, about.
READ = 8 << 20

INDEX = "page_id long, row long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, row long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _one_line(value: str) -> str:
    """A header value can't hold line breaks; they are written as their escapes."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(url: str | None, row: int, page_id: int | None, digest: str, payload: bytes, refers: tuple[int | None, int, str | None] | None) -> bytes:
    """One record, with the two line ends that close it. refers: page_id, row and URL of the
    response whose payload a revisit repeats; a revisit's own block is the HTTP head alone."""
    block = HTTP + (b"" if refers else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(int=row)}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.UUID(int=refers[1])}>"]
        if refers[2] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(refers[2])}")
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers[0]}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (what follows the HTTP head) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    length = int(headers["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return headers, rest[:length].partition(b"\r\n\r\n")[2]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """pages: page_id, url, html. Adds row, and to_page, to_row, to_url of the response that a
    revisit repeats: of equal payloads of `least` bytes or more that with the smallest page_id,
    a null id last, then the smallest row. The pages' html is not shuffled by content: only
    digests are grouped, and the few columns of a revisit come back by row number."""
    rows = scratch.put(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html")).withColumn("row", F.monotonically_increasing_id()), "pages")
    body = F.encode(text_or_empty("html"), "UTF-8")
    digests = scratch.put(rows.select("page_id", "row", "url", F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("n")), "digests")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")).alias("k")
    groups = digests.where(F.col("n") >= least).groupBy("sha").agg(first, F.count("*").alias("same")).where("same > 1")
    groups = scratch.put(groups.select("sha", F.col("k.page_id").alias("to_page"), F.col("k.row").alias("to_row"), F.col("k.url").alias("to_url")), "groups")
    revisits = digests.select("row", "sha").join(groups, "sha").where(F.col("row") != F.col("to_row")).drop("sha")
    return rows.join(scratch.put(revisits, "revisits"), "row", "left")


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the records of mark_revisits below `folder`; returns INDEX rows (write them once).
    page_id, url and html may be null: the html counts as empty, the others have no header."""
    schema = _arrow(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                found = []
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (r["html"] or "").encode()
                    digest = payload_digest(payload)
                    refers = (r["to_page"], r["to_row"], r["to_url"]) if r["to_row"] is not None else None
                    data = gzip.compress(record_bytes(r["url"], r["row"], r["page_id"], digest, payload, refers), 4, mtime=0)
                    out.write(data)
                    found.append((r["page_id"], r["row"], r["url"], name, at, len(data), len(payload), digest, "revisit" if refers else "response", r["to_page"]))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return marked.select("page_id", "row", "url", "html", "to_page", "to_row", "to_url").mapInArrow(write, INDEX)


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) spans: start, end, and the positions of the spans."""
    start = end = 0
    held: list[int] = []
    for i, (at, length) in enumerate(spans):
        if held and (at - end > GAP or at + length - start > BLOCK):
            yield start, end, held
            held = []
        if not held:
            start = end = at
        end = max(end, at + length)
        held.append(i)
    if held:
        yield start, end, held


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of `index` name, in few sorted reads per file. What is returned
    was parsed from the archive's bytes. A revisit's payload is empty here, its digest and
    payload_bytes are those of the whole payload. A response whose bytes don't match its digest
    is an error."""
    schema = _arrow(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            files, offsets, lengths = (batch[c].to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                with store.open_input_file(f"{root}/{files[at]}") as f:
                    for start, end, held in ranges(list(zip(offsets[at:to], lengths[at:to]))):
                        data, found = f.read_at(end - start, start), []
                        for i in held:
                            o = offsets[at + i] - start
                            h, payload = parse_record(gzip.decompress(data[o : o + lengths[at + i]]))
                            digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                            if kind == "response" and payload_digest(payload) != digest:
                                raise ValueError(f"{files[at]} at {offsets[at + i]}: payload and digest differ")
                            url, ids = h.get("WARC-Target-URI"), [h.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                            url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                            page, to_page = (None if x is None else int(x) for x in ids)
                            row = uuid.UUID(h["WARC-Record-ID"][10:-1]).int
                            found.append((page, row, url, int(h["X-Payload-Length"]), digest, kind, to_page, payload))
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t.type) for i, t in enumerate(schema)], schema=schema)
                at = to

    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // READ)
    sorted_index = index.repartitionByRange(max(1, tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_index.select("file", "offset", "length").mapInArrow(read, RECORDS)


def op2_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    marked = mark_revisits(table(spark, sf_dir, "pages"), scratch)
    index = scratch.put(write_archives(marked, scratch.path("warc")), "index")
    got = read_records(index, scratch.path("warc"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT *, sha1(body) AS hex, first_value(page_id) OVER w AS first_id, row_number() OVER w AS nth
  FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST)
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to, url
FROM d
"""
