"""WARC archives, index first: write records with an index, then read selected records by coalesced byte ranges.

Each writing task appends gzip members (one record each) to archives of its own in the shared folder; the index
(file, offset, length, url, digest, ...) is the task's output, so only files of tasks that succeeded are ever read.
Reading sorts the selected index rows by file and offset, joins neighbouring ranges into one read, and parses and
verifies the records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, delete_path, make_dirs, sized, text_of

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, payload_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, verified boolean"
EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else " " for c in value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but states the full payload's length and digest."""
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if is_revisit else len(payload)}",
    ]
    if is_revisit:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if is_revisit else payload) + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record, by its Content-Length."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _urn(value: str) -> int | None:
    name = value.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def _write(folder: str, max_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        try:
            for batch in batches:
                rows: list[list] = [[] for _ in range(8)]
                for page_id, url, payload, refers_to, is_revisit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None or at >= max_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    digest = base32_sha1(payload)
                    member = gzip.compress(record(page_id, url, payload, digest, refers_to, is_revisit), 4, mtime=0)
                    out.write(member)
                    values = (name, at, len(member), url, digest, page_id, "revisit" if is_revisit else "response", len(payload))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    at += len(member)
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return work


def _read(folder: str, gap: int, max_range: int, with_payload: bool):
    def members(rows: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
        store, path = pafs.FileSystem.from_uri(folder)
        held: list[tuple[str, int, int]] = []

        def fetch() -> Iterator[bytes]:
            first, last = held[0][1], max(o + n for _, o, n in held)
            with store.open_input_file(f"{path}/{held[0][0]}") as f:
                data = f.read_at(last - first, first)
            for _, o, n in held:
                yield gzip.decompress(data[o - first : o - first + n])
            held.clear()

        for row in rows:
            if held and (row[0] != held[0][0] or row[1] - (held[-1][1] + held[-1][2]) > gap or row[1] + row[2] - held[0][1] > max_range):
                yield from fetch()
            held.append(row)
        if held:
            yield from fetch()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for member in members(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                fields, content = parse(member)
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                verified = revisit or (base32_sha1(content) == digest and len(content) == int(fields["X-Payload-Length"]))
                values = (_urn(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], _urn(fields["WARC-Refers-To"]) if revisit else None, fields.get("WARC-Target-URI", ""), content if with_payload else None, verified)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    return work


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, max_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record per row and returns the (lazy) index. Materialise it once: each evaluation writes anew.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest id is a response and
    the others revisit it. Rows that share the largest id are all responses, as are rows with null ids (they can
    neither be referred to nor be ranked). Null html is an empty payload, a null url an empty one.
    """
    html = text_of(pages, html_col)
    src = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), html.cast("binary").alias("payload"))
    src = src.withColumn("key", F.sha2("payload", 256))
    many = src.where((F.octet_length("payload") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("key").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = many.select("key", "top")
    joined = src.join(sized(many), "key", "left")
    is_revisit = F.coalesce(F.col("top") > F.col("page_id"), F.lit(False))
    rows = joined.select("page_id", "url", "payload", F.when(is_revisit, F.col("top")).alias("refers_to"), is_revisit.alias("is_revisit"))
    return rows.mapInArrow(_write(folder, max_bytes), INDEX)


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, max_range: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records that the index rows select, by coalesced reads in (file, offset) order."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read(folder, gap, max_range, with_payload), RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes all rows, reads them back and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    An empty table gives an empty result; repeated rows give repeated records.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    folder = make_dirs(spark, f"{ws.base}/archives").replace("file:/", "file:///").replace("file:////", "file:///")
    index = ws.table(write_archives(pages, folder, id_col, url_col, html_col, min_revisit_bytes), "index")
    records = read_records(index, folder, with_payload=False)
    out = ws.result(records.select(F.assert_true("verified", "a record's payload does not match its digest").alias("checked"), "*").select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("checked").isNull().alias("verified")))
    delete_path(spark, folder)
    return out
