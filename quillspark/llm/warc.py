"""WARC archives: write captures as records, read archives, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record that name
the response through WARC-Concurrent-To. Reading joins them again and gives one nested row a capture.
Files are written whole under their task's name and listed by the rows that their task returns, so an
attempt that was lost leaves nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, park, partitions, shared_dir
from .fsio import read_range, write_whole

#: Bytes of records (before compression) after which a file is closed. A longer record makes a longer file.
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_RECORD = "file string, record_id string, warc_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, body binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, rid: str, uri: str, body: bytes, more: dict[str, str]) -> bytes:
    """One WARC 1.1 record."""
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE, "WARC-Target-URI": uri, **more, "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive of gzip members or of plain records."""
    if data[:2] == b"\x1f\x8b":
        at = 0
        while at < len(data):
            d, out = zlib.decompressobj(31), []
            while not d.eof and at < len(data):
                piece = data[at : at + (1 << 16)]
                out.append(d.decompress(piece))
                at += len(piece) - len(d.unused_data)
            plain = b"".join(out)
            yield from parse(plain)
        return
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        head = {}
        for line in data[start:end].split(b"\r\n")[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip()] = v.strip()
        size = int(head.get("Content-Length", 0))
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def http_response(payload: bytes | None, size: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return head + (payload or b"")


def payload_of(body: bytes) -> bytes:
    """What follows the HTTP header of a response body."""
    return body.partition(b"\r\n\r\n")[2]


def plan_revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, sha, first_id) of the (id, payload) pairs that revisit another id's payload: of equal payloads of ``min_bytes`` or more the smallest id is first."""
    marks = park(pages.select(F.col(id_col).cast("long").alias("page_id"), payload_sha(html_col).alias("sha"), F.coalesce(F.octet_length(html_col), F.lit(0)).alias("bytes")).where(f"page_id is not null and bytes >= {int(min_bytes)}").select("page_id", "sha").distinct())
    first = marks.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return marks.join(first, "sha").where("page_id <> first_id").select("page_id", "sha", "first_id")


def payload_sha(html_col: str) -> Column:
    """SHA-1 of the payload in hexadecimal; null counts as empty."""
    return F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write request, response or revisit, and metadata of each row; returns (path, records) of the files.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of ``min_bytes`` or more
    the smallest id is the response and the others revisit it; smaller payloads are all responses. Rows
    with a null id are responses. Rows that repeat an id and a payload are written each, numbered: the
    first of them is what the id's only row would be, the others revisit it (or are responses if the
    payload is smaller). An id that repeats with other payloads is a capture for each. A record's id
    is made of page id, digest and number, so it is never given twice. An empty table writes nothing.
    """
    revisits = plan_revisits(pages, id_col, html_col, min_bytes)
    arrow_rows(pages.sparkSession, 512)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), payload_sha(html_col).alias("sha"))
    # rows without an id are dealt by their payload and meet nothing
    rows = rows.withColumn("_key", F.coalesce("page_id", F.xxhash64("sha"))).withColumn("_id", F.col("page_id").isNotNull())
    on = ["_key", "sha", "_id"]
    rows = rows.join(revisits.select(F.col("page_id").alias("_key"), "sha", F.lit(True).alias("_id"), "first_id").hint("merge"), on, "left")
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy(*on).orderBy("url"))).select("page_id", "url", "html", "sha", "first_id", "copy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get()
        part, k, held, size, n = f"{me.partitionId():05d}-{me.taskAttemptId()}", 0, [], 0, 0
        done: list[dict] = []

        def close() -> None:
            nonlocal k, held, size, n
            if held:
                path = f"{folder}/part-{part}-{k:04d}.warc.gz"
                write_whole(path, held)
                done.append({"path": path, "records": n})
                k, held, size, n = k + 1, [], 0, 0

        for b in batches:
            for page, url, html, sha, first, copy in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "first_id", "copy")), strict=True):
                payload, own = (html or "").encode(), base64.b32encode(bytes.fromhex(sha)).decode()
                me_, uri = f"{'' if page is None else page}:{own}:{copy}", url or "urn:unknown"
                name = f"<urn:page:{me_}>"
                if first is None and copy > 1 and page is not None and len(payload) >= min_bytes:
                    first = page
                more = {"WARC-Payload-Digest": f"sha1:{own}", "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
                if first is not None:
                    more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}:{own}:1>"}
                out = [
                    record("request", f"<urn:request:{me_}>", uri, b"GET / HTTP/1.1\r\n\r\n", {"WARC-Concurrent-To": name, "Content-Type": "application/http; msgtype=request"}),
                    record("response" if first is None else "revisit", name, uri, http_response(payload if first is None else None, len(payload)), more),
                    record("metadata", f"<urn:metadata:{me_}>", uri, f"payload-length: {len(payload)}\r\n".encode(), {"WARC-Concurrent-To": name, "Content-Type": "application/warc-fields"}),
                ]
                for r in out:
                    held.append(gzip.compress(r, 1, mtime=0))
                    size += len(r)
                    n += 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return park(rows.mapInArrow(write, "path string, records long"))


def read_warc(files: DataFrame, bodies: bool = True) -> DataFrame:
    """Records of the archives that ``files`` lists in ``path``; their bodies on demand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(n, pa.string()) for n in ("file", "record_id", "warc_type", "target_uri", "concurrent_to", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                for head, body in parse(read_range(path)):
                    kind = head.get("WARC-Type")
                    payload = payload_of(body) if kind == "response" else b""
                    digest = head.get("WARC-Payload-Digest", "").rpartition(":")[2] or None
                    length = len(payload) if kind == "response" else int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None
                    if kind == "response" and digest and sha1_base32(payload) != digest:
                        raise ValueError(f"{path}: the payload of {head.get('WARC-Record-ID')} does not match its digest")
                    rows.append({"file": path, "record_id": head.get("WARC-Record-ID"), "warc_type": kind, "target_uri": head.get("WARC-Target-URI"), "concurrent_to": head.get("WARC-Concurrent-To"), "refers_to": head.get("WARC-Refers-To"), "payload_digest": digest, "payload_bytes": length, "headers": list(head.items()), "body": body if bodies else None})
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    spread = files.select("path").repartition(partitions(files.sparkSession), "path")
    return spread.mapInArrow(read, _RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: the response or revisit with the requests and metadata that are concurrent to it.

    Records that name no capture that is there make no row. Captures without request or metadata have
    empty arrays. Both sides are hashed by the capture's id, which is unique but for repeated rows.
    """
    part = F.struct("record_id", "warc_type", "headers", "body")
    capture = records.where(F.col("warc_type").isin("response", "revisit"))
    other = records.where(F.col("warc_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    other = other.groupBy("concurrent_to").agg(F.collect_list(F.when(F.col("warc_type") == "request", part)).alias("requests"), F.collect_list(F.when(F.col("warc_type") == "metadata", part)).alias("metadata"))
    # the planner knows only the size of the list of files, so it would broadcast what they hold
    out = capture.join(other.withColumnRenamed("concurrent_to", "_to").hint("merge"), F.col("record_id") == F.col("_to"), "left").drop("_to", "concurrent_to")
    none = F.array().cast(other.schema["requests"].dataType)
    return out.withColumns({"requests": F.coalesce("requests", none), "metadata": F.coalesce("metadata", none)})


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full result over ``pages``: written as archives, read back and assembled."""
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark))
    t = transactions(read_warc(files, bodies=False))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return t.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), (F.size("requests") + F.size("metadata")).alias("n_concurrent"))
