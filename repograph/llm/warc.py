"""WARC archives: one gzip member per record, written and read sequentially.

Equal payloads of at least MIN_REVISIT bytes are stored once: the record with the
smallest page_id is the response, the others are revisit records that carry the
payload's digest and HTTP length and refer to it. Archives are rows of whole
members (ARCHIVE_BYTES or one record), written by Spark to the shared folder, so
any store that Spark writes to will do; `export` and `read_files` handle .warc.gz files.

The reader inflates member by member in small steps, frames a record's block by its
Content-Length, and checks each stored payload against its digest.

Defined cases: null html is an empty payload; a null url is an empty target; a null
page_id is never referred to while its group has another; rows that repeat the
smallest page_id of a group are all responses; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm.common import attach, bounded, slices, written

MIN_REVISIT = 100
ARCHIVE_BYTES = 4 << 20
STEP = 1 << 16
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6


class BadRecord(ValueError):
    """A record that isn't framed as its headers say, or whose payload hasn't its digest."""


def record(page_id, url: str, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else quote(c) for c in url.encode("utf-8", "replace").decode())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + c.flush()


def members(stream: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a byte stream, each inflated in steps."""
    d, out = zlib.decompressobj(31), []
    for data in stream:
        while data:
            out.append(d.decompress(data, STEP * 16))
            while d.unconsumed_tail and not d.eof:
                out.append(d.decompress(d.unconsumed_tail, STEP * 16))
            if not d.eof:
                break
            yield b"".join(out)
            data, d, out = d.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise BadRecord("the archive ends within a member")


def headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The lines name: value up to the empty line, and where what follows begins."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise BadRecord("headers don't end")
    lines = data[at:end].split(b"\r\n")[1:]
    pairs = (x.partition(b":") for x in lines)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}, end + 4


def records(stream: Iterable[bytes]) -> Iterator[tuple[dict, int, bytes | None]]:
    """(headers, payload length, payload or None for a revisit) of each record, verified."""
    import hashlib

    for data in members(stream):
        if not data.startswith(b"WARC/1."):
            raise BadRecord("not a WARC record")
        head, at = headers(data, 0)
        size = int(head["content-length"])
        if data[at + size :] != b"\r\n\r\n":
            raise BadRecord("Content-Length doesn't frame the record")
        http, body = headers(data, at)
        n = int(http["content-length"])
        if head["warc-type"] == "revisit":
            yield head, n, None
            continue
        payload = data[body : at + size]
        if len(payload) != n or "sha256:" + hashlib.sha256(payload).hexdigest() != head["warc-payload-digest"]:
            raise BadRecord(f"the payload of {head['warc-record-id']} isn't what its headers say")
        yield head, n, payload


def _write(batches):
    import hashlib

    import pyarrow as pa
    from pyspark import TaskContext

    part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([f"part-{part:06d}-{seq:06d}"]), pa.array([b"".join(out)], pa.binary())], names=["archive", "content"]
        )

    for b in slices(batches):
        for page_id, url, html, low, revisit in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            out.append(record(page_id, url or "", payload, hashlib.sha256(payload).hexdigest(), low, revisit))
            size += len(out[-1])
            if size >= ARCHIVE_BYTES:
                yield row()
                seq, out, size = seq + 1, [], 0
    if out:
        yield row()


def _number(urn: str | None):
    said = (urn or "").rpartition(":")[2].rstrip(">")
    return int(said) if said.lstrip("-").isdigit() else None


def _read(with_payload: bool):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for b in batches:
            for content in b.column(0):
                data = memoryview(content.as_buffer())
                rows, size = [], 0
                for head, n, payload in records(bytes(data[i : i + STEP]) for i in range(0, len(data), STEP)):
                    rows.append((_number(head["warc-record-id"]), n, head["warc-payload-digest"].partition(":")[2], head["warc-type"], _number(head.get("warc-refers-to")), payload))
                    size += len(payload or b"") if with_payload else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield _rows(rows, kinds, names, with_payload)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, kinds, names, with_payload)

    return run


def _rows(rows, kinds, names, with_payload):
    import pyarrow as pa

    n = len(names) - (not with_payload)
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=names[:n])


def archive(pages: DataFrame) -> DataFrame:
    """Writes a record per page; returns the table of archives (archive, content)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = bounded(pages).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    )
    able = keyed.where(F.octet_length("html") >= MIN_REVISIT)
    twice = written(
        able.groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1"), "payloads"
    )
    total = pages.count()
    met = attach(keyed, twice, "digest", "n", total, F.xxhash64("page_id", "url"))
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low"))
    rows = met.select("page_id", "url", "html", "low", revisit.alias("revisit"))
    return written(rows.mapInArrow(_write, "archive string, content binary"), "warc")


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of archives (content binary): page_id, payload_bytes, payload_digest,
    record_type, refers_to, and the payload (null for revisits) if wanted."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return bounded(archives).select("content").mapInArrow(_read(with_payload), schema)


def export(archives: DataFrame, folder: str) -> None:
    """Archives as .warc.gz files in a folder that all executors see."""

    def put(rows):
        for r in rows:
            with open(f"{folder}/{r.archive}.warc.gz", "wb") as f:
                f.write(r.content)

    archives.foreachPartition(put)


def read_files(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    return read(spark.read.format("binaryFile").load(path), with_payload)
