"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

One gzip member holds one record. The reader inflates a file piece by piece with zlib, frames records by their
Content-Length and checks the digest of each block, so its memory is bounded by the largest record. Files are
opened by URI through Arrow's file systems, on the executors.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, width, written

LEAST_REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it; ``file:/x`` is taken for ``file:///x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":" in uri else "file://" + uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def frame(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member. Line breaks in a value become blanks."""
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, html: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit without it."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else html)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("WARC-Payload-Length", str(size)),
    ]
    if page_id is not None:
        headers.append(("WARC-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-Id", str(refers_to))]
    return frame(headers, block)


class BadRecord(ValueError):
    pass


def read_records(stream, size: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, gzipped by member or plain, read in order.

    A record with a wrong digest, bad framing or a cut end raises BadRecord.
    """
    source = _inflated(stream, size)
    held = bytearray()

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise BadRecord("cut off in a header")
                return
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        del held[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise BadRecord(f"no WARC version line: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("content-length", "").isdigit():
            raise BadRecord("no content length")
        need = int(headers["content-length"])
        while len(held) < need + 4:
            if not more():
                raise BadRecord("cut off in a block")
        block = bytes(held[:need])
        if held[need : need + 4] != b"\r\n\r\n":
            raise BadRecord("no end of record after the block")
        del held[: need + 4]
        told = headers.get("warc-block-digest", "")
        if told.startswith("sha1:") and told[5:] != hashlib.sha1(block).hexdigest():
            raise BadRecord("the block does not have its digest")
        yield headers, block


def _inflated(stream, size: int) -> Iterator[bytes]:
    raw = stream.read(max(2, size))
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(size)
        return
    unpack = zlib.decompressobj(31)
    while raw:
        out = unpack.decompress(raw, 4 * size)
        if out:
            yield out
        if unpack.eof:  # the next member
            raw = unpack.unused_data or stream.read(size)
            unpack = zlib.decompressobj(31)
        else:
            raw = unpack.unconsumed_tail or stream.read(size)
            if not raw:
                raise BadRecord("cut off in a gzip member")


def with_references(told: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, digest, size) with refers_to, and no html where that is set.

    Only rows that can be a revisit or have one (a page_id, LEAST_REVISIT_BYTES or more) are joined. The digests are
    joined on narrow rows: those of more than one page in 4096 are fewer than 4096 and broadcast, so no key of the
    shuffle is hotter than that. Then html meets its reference on (page_id, digest), which copies of a page don't
    share.
    """
    large = (F.col("size") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull()
    some = told.where(large)
    narrow = some.select("page_id", "digest")
    twice = written(narrow.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    hot = twice.where(F.col("n") > max(64, (twice.agg(F.sum("n")).first()[0] or 0) >> 12)).select("digest", "first")
    warm = twice.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("digest", "first")
    found = narrow.join(F.broadcast(hot), "digest").unionByName(narrow.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(warm.hint("merge"), "digest"))
    revisits = found.where("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    joined = some.join(revisits.hint("merge"), ["page_id", "digest"], "left")
    rows = joined.unionByName(told.where(~F.coalesce(large, F.lit(False))), allowMissingColumns=True)
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNotNull(), F.lit(b"")).otherwise(F.col("html")).alias("html"), "digest", "size", "refers_to")


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) to WARC files below ``folder``; returns the files.

    Rows with equal payloads of LEAST_REVISIT_BYTES or more: that with the largest page_id is the response (all
    rows of that id are), the others revisit it. A null html is empty, a null url an empty one. A row without a
    page_id is a response. Repeated rows are a record each, texts of any length are one record; other columns are
    ignored. The result, one row (uri, records) per file, is a written table: a file that a lost task left behind
    is in no row. An empty table gives no file.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1("html")).withColumn("size", F.length("html").cast("long"))
    rows = with_references(told)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = open_fs(folder)
        done: list[tuple[str, int]] = []
        out, count, size = None, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for row in batch.slice(a, 64).to_pylist():
                    if out is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                        fs.create_dir(root, recursive=True)
                        out, count, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    member = page_record(row["page_id"], row["url"], row["html"], row["digest"], row["size"], row["refers_to"])
                    out.write(member)
                    count, size = count + 1, size + len(member)
                    if size >= file_bytes:
                        out.close()
                        done.append((name, count))
                        out = None
        if out is not None:
            out.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["uri", "records"])

    return written(rows.mapInArrow(write, "uri string, records long"), "warc-files")


READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html binary"


def read_warc(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records (READ_SCHEMA) of the WARC files in the column ``uri``, each file read in order by one task.

    Responses' payloads are checked against their digests. ``html`` is null for revisits, and throughout where
    ``payload`` is false.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.binary())]
        number = lambda h, k: int(h[k]) if k in h else None
        held: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, block in read_records(stream):
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        response = h["warc-type"] == "response"
                        if response and hashlib.sha1(body).hexdigest() != digest:
                            raise BadRecord("the payload does not have its digest")
                        held.append((number(h, "warc-page-id"), h.get("warc-target-uri"), h["warc-type"], len(body) if response else number(h, "warc-payload-length"), digest, number(h, "warc-refers-to-page-id"), body if payload and response else None))
                        size += len(body) if payload else 0
                        if len(held) >= 5000 or size >= 8 << 20:
                            yield full()
                            held, size = [], 0
        if held:
            yield full()

    return files.select("uri").repartition(width(files.sparkSession), "uri").mapInArrow(read, READ_SCHEMA)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    from .common import table

    files = write_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN k.first > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.first > p.page_id THEN k.first END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
