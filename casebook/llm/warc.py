"""WARC archives: a writer and a splittable reader.

Writing: every record is one gzip member. The members are written by Spark's text
sink, so the archives get Spark's commit protocol on any file system. That sink
ends each row with a separator; the separator is chosen to be the zero byte that
ends a member of under 16 MiB anyway (a longer record is followed by an empty member).

Reading: each task gets byte ranges of the archives. It scans its range for the gzip
magic, validates each candidate by inflating the start and checking the record's
version line, and owns the records that start inside the range, whose last bytes may
lie beyond it. Candidates inside a member that was read are skipped; those in the
rest of a record of an earlier range do not inflate to a record.

Edge cases: a null url gives a record without target; a null payload is empty; a null
page id is kept as such; repeated ids give a record each; line breaks in a url are
percent-encoded in its header; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import cut

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
#: Bytes of an archive that a task scans at a time, and of a byte range.
BLOCK, RANGE = 1 << 20, 32 << 20
#: Payloads of several pages that are looked up by broadcast, some 10 MB.
BROADCAST_PAYLOADS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def identity(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record, its block an HTTP response; a revisit has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", identity(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", identity(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The record as gzip that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds payload (bytes), digest, `refers_to` and `revisit`: of rows with an equal
    payload of at least `least` bytes, the smallest page id is the response.

    The smallest ids are aggregated first, to one row for each payload of several pages.
    Up to BROADCAST_PAYLOADS of them go to the pages. Of more, those go that more than one
    in BROADCAST_PAYLOADS of their pages have, which are fewer than that; only pages
    without one of these are shuffled, so no frequent payload meets in a task.
    """
    rows = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    several = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    several = cut(several.where("n > 1"))
    n_payloads, n_pages = several.agg(F.count("*"), F.sum("n")).first()
    first = several.drop("n")
    if n_payloads <= BROADCAST_PAYLOADS:
        rows = rows.join(F.broadcast(first), "sha1", "left")
    else:
        frequent = F.broadcast(several.where(F.col("n") * BROADCAST_PAYLOADS > n_pages).drop("n"))
        rows = rows.join(frequent, "sha1").unionByName(rows.join(frequent, "sha1", "left_anti").join(first, "sha1", "left"))
    revisit = F.coalesce((F.col("page_id") > F.col("first_id")) & (F.octet_length("payload") >= least), F.lit(False))
    return rows.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("first_id")))


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes page_id, url and html as archives in a folder."""
    rows = decisions(pages.select("page_id", "url", "html"), least).select("page_id", "url", "payload", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload = r["payload"]
                out.append(member(record(r["page_id"], r["url"], payload, digest_of(payload), r["refers_to"], r["revisit"], date))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").mode("overwrite").text(folder)


def opened(path: str):
    """A file for random access, by any file system that pyarrow knows."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def inflated(read, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and where the member ends; None if there is none."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        data = read(at)
        if not data:
            return None
        try:
            out.append(unpack.decompress(data))
        except zlib.error:
            return None
        at += len(data) - len(unpack.unused_data)
        if len(out) == 1 and out[0] and not out[0].startswith(VERSION[: len(out[0])]):
            return None
    return b"".join(out), at


def owned(read, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end). read(at): bytes from there, none at the file's end."""
    at = start
    while at < end:
        data = read(at)
        if not data:
            return
        found = data.find(MAGIC)
        if found < 0:
            if len(data) < len(MAGIC):
                return
            at += len(data) - len(MAGIC) + 1
            continue
        if at + found >= end:
            return
        got = inflated(read, at + found)
        if got is None:
            at += found + 1
        else:
            if got[0]:
                yield got[0]
            at = got[1]


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def ranges(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """path, start and end of byte ranges of a folder's archives, spread over tasks."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # contents are not read
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    rows = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    rows = rows.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))
    return rows.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")


def read(spark: SparkSession, folder: str, id_type: str = "long", size: int = RANGE) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of
    every record. A response's length and digest are taken from its payload, and it is
    an error if the header's differ; a revisit's are those of its header."""

    def rows_of(path: str, start: int, end: int):
        with opened(path) as file:

            def at(place: int) -> bytes:
                file.seek(place)
                return file.read(BLOCK)

            for data in owned(at, start, end):
                fields, payload = parsed(data)
                page, other = (fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and told != digest_of(payload):
                    raise ValueError(f"{path}: the payload of {page} does not have its digest")
                yield page, fields.get("WARC-Target-URI"), payload, int(fields["Payload-Length"]), told, fields["WARC-Type"], other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for row in rows_of(r["path"], r["start"], r["end"]):
                    held.append(row)
                    size += len(row[2])
                    if size > 4 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    found = ranges(spark, folder, size).mapInArrow(run, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
