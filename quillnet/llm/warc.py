"""WARC archives with an index that is written first, and coalesced byte-range reads.

Writing: every record is a gzip member of its own, so it can be read alone. Tasks append records to files in a
shared folder and give, for each record, the file, offset, length, URL and digest; these rows are the index, kept as
Parquet beside the files. Only files that the index names count: a task that is tried again writes a new file.

Reading: the index rows wanted are grouped by file and sorted by offset; ranges that nearly touch are joined into
one read, up to a size.

Of records with equal payloads the one with the largest page_id is the response and the others revisit it. Defined
results: null html is an empty payload; a null url gives a record without a target; records whose page_id is null
are never chosen over others; repeated rows with the chosen page_id are all responses; payloads below
``least_bytes`` are all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import cut, shared_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 32 << 20
#: Reads are joined over gaps up to GAP and up to RANGE bytes.
GAP, RANGE = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_base32(payload: Column) -> Column:
    """The upper-case base32 of the SHA-1: five hexadecimal digits make four letters."""
    digits = F.sha1(payload)
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, 15 - 5 * n).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for n in range(4)]
    return F.concat(*parts)


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, payload_bytes, record_type and refers_to for each distinct (page_id, payload)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    named = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), sha1_base32(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes")).distinct())
    chosen = named.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("chosen"))
    own = F.col("page_id").eqNullSafe(F.col("chosen")) | (F.col("payload_bytes") < least_bytes)
    return named.join(chosen, ["payload_digest", "payload_bytes"]).select(
        "page_id", "payload_digest", "payload_bytes", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("chosen")).alias("refers_to")
    )


def file_system(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", uri)
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(page: int | None, url: str | None, digest: str, size: int, kind: str, refers: int | None, payload: bytes) -> bytes:
    """One record as a gzip member."""
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def writer(folder: str, file_bytes: int):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string())])

    def run(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, digest, size, kind, refers in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    raw = record(page, url, digest, size, kind, refers, (html or "").encode())
                    out.write(raw)
                    rows.append((page, url, name, at, len(raw), digest, size, kind))
                    at += len(raw)
                # The rows leave the task only when it ends well, after the file is closed.
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` below ``folder`` and gives the index, kept in ``folder``/index."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("__page"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("__digest", sha1_base32(F.col("html").cast("binary")))
    verdict = decided(pages, least_bytes)
    on = F.col("__page").eqNullSafe(F.col("page_id")) & (F.col("__digest") == F.col("payload_digest"))
    told = rows.join(verdict, on).select("page_id", "url", F.when(F.col("record_type") == "response", F.col("html")).alias("html"), "payload_digest", "payload_bytes", "record_type", "refers_to")
    told.mapInArrow(writer(f"{folder}/files", file_bytes), INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def reader(folder: str, gap: int, most: int):
    def run(batches):
        system, base = file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        opened, name = None, None

        def fetched(todo):
            nonlocal opened, name
            if todo[0][0] != name:
                if opened is not None:
                    opened.close()
                name = todo[0][0]
                opened = system.open_input_file(f"{base}/{name}")
            begin, end = todo[0][1], todo[-1][1] + todo[-1][2]
            opened.seek(begin)
            data, rows = opened.read(end - begin), []
            for _, offset, length, page, url in todo:
                headers, body = parsed(data[offset - begin : offset - begin + length])
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size, refers = int(headers["X-Payload-Bytes"]), headers.get("X-Refers-To-Page-ID")
                if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                    raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                if headers.get("X-Page-ID") != (None if page is None else str(page)):
                    raise ValueError(f"{name} at {offset}: not the record of page {page}")
                rows.append((page, url, size, digest, kind, None if refers is None else int(refers), body if kind == "response" else None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        todo: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if todo and (row[0] != todo[0][0] or row[1] > todo[-1][1] + todo[-1][2] + gap or row[1] + row[2] - todo[0][1] > most):
                    yield fetched(todo)
                    todo = []
                todo.append(row)
        if todo:
            yield fetched(todo)
        if opened is not None:
            opened.close()

    return run


def read_records(index: DataFrame, folder: str, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records that rows of the index stand for: each file's ranges in order, near ones read as one."""
    wanted = index.select("file", "offset", "length", "page_id", "url").repartition("file").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(reader(f"{folder}/files", gap, most), RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages`` and reads every record back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, least_bytes), folder)
