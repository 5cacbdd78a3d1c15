"""WARC archives: written with revisit records, read back by a salvaging reader.

Writing: payload digests are found first; of equal payloads only the one with
the smallest id is stored, the others become revisit records.  A response's
compressed member is made before the pages meet these decisions, so only
compressed bytes are shuffled.  Every task writes files of its own name and
returns their names: files that no finished task has named are never read.

Reading: a record must pass all checks (member check sum, version line,
header, length, closing line ends, block digest).  After a failed one the
reader searches for the next valid member or version line, goes on from
there and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.common import release, store
from pairlab.operators.features import hot_keys, salted_join
from pairlab.session import run_folder

LEAST_PAYLOAD = 100  # shorter payloads are always stored
ROLL = 64 << 20  # a file is closed once it holds so many bytes
STEP = 1 << 16
HEADER_ROOM = 1 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
# not only at line starts: the line end before may be what is damaged
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


# -- records ----------------------------------------------------------------------


def _uri(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:x-page:{_uri(page)}:{digest}>" if page is not None else f"<urn:x-nameless:{digest}>"


def page_of(record: str | None) -> str | None:
    """The page id in a record id that ``record_id`` made."""
    found = re.fullmatch(r"<urn:x-page:(.*):[0-9a-f]{64}>", record or "")
    if not found:
        return None
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), found[1].encode()).decode()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A whole record; absent fields are left out."""
    fields = {**fields, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + END


def response(page: str | None, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = {
        "WARC-Type": "response", "WARC-Record-ID": record_id(page, digest), "WARC-Date": date,
        "WARC-Target-URI": _uri(url) if url is not None else None, "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    return record(fields, http.encode() + payload)


def revisit(page: str | None, url: str | None, digest: str, size: int, refers_to: str, date: str = DATE) -> bytes:
    """A record without payload; the extension field ``Payload-Length`` keeps the payload's size."""
    fields = {
        "WARC-Type": "revisit", "WARC-Record-ID": record_id(page, digest), "WARC-Date": date,
        "WARC-Target-URI": _uri(url) if url is not None else None, "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": record_id(refers_to, digest), "Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
    }
    return record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def member(data: bytes) -> bytes:
    """Bytes as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# -- salvage ----------------------------------------------------------------------


class Found(NamedTuple):
    """A record (``fault`` None) or a quarantined gap; bytes start to end of the file."""

    start: int
    end: int
    fault: str | None
    fields: dict[str, str] | None
    block: bytes | None


class Faulty(Exception):
    """A check that failed."""


class Source:
    """Random access to a file, a piece at a time."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(length, self.size - start)))


def _digest_fits(claim: str, data: bytes) -> bool:
    """Whether a labelled digest fits; digests of other kinds are not checked."""
    kind, _, value = claim.partition(":")
    if kind.lower() == "sha256":
        return value.lower() == hashlib.sha256(data).hexdigest()
    if kind.lower() == "sha1":
        own = hashlib.sha1(data)
        return value.lower() == own.hexdigest() or value.upper() == base64.b32encode(own.digest()).decode()
    return True


def _fields(head: bytes) -> dict[str, str]:
    fields, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Faulty("header line without a colon")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def _plain(source: Source, start: int) -> Found:
    """The uncompressed record at ``start``."""
    room = 4_096
    while True:
        head = source.read(start, room)
        if not _VERSION_LINE.match(head):
            raise Faulty("no version line")
        cut = head.find(END)
        if cut >= 0:
            break
        if room >= HEADER_ROOM or start + len(head) >= source.size:
            raise Faulty("header without end")
        room *= 4
    fields = _fields(head[head.find(b"\r\n") + 2 : cut])
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Faulty("no length")
    body, size = start + cut + len(END), int(length)
    if body + size + len(END) > source.size:
        raise Faulty("truncated")
    block = source.read(body, size + len(END))
    if not block.endswith(END):
        raise Faulty("no line ends after the block")
    block = block[:-len(END)]
    if not _digest_fits(fields.get("warc-block-digest", ""), block):
        raise Faulty("block digest")
    return Found(start, body + size + len(END), None, fields, block)


class _Bytes:
    """A member's content in the form of a file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, length: int) -> bytes:
        return self.data[self.at : self.at + length]


def _member(source: Source, start: int) -> list[Found]:
    """The records of the gzip member at ``start``; one faulty record makes the member faulty."""
    unpack, parts, at = zlib.decompressobj(31), [], start
    while not unpack.eof:
        piece = source.read(at, STEP)
        if not piece:
            raise Faulty("truncated member")
        at += len(piece)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as e:
            raise Faulty("member: " + str(e).rsplit(": ", 1)[-1]) from None
        if len(parts) == 1 and not _VERSION_LINE.match(parts[0]) and len(parts[0]) >= len(VERSION):
            raise Faulty("member without a version line")
    end = at - len(unpack.unused_data)
    data = b"".join(parts)
    inside, place, found = Source(_Bytes(data), len(data)), 0, []
    while place < len(data):
        one = _plain(inside, place)
        place = one.end
        found.append(one._replace(start=start, end=end))
    return found


def _at(source: Source, start: int) -> list[Found]:
    lead = source.read(start, len(MAGIC))
    if lead == MAGIC:
        return _member(source, start)
    return [_plain(source, start)]


def _candidates(source: Source, start: int) -> Iterator[int]:
    """Places from ``start`` on that look like the beginning of a member or record."""
    overlap = len(VERSION)
    while start < source.size:
        for hit in _CANDIDATE.finditer(source.read(start, STEP + overlap)):
            if hit.start() < STEP:
                yield start + hit.start()
        start += STEP


def salvage(source: Source) -> Iterator[Found]:
    """Every valid record of a file in order, and every gap between them."""
    at = 0
    while at < source.size:
        try:
            found = _at(source, at)
        except Faulty as fault:
            found, reason = None, str(fault)
            for place in _candidates(source, at + 1):
                try:
                    found = _at(source, place)
                except Faulty:
                    continue
                break
            yield Found(at, place if found else source.size, reason, None, None)
            if not found:
                return
        yield from found
        at = found[-1].end


# -- tables -----------------------------------------------------------------------


def _opened(path: str):
    """(file system, path) of a place; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = LEAST_PAYLOAD, roll: int = ROLL, gzip: bool = True, date: str = DATE,
) -> DataFrame:
    """Write a record per page below ``folder``; returns the stored list of files (path, records, bytes).

    Of equal payloads of at least ``least`` bytes the rows with the smallest
    id are responses and the others revisit it; null ids are never the
    smallest, and where all are null all are responses.  Null payloads are
    empty, a null URL is left out.  An empty table gives no file.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    prints = store(named.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size")), "payload-digests")
    long = prints.where(F.col("size") >= least)
    copied = long.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    hot = hot_keys(long.select("digest"), "digest")
    again = salted_join(long, copied.drop("n"), "digest", "inner", hot).where(~F.col("id").eqNullSafe(F.col("first")))
    again = again.select("id", "digest", F.col("first").cast("string").alias("first")).distinct()

    def pack(data: bytes) -> bytes:
        return member(data) if gzip else data

    def members(batches):
        for batch in batches:
            ids, urls, payloads = (batch.column(i) for i in range(3))
            rows = zip(ids.to_pylist(), urls.to_pylist(), payloads, strict=True)
            made = [(pack(response(i, u, p.as_py(), date)), hashlib.sha256(p.as_buffer()).hexdigest(), len(p.as_buffer())) for i, u, p in rows]
            columns = [pa.array([m[k] for m in made], t) for k, t in ((0, pa.binary()), (1, pa.string()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, urls, *columns], ["key", "url", "member", "digest", "size"])

    text = named.select(F.col("id").cast("string").alias("key"), "url", "payload")
    made = text.mapInArrow(members, "key string, url string, member binary, digest string, size long")
    again = again.select(F.col("id").cast("string").alias("_key"), F.col("digest").alias("_digest"), "first")
    decided = made.join(again, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")

    def write(batches):
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"
        out, done, count, size = None, [], 0, 0

        def close():
            out.close()
            done.append((f"{folder}/{name}-{len(done):05d}.warc{'.gz' if gzip else ''}", count, size))

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}-{len(done):05d}.warc{'.gz' if gzip else ''}", compression=None)
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    lead = pack(record(info, b"format: WARC File Format 1.1\r\n"))
                    out.write(lead)
                    count, size = 1, len(lead)
                data = r["member"] if r["first"] is None else pack(revisit(r["key"], r["url"], r["digest"], r["size"], r["first"], date))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["path", "records", "bytes"],
        )

    rows = decided.select("key", "url", "digest", "size", "first", "member")
    files = store(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")
    release(prints)
    return files


RECORD = (
    "path string, start long, end long, fault string, record_type string, record_id string, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to string, page string, refers_to_page string"
)


def _row(path: str, one: Found, payloads: bool) -> tuple:
    if one.fault is not None:
        return (path, one.start, one.end, one.fault, *[None] * (9 if payloads else 8))
    f = one.fields
    kind = f.get("warc-type")
    payload = None
    if kind == "revisit":
        digest = f.get("warc-payload-digest", "").rpartition(":")[2]
        size = f.get("payload-length")
        size = int(size) if size and size.isascii() and size.isdigit() else None
    else:
        payload = one.block
        if f.get("content-type", "").startswith("application/http"):
            payload = payload.partition(END)[2]
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    name, refers = f.get("warc-record-id"), f.get("warc-refers-to")
    row = (path, one.start, one.end, None, kind, name, f.get("warc-target-uri"), digest, size, refers, page_of(name), page_of(refers))
    return (*row, payload) if payloads else row


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of the files named in column ``path``; see ``RECORD``.

    A gap is a row whose ``fault`` says which check failed at ``start``; the
    bytes up to ``end`` are quarantined.  Members and plain records may be
    mixed.  One task reads a file, a record at a time; an empty list of files
    gives no row.  ``payloads`` adds the stored payload.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _opened(path)
                with system.open_input_file(place) as file:
                    rows, held = [], 0
                    for one in salvage(Source(file, file.size())):
                        rows.append(_row(path, one, payloads))
                        held += len(one.block or b"") if payloads else 100
                        if held > 1 << 22:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    listed = files.select("path")
    return listed.repartition(max(1, listed.count())).mapInArrow(read, schema)


def unresolved(records: DataFrame) -> DataFrame:
    """(refers_to): records that revisits name and no response of these records is."""
    named = records.where("record_type = 'revisit'").select("refers_to").distinct()
    there = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"))
    return named.join(there, "refers_to", "left_anti")


def archive_folder(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive.

    See ``write_archives`` for the rules.
    """
    files = write_archives(pages, folder or archive_folder(pages.sparkSession), **options)
    records = read_archives(files).where("record_type in ('response', 'revisit')")
    kind = pages.schema[options.get("id_col", "page_id")].dataType
    return records.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_page").cast(kind).alias("refers_to"),
    )
