"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member. The reader deals byte ranges of the archives to tasks; a task looks for the
gzip magic in its range, keeps those places where a WARC header decodes, and owns the records that start
there, reading past the end of its range for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import shared_dir, slices, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, and of one read.
RANGE_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Bytes after which a new archive is begun.
FILE_BYTES = 256 << 20
#: Bytes before a window's place that are let go together.
KEPT_BYTES = 4 << 20
RECORD = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, fault string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    return " ".join(value.split())


def record(record_id: str, uri: str | None, kind: str, refers_to: str | None, digest: str, payload: bytes) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{one_line(record_id)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {one_line(uri)}"] if uri is not None else []
    head += [f"WARC-Refers-To: <urn:page:{one_line(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write (record_id, uri, record_type, refers_to, payload) as archives below folder; path, records, bytes of each.

    folder is a URI that driver and executors share. Each attempt of a task writes files of its own, and
    only those that the returned table names count, so a lost executor's files do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, n, size = None, 0, 0
        for b in slices(batches, 64):
            for rid, uri, kind, ref, payload in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                member = record(rid or "", uri, kind, ref, base32_sha1(payload), payload)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    made.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True) if made else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    rows = records.select("record_id", "uri", "record_type", "refers_to", "payload")
    return written(rows.mapInArrow(run, "path string, records long, bytes long"))


class Window:
    """A file's bytes from lo on, read in steps as they are asked for, in one buffer that isn't copied for each record."""

    def __init__(self, file: pa.NativeFile, lo: int, size: int):
        self.file, self.lo, self.size, self.data = file, lo, size, bytearray()

    def upto(self, end: int) -> bytearray:
        """The bytes from lo to at least end, or to the file's end."""
        while self.lo + len(self.data) < min(end, self.size):
            self.file.seek(self.lo + len(self.data))
            self.data += self.file.read(min(READ_BYTES, self.size - self.lo - len(self.data)))
        return self.data

    def drop(self, before: int) -> None:
        """Bytes before a place aren't needed any more."""
        if before - self.lo >= KEPT_BYTES:
            del self.data[: before - self.lo]
            self.lo = before


def member(window: Window, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at ``at`` and where it ends, or None if no whole WARC record is there."""
    z, out, pos = zlib.decompressobj(31), [], at
    seen: bytearray | None = bytearray()
    try:
        while not z.eof:
            data = window.upto(pos + 65536)
            part = data[pos - window.lo : pos - window.lo + 65536]
            if not part:
                return None
            got = z.decompress(part)
            pos += len(part)
            out.append(got)
            if seen is not None:
                at_least = max(0, len(seen) - 3)  # the header's end may lie across two parts
                seen += got
                if not seen.startswith(b"WARC/1."[: len(seen)]):
                    return None
                seen = None if seen.find(b"\r\n\r\n", at_least) >= 0 else seen
    except zlib.error:
        return None
    return (b"".join(out), pos - len(z.unused_data)) if seen is None else None


def number(value: str | bytes | None) -> int | None:
    """A length as a header gives it; null where it is none."""
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


def parsed(data: bytes) -> tuple | None:
    """The columns of RECORD, or None for other kinds of record.

    What is wrong with a record is its fault, and then it has no payload: a Content-Length that is no number
    or that the block doesn't reach, or a payload that hasn't its digest.
    """
    head, _, block = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", errors="replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    size = number(fields.get("content-length"))
    fault = "length" if size is None or not 0 <= size <= len(block) else None
    http, _, payload = (block if fault else block[:size]).partition(b"\r\n\r\n")
    stated = [number(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    length = stated[0] if stated and stated[0] is not None else len(payload)
    bare = lambda k: v.removeprefix("<urn:page:").removesuffix(">") if (v := fields.get(k)) is not None else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not fault and kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        fault = "digest"
    return bare("warc-record-id"), kind, fields.get("warc-target-uri"), bare("warc-refers-to"), digest, length, payload if kind == "response" and not fault else None, fault


def owned(window: Window, lo: int, hi: int) -> Iterator[tuple[bytes, int]]:
    """Records that start in lo .. hi and their places."""
    at = lo
    while at < min(hi, window.size):
        data = window.upto(at + READ_BYTES)
        found = data.find(MAGIC, at - window.lo)
        if found < 0 or window.lo + found >= hi:
            if found >= 0 or window.lo + len(data) >= min(hi + 2, window.size):
                return
            at = window.lo + len(data) - len(MAGIC) + 1
            window.drop(at)
            continue
        start = window.lo + found
        window.drop(start)
        if (got := member(window, start)) is None:
            at = start + 1
        else:
            yield got[0], start
            at = got[1]


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records (RECORD) of the archives (path, bytes) of a table such as ``write`` gives; an empty table gives none.

    Records are found from any byte on: a range's first record needs no index. Responses are held against
    their payload digest, and a record that is wrong has a fault instead of a payload. Members that hold no
    WARC record are passed over.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / range_bytes)).cast("int")
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    ranges = ranges.select("path", "bytes", (F.col("i") * F.lit(range_bytes)).cast("long").alias("lo"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, lo in zip(*[c.to_pylist() for c in b.columns], strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as f:
                    for data, _ in owned(Window(f, lo, size), lo, min(size, lo + range_bytes)):
                        if (row := parsed(data)) is not None:
                            rows.append(row)
                            held += len(data)
                        if held >= READ_BYTES * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(tasks, "path", "lo").mapInArrow(run, RECORD)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """What ``write`` takes, from pages (page_id, url, html): one record per row.

    Null html counts as empty. Of rows with equal payloads of at least ``least`` bytes, those of the
    smallest page_id are responses (one, unless rows repeat that id and payload) and the others revisit it;
    smaller ones are all responses. Null ids come last: if all are null, all are responses. Other columns
    are left out.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    # Copies are counted before the shuffle, and only payloads that have any meet their rows again.
    copies = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(copies.select("sha", "first", F.lit(True).alias("many")), "sha", "left")
    again = F.col("many") & (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        F.col("page_id").cast("string").alias("record_id"),
        "uri",
        F.when(F.coalesce(again, F.lit(False)), "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
        "payload",
    )


def complete(back: DataFrame, made: DataFrame) -> DataFrame:
    """The records read, or an error if they aren't as many as ``write`` counted."""
    back = written(back)
    n, want = back.count(), made.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    if n != want:
        raise ValueError(f"{n} records were read of {want} that were written")
    return back


def round_trip(pages: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, written to archives and read back.

    Archives go to a new folder in the one that driver and executors share, unless one is named.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    made = write(records(pages), folder)
    back = read(made, range_bytes)
    ident = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    rows = back.where("fault IS NULL").select(ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))
    return complete(rows, made)
