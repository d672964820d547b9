"""WARC archives: one gzip member per record, written and read record by record.

Tasks write their rows into archives below a shared folder and return what they wrote; only
the archives named in rows of finished tasks are read, so a repeated task leaves at most an
unused file. The reader is sequential: it inflates in small steps, frames records by their
content length and checks block and payload digests. It never holds more than one record.

Payloads that occur again are written once. Of the records with equal payloads of at least
``MIN_SHARED`` bytes the one with the largest id is the ``response``, the others are
``revisit`` records that name it.

Defined cases: a null payload is empty; a null id is written as ``null`` and read as null;
rows with equal id and payload are all ``response`` if that id is the largest; a target that is
a URI is written and read as it is, escapes included; any other (with white space, control or
non-ASCII characters) is percent-encoded with its percent signs, and a field of its own says so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialized, new_dir

MIN_SHARED = 1000
ARCHIVE_BYTES = 64 << 20
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
KEPT_IN_TARGET = "!#$&'()*+,/:;=?@[]~"
READ_SCHEMA = (
    "record_type string, page_id long, target string, payload_bytes long, payload_digest string, refers_to long, "
    "verified boolean, payload binary"
)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would use for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


# --- writing ---


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(kind: str, page_id: int | None, target: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record: a ``response`` with its payload, or a ``revisit`` with the response's headers only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if target is not None:
        as_is = quote(target, safe=KEPT_IN_TARGET + "%") == target
        fields.insert(3, ("WARC-Target-URI", target if as_is else quote(target, safe=KEPT_IN_TARGET)))
        if not as_is:
            fields.insert(4, ("Target-Encoding", "percent"))
    if kind == "revisit":
        fields.insert(3, ("WARC-Refers-To", _name(refers_to)))
        fields.insert(3, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    header = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + header + b"\r\n" + block + b"\r\n\r\n"


def _opening(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    header = (
        f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n"
        f"WARC-Block-Digest: {_digest(block)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n"
    ).encode()
    return VERSION + b"\r\n" + header + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``_id, _target, _payload, _response``: the id of the response, where it is another record.

    Ids per payload are aggregated before they are joined back; only payloads that occur more
    than once meet their rows, so a payload of a third of all rows is one row on that side.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("_id"),
        F.col(f"`{url}`").cast("string").alias("_target"),
        F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("_payload"),
    ).withColumn("_key", F.sha2("_payload", 256))
    shared = rows.where(F.octet_length("_payload") >= MIN_SHARED).groupBy("_key")
    shared = shared.agg(F.max("_id").alias("_response"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    out = rows.join(shared, "_key", "left").drop("_key")
    other = F.col("_response").isNotNull() & ~F.col("_response").eqNullSafe(F.col("_id"))
    return out.withColumn("_response", F.when(other, F.col("_response")))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives below ``folder``; returns the stored list of archives ``(path, records)``."""
    root = qualified(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        out, path, records, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for i, target, payload, response in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    path, records, size = f"{root.rstrip('/')}/{name}", 0, 0
                    out = fs.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
                    out.write(_member(_opening(name)))
                refers_to = response.as_py()
                kind = "response" if refers_to is None else "revisit"
                data = _member(record(kind, i.as_py(), target.as_py(), payload.as_py(), refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"]
        )

    plan = planned(pages, page_id, url, html).select("_id", "_target", "_payload", "_response")
    return materialized(plan.mapInArrow(run, "path string, records long"), "archives")


# --- reading ---


class Members:
    """Bytes of a file of gzip members, inflated in small steps."""

    def __init__(self, stream):
        self.stream, self.unzip, self.ready, self.ended = stream, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        """Inflate the next step; false at the end of the file."""
        if self.ended:
            return False
        if self.unzip.eof:
            rest = self.unzip.unused_data or self.stream.read(STEP)
            self.unzip = zlib.decompressobj(31)
        else:
            rest = self.unzip.unconsumed_tail or self.stream.read(STEP)
        if not rest:
            self.ended = True
            return False
        self.ready += self.unzip.decompress(rest, STEP * 4)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is taken too; None at the end."""
        seen = 0
        while True:
            at = self.ready.find(mark, max(0, seen - len(mark)))
            if at >= 0:
                out = bytes(self.ready[:at])
                del self.ready[: at + len(mark)]
                return out
            seen = len(self.ready)
            if not self._more():
                return None

    def chunks(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.ready[:n])
            del self.ready[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n"))
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _base32(digest: str | None) -> bytes | None:
    return base64.b32decode(digest.partition(":")[2]) if digest else None


def records(stream, payloads: bool = True) -> Iterator[tuple]:
    """Rows of ``READ_SCHEMA`` for the response and revisit records of an open archive."""
    source = Members(stream)
    while (top := source.until(b"\r\n\r\n")) is not None:
        version, _, lines = top.lstrip(b"\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(lines)
        kind, head, body, start = fields["warc-type"], None, [], bytearray()
        block, payload, size = hashlib.sha1(), hashlib.sha1(), 0
        for piece in source.chunks(int(fields["content-length"])):
            block.update(piece)
            if head is None:
                start += piece
                cut = start.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                head, piece = bytes(start[:cut]), bytes(start[cut + 4 :])
            payload.update(piece)
            size += len(piece)
            if payloads:
                body.append(piece)
        for _ in source.chunks(4):
            pass
        if kind not in ("response", "revisit"):
            continue
        http = _fields((head or b"").partition(b"\r\n")[2])
        own = _base32(fields.get("warc-payload-digest"))
        good = _base32(fields.get("warc-block-digest")) == block.digest()
        if kind == "response":
            good = good and own == payload.digest() and int(http.get("content-length", size)) == size
        target = fields.get("warc-target-uri")
        if target is not None and fields.get("target-encoding") == "percent":
            target = unquote(target)
        yield (
            kind,
            _page(fields.get("warc-record-id")),
            target,
            size if kind == "response" else int(http["content-length"]),
            own.hex() if own else None,
            _page(fields.get("warc-refers-to")) if kind == "revisit" else None,
            good,
            b"".join(body) if payloads and kind == "response" else None,
        )


def read(archives: DataFrame, payloads: bool = True, rows: int = 512) -> DataFrame:
    """Records of the archives in a list with a ``path`` column; one task per archive at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_type", pa.string()), ("page_id", pa.int64()), ("target", pa.string()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary()),
            ]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = _open(path)
                with fs.open_input_stream(place, compression=None) as stream:
                    held: list[tuple] = []
                    for row in records(stream, payloads):
                        held.append(row)
                        if len(held) >= rows:
                            yield _batch(held, schema)
                            held = []
                    if held:
                        yield _batch(held, schema)

    paths = archives.select("path")
    spread = paths.repartition(max(1, paths.count()), "path")
    return spread.mapInArrow(run, READ_SCHEMA)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives, read the archives back, without payloads in the rows."""
    archives = write(pages, folder or new_dir(pages.sparkSession, "warc"))
    return read(archives, payloads=False).drop("payload")
