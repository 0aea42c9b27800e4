"""Web pages to WARC archives and back, as a table of chunks.

Writing: every page becomes a ``response`` record, or a ``revisit`` of the page with the smallest id that has the same
payload. A payload above ``SEGMENT_BYTES`` is written as a first segment and ``continuation`` records. Every record is
a gzip member of its own. Each task writes files of its own to the shared folder; those that finished tasks report
(one manifest row per file) are the archive, so what a lost or repeated task leaves behind is never read.

Reading: files are streamed through a fixed buffer. A record becomes rows of (record_id, chunk_no) with at most
``CHUNK_BYTES`` of its payload and the SHA-256 of all payload up to and including the chunk, so no record is ever held
whole; the last chunk carries the payload's digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import map_batches, new_path, staged

REVISIT_BYTES = 100
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
FILE_BYTES = 32 << 20

_MANIFEST = "path string, n_records long"
_CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, chunk_no long, payload_bytes long, "
    "data binary, sha256_so_far string, last boolean"
)


def with_revisits(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): ``refers_to`` is null for pages that are written as responses.

    Only digests are grouped, by partial minima; payloads travel once, by page id, so equal payloads never meet.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = staged(rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest"), "payloads")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = (
        slim.join(first, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
        .select(F.coalesce("page_id", F.lit(0)).alias("k"), F.isnull("page_id").alias("k_null"), "digest", "refers_to")
        .distinct()
    )
    keyed = rows.withColumn("k", F.coalesce("page_id", F.lit(0))).withColumn("k_null", F.isnull("page_id"))
    return keyed.join(revisits, ["k", "k_null", "digest"], "left").select("page_id", "url", "payload", "refers_to")


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, name)}>"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def records_of(number: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str) -> Iterator[bytes]:
    """The gzip members of one page; ``name`` makes the record's id."""
    origin = _record_id(name)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").encode("ascii", "xmlcharrefreplace").decode()
    target = "".join(mark if " " < mark < "\x7f" else "%" + format(ord(mark), "02X") for mark in target)
    common = [
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target or "about:blank"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        *([("X-Page-Id", number)] if number is not None else []),
    ]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _member(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, ("WARC-Profile", profile), ("X-Refers-To-Page", refers_to)],
            http,
        )
        return
    several = len(payload) > SEGMENT_BYTES
    first = [("WARC-Segment-Number", 1)] if several else []
    yield _member(
        [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, *first], http + payload[:SEGMENT_BYTES]
    )
    for segment, start in enumerate(range(SEGMENT_BYTES, len(payload), SEGMENT_BYTES), 2):
        last = start + SEGMENT_BYTES >= len(payload)
        yield _member(
            [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", _record_id(f"{name}/{segment}")),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Segment-Origin-ID", origin),
                ("WARC-Segment-Number", segment),
                *([("WARC-Segment-Total-Length", len(http) + len(payload))] if last else []),
            ],
            payload[start : start + SEGMENT_BYTES],
        )


class _Writer:
    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pyarrow.fs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        name, out, size, count = "", None, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(column) for column in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name = f"{uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                number, url, payload, refers_to = (value.as_py() for value in row)
                for member in records_of(number, url, payload, refers_to, f"{name}/{count}"):
                    out.write(member)
                    size += len(member)
                count += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{self.folder}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{self.folder}/{name}", count))
        columns = [pa.array([path for path, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "n_records"])


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, refers_to) as WARC files under ``folder``; the manifest (path, n_records)."""
    return staged(map_batches(rows, _Writer(folder), _MANIFEST), "manifest")


class _Unpacked:
    """Bytes of a file of gzip members, unpacked piece by piece."""

    def __init__(self, raw, piece: int = 1 << 16):
        self.raw, self.piece = raw, piece
        self.packed, self.open, self.ended = b"", None, False
        self.ready = bytearray()

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.raw.read(self.piece)
            if not self.packed:
                if self.open is not None:
                    raise ValueError("an archive ends inside a record")
                return False
        if self.open is None:
            self.open = zlib.decompressobj(31)
        self.ready += self.open.decompress(self.packed, self.piece)
        if self.open.eof:
            self.packed, self.open = self.open.unused_data, None
        else:
            self.packed = self.open.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        """Up to and without the next CR LF; None at the end."""
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                if self.ready:
                    raise ValueError("an archive ends inside a line")
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return out

    def some(self, most: int) -> bytes:
        """At least one and at most ``most`` bytes."""
        while not self.ready:
            if not self._more():
                raise ValueError("an archive ends inside a block")
        out = bytes(self.ready[:most])
        del self.ready[: len(out)]
        return out


def _fields(lines: _Unpacked) -> dict[str, str]:
    fields = {}
    while line := lines.line():
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def chunks_of(raw) -> Iterator[tuple]:
    """Chunk rows of one archive, in order; see ``read_archives``."""
    lines = _Unpacked(raw)
    origin: tuple | None = None
    chunk_no, digest, total, open_bytes, expected = 0, hashlib.sha256(), 0, bytearray(), 0
    while (start := lines.line()) is not None:
        if start != b"WARC/1.1":
            raise ValueError(f"not a record: {start[:40]!r}")
        fields = _fields(lines)
        left, kind = int(fields["content-length"]), fields["warc-type"]
        if kind == "continuation":
            if origin is None or fields["warc-segment-origin-id"] != origin[0]:
                raise ValueError("a continuation does not follow its record")
        else:
            number, refers_to = fields.get("x-page-id"), fields.get("x-refers-to-page")
            origin = fields["warc-record-id"], number and int(number), kind, refers_to and int(refers_to)
            chunk_no, digest, total, open_bytes = 0, hashlib.sha256(), 0, bytearray()
            expected = None
            while line := lines.line():
                left -= len(line) + 2
                if line.lower().startswith(b"content-length:"):
                    expected = int(line[15:])
            left -= 2
            if kind == "revisit":
                yield *origin, 0, expected, None, fields["warc-payload-digest"].removeprefix("sha256:"), True
        while left:
            part = lines.some(min(left, CHUNK_BYTES - len(open_bytes)))
            left -= len(part)
            total += len(part)
            open_bytes += part
            if len(open_bytes) == CHUNK_BYTES and total < expected:
                digest.update(open_bytes)
                yield *origin, chunk_no, len(open_bytes), bytes(open_bytes), digest.hexdigest(), False
                chunk_no, open_bytes = chunk_no + 1, bytearray()
        if kind != "revisit" and total == expected:
            digest.update(open_bytes)
            yield *origin, chunk_no, len(open_bytes), bytes(open_bytes), digest.hexdigest(), True
        if lines.line() or lines.line():
            raise ValueError("a record does not end in two line ends")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in _CHUNKS.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            rows, size = [], 0
            with store.open_input_stream(path, compression=None) as raw:
                for row in chunks_of(raw):
                    rows.append(row)
                    size += 200 + len(row[6] or b"")
                    if size >= 4 * CHUNK_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
            if rows:
                yield pack(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunk table of the manifest's archives, a task per few files.

    Per chunk: record_id, page_id, record_type, refers_to (the page of a revisit's response), chunk_no from 0, the
    chunk's payload_bytes and data, sha256_so_far, and last. A revisit is one row without data whose payload_bytes and
    digest are those of the payload it stands for; an empty payload is one empty chunk.
    """
    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return map_batches(spread, _read, _CHUNKS)


def round_trip(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back as the chunk table.

    A null payload counts as empty. Pages with equal payloads of at least ``REVISIT_BYTES`` bytes refer to the smallest
    page id among them; rows that repeat that id are all responses. A null id never is the smallest, and where all ids
    are null all are responses. Other columns than ``url`` are not read; an empty table gives an empty result.
    """
    rows = with_revisits(pages, id_column, payload_column)
    return read_archives(write_archives(rows, new_path(pages.sparkSession, "archive")))


def record_summary(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return chunks.groupBy("record_id").agg(
        F.first("page_id").alias("page_id"),
        F.sum("payload_bytes").alias("payload_bytes"),
        F.max(F.when(F.col("last"), F.col("sha256_so_far"))).alias("payload_digest"),
        F.first("record_type").alias("record_type"),
        F.first("refers_to").alias("refers_to"),
    ).drop("record_id")
