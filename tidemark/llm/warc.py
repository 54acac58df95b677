"""WARC archives of individually compressed records with a shared Zstandard dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's own first
records; every record then is a Zstandard frame of its own.  A page whose payload equals that of a page with a larger id
is a revisit: it has headers only, and names the response it repeats.

Archives lie in a folder that driver and executors share.  A task writes to names of its own attempt, and only names in
the manifest that a finished job wrote count, so a task that is run again leaves nothing behind that would be read.
A task holds one archive's training records (``SAMPLE_BYTES``) and one record at a time.  Which pages repeat others is found by
digest, size and id alone.  An archive with less than 64 records or eight dictionaries of text to train on has the text itself as dictionary.

Defined cases: null html is an empty payload; null url has no target header; control characters in urls are percent
encoded; rows that repeat the largest id of their payload are all responses; null ids repeat whatever non-null id has
their payload, and are responses among themselves; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import scratch, stored

#: What a dictionary is built from, and its size, in bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 2_000_000, 65_536
ARCHIVE_BYTES = 64_000_000
#: Repeated payloads (about 100 bytes each) that may be broadcast, and to how many places the pages of one go if there are more.
BROADCAST_REPEATS, SALTS = 200_000, 64
SKIPPABLE_MAGIC = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "path string, records long, bytes long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, size: int, original: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode())
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(original)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained, or the samples' own text where there is too little to train on."""
    total = sum(map(len, samples))
    if len(samples) >= 64 and total >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """One file: records wait until the dictionary is made."""

    def __init__(self, files: pa.fs.FileSystem, path: str) -> None:
        self._files, self.path = files, path
        self._waiting: list[bytes] = []
        self._held = self.bytes = self.records = 0
        self._out = self._compress = None

    def _open(self) -> None:
        made = dictionary(self._waiting)
        data = made.as_bytes()
        self._compress = zstandard.ZstdCompressor(level=3, dict_data=made).compress
        self._out = self._files.open_output_stream(self.path, compression=None)  # the name would have the file compressed again
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
        self._write(SKIPPABLE_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        for x in (first, *self._waiting):
            self._write(self._compress(x))
        self._waiting = []

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self.records += 1
        if self._out:
            self._write(self._compress(data))
            return
        self._waiting.append(data)
        self._held += len(data)
        if self._held >= SAMPLE_BYTES:
            self._open()

    def close(self) -> tuple[str, int, int]:
        if not self._out:
            self._open()
        self._out.close()
        return self.path, self.records, self.bytes


def _files(folder: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _with_originals(rows: DataFrame, same: DataFrame) -> DataFrame:
    """rows with original. Payloads stay where they are read; only with too many repeated ones to broadcast are they dealt, each payload to SALTS places."""
    if same.count() <= BROADCAST_REPEATS:
        return rows.join(F.broadcast(same), ["sha1", "size"], "left")
    salted = same.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, ["sha1", "size", "_salt"], "left")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """The manifest of the archives written to folder: path, records, bytes. Payloads of fewer bytes are never revisits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    same = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    same = stored(same.filter("n > 1").drop("n"), "repeats")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    dealt = _with_originals(rows, same).select("page_id", "url", "payload", "sha1", "size", "original", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        files.create_dir(base)
        made, archive, attempt = [], None, uuid.uuid4().hex
        for batch in batches:
            for row in zip(*batch.columns, strict=True):  # one record at a time
                if archive is None:
                    archive = _Archive(files, f"{base}/{attempt}-{len(made):05d}.warc.zst")
                archive.add(record(*(x.as_py() for x in row)))
                if archive.bytes >= ARCHIVE_BYTES:
                    made.append(archive.close())
                    archive = None
        if archive is not None:
            made.append(archive.close())
        if made:
            yield pa.record_batch([pa.array(c) for c in zip(*made, strict=True)], names=["path", "records", "bytes"])

    return stored(dealt.mapInArrow(write, _MANIFEST), "manifest")


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, size = (int.from_bytes(stream.read(4), "little") for _ in range(2))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    data = zstandard.ZstdCompressionDict(stream.read(size))
    with zstandard.ZstdDecompressor(dict_data=data).stream_reader(stream, read_across_frames=True, read_size=1 << 20) as plain:
        lines = io.BufferedReader(plain, 1 << 20)
        while version := lines.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {version[:40]!r}")
            headers = {}
            while (line := lines.readline()) != b"\r\n":
                name, _, value = line.decode().partition(":")
                headers[name] = value.strip()
            block = lines.read(int(headers["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record ends early")
            yield headers, block


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; checks payloads against digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out = []
                with files.open_input_stream(path, compression=None) as stream:
                    for headers, block in _records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{headers['WARC-Record-ID']}: payload and digest differ")
                        out.append((_page(headers["WARC-Record-ID"]), size, digest, kind, _page(headers["WARC-Refers-To"]) if kind == "revisit" else None))
                if len(out) != count:
                    raise ValueError(f"{path} has {len(out)} of {count} records")
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return manifest.mapInArrow(read, _READ)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder)
