"""WARC archives of pages, and archives without repeated payloads: revisit resolution.

Every task writes files of its own, each record a gzip member of its own. A task that runs twice writes
other files; which ones count is what Spark commits in the manifest, a table of file names. Reading the
archives back gives a table of headers, without payloads. Only these are shuffled, by the digest of the
payload: each group of equal payloads has one original response, all others of the group revisit it, and
revisit records that were there before are joined to it too. The archives are then copied, file by file,
with the decisions of each file in the order of its records: every record gets fresh headers, and a
revisit has no payload, but refers to the record of its original.

Equal payloads have one SHA-1, which the format names records by, and one SHA-256 (texts with one SHA-1
can be made on purpose). Groups with a large share of all records are joined by broadcast, and there can
be at most 10 000 of those; so no task holds a large group.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rowmap

MANIFEST = "file string, records long, bytes long"
HEADERS = (
    "file string, offset long, length long, record_id string, record_type string, target_uri string, date string, page_id long, "
    "payload_bytes long, payload_digest string, strong_digest string, refers_to_id string, refers_to long"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # the OID name space of RFC 4122
_CHUNK = 1 << 16


@dataclass(frozen=True)
class WarcSpec:
    """least_bytes: smaller payloads are never revisited. file_bytes: a file with so many is closed. hot: a group with more records than this, and than a 10 000th of all, is large."""

    least_bytes: int = 0
    file_bytes: int = 256 << 20
    level: int = 1
    hot: int = 1000


def _identity(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(parts))}>"


def _uri(url: str) -> str:
    """White space and control characters would end a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def digests(payload: bytes) -> tuple[str, str]:
    """The upper-case base32 SHA-1 and the hexadecimal SHA-256."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode(), hashlib.sha256(payload).hexdigest()


def member(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """A record as a gzip member; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return zlib.compress(b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"]), level, 31)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file, read in small parts."""
    start = at = 0
    pending, inflate, parts = b"", None, []
    while pending := pending or stream.read(_CHUNK):
        inflate = inflate or zlib.decompressobj(31)
        parts.append(inflate.decompress(pending))
        rest = inflate.unused_data if inflate.eof else b""
        at += len(pending) - len(rest)
        pending = rest
        if inflate.eof:
            yield start, at - start, b"".join(parts)
            start, inflate, parts = at, None, []
    if inflate is not None:
        raise ValueError("an archive ends inside a record")


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields.get("content-length", -1))
    if not version.startswith("WARC/") or size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers, with the line that ends them, and payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


class _Files:
    """The files that a task writes; `done` has a row of the manifest for each."""

    def __init__(self, path: str, spec: WarcSpec, date: str):
        self.fs, self.folder = rowmap.folder(path)
        self.spec, self.date, self.done, self.sink = spec, date, [], None

    def _put(self, body: bytes) -> None:
        self.sink.write(body)
        self.size += len(body)

    def add(self, fields: list[tuple[str, object]], block: bytes) -> None:
        if self.sink is None:
            self.name, self.size, self.count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.sink = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _identity(self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(member(info, b"format: WARC file version 1.1\r\n", self.spec.level))
        if fields[1][0] != "WARC-Record-ID":
            fields = [fields[0], ("WARC-Record-ID", _identity(self.name, str(self.count))), *fields[1:]]
        self._put(member(fields, block, self.spec.level))
        self.count += 1
        if self.size >= self.spec.file_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.name, self.count, self.size))
            self.sink = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.done], t) for i, t in enumerate(kinds)], ["file", "records", "bytes"])


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, path: str, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Writes a response record for every row of pages into files in the folder `path`; (file, records, bytes) of the files that count.

    pages: page_id, url, html, and other columns, which are ignored. The payload is the html in UTF-8,
    empty for a null; a null url or page_id is left out of the headers; repeated rows are records each; a
    payload of any length is one record; an empty table writes no files.
    """
    date = _now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path, spec, date)
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = (html.as_py() or "").encode()
                sha1, sha256 = digests(payload)
                fields = [
                    ("WARC-Type", "response"), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _uri(url)), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-SHA256", sha256),
                    ("X-Payload-Length", len(payload)), ("X-Page-Id", page), ("Content-Type", "application/http; msgtype=response"),
                ]
                files.add(fields, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload)
        yield files.manifest()

    fs, folder = rowmap.folder(path)
    fs.create_dir(folder, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rowmap.written(rows.mapInArrow(run, MANIFEST), "manifest")


def _by_file(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows dealt out by file, as many partitions as there are files."""
    return rows.repartition(max(1, manifest.count()), "file")


def read_headers(manifest: DataFrame, path: str) -> DataFrame:
    """The headers of all response and revisit records of the files, with the place of each; no payload leaves a task.

    The digests are those of the payload as it was read; a record that says another one, and a file that
    is cut off, raise ValueError. A revisit has what its headers say. Fields that a record lacks are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = rowmap.folder(path)
        names = [x.split()[0] for x in HEADERS.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in HEADERS.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        number = lambda fields, name: int(fields[name]) if name in fields else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                made = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for offset, length, content in members(stream):
                        fields, block = parse(content)
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        strong, size = fields.get("x-payload-sha256"), number(fields, "x-payload-length")
                        if kind == "response":
                            payload = _split_http(block)[1]
                            size, (sha1, strong) = len(payload), digests(payload)
                            if said not in (None, sha1):
                                raise ValueError(f"{name}: the record at {offset} has another digest than it says")
                            said = sha1
                        made.append((name, offset, length, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), number(fields, "x-page-id"), size, said, strong, fields.get("warc-refers-to"), number(fields, "x-refers-to-page-id")))
                        if len(made) >= 10_000:
                            yield batch_of(made)
                            made = []
                yield batch_of(made)

    return _by_file(manifest.select("file"), manifest).mapInArrow(run, HEADERS)


_DECISION = "file string, offset long, refers_to_id string, refers_to long, refers_to_uri string, refers_to_date string, here boolean"


def resolve(headers: DataFrame, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """(file, offset, refers_to_id, refers_to, refers_to_uri, refers_to_date, here) of each record that is to be a revisit; here: of a record among these.

    headers: as of `read_headers`, stored, since it is read more than once. Of the responses with equal
    payloads of least_bytes or more the one of the largest page_id stays (a null counts as the smallest;
    ties by record_id). A revisit record without an original among them keeps what it refers to.
    """
    keys = ["payload_digest", "strong_digest"]
    known = headers.where(F.col("payload_digest").isNotNull() & F.col("strong_digest").isNotNull() & (F.coalesce("payload_bytes", F.lit(0)) >= spec.least_bytes))
    original = F.struct("page_id", "record_id", "file", "offset", "target_uri", "date")
    groups = known.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("record_type") == "response", original)).alias("original")).where("n > 1 and original is not null")
    groups = rowmap.written(groups, "groups")
    most = max(spec.hot, headers.count() // 10_000)
    large = F.col("n") > most
    hot = known.join(F.broadcast(groups.where(large)), keys)  # fewer than 10 000 groups can be so large
    rest = known.join(F.broadcast(groups.where(large).select(*keys)), keys, "left_anti").join(groups.where(~large), keys)
    found = hot.unionByName(rest).where("file <> original.file or offset <> original.offset")
    decided = found.select("file", "offset", F.col("original.record_id").alias("refers_to_id"), F.col("original.page_id").alias("refers_to"), F.col("original.target_uri").alias("refers_to_uri"), F.col("original.date").alias("refers_to_date"), F.lit(True).alias("here"))
    kept = headers.where("record_type = 'revisit'").join(decided.select("file", "offset"), ["file", "offset"], "left_anti")
    none = F.lit(None).cast("string")
    return decided.unionByName(kept.select("file", "offset", "refers_to_id", "refers_to", none.alias("refers_to_uri"), none.alias("refers_to_date"), F.lit(False).alias("here")))


def rewrite(manifest: DataFrame, decisions: DataFrame, source: str, target: str, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Copies the archives of `source` to the folder `target` with fresh headers, the decided records as revisits; the new manifest."""
    date = _now()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        fs, folder = rowmap.folder(source)
        files = _Files(target, spec, date)
        row = next(rows, None)
        while row is not None:  # the first row of a file is that of the manifest
            name = row[0]
            row = next(rows, None)
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for offset, _, content in members(stream):
                    fields, block = parse(content)
                    decided = row if row is not None and row[:2] == (name, offset) else None
                    if decided is not None:
                        row = next(rows, None)
                    if fields.get("warc-type") in ("response", "revisit"):
                        files.add(*_fresh(fields, block, decided))
            if row is not None and row[0] == name:
                raise ValueError(f"{name} has no record at {row[1]}")
        yield files.manifest()

    fs, folder = rowmap.folder(target)
    fs.create_dir(folder, recursive=True)
    fields = [x.split() for x in _DECISION.split(", ")]
    names = [n for n, _ in fields]
    whole = manifest.select("file", F.lit(-1).cast("long").alias("offset"), *[F.lit(None).cast(t).alias(n) for n, t in fields[2:]])
    rows = _by_file(whole.unionByName(decisions.select(*names)), manifest).sortWithinPartitions("file", "offset")
    return rowmap.written(rows.mapInArrow(run, MANIFEST), "manifest")


def _fresh(fields: dict[str, str], block: bytes, decided: tuple | None) -> tuple[list[tuple[str, object]], bytes]:
    """Headers and block of a record in the new archives. An identity there follows from that here, so that any task can refer to it."""
    of = fields.get
    again = decided is not None or of("warc-type") == "revisit"
    made: list[tuple[str, object]] = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _identity(of("warc-record-id", "")))]
    made += [("WARC-Date", of("warc-date")), ("WARC-Target-URI", of("warc-target-uri"))]
    if again and decided is not None:
        to, page, uri, when, here = decided[2:]
        made += [("WARC-Profile", of("warc-profile") or PROFILE), ("WARC-Refers-To", _identity(to) if here else to), ("WARC-Refers-To-Target-URI", uri or of("warc-refers-to-target-uri")), ("WARC-Refers-To-Date", when or of("warc-refers-to-date")), ("X-Refers-To-Page-Id", page)]
    head, payload = _split_http(block)
    sha1, sha256 = (of("warc-payload-digest", "").removeprefix("sha1:"), of("x-payload-sha256")) if of("warc-type") == "revisit" else digests(payload)
    length = of("x-payload-length") if of("warc-type") == "revisit" else len(payload)
    made += [("WARC-Payload-Digest", f"sha1:{sha1}" if sha1 else None), ("X-Payload-SHA256", sha256), ("X-Payload-Length", length), ("X-Page-Id", of("x-page-id")), ("Content-Type", of("content-type"))]
    return made, head if again else block


def deduplicate(manifest: DataFrame, source: str, target: str, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Archives in the folder `target` with the records of those in `source`, repeated payloads as revisits; the new manifest.

    See `resolve` for which record stays; archives without records give none.
    """
    headers = rowmap.written(read_headers(manifest, source), "headers")
    return rewrite(manifest, resolve(headers, spec), source, target, spec)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    rowmap.text_batches(spark)
    source, target = rowmap.scratch(spark, "warc"), rowmap.scratch(spark, "warc-deduplicated")
    first = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), source)
    found = read_headers(deduplicate(first, source, target), target)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
