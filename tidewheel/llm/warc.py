"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index.

``write_monolithic`` writes pages the way a simple crawler does: each file is one gzip
stream over all its records, so no record can be reached without inflating all before it.
``normalise`` inflates such a file once, front to back, and writes every record as a gzip
member of its own, with a sidecar index of offsets.  Records are copied in blocks, so a
task holds one block and one record's headers, however long the record is.  ``plan`` may
turn records into revisits of an equal payload; their block is then left out.
``read_index`` reads each record by its offset alone.

All files lie in the shared folder and get their final name only when complete; tables of
(path, ...) rows written by Spark say which files count, so lost or repeated tasks do no
harm.

Defined cases: a null html is an empty payload.  A null url is written as ``about:blank``;
control characters and spaces in urls are percent-encoded.  A null page_id is kept and, as
the origin of a group, comes after all others.  Rows with equal page_ids each get a record;
of equal rows one is the response.  An empty table gives no file and no row.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewheel.llm.files import Sink, open_input, read_bytes
from tidewheel.llm.tables import fresh_path, partitions, stored

BLOCK = 1 << 20
FILE_BYTES = 256 << 20
FILE_RECORDS = 50_000
STRETCH = 16 << 20
LEVEL = 3
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = "path string, ordinal long, page_id long, url string, payload_bytes long, payload_digest string, payload_sha256 binary"
INDEXED = "path string, offset long, length long, ordinal long"
READ = (
    "path string, offset long, length long, page_id long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload string"
)


# --- records -------------------------------------------------------------------------


def record_id(path: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{ordinal}')}>"


def header_bytes(fields: list[tuple[str, str]]) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n"


def parse_headers(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header fields in order; a line that starts with white space continues the one above."""
    fields: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            fields.append((name.strip(), value.strip()))
    return fields


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in fields if n.lower() == name.lower()), None)


def safe_url(url: str | None) -> str:
    if not url:
        return "about:blank"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def read_head(source) -> list[tuple[str, str]] | None:
    """The next record's headers; None at the end.  Blank lines between records are skipped."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    lines = []
    while (line := source.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the archive ends inside a record's headers")
        lines.append(line)
    return parse_headers(lines)


class Inflated(io.RawIOBase):
    """Inflates gzip data front to back: one stream over all records, or members in a row."""

    def __init__(self, source):
        self.source, self.inflater, self.left = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data = self.left or self.source.read(BLOCK)
            if not data:
                if not self.inflater.eof:
                    raise EOFError("the gzip stream is cut off")
                return 0
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            out = self.inflater.decompress(data, len(buffer))
            self.left = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)


# --- writing -------------------------------------------------------------------------


class _Monolith:
    """One gzip stream over many records."""

    def __init__(self, uri: str):
        self.uri, self.sink, self.records = uri, Sink(uri), 0
        self.deflater = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str) -> None:
        head = header_bytes(
            [
                ("WARC-Type", "response"),
                ("WARC-Record-ID", record_id(self.uri, self.records)),
                ("WARC-Date", DATE),
                ("WARC-Target-URI", safe_url(url)),
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("X-Page-Id", "" if page_id is None else str(page_id)),
                ("Content-Type", "application/http; msgtype=response"),
                ("Content-Length", str(len(HTTP_HEAD) + len(payload))),
            ]
        )
        for part in (head, HTTP_HEAD, payload, b"\r\n\r\n"):
            self.sink.write(self.deflater.compress(part))
        self.records += 1

    def close(self) -> None:
        self.sink.write(self.deflater.flush())
        self.sink.close()


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """One record per (page_id, url, html) row; returns where each lies, with its digests."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: _Monolith | None = None
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(c) for c in range(3))):
                page_id, url = page_id.as_py(), url.as_py()
                payload = (html.as_py() or "").encode()
                if archive and (archive.records >= FILE_RECORDS or archive.sink.size >= FILE_BYTES):
                    archive.close()
                    archive = None
                if archive is None:
                    archive = _Monolith(f"{folder}/crawl-{uuid.uuid4().hex}.warc.gz")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((archive.uri, archive.records, page_id, url, len(payload), digest, hashlib.sha256(payload).digest()))
                archive.add(page_id, url, payload, digest)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(WRITTEN))], _names(WRITTEN))
        if archive:
            archive.close()

    return stored(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
        .mapInArrow(write, WRITTEN),
        "written",
    )


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


# --- revisits ------------------------------------------------------------------------


def revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(path, ordinal, refers_to) of records whose payload equals that of the smallest page.

    Payloads under ``min_bytes`` stay responses.  Digest groups are reduced per task first;
    the join back meets stored tables, so that a group with very many copies is split.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "ordinal"))
    groups = stored(
        written.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_sha256", "payload_bytes")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_sha256", "payload_bytes", "first"),
        "payloads",
    )
    origin = (F.col("first.path") == F.col("path")) & (F.col("first.ordinal") == F.col("ordinal"))
    return stored(
        written.join(groups, ["payload_sha256", "payload_bytes"])
        .where(~origin)
        .select("path", "ordinal", F.col("first.page_id").alias("refers_to"),
                F.col("first.path").alias("origin_path"), F.col("first.ordinal").alias("origin_ordinal")),
        "revisits",
    )


# --- normalising ---------------------------------------------------------------------


def _copy(source, write, length: int) -> None:
    while length:
        block = source.read(min(BLOCK, length))
        if not block:
            raise EOFError("the archive ends inside a record")
        write(block)
        length -= len(block)


def rewrite(source_uri: str, target_uri: str, plan: dict[int, tuple]) -> list[tuple[int, int]]:
    """Inflate one archive once; each record becomes a member.  Returns (offset, length) each.

    ``plan`` maps a record's number to (refers_to, origin_path, origin_ordinal): it becomes a
    revisit without a block.  The sidecar ``.idx`` holds one JSON line per record.
    """
    sink, places, lines = Sink(target_uri), [], []
    with open_input(source_uri) as raw:
        source = io.BufferedReader(Inflated(raw), BLOCK)
        while (fields := read_head(source)) is not None:
            length = int(field(fields, "Content-Length") or 0)
            start, member = sink.size, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

            def write(data: bytes) -> None:
                sink.write(member.compress(data))

            turned = plan.get(len(places))
            if turned is None:
                write(header_bytes(fields))
                _copy(source, write, length)
            else:
                refers_to, path, ordinal = turned
                _copy(source, lambda block: None, length)
                kept = [f for f in fields if f[0].lower() not in ("warc-type", "content-length")]
                write(
                    header_bytes(
                        [
                            ("WARC-Type", "revisit"),
                            *kept,
                            ("WARC-Profile", REVISIT),
                            ("WARC-Refers-To", record_id(path, ordinal)),
                            ("X-Refers-To-Page", "" if refers_to is None else str(refers_to)),
                            ("X-Payload-Length", str(length - len(HTTP_HEAD))),
                            ("Content-Length", "0"),
                        ]
                    )
                )
            write(b"\r\n\r\n")
            sink.write(member.flush())
            places.append((start, sink.size - start))
            lines.append(
                json.dumps({"offset": start, "length": sink.size - start, "id": field(fields, "WARC-Record-ID"),
                            "type": "revisit" if turned else field(fields, "WARC-Type"),
                            "digest": field(fields, "WARC-Payload-Digest")})
            )
    sink.close()
    index = Sink(f"{target_uri}.idx")
    index.write("".join(f"{line}\n" for line in lines).encode())
    index.close()
    return places


def normalise(archives: DataFrame, folder: str, plan: DataFrame | None = None) -> DataFrame:
    """Rewrite the archives named in the column ``path``; one (path, offset, length, ordinal)
    row per record.  ``plan`` has rows as made by ``revisits``.

    Plan rows meet their archive in one group, which is bounded by the records of one file.
    """
    spark = archives.sparkSession
    if plan is None:
        plan = spark.createDataFrame([], "path string, ordinal long, refers_to long, origin_path string, origin_ordinal long")

    plan = plan.withColumn("refers_to", F.col("refers_to").cast("string"))  # a null would make it a float

    def work(key: tuple, named: pd.DataFrame, turned: pd.DataFrame) -> pd.DataFrame:
        if named.empty:
            return pd.DataFrame({"path": [], "offset": [], "length": [], "ordinal": []})
        target = f"{folder}/{key[0].rpartition('/')[2]}"
        turn = {
            int(o): (None if r is None else int(r), p, int(n))
            for o, r, p, n in zip(turned["ordinal"], turned["refers_to"], turned["origin_path"], turned["origin_ordinal"])
        }
        places = rewrite(key[0], target, turn)
        return pd.DataFrame(
            {"path": target, "offset": [p[0] for p in places], "length": [p[1] for p in places], "ordinal": range(len(places))}
        )

    # A path is a short row that stands for a large file, so the number of tasks is given.
    tasks = partitions(archives)
    named = archives.groupBy("path").agg(F.count(F.lit(1)).alias("records")).repartition(tasks, "path")
    return stored(
        named.groupBy("path").cogroup(plan.repartition(tasks, "path").groupBy("path")).applyInPandas(work, INDEXED),
        "index",
    )


# --- reading -------------------------------------------------------------------------


def _parse_member(data: bytes) -> tuple:
    source = io.BytesIO(zlib.decompress(data, 31))
    fields = read_head(source)
    body = source.read(int(field(fields, "Content-Length") or 0))
    kind = field(fields, "WARC-Type")
    digest = (field(fields, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    page = field(fields, "X-Page-Id")
    page = int(page) if page else None
    url = field(fields, "WARC-Target-URI")
    if kind == "revisit":
        target = field(fields, "X-Refers-To-Page")
        return page, url, kind, int(field(fields, "X-Payload-Length")), digest, int(target) if target else None, None
    payload = body.partition(b"\r\n\r\n")[2]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and found != digest:
        raise ValueError(f"payload digest {found} differs from the header's {digest}")
    return page, url, kind, len(payload), found, None, payload.decode("utf-8", "replace")


def read_index(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record named by (path, offset, length), each by a seek of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                out, name, source = [], None, None
                for path, offset, length in zip(*(rows.column(c).to_pylist() for c in range(3))):
                    if path != name:
                        if source is not None:
                            source.close()
                        name, source = path, open_input(path)
                    source.seek(offset)
                    record = _parse_member(source.read(length))
                    out.append((path, offset, length, *record[:-1], record[-1] if with_payload else None))
                if source is not None:
                    source.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _types(READ))], _names(READ))

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = index.select("path", "offset", "length").repartition(partitions(index), "path", stretch)
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(read, READ)


def sidecar(path: str) -> list[dict]:
    """The index beside one archive."""
    return [json.loads(line) for line in read_bytes(f"{path}.idx").splitlines()]


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, normalise them with revisits, and read them back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    written = write_monolithic(pages, f"{folder}/raw")
    index = normalise(written, f"{folder}/records", revisits(written, min_bytes))
    return read_index(index)
