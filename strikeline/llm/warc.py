"""WARC archives: written by tasks, read back in byte ranges.

Every record is a gzip member of its own, so an archive can be entered anywhere. A reading
task gets a byte range, looks for the gzip magic, and takes a place for a member only if what
inflates from there is a WARC header. It owns the records whose members start in its range and
reads on past the end to finish the last; so each record is read once, by whatever ranges the
files are cut into. A member is held in memory while it is read.

Writing tasks give each file a name of its own. Only files named in the manifest, which holds
the rows of tasks that ended well, are archives; files of lost attempts are never read.

Rules for odd input: null html is an empty payload; null ids and urls leave their header out
and come back as null; of pages that repeat id and payload all are responses if theirs is the
largest id; an empty table gives no file and an empty result. Only id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import sliced
from strikeline.llm.common import filled, join_groups, ship
from strikeline.session import cut_lineage

MAGIC = b"\x1f\x8b\x08"
REVISIT_FROM = 1000
SPLIT_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
_READ = 1 << 20
_PROBE = 1 << 16
_START = b"WARC/1."
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload of at least ``least`` bytes is
    that of a page with a larger id: the largest such."""
    slim = cut_lineage(
        pages.where(F.octet_length("payload") >= least).select("page_id", "digest")
    )
    groups = cut_lineage(
        slim.groupBy("digest").agg(
            F.max("page_id").alias("refers_to"), F.count("*").alias("copies")
        ).where("copies > 1")
    )
    return (
        join_groups(slim, groups, "digest", "copies", slim.count())
        .where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    )


def record(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One WARC record, not yet compressed; a revisit if ``refers_to`` is given."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
    ]
    if url is not None:
        # white space and control characters cannot stand in a header
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write(
    pages: DataFrame, root: str, least: int = REVISIT_FROM,
    id_column: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Write the pages to archives below ``root``; the manifest: path, bytes, records.

    Pages are joined to the few that are revisits by id, so pages with a common payload are
    spread like all others.
    """
    ship(pages.sparkSession)
    payload = filled(html)
    pages = pages.select(
        F.col(id_column).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.unhex(F.sha1(payload)).alias("digest"),
    )
    rows = pages.join(revisits(pages, least), ["page_id", "digest"], "left").select(
        "page_id", "url", "payload", "refers_to"
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(root)
        fs.create_dir(folder, recursive=True)
        out, name, size, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [f"{root}/{name}"], "bytes": [size], "records": [count]}, _MANIFEST
            )

        for part in sliced(batches):
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                page_id, address, text, refers_to = row
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    # records are compressed here, one by one
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                raw = record(page_id, address, text.encode(), refers_to)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(raw) + deflate.flush()
                out.write(member)
                size += len(member)
                count += 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return cut_lineage(rows.mapInArrow(save, "path string, bytes long, records long"))


class _Reader:
    """A file from some place on, read in pieces as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def fill(self, to: int) -> bool:
        """Hold the file up to position ``to``, if it goes that far."""
        while self.at + len(self.held) < to:
            more = self.file.read(max(_READ, to - self.at - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def drop(self, before: int) -> None:
        self.held = self.held[before - self.at :]
        self.at = before

    def find(self, start: int, end: int) -> int:
        """First place of the magic at or after ``start`` and before ``end``, or -1."""
        while start < end:
            self.drop(start)
            self.fill(min(end, start + _READ) + len(MAGIC) - 1)
            found = self.held.find(MAGIC)
            if found >= 0:
                return self.at + found if self.at + found < end else -1
            known = self.at + len(self.held) - len(MAGIC) + 1
            if known <= start:
                return -1
            start = known
        return -1

    def member(self, start: int) -> tuple[bytes, int] | None:
        """The inflated member at ``start`` and its end; None if no WARC record starts there."""
        inflate, got, at, head = zlib.decompressobj(31), [], start, b""
        while not inflate.eof:
            if not self.fill(at + 1):
                return None  # the file ends inside the member
            piece = self.held[at - self.at : at - self.at + _READ]
            known = len(head) == len(_START)
            try:
                # little is inflated of what may be no record
                out = inflate.decompress(piece, 0 if known else _PROBE)
            except zlib.error:
                return None
            # at a member's end both may hold what follows it
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            at += len(piece) - len(rest)
            got.append(out)
            if not known:
                head = (head + out)[: len(_START)]
                if not _START.startswith(head):
                    return None
        raw = b"".join(got)
        return (raw, at) if head == _START and b"\r\n\r\n" in raw else None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in an inflated member."""
    at = 0
    while raw.startswith(_START, at) and (stop := raw.find(b"\r\n\r\n", at)) >= 0:
        headers = _headers(raw[at:stop])
        length = int(headers.get("content-length", "0"))
        yield headers, raw[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_ID)
    return int(number) if number.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type")
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    stated = base64.b32decode(stated).hex() if stated else None
    if kind == "revisit":
        size, digest, intact = int(_headers(http).get("content-length", "0")), stated, True
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        intact = stated is None or stated == digest
    row = {
        "page_id": _page(headers.get("warc-record-id")), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind,
        "refers_to": _page(headers.get("warc-refers-to")),
        "url": headers.get("warc-target-uri"), "intact": intact,
    }
    return row | ({"payload": payload} if with_payload else {})


def records_in(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the members that start in the byte range."""
    reader, at = _Reader(file, start), start
    while (at := reader.find(at, end)) >= 0:
        found = reader.member(at)
        if found is None:
            at += 1
            continue
        raw, at = found
        yield from parsed(raw)


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives (path, bytes): page_id, payload_bytes,
    payload_digest, record_type, refers_to, url, intact (the stated digest holds), and
    ``payload`` on request. Each task reads some byte ranges of at most ``split_bytes``. If the
    manifest has ``records``, the rows are written to the shared folder and counted, and it is
    an error if they are not as many."""
    ship(manifest.sparkSession)
    fields = [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
        ("intact", pa.bool_()),
    ]
    ddl = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string, intact boolean"
    )
    if with_payload:
        fields.append(("payload", pa.binary()))
        ddl += ", payload binary"
    schema = pa.schema(fields)
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
        .alias("start"),
    )
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _file_system(r["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    end = min(r["start"] + split_bytes, r["bytes"])
                    for headers, block in records_in(file, r["start"], end):
                        rows.append(_row(headers, block, with_payload))
                        held += len(block) if with_payload else 100
                        if held > _READ:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    rows = ranges.repartition(int(min(count, 100_000))).mapInArrow(scan, ddl)
    if "records" not in manifest.columns:
        return rows
    rows = cut_lineage(rows)
    written, found = manifest.agg(F.sum("records")).first()[0] or 0, rows.count()
    if written != found:
        raise RuntimeError(f"the archives hold {written} records, {found} were read")
    return rows


READ_BACK_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
