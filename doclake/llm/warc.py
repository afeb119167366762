"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Each record is a gzip member of its own. Pages with equal payloads are told by their SHA-1: the one with the least id is a
``response`` and the others are ``revisit`` records, which name it and carry the payload's digest and length but not the
payload. The index has offset, length, URL and digest of each record; a reader picks records from it, sorts them by file
and offset, joins ranges that lie close together, and parses what it picked.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import partitions, stage

#: Ranges with no more than this between them are read at once, up to READ_BYTES.
JOIN_GAP = 64 << 10
READ_BYTES = 8 << 20
#: Bytes after which a task starts its next file.
FILE_BYTES = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_INDEX = "path string, offset long, length long, url string, payload_digest string, record_type string, page_id long"


def _urn(page_id: int | None) -> str:
    return f"<urn:doclake:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return None if number == "none" else int(number)


def _one_line(text: str) -> str:
    return "".join(c if c not in "\r\n" else " " for c in text)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(member: bytes) -> dict:
    """The headers, payload (None for a revisit) and payload length of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": None if revisit else payload, "payload_bytes": length, "digest": digest}


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row of ``pages`` and returns the staged index.

    Payloads are the html in UTF-8; null counts as empty. Of equal payloads of at least ``min_revisit_bytes`` the row with
    the least id is the response; rows that repeat that very id and payload are responses too, as they name themselves.
    Null ids are written as such; they are least only where all ids of a payload are null, and then all are responses.
    """
    from pyarrow import fs

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html"))
    least = keyed.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marked = keyed.join(stage(least, "repeated"), "sha", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out, at, found, name = None, 0, [], ""
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i) for i in range(4))):
                page_id, url, payload, first = page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py()
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, at = system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20), 0
                digest, revisit = digest_of(payload), first is not None and first != page_id
                data = record(page_id, url, payload, digest, first, revisit)
                out.write(data)
                found.append((f"{folder}/{name}", at, len(data), url, digest, "revisit" if revisit else "response", page_id))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
                if len(found) >= 4096:
                    yield _batch(found)
                    found = []
        if out is not None:
            out.close()
        if found:
            yield _batch(found)

    return stage(marked.select("page_id", "url", "html", "first").mapInArrow(work, _INDEX), "warc-index")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (path, offset, length) joined into reads: path, first byte, end, and the records inside."""
    held: list[tuple[int, int]] = []
    where, start, stop = "", 0, 0
    for path, offset, length in rows:
        if held and (path != where or offset - stop > JOIN_GAP or offset + length - start > READ_BYTES):
            yield where, start, stop, held
            held = []
        if not held:
            where, start = path, offset
        held.append((offset, length))
        stop = offset + length
    if held:
        yield where, start, stop, held


def read_warc(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``selected`` rows of an index point at: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, the payload (null for a revisit)."""
    n = partitions(selected.sparkSession)
    sorted_rows = selected.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start, stop, held in ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                system, local = fs.FileSystem.from_uri(path)
                with system.open_input_file(local) as f:
                    f.seek(start)
                    data = memoryview(f.read(stop - start))
                got = [parse(data[offset - start : offset - start + length]) for offset, length in held]
                fields = [x["fields"] for x in got]
                refers = [f.get("WARC-Refers-To") for f in fields]
                columns = [
                    pa.array([_page(f["WARC-Record-ID"]) for f in fields], pa.int64()),
                    pa.array([f.get("WARC-Target-URI") for f in fields], pa.string()),
                    pa.array([x["payload_bytes"] for x in got], pa.int64()),
                    pa.array([x["digest"] for x in got], pa.string()),
                    pa.array([f["WARC-Type"] for f in fields], pa.string()),
                    pa.array([_page(r) if r else None for r in refers], pa.int64()),
                ]
                if with_payload:
                    columns.append(pa.array([x["payload"] for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload])

    return sorted_rows.mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)
