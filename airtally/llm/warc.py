"""WARC archives: a writer, and a reader that splits compressed files.

*Writer.* Every page is a record in a gzip member of its own. Of pages with the same payload, the
one with the largest id is a ``response`` and the others are ``revisit`` records that name it; they
keep the HTTP headers but no payload. Each task writes its own files, named after its attempt, and
returns their manifest rows, so files of lost attempts are never read.

*Reader.* Files are cut into byte ranges. The task of a range searches it for the magic number of
gzip, and takes a place as the start of a member if the flags are allowed and what is decompressed
from there begins as a WARC record and ends with the right checksum. It owns the members that start
inside its range and reads the last one beyond the range's end. So a file of any size is read by
as many tasks as it has ranges, and each record by one of them.

Defined cases: a null payload is an empty one; payloads below ``revisit_bytes`` are all responses;
a null url leaves out the target; pages with a null id are never named by others, and are responses
where no page with an id has their payload; rows that repeat the largest id are responses all; an
empty table gives no files; further columns are ignored. Bytes between members, and members that
are no WARC records, are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, open_store, shared_folder

#: Bytes read at a time behind a range's end, and unpacked at a time; ranges that a task reads on average.
STEP_BYTES, RANGES_OF_TASK = 16_384, 2
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 1_000_000_000
RANGE_BYTES = 4_000_000
READ_BYTES = 1_000_000
RECORDS = (
    "path string, offset long, bytes long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, digest_agrees boolean, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """A record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(
    pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 6,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write all pages; returns ``path``, ``bytes`` and ``records`` of each file."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= revisit_bytes, F.sha1("html")))
    # digests of a single page need no partner
    owners = rows.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("pages")).where("pages > 1").select("digest", "owner")

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        fs, root = open_store(folder)
        task = TaskContext.get()
        out, path, size, records, files = None, "", 0, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, text, owner = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "owner"))
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path, size, records = f"{root}/part-of-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                    files += 1
                data = member(page_id, url, text.encode(), None if owner is None or owner == page_id else owner, level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})

    def as_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in write_files(batches):
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    named = rows.join(owners, "digest", "left").select("page_id", "url", "html", "owner")
    return materialize(named.mapInArrow(as_arrow, "path string, bytes long, records long"), "warc-files")


class Window:
    """The part of a file that a range needs, read once from its start on."""

    def __init__(self, source, start: int, end: int, size: int) -> None:
        self.source, self.end, self.size = source, end, size
        self.base, self.data = start, b""
        source.seek(start)

    def grow(self) -> bool:
        """Read on: up to the end of the range, then in small steps, as records may go beyond it."""
        at = self.base + len(self.data)
        part = self.source.read(min(READ_BYTES, max(self.end - at, STEP_BYTES), self.size - at))
        self.data += part
        return bool(part)

    def drop(self, before: int) -> None:
        if before - self.base > READ_BYTES:
            self.data, self.base = self.data[before - self.base :], before

    def record(self, offset: int) -> tuple[bytes, int] | None:
        """Content and length of the gzip member at an offset, if a WARC record is there."""
        start = at = offset - self.base
        while len(self.data) < start + 4 and self.grow():
            pass
        if len(self.data) < start + 4 or self.data[start + 3] & 0xE0:
            return None
        reader, parts, got = zlib.decompressobj(31), [], 0
        try:
            while at < len(self.data) or self.grow():
                piece = self.data[at : at + STEP_BYTES]
                part = reader.decompress(piece)
                at += len(piece) - len(reader.unused_data)
                if part:
                    parts.append(part)
                    got += len(part)
                    if got >= 7 and len(parts) < 8 and not b"".join(parts)[:7] == b"WARC/1.":
                        return None
                if reader.eof:
                    return (b"".join(parts), at - start) if got >= 7 else None
        except zlib.error:
            pass
        return None


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the records that start in a byte range."""
    window, at = Window(source, start, end, size), start
    while at < end:
        window.drop(at)
        found = window.data.find(MAGIC, at - window.base, end + len(MAGIC) - 1 - window.base)
        if found < 0:
            at = max(at, window.base + len(window.data) - len(MAGIC) + 1)
            if at >= end or not window.grow():
                return
            continue
        at = window.base + found
        record = window.record(at)
        if record is None:
            at += 1
        else:
            yield at, record[1], record[0]
            at += record[1]


def headers(text: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def parsed(content: bytes, with_payload: bool) -> dict:
    """What a record says of itself and of its payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    own = headers(head)
    block = rest[: int(own.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = own.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = own.get("warc-type") == "revisit"
    found = said if revisit else sha1_base32(payload)
    length = int(headers(http).get("content-length", 0)) if revisit else len(payload)
    return {
        "record_type": own.get("warc-type"), "record_id": own.get("warc-record-id"), "target_uri": own.get("warc-target-uri"), "refers_to": own.get("warc-refers-to"),
        "payload_digest": found, "payload_bytes": length, "digest_agrees": said is None or said == found, "payload": payload if with_payload and not revisit else None,
    }


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True, store: str = "file:///") -> DataFrame:
    """All records of files given by ``path`` and ``bytes``; ``store`` is a URI of their file system."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_store(store)
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"].tolist(), batch["start"].tolist(), strict=True):
                rows: list[dict] = []
                held = 0
                with fs.open_input_file(path) as source:
                    for offset, length, content in members(source, start, min(start + range_bytes, size), size):
                        rows.append({"path": path, "offset": offset, "bytes": length} | parsed(content, with_payload))
                        held += len(content) if with_payload else 0
                        if len(rows) >= 5000 or held > 16_000_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    # a number of tasks that follows from the files: ranges are tiny rows, which adaptive execution would merge
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    return ranges.repartition(max(1, -(-int(tasks) // RANGES_OF_TASK)), "path", "start").mapInPandas(read_ranges, RECORDS)
