"""WARC archives: written with an index first, read back by coalesced byte ranges.

``write_archives`` turns pages into gzip-member-per-record WARC/1.1 files and returns the
index: file, offset, length, URL and digest of every record. ``read_records`` takes any
selection of index rows, sorts them by file and offset, joins neighbouring ranges into one
read, and parses the records.

Among pages with equal payloads of at least ``revisit_bytes`` the one with the largest
page_id is stored as ``response``; the others are ``revisit`` records that carry its id and
the payload's length and digest, but no payload.

Defined cases. Null or empty html: an empty payload, always ``response``. Null page_id: such
a row is never the one referred to unless all of its group are null, and then all are
``response``. Rows repeated with the same page_id and payload: all of those with the largest
id are ``response``. Null URL: no WARC-Target-URI; line breaks in a URL are percent-encoded.
Empty table: no archive and an empty index. Other columns are ignored. A page is held in
memory whole, one at a time.

Files are written under names that hold the task attempt, and only the rows of the attempt
that Spark commits point to them: a repeated or lost attempt leaves at most a file that no
index row names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import parts_for, scratch_dir, staged, utf8

INDEX = "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORD_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. With ``refers_to`` it is a revisit: the block keeps
    the HTTP head, whose Content-Length is that of the payload left out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=4, mtime=0) as z:
        z.write("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a gzip member."""

    def fields(head: bytes) -> dict[str, str]:
        pairs = (x.partition(": ") for x in head.decode("utf-8").split("\r\n")[1:])
        return {k.lower(): v for k, _, v in pairs}

    head, _, rest = zlib.decompress(raw, wbits=31).partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _writer(root: str, rotate_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        task, part, out, at, name = TaskContext.get().taskAttemptId(), 0, None, 0, ""
        for pdf in batches:
            rows = []
            for page_id, url, html, digest, refers_to in pdf.itertuples(index=False, name=None):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                if out is None or at >= rotate_bytes:
                    if out is not None:
                        out.close()
                    name = f"{task:08d}-{part:04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    part, at, out = part + 1, 0, store.open_output_stream(f"{base}/{name}", compression=None)
                payload = bytes(html)
                raw = record_bytes(page_id, url, payload, digest, refers_to)
                out.write(raw)
                rows.append((page_id, url, digest, len(payload), "response" if refers_to is None else "revisit", name, at, len(raw)))
                at += len(raw)
            frame = pd.DataFrame(rows, columns=["page_id", "url", "digest", "payload_bytes", "record_type", "file", "offset", "length"])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, root: str, revisit_bytes: int = 1000, rotate_bytes: int = 1 << 30, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages as WARC files below the URI ``root`` and return their index, staged
    in the shared folder.

    The payload is shuffled once, in the join that tells each page of the group it belongs
    to; the groups themselves are found from digests alone, and Spark splits a hot digest.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(F.col(html)).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = pages.select(F.col(page_id).cast("long").alias("p"), utf8(F.col(html)).alias("b")).where(F.octet_length("b") >= revisit_bytes)
    groups = large.groupBy(F.sha1("b").alias("d")).agg(F.max("p").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("d", "first")
    whole = rows.join(groups, F.col("digest") == F.col("d"), "left")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    store, base = _store(root)
    store.create_dir(base, recursive=True)
    return staged(whole.select("page_id", "url", "html", "digest", refers_to.alias("refers_to")).mapInPandas(_writer(root, rotate_bytes), INDEX), "warc-index", parts_for(pages))


def coalesce_ranges(ranges: Iterable[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, members) of joined reads over (offset, length) sorted by offset: neighbours
    are joined over holes of up to ``gap`` bytes while the read stays within ``most``."""
    start, end, members = 0, -1, []
    for offset, length in ranges:
        if members and offset - end <= gap and offset + length - start <= most:
            end = max(end, offset + length)
        else:
            if members:
                yield start, end, members
            start, end, members = offset, offset + length, []
        members.append((offset, length))
    if members:
        yield start, end, members


def _reader(root: str, gap: int, most: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for pdf in batches:
            for name, part in pdf.groupby("file", sort=False):
                with store.open_input_file(f"{base}/{name}") as f:
                    for start, end, members in coalesce_ranges(zip(part["offset"].tolist(), part["length"].tolist(), strict=True), gap, most):
                        data, rows = memoryview(f.read_at(end - start, start)), []
                        for offset, length in members:
                            warc, http, payload = parse_record(data[offset - start : offset - start + length])
                            kind, named = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                            found = hashlib.sha1(payload).hexdigest() if kind == "response" else named
                            size = len(payload) if kind == "response" else int(http["content-length"])
                            if found != named:
                                raise ValueError(f"{name} at {offset}: payload has digest {found}, its record says {named}")
                            refers_to = _page_of(warc["warc-refers-to"]) if kind == "revisit" else None
                            rows.append((_page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), size, found, kind, refers_to))
                        yield pd.DataFrame(rows, columns=RECORD_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})

    return read


def read_records(selected: DataFrame, root: str, gap: int = 1 << 16, most: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Records of the selected index rows. The archives are read by as many tasks as their
    selected bytes ask for (``task_bytes``, not the size of the index), one a core at least; files
    are dealt to them in slices of offsets, several a task, so that one large archive is read by
    many tasks and all have about as much."""
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, math.ceil(total / task_bytes))
    slice_bytes = max(1 << 16, min(most, total // (8 * tasks)))
    rows = selected.select("file", "offset", "length")
    rows = rows.repartition(tasks, "file", F.floor(F.col("offset") / slice_bytes)).sortWithinPartitions("file", "offset")
    return rows.mapInPandas(_reader(root, gap, most), RECORD)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages to a new archive folder in the shared scratch space and read every
    record back."""
    root = f"{scratch_dir(pages.sparkSession)}/lectern/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, root, **columns), root).select(*RECORD_COLUMNS)
