"""WARC files, index first.

`write` puts records, each a gzip member, into files in a shared folder, and notes offset, length, URL and digest of every
record as it does; `index` makes the same table of WARC files that others wrote, reading each once from front to back. A
selection is a query over that index alone. `read` then sorts the selected entries by file and offset and fetches byte
ranges, near ones together, so that records not selected cost little or nothing.

A task that is tried again writes another file; the written index names the files of the attempts that counted. Ranges
are read by tasks of up to BLOCK bytes of a file, as many as the selected bytes fill or cores can use; no range is above
LARGEST unless one record is.

Defined results: null html, url or page_id come back as nulls, an empty html as empty; a null html has a null digest and
is never selected by `distinct_payloads`. URLs with control or other than ASCII characters come back exactly. Repeated rows
are records of their own. Of records with equal digests the one of least page_id, then url, is selected, nulls first. No pages give no files and an
empty index. Other columns are not written. Of foreign files, records of the types in PAYLOADS are indexed, of a `response`
the payload is what follows the HTTP head, as stored; bytes that aren't UTF-8 come back as replacement characters. The digest is always
worked out from the payload (MD5); a stated MD5, SHA-1 or SHA-256 that doesn't fit is an error, other stated digests are not checked.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, in_arrow, shared_folder, table

BLOCK = 64 << 20
GAP = 64 << 10
LARGEST = 8 << 20
PIECE = 64 << 10
PAYLOADS = ("resource", "response", "conversion")
LEAST_BLOCK = 1 << 20  # bytes below which reads aren't cut further to keep cores busy
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it."""
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record(page_id: int | None, url: str | None, html: str | None, name: str = "") -> bytes:
    """A record; `name` makes its identifier, the same at each attempt."""
    body = b"" if html is None else html.encode("utf-8", "surrogatepass")
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name or f'{page_id} {url!r}')}>", f"WARC-Date: {DATE}", "Content-Type: text/html"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        plain = url.isascii() and url.isprintable() and url == url.strip()
        head.append(f"WARC-Target-URI: {url}" if plain else f"X-Target-URI-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    head.append("X-Payload: none" if html is None else f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest()}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def fits(stated: str, body: bytes) -> bool:
    """Whether a stated digest is that of the body; true for algorithms that aren't known here."""
    kind, _, value = stated.partition(":")
    name = kind.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256"):
        return True
    raw, value = hashlib.new(name, body).digest(), value.strip()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def parsed(raw: bytes) -> tuple[int | None, str | None, str | None, str | None] | None:
    """page_id, url, html, digest of a record; None if its type has no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if fields.get("warc-type", "").lower() not in PAYLOADS:
        return None
    body = rest[: int(fields["content-length"])]
    if fields["warc-type"].lower() == "response" and fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        body = body.partition(b"\r\n\r\n")[2]
    url = fields.get("warc-target-uri")
    if url and url[0] == "<" and url[-1] == ">":
        url = url[1:-1]
    if "x-target-uri-base64" in fields:
        url = base64.b64decode(fields["x-target-uri-base64"]).decode("utf-8", "surrogatepass")
    digest = html = None
    if fields.get("x-payload") != "none":
        stated = fields.get("warc-payload-digest", "")
        if not fits(stated, body):
            raise ValueError(f"a record's payload doesn't fit its digest {stated}")
        digest = hashlib.md5(body).hexdigest()
        try:
            html = body.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            html = body.decode("utf-8", "replace")
    page = fields.get("x-page-id", "")
    return int(page) if page.lstrip("-").isdigit() else None, url, html, digest


def write(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes page_id, url, html as WARC files; gives the index, written too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, path = store(folder)
        out, at, n, rows = None, 0, 0, []
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                raw = record(page_id, url, html, f"{name}/{n}")
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = member.compress(raw) + member.flush()
                out.write(data)
                digest = None if html is None else hashlib.md5(html.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((name, at, len(data), page_id, url, digest))
                at, n = at + len(data), n + 1
                if len(rows) == 10_000:
                    yield entries(rows)
                    rows = []
        if out is not None:
            out.close()  # before the last entries go out, so that no entry is committed without its bytes
        if rows:
            yield entries(rows)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return scratch.save(in_arrow(rows, run, INDEX), "index")


def members(stream: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a file, read once from front to back."""
    at, start, data = 0, 0, b""
    while True:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not data:
                data = stream.read(PIECE)
                if not data:
                    if parts or d.unconsumed_tail:
                        raise EOFError(f"the member at {start} is cut off")
                    return
            parts.append(d.decompress(data))
            at += len(data) - len(d.unused_data)
            data = d.unused_data
        yield start, at - start, b"".join(parts)
        start = at


def index(files: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes and gives an entry for each record of each named file (`file`, below the folder): file, offset, length, page_id, url, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    for offset, length, raw in members(stream):
                        if found := parsed(raw):
                            rows.append((name, offset, length, found[0], found[1], found[3]))
                        if len(rows) == 10_000:
                            yield entries(rows)
                            rows = []
                if rows:
                    yield entries(rows)

    names = files.select("file").distinct()
    return scratch.save(in_arrow(names.repartition(max(1, names.count()), "file"), run, INDEX), "index")


def entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["file", "offset", "length", "page_id", "url", "digest"])


def distinct_payloads(entries_: DataFrame) -> DataFrame:
    """One entry of each digest."""
    first = F.min(F.struct("page_id", "url", "file", "offset", "length")).alias("e")
    return entries_.filter("digest is not null").groupBy("digest").agg(first).select("e.file", "e.offset", "e.length")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted entries as byte ranges: file, start, end and the records in it."""
    run: list[tuple[int, int]] = []
    name, start, end = "", 0, 0
    for file, offset, length in rows:
        if run and (file != name or offset - end > GAP or offset + length - start > LARGEST):
            yield name, start, end, run
            run = []
        if not run:
            name, start, end = file, offset, offset
        run.append((offset, length))
        end = max(end, offset + length)
    if run:
        yield name, start, end, run


def read(selected: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html, digest of the records that entries (file, offset, length) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for name, start, end, inside in ranges(rows):
                with fs.open_input_file(f"{path}/{name}") as f:
                    data = f.read_at(end - start, start)
                out = [x for x in (parsed(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inside) if x]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["page_id", "url", "html", "digest"])

    size = selected.agg(F.sum("length")).first()[0] or 0
    cores = selected.sparkSession.sparkContext.defaultParallelism
    block = min(BLOCK, max(LEAST_BLOCK, size // (2 * cores)))
    # a number of partitions of its own, as entries are small and what they name is not
    placed = selected.select("file", "offset", "length").repartition(max(1, math.ceil(size / block)), "file", F.floor(F.col("offset") / block)).sortWithinPartitions("file", "offset")
    return in_arrow(placed, run, "page_id long, url string, html string, digest string")


def distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct page, read back by way of files and index."""
    scratch, folder = Scratch(spark), shared_folder(spark) + "-warc"
    selected = distinct_payloads(write(table(spark, sf_dir, "pages"), folder, scratch))
    return read(scratch.save(selected, "selected"), folder)


PAGES_SQL = """
SELECT page_id, url, html, md5(html) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS FIRST, url NULLS FIRST) AS n FROM pages WHERE html IS NOT NULL)
WHERE n = 1
"""
