"""WARC archives: write them, turn a monolithic gzip into one member a record, index and read them.

``write_monolithic`` writes records the way careless crawlers do, a whole file as one gzip stream.
``normalise`` inflates each such stream once, in constant memory, and rewrites every record as a gzip
member of its own next to a sidecar index (page, offset, length), so one record can be read with one
seek. While it rewrites, a record whose payload another record holds becomes a ``revisit`` without
payload. ``read_indexed`` reads members by the index.

Input columns ``page_id``, ``url`` and ``html``; others are ignored. A null html is an empty payload,
a null url an empty target; repeated rows each give a record (a repeated page_id at most one response
of a payload, the first of its file order); a null page_id is carried as "-", and gives way to any
other as the response; an empty table gives no rows. Files are written under names of their own
attempt and count only through the rows that the attempt returns, so a lost executor leaves no half
file in use. A task holds one payload and the slim rows of its file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._shared import filesystem, from_lists, shared_folder, ship, stored

#: Payloads from so many bytes on are stored once; uncompressed bytes of one file.
LEAST_SHARED, FILE_BYTES = 1000, 64 << 20
READ = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_name(digest: bytes) -> str:
    """A digest as WARC headers hold it."""
    return "sha1:" + base64.b32encode(digest).decode()


def sha1_hex(name: str) -> str:
    return base64.b32decode(name.removeprefix("sha1:")).hex()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " ")


def record(kind: str, page: int | None, url: str, payload_bytes: int, digest: str, payload: bytes, refers: int | None = None) -> bytes:
    """One WARC record: its headers, an HTTP head that tells the payload's full length, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    name = "-" if page is None else page
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest} {kind}')}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Page-ID: {name}", f"WARC-Payload-Digest: {digest}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    of = _headers(head)
    http, _, payload = rest[: int(of["content-length"])].partition(b"\r\n\r\n")
    lines = http.decode("utf-8", "replace").split("\r\n")[1:]
    return of, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def records(stream: BinaryIO) -> Iterator[bytes]:
    """Records of a gzip file, one stream or many members alike, inflated once and in order."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = None  # bytes of the record at the start of held, once its headers are known
    seen = 0  # of held, searched for the headers' end
    while True:
        data = stream.read(READ)
        if not data:
            break
        while data:
            held += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof and data:
                inflate = zlib.decompressobj(31)
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n", seen)
                    if end < 0:
                        seen = max(0, len(held) - 3)
                        break
                    need = end + 4 + int(_headers(bytes(held[:end]))["content-length"]) + 4
                if len(held) < need:
                    break
                yield bytes(held[:need])
                del held[:need]
                need, seen = None, 0
    if held:
        raise ValueError("a WARC file ends inside a record")


_WRITTEN = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.binary()), ("file", pa.string()), ("n", pa.int64())])


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a response record into gzip files of one stream each; a row a record:
    page_id, payload_bytes, digest, file, n (the record's place in its file)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, rows = None, []
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/crawl-{uuid.uuid4().hex}.warc.gz"
                    out, deflate, size, n = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload).digest()
                raw = record("response", page, _clean(url), len(payload), sha1_name(digest), payload)
                out.write(deflate.compress(raw))
                rows.append((page, len(payload), digest, path, n))
                size, n = size + len(raw), n + 1
                if size >= FILE_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                if len(rows) >= 5000:
                    yield from_lists(_WRITTEN, rows)
                    rows = []
        if out is not None:
            out.write(deflate.flush())
            out.close()
        yield from_lists(_WRITTEN, rows)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, payload_bytes long, digest binary, file string, n long")


_INDEX = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def normalise(written: DataFrame, folder: str) -> DataFrame:
    """Rewrite monolithic files with one gzip member a record and a sidecar index beside each; returns
    the index rows: file, page_id, offset, length.

    Only slim rows are shuffled: (digest, page) to find each shared payload's response, then (file,
    record number) to the task that rewrites that file. Payloads never are.
    """
    slim = written.select("file", "n", "page_id", F.when(F.col("payload_bytes") >= LEAST_SHARED, F.col("digest")).alias("digest"))
    # The response: the largest page_id, of its repetitions the first in file order.
    large = slim.where("digest is not null")
    heads = large.groupBy("digest").agg(F.count("*").alias("copies"), F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), F.col("file").alias("f"), (-F.col("n")).alias("k"))).alias("head")).where("copies > 1")
    # As a table of its own, so that the partition of a body that many pages share can be split in the join.
    heads = stored(heads, "heads")
    joined = large.join(heads, "digest", "left").select("file", "n", "page_id", F.when((F.col("head.f") != F.col("file")) | (F.col("head.k") != -F.col("n")), F.col("head.p")).alias("refers"))
    marked = joined.unionByName(slim.where("digest is null").select("file", "n", "page_id", F.lit(None).cast("long").alias("refers")))

    def rewrite(table: pa.Table) -> pa.Table:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        path = table.column("file")[0].as_py()
        refers = {n: r for n, r in zip(table.column("n").to_pylist(), table.column("refers").to_pylist(), strict=True) if r is not None}
        new, rows, at = f"{base}/part-{uuid.uuid4().hex}.warc.gz", [], 0
        with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(new, compression=None) as out:
            for n, raw in enumerate(records(source)):
                of, http, _ = parse(raw) if n in refers else (_headers(raw[: raw.index(b"\r\n\r\n")]), {}, b"")
                page = None if of["warc-page-id"] == "-" else int(of["warc-page-id"])
                if n in refers:
                    raw = record("revisit", page, of["warc-target-uri"], int(http["content-length"]), of["warc-payload-digest"], b"", refers[n])
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(raw) + deflate.flush()
                out.write(member)
                rows.append((new, page, at, len(member)))
                at += len(member)
        if len(rows) != table.num_rows:
            raise ValueError(f"{path}: {len(rows)} records, {table.num_rows} written")
        with fs.open_output_stream(f"{new}.idx") as out:
            out.write("".join(f"{'-' if p is None else p} {o} {size}\n" for _, p, o, size in rows).encode())
        return pa.Table.from_batches([from_lists(_INDEX, rows)])

    # Slim rows bring much work, so their size must not decide how many tasks there are.
    parts = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.repartition(parts, "file").groupBy("file").applyInArrow(rewrite, "file string, page_id long, offset long, length long")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_indexed(files: DataFrame, folder: str) -> DataFrame:
    """Read every record of the named normalised files through their sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}.idx") as f:
                    places = [line.split() for line in f.read().decode().splitlines()]
                with fs.open_input_file(path) as f:
                    for name, offset, length in places:
                        f.seek(int(offset))
                        of, http, payload = parse(zlib.decompress(f.read(int(length)), 31))
                        if of["warc-page-id"] != name:
                            raise ValueError(f"{path}: the index names page {name} at {offset}, the record {of['warc-page-id']}")
                        digest, size = sha1_hex(of["warc-payload-digest"]), int(http["content-length"])
                        if of["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{path}: page {name} has another payload than its digest")
                        refers = of.get("warc-refers-to-page-id")
                        rows.append((None if name == "-" else int(name), size, digest, of["warc-type"], None if refers is None else int(refers)))
                        if len(rows) >= 5000:
                            yield from_lists(_READ, rows)
                            rows = []
                yield from_lists(_READ, rows)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, F.xxhash64("file")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read the result back."""
    folder = shared_folder(pages.sparkSession)
    written = stored(write_monolithic(pages, f"{folder}/crawl"), "written")
    index = stored(normalise(written, f"{folder}/warc"), "index")
    return read_indexed(index.select("file").distinct(), f"{folder}/warc")
