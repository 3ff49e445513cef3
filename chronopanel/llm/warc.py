"""WARC archives: written with an index first, read by coalesced byte ranges.

Each task writes one archive of gzip members, a record each, into the shared
folder and returns an index row per record: file, offset, length, URL, digest.
The index is a Parquet table that Spark commits, so only archives of tasks that
succeeded are ever named in it; what a lost or repeated attempt wrote is never
read.  Readers take any selection of index rows, cut it into regions of a file,
sort each by offset and read neighbours that lie at most ``gap`` apart with one
range request of at most ``most`` bytes.

Equal payloads are found by digest before writing: one row per digest is
aggregated, and the record with the largest id is the response that the others
revisit.  A revisit record has no payload; its digest and length headers tell
those of the full payload.

Defined cases: a null payload is empty; a null URL gives no target header and
reads back as null.  Repeated rows are records of their own: of equal ids and
payloads every one with the largest id is a response.  Rows with null ids
revisit if another id is there, else they are responses.  Only the id, the URL
and the payload are read, so other columns can't clash.  An empty table gives
an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialise, shared_path, utf8

INDEX = "id long, file string, start long, length long, url string, digest string, record_type string"
RECORDS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, url, html, refers_to): refers_to is the response's id for records that revisit it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where("n > 1").select(F.col("sha").alias("of"), "response"), "responses", few_files=True)
    joined = rows.join(groups, (F.col("sha") == F.col("of")) & (F.octet_length("html") >= min_bytes), "left")
    return joined.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def record(ident: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed; the time is fixed so that equal input gives equal archives."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if ident is None else ident}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}" if url.isascii() and url.isprintable() and " " not in url and "'" not in url else f"X-Target-Quoted: {quote(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _ident(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def arrow_uri(spark: SparkSession, path: str) -> str:
    """The path as Spark understands it, spelled for Arrow; fails on the driver where Arrow knows no such store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full.removeprefix("file:")
    full = re.sub(r"^s3[an]://", "s3://", full)
    fs.FileSystem.from_uri(full)
    return full


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 3, path: str | None = None) -> DataFrame:
    """Write the archives and return their index."""
    top = arrow_uri(pages.sparkSession, path or shared_path(pages.sparkSession, "warc"))

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = batches(rows)
        first = next(rows, None)
        if first is None:
            return
        store, folder = fs.FileSystem.from_uri(top)
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        at = 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for b in chain([first], rows):
                found: list[tuple] = []
                for ident, url, html, to in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), utf8(b.column("html")), b.column("refers_to").to_pylist(), strict=True):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(ident, url, html, to)) + packer.flush()
                    out.write(member)
                    found.append((ident, f"{top}/{name}", at, len(member), url, digest_of(html), "response" if to is None else "revisit"))
                    at += len(member)
                cols = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "file", "start", "length", "url", "digest", "record_type"])

    return materialise(with_revisits(pages, id_col, url_col, html_col, min_bytes).mapInArrow(write, INDEX), "index")


def ranges(starts: list[int], lengths: list[int], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Coalesce records sorted by offset: (start, end, records) of each read."""
    held: list[tuple[int, int]] = []
    for s, n in zip(starts, lengths, strict=True):
        if held and (s - (held[-1][0] + held[-1][1]) > gap or s + n - held[0][0] > most):
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((s, n))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20, region: int = 32 << 20) -> DataFrame:
    """The records that the index rows name, by sorted and coalesced byte ranges."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}
        for b in batches(rows):
            wanted: dict[str, list[tuple[int, int]]] = {}
            for f, s, n in zip(*(b.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                wanted.setdefault(f, []).append((s, n))
            for f, own in wanted.items():
                folder = f.rpartition("/")[0]
                if folder not in stores:
                    stores[folder] = fs.FileSystem.from_uri(folder)
                store, inner = stores[folder]
                own.sort()
                with store.open_input_file(f"{inner}/{f.rpartition('/')[2]}") as source:
                    for start, end, members in ranges([s for s, _ in own], [n for _, n in own], gap, most):
                        source.seek(start)
                        data, out = source.read(end - start), []
                        for s, n in members:
                            head, payload = _headers(zlib.decompress(data[s - start : s - start + n], 31))
                            kind = head["WARC-Type"]
                            if kind == "response" and digest_of(payload) != head["WARC-Payload-Digest"].removeprefix("sha1:"):
                                raise ValueError(f"{f} at {s}: the payload's digest is not the one its header tells")
                            url = head.get("WARC-Target-URI")
                            size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                            out.append((_ident(head["WARC-Record-ID"]), unquote(head["X-Target-Quoted"]) if "X-Target-Quoted" in head else url, size, head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, _ident(head.get("WARC-Refers-To")), payload))
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    placed = index.select("file", "start", "length", F.floor(F.col("start") / region).alias("region"))
    regions = -(-(placed.agg(F.sum("length")).first()[0] or 0) // region) or 1  # tasks by bytes to read; the index rows themselves are few
    return placed.repartition(regions, "file", "region").sortWithinPartitions("file", "start").drop("region").mapInArrow(read, RECORDS)
