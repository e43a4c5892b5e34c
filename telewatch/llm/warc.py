"""Web archives: a transaction of records per page, and its assembly from the archives.

Writing: every page becomes a response or revisit record, a request record and a metadata record; the last two name the first in
`WARC-Concurrent-To`. Of pages with equal payloads of at least `LEAST` bytes the one with the smallest id keeps its payload, the
others are revisits of it. Every task writes one compressed archive (each record a member of its own) under a name of its own, and only archives
in the manifest, which finished tasks fill, are read.

Reading: the archives are parsed into a table of records, and request, response or revisit, and metadata are joined on the identifiers
of their transaction to one nested row per capture.

Defined cases: null html is an empty payload; a null url leaves the target header out; a page with a null id is never the kept one of
equal payloads unless all of them have none; rows that repeat a page are written and returned as often as they occur; of several
requests or metadata records of one capture the smallest identifier is shown and all are counted; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewatch.llm import common as C
from telewatch.llm.records import file_system
from telewatch.sources.tables import materialise, shared_folder

LEAST = 100
DATE = "2024-01-01T00:00:00Z"  # the tables carry no capture time
RECORD = ("kind string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, "
          "payload_digest string, payload binary")


def record_id(role: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{role}:{page_id}'.encode()).digest())}>"


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def transaction(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """The three records of a page. `first` is the page whose payload this one repeats, itself if it keeps its own."""
    revisit = first is not None and first != page_id
    target = None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%")
    me = record_id("capture", page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    main = _record("revisit" if revisit else "response", [
        ("WARC-Record-ID", me), *common, ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", record_id("capture", first) if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http; msgtype=response")], http + (b"" if revisit else payload))
    request = _record("request", [("WARC-Record-ID", record_id("request", page_id)), *common, ("WARC-Concurrent-To", me),
                                  ("Content-Type", "application/http; msgtype=request")], f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode())
    metadata = _record("metadata", [("WARC-Record-ID", record_id("metadata", page_id)), *common, ("WARC-Concurrent-To", me),
                                    ("Content-Type", "application/warc-fields")], b"" if page_id is None else f"page-id: {page_id}\r\n".encode())
    return main + request + metadata


def write_archives(pages: DataFrame) -> DataFrame:
    """Write all pages (`page_id`, `url`, `html`) to archives below the shared folder; returns the manifest."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    # One row per repeated payload; stored, so that both sides of the join have an exchange and a hot payload can be split.
    repeated = (rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                .filter("n > 1").select("digest", "first"))
    marked = rows.join(materialise(repeated, "payloads"), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                system, root = file_system(folder)
                system.create_dir(root, recursive=True)
                name = f"pages-{uuid.uuid4().hex}.warc.gz"
                sink = system.open_output_stream(f"{root}/{name}", compression=None)
            for r in batch.to_pylist():
                sink.write(transaction(r["page_id"], r["url"], r["payload"], r["digest"], r["first"]))
            n += batch.num_rows
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "pages": [n]})

    return materialise(marked.mapInArrow(run, "path string, pages long"), "archives")


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(stream, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, one at a time."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        h = _headers(stream)
        block = stream.read(int(h["content-length"]))
        if len(block) != int(h["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        kind = h["warc-type"]
        row = {"kind": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"),
               "target_uri": h.get("warc-target-uri"), "page_id": None, "payload_bytes": None, "payload_digest": None, "payload": None}
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            said = h.get("warc-payload-digest", "").removeprefix("sha256:")
            length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != said):
                raise ValueError("a payload is damaged")
            row |= {"payload_bytes": length, "payload_digest": said, "payload": payload if with_payload and kind == "response" else None}
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
            row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
        yield row


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = file_system(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as raw, gzip.open(raw, "rb") as stream:
                    for r in parse(stream, with_payload):
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if len(rows) >= 3000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    text = [(n, pa.string()) for n in ("kind", "record_id", "concurrent_to", "refers_to", "target_uri")]
    schema = pa.schema([*text, ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RECORD)  # one row per archive


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its request and its metadata, and the page that a revisit repeats."""
    def beside(kind: str, show: list[Column]) -> DataFrame:
        found = records.filter(F.col("kind") == kind).groupBy("concurrent_to")
        grouped = found.agg(F.min(F.struct("record_id", *show)).alias(kind), F.count("*").alias(f"n_{kind}"))
        return materialise(grouped, kind)

    main = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", F.struct("target_uri", "payload_bytes", "payload_digest", "payload").alias("response"), "refers_to")
    request, metadata = beside("request", [F.col("target_uri")]), beside("metadata", [F.col("page_id")])
    by_id = F.col("concurrent_to") == F.col("record_id")
    captures = main.join(request, by_id, "left").drop("concurrent_to").join(metadata, by_id, "left").drop("concurrent_to")
    # A capture that repeats nothing looks itself up, which spreads these rows and finds nothing new.
    pages = metadata.select(F.col("concurrent_to").alias("target"), F.col("metadata.page_id").alias("target_page"))
    found = captures.join(pages, F.coalesce("refers_to", "record_id") == F.col("target"), "left")
    return found.select("record_id", "kind", "request", "response", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_request"),
                        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
                        F.when(F.col("kind") == "revisit", F.col("target_page")).alias("refers_to"))


def captures(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return a row per page."""
    records = materialise(read_archives(write_archives(pages), with_payload=False), "records")
    return assemble(records).select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "n_request", "n_metadata")
