"""WARC archives: whole-file gzip streams, normalised to one gzip member a record, with an offset index.

Crawlers often leave `.warc.gz` files that are one gzip stream; no record of such a file can be read
without inflating all before it. `write_archives` makes such files from a table, `normalise` inflates each
once, rewrites every record as a gzip member of its own and writes a sidecar index of offsets, and
`read_records` reads records by their offsets.

Defined results: a null payload is an empty one; a null URL becomes the record's own id; control
characters and spaces of a URL are percent-encoded; a row with null page_id is written with the id
`urn:page:` and read back as null, and is a revisit only if a row with an id has the same payload;
rows that repeat the largest page_id of a payload are all responses. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import joined, saved, shared_dir, table

CHUNK = 1 << 20
#: Repeated digests up to which they are sent to every executor, at about 60 bytes; beyond it they are joined by a shuffle.
SENT = 500_000
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str, mode: str):
    """A stream of a file in any store that pyarrow knows, such as file:, hdfs: or s3:."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "wb":
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_file(inner) if mode == "at" else store.open_input_stream(inner, compression=None)


def _page(page_id) -> str:
    return f"<urn:page:{'' if pd.isna(page_id) else int(page_id)}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record. A revisit keeps the HTTP head, whose Content-Length tells the payload's size."""
    revisit = not pd.isna(refers_to)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if isinstance(url, str) and url else _page(page_id)[1:-1]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_page(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(path: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces of bounded size."""
    with _open(path, "rb") as f:
        z = zlib.decompressobj(31)
        while data := f.read(CHUNK):
            while data:
                yield z.decompress(data, CHUNK)
                data = z.unconsumed_tail
                if z.eof:
                    data, z = z.unused_data, zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head fields, whole record) of every record of a stream; holds one record at a time."""
    buffer = bytearray()

    def need(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not need(seen + 1):
                if buffer.strip():
                    raise ValueError("a record is cut off")
                return
        fields = parse_head(bytes(buffer[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not need(size):
            raise ValueError("a record is cut off")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def _write_partition(folder: str, date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = None
        n, z = 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        for b in batches:
            for page_id, url, html, refers_to in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                if out is None:
                    path = f"{folder}/whole/{uuid.uuid4().hex}.warc.gz"
                    out = _open(path, "wb")
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.write(z.compress(record_bytes(page_id, url, payload, digest, refers_to, date)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"path": [path], "n": [n]})

    return write


def write_archives(pages: DataFrame, *, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html) and return a table of the files (path, n).

    Of rows with equal payloads of at least min_revisit_bytes the one with the largest page_id is a
    response and the others revisit it. Digests are summed up before the shuffle, and only those held
    by several rows are joined back: as a broadcast table up to SENT of them.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    several = saved(pages.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).filter("copies > 1"))
    # Pages with unlike payloads need not move where the repeated ones are few; else those of one payload with very many copies don't.
    met = pages.join(F.broadcast(several), "digest", "left") if several.count() <= SENT else joined(pages, several, "digest", "copies", pages.count(), "left")
    rows = met.select("page_id", "url", "html", F.when(F.octet_length("html") >= min_revisit_bytes, F.expr("if(page_id <=> newest, null, newest)")).alias("refers_to"))
    return saved(rows.mapInPandas(_write_partition(shared_dir(pages.sparkSession), date), "path string, n long"))


def _normalise_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path in b["path"]:
            to = path.replace("/whole/", "/members/").removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.warc.gz"
            offset = n = 0
            with _open(to, "wb") as out, _open(f"{to}.idx", "wb") as index:
                for fields, raw in records(inflate(path)):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    out.write(member)
                    index.write((json.dumps({"id": fields["warc-record-id"], "offset": offset, "length": len(member)}) + "\n").encode())
                    offset, n = offset + len(member), n + 1
            yield pd.DataFrame({"path": [to], "n": [n]})


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite archives (path) of any gzip layout with one member a record; `<path>.idx` lists offsets."""
    files = archives.select("path")
    return saved(files.repartition(max(1, files.count()), "path").mapInPandas(_normalise_partition, "path string, n long"))


def _lines(path: str) -> Iterator[str]:
    rest = b""
    with _open(path, "rb") as f:
        while data := f.read(CHUNK):
            *whole, rest = (rest + data).split(b"\n")
            yield from (x.decode() for x in whole)


def _read_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda x: int(m[1]) if x and (m := re.search(r"urn:page:(-?\d+)", x)) else None
    for b in batches:
        for path in b["path"]:
            rows = []
            with _open(path, "at") as f:
                for line in _lines(f"{path}.idx"):
                    at = json.loads(line)
                    f.seek(at["offset"])
                    raw = zlib.decompress(f.read(at["length"]), 31)
                    end = raw.index(b"\r\n\r\n")
                    fields = parse_head(raw[:end])
                    block = raw[end + 4 : end + 4 + int(fields["content-length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{at['id']} in {path} does not have its digest")
                    rows.append((number(fields["warc-record-id"]), int(parse_head(http)["content-length"]), digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
                    if len(rows) == 4096:
                        yield _frame(rows)
                        rows = []
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [x.split()[0] for x in RESULT.split(", ")]
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, each read by its offset and checked against its digest."""
    return archives.select("path").mapInPandas(_read_partition, RESULT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(normalise(write_archives(table(spark, sf_dir, "pages"))))
