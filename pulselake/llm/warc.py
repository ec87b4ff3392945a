"""WARC archives: writing, turning whole-file gzip into a member per record, and reading by offset index.

``write`` makes archives in which one gzip stream runs over the whole file. ``normalise`` inflates such a stream once, in pieces,
and rewrites each record as a gzip member of its own, with a sidecar of one JSON line a record: offset, length, type,
page. ``read`` takes each record by its offset alone.

Of pages with equal payloads (by SHA-1 and length), if these have at least ``least_bytes`` bytes, the one with the smallest id is
a response, the others are revisits that refer to it and carry no payload. Null html is an empty payload. Pages with a null
id are never referred to unless all equal ones are so; then each is a response. A repeated id with equal payload: one row
is the response, as both would be the smallest, so both are responses. Files have unique names and count only if the
finished job's manifest lists them, so a repeated task does no harm. A file holds ``FILE_BYTES`` of payload at most unless one
page is larger.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import table, written
from pulselake.session import shared_folder

FILE_BYTES = 32_000_000
PIECE = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, not compressed."""
    revisit = refers_to is not None
    body = HTTP if revisit else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Refers-To", _id(refers_to) if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
        ("Page", "" if page is None else str(page)),
        ("Page-Refers-To", str(refers_to) if revisit else None),
        ("Page-Payload-Length", str(len(payload))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces."""
    inflate, left = zlib.decompressobj(31), b""
    while True:
        if not left and not (left := source.read(PIECE)):
            break
        piece = inflate.decompress(left, PIECE)
        left = inflate.unconsumed_tail
        if piece:
            yield piece
        if inflate.eof:
            left, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


def records(source) -> Iterator[bytes]:
    """The records of a gzip file, however its members are cut; no more than one record is held."""
    held = bytearray()
    pieces = _inflated(source)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while held[:2] in (b"", b"\r", b"\r\n") or held[:1] in (b"\r", b"\n"):
            if held[:1] in (b"\r", b"\n"):
                del held[:1]
            elif not more():
                return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header is cut off")
        length = next(
            int(line.split(b":", 1)[1]) for line in bytes(held[:end]).split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")
        )
        while len(held) < end + 4 + length:
            if not more():
                raise ValueError("a record is cut off")
        yield bytes(held[: end + 4 + length]) + b"\r\n\r\n"
        del held[: end + 4 + length]


def _with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with ``refers_to``. Groups of equal payloads are a written table, so a large one can be split in the join."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keyed = keyed.withColumn("size", F.octet_length("html"))
    groups = keyed.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    equal = written(groups.filter((F.col("n") > 1) & (F.col("size") >= least_bytes)).drop("n"), "equal-payloads")
    joined = keyed.join(equal, ["sha", "size"], "left")
    own = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(~own, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as archives of one gzip stream each; the manifest (path) of those that count."""
    folder = shared_folder(pages.sparkSession, "warc")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out = squeeze = name = None
        held = 0

        def close():
            out.write(squeeze.flush())
            out.close()
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            return pa.record_batch([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                if out and held + len(payload) > FILE_BYTES:
                    yield close()
                    out, held = None, 0
                if not out:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, squeeze = fs.open_output_stream(f"{base}/{name}.tmp", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(squeeze.compress(record(page, url, payload, refers_to, date)))
                held += len(payload)
        if out:
            yield close()

    return written(_with_first(pages, least_bytes).mapInArrow(run, "path string"), "warc-manifest")


def normalise(manifest: DataFrame, level: int = 1) -> DataFrame:
    """Rewrite each archive of the manifest (path) with a member per record and a sidecar; the manifest (path, index)."""
    folder = shared_folder(manifest.sparkSession, "warc-members")
    files = manifest.count()

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                origin, place = pafs.FileSystem.from_uri(path)
                offset, lines = 0, []
                with origin.open_input_stream(place, compression=None) as source, fs.open_output_stream(f"{base}/{name}.tmp", compression=None) as out:
                    for raw in records(source):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        fields, _ = parse(raw)
                        line = {"offset": offset, "length": len(member), "type": fields.get("warc-type"), "page": fields.get("page")}
                        lines.append(json.dumps(line))
                        out.write(member)
                        offset += len(member)
                with fs.open_output_stream(f"{base}/{name}.idx.tmp", compression=None) as out:
                    out.write("".join(f"{line}\n" for line in lines).encode())
                for end in ("", ".idx"):
                    fs.move(f"{base}/{name}{end}.tmp", f"{base}/{name}{end}")
                yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([f"{folder}/{name}.idx"])], names=["path", "index"])

    return written(manifest.select("path").repartition(max(1, files)).mapInArrow(run, "path string, index string"), "member-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each taken by its offset.

    A response whose payload does not have the digest of its header is an error.
    """
    files = manifest.count()

    def run(batches):
        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist()):
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(pafs.FileSystem.from_uri(index)[1], compression=None) as source:
                    entries = [json.loads(line) for line in source.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(place) as source:
                    for entry in entries:
                        source.seek(entry["offset"])
                        fields, body = parse(zlib.decompress(source.read(entry["length"]), 31))
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["page-payload-length"])
                        if fields["warc-type"] == "response":
                            payload = body.partition(b"\r\n\r\n")[2]
                            if payload_digest(payload) != digest or len(payload) != size:
                                raise ValueError(f"payload of page {fields['page']} in {path} is damaged")
                        number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
                        rows.append((number("page"), size, digest, fields["warc-type"], number("page-refers-to")))
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return manifest.repartition(max(1, files)).mapInArrow(run, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return read(normalise(write(pages)))


# Base 32 of the digest: each character is five bits, cut from two neighbouring hex digits.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY sha, strlen(html)) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((strpos('0123456789abcdef', substr(sha || '0', 1 + (5 * i) // 4, 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(sha || '0', 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
