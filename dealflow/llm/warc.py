"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.session import materialise, work_path

# Fixed values of the file formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000  # payload bytes from which an equal payload is not stored again
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:page:"
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 1 << 21  # what a writer holds back to train its dictionary on
DICTIONARY_BYTES = 16 << 10
CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PLAIN_DICTIONARY = f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <{RECORD_ID}".encode() + _HTTP


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """Parse one record; a wrong version, header, length or end is an error."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name] = value.strip()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in headers:
            raise ValueError(f"no {name} header")
    if not headers["Content-Length"].isdecimal() or len(rest) != int(headers["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"record of {len(rest) - 4} bytes says {headers['Content-Length']}")
    return Record(headers, rest[:-4])


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for records like ``samples``; a plain one if they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(_PLAIN_DICTIONARY)


def write_archive(out, records: Iterator[bytes]) -> tuple[int, int]:
    """Write encoded records to the binary file ``out``: records and bytes written."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if len(held) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    dictionary = train(held)
    payload = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(payload)) + payload)
    tool = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True, write_content_size=True)
    count, written = 0, 8 + len(payload)
    for part in (held, records):
        for record in part:
            frame = tool.compress(record)
            out.write(frame)
            count, written = count + 1, written + len(frame)
    return count, written


def read_archive(source) -> Iterator[Record]:
    """The records of the binary file ``source``, read in chunks; anything but whole, valid frames is an error."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError("no dictionary in front")
    length = struct.unpack("<I", head[4:])[0]
    data = source.read(length)
    if len(data) != length:
        raise ValueError("the dictionary is cut short")
    if data.startswith(FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompress(data)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    left = source.read(CHUNK)
    while left:
        frame, parts = tool.decompressobj(), []
        while not frame.eof:
            if not left and not (left := source.read(CHUNK)):
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(left))
            left = b""
        left = frame.unused_data or source.read(CHUNK)
        yield decode_record(b"".join(parts))


def _page_records(batches, date: str) -> Iterator[bytes]:
    for batch in batches:
        for page, url, html, kind, digest, refers in zip(*[batch[c].to_pylist() for c in ("page", "url", "html", "kind", "digest", "refers")], strict=True):
            body = (html or "").encode()
            headers = {"WARC-Type": kind, "WARC-Record-ID": f"<{RECORD_ID}{quote(page or '')}>", "WARC-Date": date}
            if url is not None:
                headers["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))) + "%")
            headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
            headers["Content-Type"] = "application/http; msgtype=response"
            block = _HTTP % len(body)
            if kind == "revisit":
                headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{RECORD_ID}{quote(refers)}>"}
            else:
                block += body
            yield encode_record(headers, block)


def write_pages(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, date: str = DATE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in ``folder``, one per task: ``path, records, bytes``.

    Of equal payloads of ``least`` bytes or more the one with the largest ``page_id`` is stored and the others are
    revisits of it; rows that repeat that id are stored too, and payloads known by null ids only are all stored.
    A null html is an empty payload, a null URL leaves its header out. The result is stored: an archive counts only
    if its task's row got there, so what a lost task or a second attempt leaves behind is never read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").alias("page"), "url", F.col("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size")
    )
    equal = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("stored"), F.count(F.lit(1)).alias("n"))
    kept = equal.where("n > 1 AND stored IS NOT NULL").select(F.col("digest").alias("_digest"), F.col("size").alias("_size"), "stored")
    known = rows.join(kept, (rows["digest"] == kept["_digest"]) & (rows["size"] == kept["_size"]), "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page").eqNullSafe(F.col("stored"))
    ready = known.select(
        F.col("page").cast("string").alias("page"),
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        "digest",
        F.col("stored").cast("string").alias("refers"),
    )

    def write(batches):
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(place.rpartition("/")[0], recursive=True)

        def all_batches():
            yield first
            yield from batches

        with system.open_output_stream(place) as out:
            count, size = write_archive(out, _page_records(all_batches(), date))
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    return materialise(ready.mapInArrow(write, "path string, records long, bytes long"), "archives")


def _row(record: Record) -> dict:
    """What a record says of its page, the digest checked against the payload where there is one."""
    headers, block = record
    http, gap, body = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?mi)^content-length: *(\d+)", http)
    if not gap or not said:
        raise ValueError("no HTTP header in the block")
    size, kind = int(said[1]), headers["WARC-Type"]
    method, _, value = headers["WARC-Payload-Digest"].partition(":")
    digest = base64.b32decode(value)
    if method != "sha1" or kind == "response" and (len(body) != size or hashlib.sha1(body).digest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} differs from its header")
    if kind not in ("response", "revisit") or kind == "revisit" and "WARC-Refers-To" not in headers:
        raise ValueError(f"unexpected record of type {kind}")
    page = headers["WARC-Record-ID"].strip("<>").removeprefix(RECORD_ID)
    refers = headers["WARC-Refers-To"].strip("<>").removeprefix(RECORD_ID) if kind == "revisit" else None
    return {
        "page_id": unquote(page) or None, "url": headers.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digest.hex(), "record_type": kind, "refers_to": unquote(refers) if refers else None, "payload": body,
    }


def read_pages(spark: SparkSession, archives: DataFrame, payload: bool = True) -> DataFrame:
    """Read the archives listed in ``archives(path, records)``: one row per record, ids as text.

    Columns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, unless left out, ``payload``
    (empty for a revisit). Each archive is one task; a count that differs from ``records`` is an error.
    """
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    schema += ", payload binary" if payload else ""
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                rows: list[dict] = []
                size = count = 0
                with system.open_input_stream(place) as source:
                    for record in read_archive(source):
                        rows.append(_row(record))
                        count, size = count + 1, size + len(record.block)
                        if len(rows) >= 4096 or size >= 16 * CHUNK:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if count != records:
                    raise ValueError(f"{path} has {count} records instead of {records}")
                if rows:
                    yield _batch(rows, names)

    tasks = max(1, min(archives.count(), 100_000))
    return archives.select("path", "records").repartition(tasks).mapInArrow(read, schema)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back: one row per page, ids of their own type."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    found = read_pages(spark, write_pages(pages, work_path(spark, "warc")), payload=False)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
