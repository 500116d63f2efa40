"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task makes one archive, its dictionary frame first, then a warcinfo record
and the records.  Spark's text writer puts the frames one after the other into a file of
the shared folder; its line separator is an empty skippable frame, which every decoder
skips, so the files are valid archives and the write is committed as any other.

Reading: every archive is one ``binaryFile`` row.  The dictionary is loaded from the
leading skippable frame; the length of each frame is read from its block headers, and one
frame is decoded at a time.  Version line, required headers, lengths and digests are
checked; a damaged record becomes a row with its ``problem``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquarry.llm.common import written

#: Magic numbers, little-endian (fixed values): a frame, the dictionary's skippable frame, an empty skippable frame.
FRAME, DICTIONARY = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18"
SEPARATOR = "P*M\x18\0\0\0\0"
#: Pages and bytes that the dictionary is trained on at most, and its own size.
SAMPLE_PAGES, SAMPLE_PAGE_BYTES, DICTIONARY_BYTES = 256, 65_536, 16_384
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX = "<urn:page:"
MAX_RECORD_BYTES = 2**31 - 1


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, key: str, html: str) -> bytes:
    """A dictionary from at most ``SAMPLE_PAGES`` pages; too small a sample is used as it is.

    A hash of the key leaves about four times as many for the sort, whatever the table's size.
    """
    import zstandard

    every = max(1, pages.count() // (4 * SAMPLE_PAGES))
    rows = (
        pages.where((F.pmod(F.xxhash64(key), F.lit(every)) == 0) & F.octet_length(html).between(1, SAMPLE_PAGE_BYTES))
        .orderBy(F.xxhash64(key), F.xxhash64(html)).limit(SAMPLE_PAGES).select(F.col(html).alias("h")).collect()
    )
    samples = [r.h.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode()


def _uri(url: str | None) -> str:
    """A header value: control characters and spaces are percent-encoded, null is empty."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or ""))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit holds the HTTP headers only, whose length tells the payload's."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"{PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"{PREFIX}{refers_to}>")]
    return b"WARC/1.1\r\n" + _headers([*fields, ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:archive:info>"), ("WARC-Date", DATE),
              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(fields) + b"\r\n" + block + b"\r\n\r\n"


def _frames(dictionary: bytes):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True
        )
        head = [DICTIONARY + len(dictionary).to_bytes(4, "little") + dictionary, press.compress(info_record())]
        for batch in batches:
            out = head
            for page_id, url, html, refers_to in zip(*(c for c in batch.columns)):
                out.append(press.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py())))
            head = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return frames


def with_references(pages: DataFrame, key: str, html: str, least_bytes: int = 0) -> DataFrame:
    """``refers_to``: the largest key with the same payload, if it is another one and the payload long enough."""
    digest = F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary"))
    long_enough = F.coalesce(F.octet_length(html), F.lit(0)) >= least_bytes
    rows = pages.withColumn("_digest", F.when(long_enough, digest))
    repeated = (
        pages.select(F.col(key).alias("_key"), F.when(long_enough, digest).alias("_digest")).where("_digest is not null")
        .groupBy("_digest").agg(F.max("_key").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    # Written, so that its size is known: payloads are only shuffled if there are too many repeated ones to broadcast.
    repeated = written(repeated, "archive-repeats")
    other = ~F.col(key).eqNullSafe(F.col("_last"))
    return rows.join(repeated, "_digest", "left").withColumn("refers_to", F.when(other, F.col("_last"))).drop("_digest", "_last")


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> None:
    """One archive per task below ``folder``.

    A null payload is empty; a null key is smaller than any other and has an empty id; rows
    with the same key and payload are all responses; other columns are left out.
    """
    rows = with_references(pages.select(key, url, html), key, html, least_bytes).select(
        F.col(key).cast("bigint"), F.col(url), F.col(html), F.col("refers_to").cast("bigint")
    )
    dictionary = train_dictionary(pages, key, html)
    framed = rows.mapInArrow(_frames(dictionary), "frame binary").select(F.col("frame").cast("string"))
    framed.write.option("lineSep", SEPARATOR).text(folder)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its header and block headers."""
    if 0x184D2A50 <= int.from_bytes(data[at : at + 4], "little") <= 0x184D2A5F:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif bytes(data[at : at + 4]) == FRAME:
        descriptor = data[at + 4]
        single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
        size_bytes = (single, 2, 4, 8)[descriptor >> 6]
        place = at + 5 + (1 - single) + (0, 1, 2, 4)[descriptor & 3] + size_bytes
        while True:
            block = int.from_bytes(data[place : place + 3], "little")
            if place + 3 > len(data):
                raise ValueError("frame is cut off")
            place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        end = place + 4 * checksum
    else:
        raise ValueError("no frame")
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def parse_record(data: bytes) -> dict:
    """Headers and block of one record; raises ``ValueError`` for anything out of order."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("wrong block digest")
    return {"headers": headers, "block": block}


def _page(data: bytes) -> tuple | None:
    """``(page_id, url, type, refers_to, digest, bytes, payload, None)`` of a page's record."""
    parsed = parse_record(data)
    headers, kind = parsed["headers"], parsed["headers"]["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = parsed["block"].partition(b"\r\n\r\n")
    length = next((v for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:]) if k.lower() == "content-length"), "")
    if not gap or not length.strip().isdigit():
        raise ValueError("no HTTP header")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(length) or base32_sha1(payload) != digest):
        raise ValueError("payload differs from its header")

    def number(name: str) -> int | None:
        text = headers.get(name, "")
        if not text:
            return None
        if not (text.startswith(PREFIX) and text.endswith(">")):
            raise ValueError(f"bad {name}")
        text = text[len(PREFIX) : -1]
        return int(text) if text else None

    text = payload.decode("utf-8", "replace") if kind == "response" else None
    return number("warc-record-id"), headers.get("warc-target-uri"), kind, number("warc-refers-to"), digest, int(length), text, None


FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload string, problem string"
BATCH = 256


def _reader(batches: Iterator[pa.RecordBatch], payloads: bool = True) -> Iterator[pa.RecordBatch]:
    import zstandard

    schema = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string()}[t]) for n, t in (f.split() for f in FIELDS.split(", "))])

    def rows(content: bytes) -> Iterator[tuple]:
        data, at = memoryview(content), 0
        press = None
        try:
            while at < len(data):
                end = frame_end(data, at)
                frame = data[at:end]
                at = end
                if press is None:
                    dictionary = bytes(frame[8:]) if bytes(frame[:4]) == DICTIONARY else b""
                    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                    if bytes(frame[:4]) == DICTIONARY:
                        continue
                if bytes(frame[:4]) != FRAME:
                    continue
                try:
                    found = _page(press.decompress(frame, max_output_size=MAX_RECORD_BYTES if zstandard.frame_content_size(frame) < 0 else 0))
                except (ValueError, zstandard.ZstdError) as error:
                    found = (None,) * 7 + (str(error)[:200],)
                if found:
                    yield found if payloads else (*found[:6], None, found[7])
        except (ValueError, IndexError) as error:
            yield (None,) * 7 + (str(error)[:200],)

    for batch in batches:
        for content in batch.column(0):
            held = []
            for row in rows(content.as_py()):
                held.append(row)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for every response, revisit and damaged record of all archives below a folder.

    Payloads come with responses only, and are null without ``payloads``, though they are
    decoded and checked; length and digest are those of the full payload.
    Reading goes on behind a damaged record, and stops in an archive where no frame is found.
    """
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(partial(_reader, payloads=payloads), FIELDS)


