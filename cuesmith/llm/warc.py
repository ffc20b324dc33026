"""Zstandard WARC archives: a dictionary in the leading skippable frame, one frame per record, checked headers and lengths."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesmith.llm.common import save

#: Of the skippable frame that holds a dictionary, and of a plain frame.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which an archive is closed, bytes of it from which its dictionary is trained, and the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 16 << 10
#: Bytes of an archive that the reader takes at a time.
READ = 1 << 16
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2025-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format; the message names the place."""


def sha1_base32(data: Column) -> Column:
    """Base32 SHA-1 as a column expression: each five hex digits are four letters."""
    hexes = F.sha1(data)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(hexes, group * 5 + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


# ---------------------------------------------------------------- one archive


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record with its Content-Length."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records as one archive, each compressed alone with a dictionary trained on the first of them; too few to train on: none."""
    dictionary, sample, n = b"", [], 0
    for r in records:
        if n < SAMPLE_BYTES:
            sample.append(r[: 32 << 10])
            n += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, n // 8)), sample, k=64, d=8, steps=1, threads=1) if len(sample) > 7 else None
    except zstandard.ZstdError:
        trained = None
    if trained is not None:
        raw = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        dictionary = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    return dictionary + b"".join(map(packer.compress, records))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and content of each record's frame. The dictionary, itself plain or compressed, is loaded from the leading skippable frame."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise WarcError("the dictionary's frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError(f"{len(data) - at} stray bytes at {at}")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            stop = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if stop > len(data):
                raise WarcError(f"the skippable frame at {at} is cut off")
            at = stop
            continue
        if magic != FRAME:
            raise WarcError(f"no frame begins at {at}")
        one, parts, stop = unpacker.decompressobj(), [], at
        try:
            while not one.eof and stop < len(data):
                parts.append(one.decompress(data[stop : stop + READ]))
                stop += READ
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at {at} doesn't decode: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at {at} is cut off")
        yield at, b"".join(parts)
        at = min(stop, len(data)) - len(one.unused_data)


def parse(content: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of the one record in a frame, with its version, needed fields and lengths checked."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"the header at {at} isn't UTF-8: {e}") from e
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC header at {at}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"header line {line!r} at {at}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name} at {at}")
    size = fields["content-length"]
    if not (size.isascii() and size.isdigit()) or len(rest) != int(size) + 4 or rest[int(size) :] != b"\r\n\r\n":
        raise WarcError(f"content length {size} at {at}, but {len(rest) - 4} bytes")
    return fields, rest[: int(size)]


# ---------------------------------------------------------------- tables of archives

ARCHIVES = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_records", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives (content, n_records) that hold one record per row of pages, the payload being html in UTF-8 (null: empty).

    Of rows with equal payloads of at least `least_bytes`, that with the smallest id is a response and the others revisit it; smaller
    payloads are all responses. Rows that repeat the smallest id are responses each; null ids come after all others, and rows without any
    id but null are responses. Equal payloads are counted by digest with map-side sums; the rows then join one row per digest, a join
    that Spark may split where a digest is hot. An archive holds about 8 MB of payload, or one longer payload.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), sha1_base32(payload).alias("digest"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    joined = rows.join(first, "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(waiting)], pa.binary()), pa.array([len(waiting)], pa.int64())], ARCHIVES.names)

        for batch in batches:
            for digest, page, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                digest, page, url, body, first = digest.as_py(), page.as_py(), url.as_py(), payload.as_py(), first.as_py()
                again = first is not None and page != first
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if again:
                    fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{first}>")]
                waiting.append(record(fields, http if again else http + body))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    waiting.clear()
                    size = 0
        if waiting:
            yield closed()

    return joined.select("digest", "id", "url", "payload", "first").mapInArrow(write, ARCHIVES)


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a binary column, such as spark.read.format("binaryFile") gives.

    record_id, target_uri, record_type, refers_to, payload_digest, payload_bytes and (unless payloads is False) the payload. Frames,
    headers, record lengths, HTTP lengths and payload digests are checked and a broken archive fails with WarcError. A revisit has no payload of
    its own; its payload's length is that of the HTTP header it repeats. Null contents hold no record; other columns aren't read.
    Records are decoded one by one.
    """
    schema = RECORDS if payloads else T.StructType(RECORDS.fields[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0):
                if not one.is_valid:
                    continue
                rows, size = [], 0
                for at, frame in frames(one.as_py()):
                    fields, block = parse(frame, at)
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, sep, body = block.partition(b"\r\n\r\n")
                    lengths = [line[15:].strip() for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:"]
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if not sep or len(lengths) != 1 or not lengths[0].isdigit():
                        raise WarcError(f"no HTTP length at {at}")
                    lengths = [int(lengths[0])]
                    if kind == "revisit" and (body or fields.get("warc-profile") != IDENTICAL or "warc-refers-to" not in fields):
                        raise WarcError(f"revisit at {at} with a payload or without its profile and origin")
                    if kind == "response" and (len(body) != lengths[0] or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise WarcError(f"payload at {at} against its length or digest")
                    rows.append((fields["warc-record-id"], fields.get("warc-target-uri"), kind, fields.get("warc-refers-to"), digest, lengths[0], body if payloads else None))
                    size += len(body) if payloads else 0
                    if len(rows) >= 2048 or size >= ARCHIVE_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)

    return archives.select(content).mapInArrow(read, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in range(len(schema))], schema.names)


def page_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """pages written as archives into shared storage and read back: one row per page."""
    back = read_archives(save(write_archives(pages, **names)), payloads=False)
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
