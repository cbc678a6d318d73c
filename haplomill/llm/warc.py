"""Web archives of records compressed one by one under a shared Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary, then has one frame for each
record. `write_archives` writes pages as `response` records, and pages whose payload another page
has as `revisit` records without payload; `read_archives` loads the dictionary, decodes frame by
frame, and checks headers, lengths and digests. The archives' bytes come through the file system of
the folder's URI as a stream, so that an archive of any length is read in bounded memory.

Which page keeps a payload is found from digests alone, counted before they are shuffled; only
digests that come twice are joined back, salted, to the pages' digests, and only the resulting
revisits to the pages. Payloads are shuffled once, compressed.

Defined cases: a null payload is empty; a null URL writes no target URI; a null id is written as a
record without number, is never referred to and reads back as null; rows that repeat the smallest
id of a payload are all responses; no rows make no archive and give no rows; other columns are
ignored. A record of any length is one frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, open_fs, table, tidy, write_file

MAGIC = 0x184D2A5D  # of the skippable frame that holds the dictionary
FRAME = 0xFD2FB528
MIN_SHARED = 100  # bytes from which equal payloads are stored once
ARCHIVE_BYTES = 64 << 20  # of payload in an archive, before compression
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20  # of an archive's first payloads, from which its dictionary is made
SALTS = 16
LEVEL = 3
ARCHIVES = "path string, n_records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
PAGE_URI = "urn:x-page:"


class BadArchive(ValueError):
    """An archive, a frame or a record that is not what it says."""


def record_bytes(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes | None, length: int, digest: str) -> bytes:
    """A record: its headers, then the HTTP headers and, of a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PAGE_URI}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_URI}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(": ")
        if not colon or not name:
            raise BadArchive(f"a header without a name: {line[:80]!r}")
        if name.lower() in out:
            raise BadArchive(f"a header that comes twice: {name}")
        out[name.lower()] = value
    return out


def _number(uri: str) -> int | None:
    if not (uri.startswith(f"<{PAGE_URI}") and uri.endswith(">")):
        raise BadArchive(f"a record's URI: {uri[:80]}")
    number = uri[len(PAGE_URI) + 1 : -1]
    return int(number) if number else None


def parse_record(data: bytes) -> tuple:
    """A record as a row of RECORDS, after all its lengths and digests were checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("a record without a version")
    h = _headers(lines[1:])
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - h.keys()
    if missing:
        raise BadArchive(f"a record without {', '.join(sorted(missing))}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"a record whose block has {len(rest) - 4} bytes, not {h['content-length']}")
    block = rest[:-4]
    if h["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadArchive("a block that differs from its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    http_lines = http.decode().split("\r\n")
    if not gap or not http_lines[0].startswith("HTTP/"):
        raise BadArchive("a block without HTTP headers")
    length, digest = int(_headers(http_lines[1:])["content-length"]), h["warc-payload-digest"].removeprefix("sha256:")
    kind, refers_to = h["warc-type"], None
    if kind == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("a payload that differs from its length or digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in h:
            raise BadArchive("a revisit with a payload or without a reference")
        refers_to, payload = _number(h["warc-refers-to"]), None
    else:
        raise BadArchive(f"a record of type {kind}")
    url = h.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return _number(h["warc-record-id"]), url, kind, refers_to, length, digest, payload


def make_dictionary(samples: list[bytes]):
    """A dictionary from the first payloads: trained where there are enough, else their beginnings."""
    import zstandard

    samples = [s for s in samples if s]
    if len(samples) >= 32 and sum(map(len, samples)) >= 10 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too little in common to train on
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"<html></html>", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], samples: list[bytes]) -> Iterator[bytes]:
    import zstandard

    dictionary = make_dictionary(samples)
    raw = dictionary.as_bytes()
    yield struct.pack("<II", MAGIC, len(raw)) + raw
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for record in records:
        yield compressor.compress(record)


def archive_records(stream) -> Iterator[bytes]:
    """The records of an open archive, a frame each."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise BadArchive("an archive without a dictionary frame")
    magic, length = struct.unpack("<II", head)
    if magic != MAGIC:
        raise BadArchive("an archive that does not start with a dictionary frame")
    raw = stream.read(length)
    if len(raw) < length:
        raise BadArchive("a dictionary frame that is cut")
    if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor, data = zstandard.ZstdDecompressor(dict_data=dictionary), b""
    while data := data or stream.read(1 << 20):
        while len(data) < 4 and (more := stream.read(1 << 20)):
            data += more
        if data[:4] != struct.pack("<I", FRAME):
            raise BadArchive("bytes that start no frame")
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(1 << 20)):
                raise BadArchive("a frame that is cut")
        yield b"".join(parts)


def decisions(digests: DataFrame) -> DataFrame:
    """Of rows (page_id, length, digest) those that revisit: page_id, digest, refers_to."""
    shared = digests.where((F.col("length") >= MIN_SHARED) & F.col("page_id").isNotNull())
    owners = shared.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a payload that many pages share is met by SALTS tasks, each with a copy of its owner
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = shared.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    return salted.join(owners, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row; returns the archives that finished."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = materialize(rows.select("page_id", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest")), "digests")
    revisits = materialize(decisions(digests), "revisits")

    def shrink(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            payloads = [x.as_py() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()), pa.array([compress(x) for x in payloads], pa.binary())], ["page_id", "url", "digest", "packed"])

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        partition, number = TaskContext.get().partitionId(), 0
        records, samples, held, sampled = [], [], 0, 0
        unpack = zstandard.ZstdDecompressor().decompress

        def flush() -> pa.RecordBatch:
            path = write_file(folder, f"pages-{partition:06d}-{number:04d}", archive_bytes(records, samples))
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([len(records)], pa.int64())], ["path", "n_records"])

        for batch in batches:
            for page, url, digest, packed, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = unpack(packed)
                if sampled < SAMPLE_BYTES and refers_to is None:
                    samples.append(body[: SAMPLE_BYTES // 8])
                    sampled += len(samples[-1])
                records.append(record_bytes(page, url, "response" if refers_to is None else "revisit", refers_to, body, len(body), digest))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    records, samples, held, sampled, number = [], [], 0, 0, number + 1
        if records:
            yield flush()

    packed = rows.mapInArrow(tidy(shrink), "page_id long, url string, digest string, packed binary")
    joined = packed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "digest", "packed", "refers_to")
    return materialize(joined.mapInArrow(tidy(write), ARCHIVES), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives in column `path`."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(at) as stream:
                    for record in archive_records(stream):
                        rows.append(parse_record(record))
                        held += len(record)
                        if held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    tasks = 4 * max(archives.sparkSession.sparkContext.defaultParallelism, 1)
    return archives.select("path").repartition(tasks).mapInArrow(tidy(read), RECORDS)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
