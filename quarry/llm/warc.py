"""Operator 7: write pages as dictionary-compressed WARC archives, and read such archives.

An archive is a ``.warc.zst`` file: a skippable frame that holds a Zstandard dictionary built from
the archive's own records, then each record compressed as a frame of its own with it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_folder, stage

#: An archive is closed at about so many bytes of records, which a task holds in memory.
ARCHIVE_BYTES = 24 << 20
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
MIN_PAYLOAD = 0
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the formats: the skippable frame's magic number, and the profile of a revisit.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = "urn:x-page:"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, payload, sha1 hex, refers_to): null refers_to means a response record.

    Digests are counted with pre-aggregation, so a payload that a third of all pages share costs a
    row per task; only digests seen more than once are joined back.
    """
    payload: Column = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    shared = rows.where(F.octet_length("payload") >= min_payload).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = stage(shared.where("n > 1").select("sha1", "first"), "warc-shared")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_payload)
    return (rows.join(shared, "sha1", "left").select("page_id", "url", "payload", "sha1", F.when(revisits, F.col("first")).alias("refers_to")))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record.  A revisit has the HTTP header, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary from evenly spaced records; from too few of them, their plain bytes."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[:SAMPLE_BYTES // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], level: int = LEVEL) -> bytes:
    own = build_dictionary(records)
    own.precompute_compress(level=level)
    pack = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True).compress
    plain = own.as_bytes()
    return struct.pack("<II", DICT_MAGIC, len(plain)) + plain + b"".join(map(pack, records))


def read_archive(data: bytes):
    """Yields (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record.

    The payload of a response is checked against its digest; a damaged archive raises.
    """
    start, options = 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        start = 8 + struct.unpack_from("<I", data, 4)[0]
        options["dict_data"] = zstandard.ZstdCompressionDict(data[8:start])
    stream = zstandard.ZstdDecompressor(**options).stream_reader(memoryview(data)[start:], read_across_frames=True)
    held = b""
    while True:
        while b"\r\n\r\n" not in held:
            more = stream.read(1 << 16)
            if not more:
                if held:
                    raise ValueError("the archive ends within a record")
                return
            held += more
        head, held = held.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC 1.1 record: {version[:40]!r}")
        field = dict(x.split(": ", 1) for x in lines)
        length = int(field["Content-Length"])
        if len(held) < length + 4:
            held = b"".join([held, *iter(_exactly(stream, length + 4 - len(held)))])
        block, held = held[:length], held[length + 4:]
        http, payload = block.split(b"\r\n\r\n", 1)
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        digest, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{field['WARC-Record-ID']}: the payload does not fit its digest")
        number = lambda x: int(x[len(_ID) + 1:-1]) if x and len(x) > len(_ID) + 2 else None
        yield number(field["WARC-Record-ID"]), field.get("WARC-Target-URI"), size, digest, kind, number(field.get("WARC-Refers-To")), payload


def _exactly(stream, n: int):
    while n > 0:
        part = stream.read(min(n, 1 << 20))
        if not part:
            raise ValueError("the archive ends within a record")
        n -= len(part)
        yield part


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD,
               archive_limit: int = ARCHIVE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Write a record for every row of ``pages`` into archives in ``folder``; return the list of
    archives (file, records, bytes).

    ``folder`` is one that all executors reach by pyarrow's file systems (a shared mount, HDFS,
    S3).  Each task writes its own archives, under names of their own in every attempt, and only
    attempts that succeed are in the list, so lost executors and repeated tasks leave at most files
    that are not listed.  Of rows with equal payloads of ``min_payload`` bytes or more, those with
    the smallest page_id are responses and the others revisit it.

    Null html: an empty payload.  Null url: no target field.  Null page_id: an empty record id;
    such a row revisits a page with an id and equal payload, and is a response if there is none.
    Repeated rows: each is a record, all responses if their id is the smallest.  Very long pages:
    an archive of their own if need be.  An empty table: no archives.  Other columns are ignored.
    """
    from pyarrow import fs

    target = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    fs.FileSystem.from_uri(target)[0].create_dir(fs.FileSystem.from_uri(target)[1])

    def write(batches):
        store, path = fs.FileSystem.from_uri(target)
        part, run, held, size, done = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], 0, []

        def close():
            nonlocal held, size
            name, data = f"pages-{part:06d}-{len(done):04d}-{run}.warc.zst", archive_bytes(held, level)
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            done.append((name, len(held), len(data)))
            held, size = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, address, payload, sha1, refers_to = row
                held.append(record_bytes(page_id, address, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date))
                size += len(held[-1])
                if size >= archive_limit:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["file", "records", "bytes"])

    planned = plan_records(pages, id_col, url, html, min_payload)
    return stage(planned.mapInArrow(write, "file string, records long, bytes long"), "warc-list")


def read_warc(spark: SparkSession, folder: str, files: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``folder``, or of those that ``files`` (column file) lists.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked
    for, payload (empty for revisits).  No archives give an empty table.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if files is not None:
        found = found.join(F.broadcast(files.select("file")) if files.count() <= 100_000 else files.select("file"), "file", "left_semi")

    def read(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = list(read_archive(data.as_py()))
                cols = list(zip(*rows)) if rows else [[]] * 7
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
                n = 7 if payloads else 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[i], types[i]) for i in range(n)], names=list(names[:n]))

    return found.select("content").mapInArrow(read, _READ if payloads else _READ.rsplit(",", 1)[0])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and read these back."""
    folder = shared_folder(pages.sparkSession, "warc")
    files = write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder, files, payloads=False).drop("url")


_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p WHERE strlen(h) >= {MIN_PAYLOAD} GROUP BY hex)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr({_B32}, CAST(((('0x' || substr(hex, CAST(i // 4 AS BIGINT) * 5 + 1, 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (hex)
"""
