import base64
import hashlib
import os
import struct

import pytest
import zstandard

from quarry.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_archive_layout():
    """A leading skippable frame with the dictionary, then one frame a record that needs it."""
    records = [warc.record_bytes(i, f"http://x/{i}", b"<p>some text</p>" * (i + 1), "D", None) for i in range(300)]
    data = warc.archive_bytes(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0
    own = zstandard.ZstdCompressionDict(data[8:8 + size])
    at, seen = 8 + size, []
    while at < len(data):
        step = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
        seen.append(step.decompress(data[at:]))
        at = len(data) - len(step.unused_data)
    assert seen == records


@pytest.mark.parametrize("payload", [b"", b"x", b"\r\n\r\nWARC/1.1\r\n", b"a" * 3_000_000, "ümläut".encode()])
def test_records_read_back(payload):
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    data = warc.archive_bytes([warc.record_bytes(5, "http://x/ü y", payload, digest, None), warc.record_bytes(None, None, payload, digest, 5)])
    assert list(warc.read_archive(data)) == [(5, "http://x/%C3%BC%20y", len(payload), digest, "response", None, payload),
                                             (None, None, len(payload), digest, "revisit", 5, b"")]


def test_damage_is_noticed():
    good = warc.archive_bytes([warc.record_bytes(1, None, b"abc", "WRONG", None)])
    with pytest.raises(ValueError):
        list(warc.read_archive(good))


def test_odd_pages(spark, tmp_path):
    long = "x" * 2_000_000
    rows = [(3, "u", "same"), (1, "u", "same"), (2, None, "same"), (1, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", long), (None, "u", "same"),
            (None, "u", "lone"), (7, "a\r\nb", "seven")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA + ", sha1 string").repartition(3)
    files = warc.write_warc(pages, str(tmp_path / "w"), archive_limit=1000)
    back = warc.read_warc(spark, str(tmp_path / "w"), files).collect()
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in back)
    assert kinds == sorted([("1", "response", "None", 4)] * 2 + [("2", "revisit", "1", 4), ("3", "revisit", "1", 4), ("None", "revisit", "1", 4),
                           ("4", "response", "None", 0), ("5", "revisit", "4", 0), ("6", "response", "None", 2_000_000), ("None", "response", "None", 4),
                           ("7", "response", "None", 5)])
    assert next(r.payload for r in back if r.page_id == 6) == long.encode()
    assert files.agg({"records": "sum"}).first()[0] == 10 and len(os.listdir(tmp_path / "w")) == files.count()
    with open(tmp_path / "w" / "stray.warc.zst", "wb") as f:                    # left by a failed attempt: not listed, not read
        f.write(b"junk")
    assert warc.read_warc(spark, str(tmp_path / "w"), files).count() == 10
    apart = warc.plan_records(pages, min_payload=5).where("refers_to is not null")
    assert apart.count() == 0                                                    # small payloads never revisit


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
