import base64
import hashlib
import io
import random
import struct

import pytest
import zstandard

from provenant.llm import warc
from provenant.llm.common import new_folder

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(0)
    body = lambda n: "<html>" + " ".join(f"w{rng.randrange(500)}" for _ in range(n)) + "</html>"
    rows = [(i, f"http://h{i % 7}.example/{i}", body(60)) for i in range(80)]
    rows += [(100 + i, "http://x.example/é ü\r\nInjected: 1", rows[3][2]) for i in range(5)]
    rows += [(200, None, None), (201, "", ""), (202, "u", None), (None, "http://n.example/", rows[4][2]), (None, "q", "only null ids"), (3, rows[3][1], rows[3][2]), (300, "big", "ÿ\r\n\r\nWARC/1.1\r\n" * 40000)]
    return rows


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == p and j is not None]
        first = min(same, default=None)
        revisit = len(p) >= least and sum((x or "").encode() == p for _, _, x in rows) > 1 and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pages(), PAGES).withColumns({"d": F.lit(1), "first": F.lit(2), "many": F.lit(3), "revisit": F.lit(4)})
    paths = warc.write_archives(df, new_folder(spark, "w"), warc.Params(least_bytes=least))
    got = warc.read_archives(spark, paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(pages(), least)))


def test_file_form():
    """A skippable frame with the dictionary, then one frame per record that the library reads with it."""
    out = io.BytesIO()
    w = warc.Writer(out, warc.Params(sample_bytes=50_000))
    raw = [warc.record(i, f"http://a.example/{i}", f"<p>hello {i} and some words that repeat {i % 7}</p>".encode() * 20, None, False, warc.Params()) for i in range(300)]
    for r in raw:
        w.add(r)
    w.close()
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    d, rest, seen = zstandard.ZstdCompressionDict(data[8:8 + size]), data[8 + size:], []
    assert d.dict_id()
    while rest:
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        seen.append(o.decompress(rest))
        rest = o.unused_data
    assert seen[1:] == raw and b"warcinfo" in seen[0]
    plain = sum(len(zstandard.ZstdCompressor(level=6).compress(r)) for r in raw)
    assert len(data) - size < plain
    assert [h["warc-record-id"] for h, _ in warc.read_records(io.BytesIO(data))][1:] == [f"<urn:page:{i}>" for i in range(300)]


def test_damage_is_seen():
    out = io.BytesIO()
    w = warc.Writer(out, warc.Params())
    w.add(warc.record(1, None, b"payload" * 100, None, False, warc.Params()))
    w.close()
    data = bytearray(out.getvalue())
    data[-8] ^= 1
    with pytest.raises((zstandard.ZstdError, ValueError)):
        list(warc.read_records(io.BytesIO(bytes(data))))


def test_headers_cannot_be_injected():
    r = warc.record(1, "http://a/\r\nX: y", b"", None, False, warc.Params())
    assert b"\r\nX: y" not in r and b"%0D%0AX:%20y" in r


def test_empty(spark):
    paths = warc.write_archives(spark.createDataFrame([], PAGES), new_folder(spark, "w"))
    assert paths == [] and warc.read_archives(spark, paths).count() == 0
