"""WARC (3): archives of pages as .warc.zst with a trained dictionary in a leading skippable frame.

A file starts with a skippable Zstandard frame (magic 0x184D2A5D) that holds the dictionary, then one frame per WARC/1.1
record: a warcinfo record, and one record per page. The dictionary is built from the first records of the file, up to
``sample_bytes``, the only part of a file held in memory; a file with too little to learn from has no dictionary.

Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id becomes a response record,
the others revisit records of profile identical-payload-digest that refer to it; smaller payloads always get responses.
Digests are computed beside the scan and grouped (partial sums first, so a hot payload costs a row per task); the rows
with their payloads are shuffled once, by digest, where adaptive execution splits a hot digest.

A task writes its file under a name of its own and renames it, so a rerun after a lost executor leaves one whole file.

Defined results: a null html is an empty payload; a null page_id is larger than any number and written as ``null``; rows
that repeat the smallest page_id of a payload are all responses; a null url has no target header; control characters in
a url are percent-encoded; an empty table has no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Params:
    least_bytes: int = 0
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6
    dictionary_bytes: int = 1 << 16
    sample_bytes: int = 1 << 22


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _http(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, params: Params) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    block = _http(len(payload)) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {params.date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(params: Params) -> bytes:
    body = b"software: provenant\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(int=0)}>\r\nWARC-Date: {params.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _dictionary(sample: list[bytes], params: Params) -> zstandard.ZstdCompressionDict | None:
    size = min(params.dictionary_bytes, sum(map(len, sample)) // 8)
    if len(sample) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, sample, level=params.level)
    except zstandard.ZstdError:
        return None  # records too uniform or too small to learn from


class Writer:
    """Buffers the first records, then writes the dictionary frame and every record in a frame of its own."""

    def __init__(self, out, params: Params):
        self.out, self.params, self.sample, self.size, self.compressor = out, params, [], 0, None

    def add(self, raw: bytes) -> None:
        if self.compressor:
            self.out.write(self.compressor.compress(raw))
            return
        self.sample.append(raw)
        self.size += len(raw)
        if self.size >= self.params.sample_bytes:
            self._start()

    def _start(self) -> None:
        dictionary = _dictionary(self.sample, self.params)
        if dictionary:
            data = dictionary.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=self.params.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for raw in [_info(self.params), *self.sample]:
            self.out.write(self.compressor.compress(raw))
        self.sample = []

    def close(self) -> None:
        if not self.compressor:
            self._start()


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive."""
    head = file.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        dictionary = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", head[4:])[0]))
    else:
        file.seek(0)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(file, read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, params: Params = Params()) -> list[str]:
    """Writes pages (page_id, url, html) to archives in a folder; their paths come to the driver."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("d"))
    equal = rows.where(F.octet_length("html") >= params.least_bytes).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = equal.select(F.col("d").alias("_d"), "first", F.lit(True).alias("many"))
    met = rows.join(equal.hint("shuffle_hash"), (F.col("d") == F.col("_d")) & (F.octet_length("html") >= params.least_bytes), "left")
    revisit = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (r for b in batches for p in (b.slice(k, 500) for k in range(0, b.num_rows, 500)) for r in zip(*(p.column(c).to_pylist() for c in range(2)), p.column(2).cast(pa.large_binary()).to_pylist(), *(p.column(c).to_pylist() for c in (3, 4))))
        first = next(rows, None)
        if first is None:
            return
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.zst"
        fs, where = _open(path)
        fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        own = f"{where}.{uuid.uuid4().hex[:8]}.tmp"
        with fs.open_output_stream(own) as out:
            writer = Writer(out, params)
            for part in ([first], rows):
                for page_id, url, payload, referred, again in part:
                    writer.add(record(page_id, url, payload, referred, again, params))
            writer.close()
        fs.move(own, where)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    made = met.select("page_id", "url", "html", "first", revisit.alias("revisit")).mapInArrow(work, "path string").collect()
    return sorted(r["path"] for r in made)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Payloads that are
    there are digested again and must agree with their header."""
    out = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    if not paths:
        return spark.createDataFrame([], out)

    def page(urn: str | None) -> int | None:
        value = (urn or "").strip("<>").rpartition(":")[2]
        return int(value) if value.lstrip("-").isdigit() else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in out.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(1).to_pylist():
                fs, where = _open(path)
                found = []
                with fs.open_input_file(where) as file:
                    for headers, block in read_records(file):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (digest(payload) != said or len(payload) != size):
                            raise ValueError(f"{path}: the payload of {headers['warc-record-id']} does not agree with its digest")
                        found.append((page(headers["warc-record-id"]), headers.get("warc-target-uri"), size, said, kind, page(headers.get("warc-refers-to"))))
                        if len(found) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    files = spark.createDataFrame(list(enumerate(paths)), "n int, path string").repartitionByRange(len(paths), "n")
    return files.mapInArrow(work, out)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_folder(spark, "warc"))
    return read_archives(spark, paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT d, min(page_id) AS first FROM p GROUP BY d
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN g USING (d)
"""

QUERIES = {"op3_warc": op3_warc}
SQL = {"op3_warc": OP3_SQL}
