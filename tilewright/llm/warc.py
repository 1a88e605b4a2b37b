"""WARC archives as seekable Zstandard bundles.

Every record is WARC/1.1 text plus payload. Records are grouped into independent frames of about ``FRAME_BYTES``, frames
into bundles of about ``BUNDLE_BYTES``; a bundle ends with the seek table of the public seekable format (a skippable
frame), so any frame is read without the others. A bundle is one binary value, written by Spark next to its index of
``record identifier -> (frame, offset in the frame, length)``: Spark's committer drops the output of lost attempts, and
any store that Spark writes to will do. :func:`export_files` lays bundles out as ``.warc.zst`` files on a mounted store.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from tilewright.llm.common import keep, table

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 16 * 1024 * 1024
LEAST_PAYLOAD = 100        # smaller payloads are never revisits
HOT_SHARE = 1000           # digests with more than 1/HOT_SHARE of the rows: at most HOT_SHARE of them

# Fixed values of the seekable format: magic number of its skippable frame, and of the footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLES = T.StructType([
    T.StructField("bundle", T.StringType()), T.StructField("data", T.BinaryType()),
    T.StructField("index", T.ArrayType(T.StructType([
        T.StructField("record", T.StringType()), T.StructField("frame", T.IntegerType()),
        T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType())])))])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record", T.StringType()), T.StructField("bundle", T.StringType()),
    T.StructField("frame", T.IntegerType()), T.StructField("offset", T.IntegerType())])


def decide(pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` with ``_digest``, ``_bytes`` and ``_refers`` (null: the row is a response).

    Of the rows with one payload of at least ``LEAST_PAYLOAD`` bytes, those with the smallest page_id (null counts as
    the largest) are responses. First identifiers of hot digests, of which there are at most ``HOT_SHARE``, are
    broadcast; the others are joined, so no task gets a hot payload.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("_digest"),
                        F.octet_length(payload).cast("long").alias("_bytes"))
    large = rows.where(F.col("_bytes") >= LEAST_PAYLOAD).select("page_id", "_digest")
    firsts = keep(large.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                  .where((F.col("_n") > 1) & F.col("_first").isNotNull()))
    share = (pages.count() // HOT_SHARE) + 1
    hot = firsts.where(F.col("_n") > share).select("_digest", F.col("_first").alias("_hot_first"))
    rest = firsts.where(F.col("_n") <= share).select("_digest", "_first")
    # The narrow rows of cool digests carry the answer back by page_id; no payload is shuffled for it.
    revisits = (large.join(F.broadcast(hot), "_digest", "left_anti").join(rest, "_digest")
                .where(F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
                .select(F.col("page_id").alias("_p"), F.col("_digest").alias("_d"), "_first").distinct())
    out = rows.join(F.broadcast(hot), "_digest", "left").join(
        revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_digest") == F.col("_d")), "left")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("_hot_first"))
    refers = F.coalesce(F.when((F.col("_bytes") >= LEAST_PAYLOAD) & later, F.col("_hot_first")), F.col("_first"))
    return out.select("page_id", "url", "html", "_digest", "_bytes", refers.alias("_refers"))


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest[:16]}"


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, refers) -> tuple[str, bytes]:
    name = record_name(page_id, digest)
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "urn:none"
    body = b"" if refers is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Payload-Length: {size}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_name(refers, digest)}>"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class BundleWriter:
    """Collects records of one task; gives a bundle whenever one is full."""

    def __init__(self, level: int = 3):
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.clear()

    def clear(self) -> None:
        self.frames, self.table, self.index, self.open, self.done, self.raw = [], [], [], bytearray(), 0, 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append({"record": name, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        self.raw += len(record)
        if len(self.open) >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(bytes(self.open))
            self.table.append(struct.pack("<II", len(frame), len(self.open)))
            self.frames.append(frame)
            self.open = bytearray()

    def bundle(self) -> tuple[bytes, list[dict]]:
        self.end_frame()
        entries = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        data = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries
        index = self.index
        self.clear()
        return data, index


def seek_table(data: bytes) -> list[tuple[int, int]]:
    """(start, compressed length) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    entries = struct.iter_unpack("<II", data[-9 - 8 * count:-9])
    out, at = [], 0
    for packed, _ in entries:
        out.append((at, packed))
        at += packed
    return out


def read_record(frame: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    head, _, rest = frame[offset:offset + length].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def write_bundles(decided: DataFrame) -> DataFrame:
    """One row for each bundle; a bundle's name holds the task's partition, so reruns name it alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct(
            [("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])
        writer, part, made = BundleWriter(), 0, 0

        def out() -> pa.RecordBatch:
            data, index = writer.bundle()
            return pa.RecordBatch.from_pylist([{"bundle": f"{part:06d}-{made:06d}", "data": data, "index": index}], schema)

        for batch in batches:
            payloads = batch.column("html").cast(pa.binary())
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "_digest", "_bytes", "_refers", "_part")]
            for i, (page, url, digest, size, refers, part) in enumerate(zip(*cols)):
                writer.add(*record_bytes(page, url, payloads[i].as_py() or b"", digest, size, refers))
                if writer.raw >= BUNDLE_BYTES:
                    yield out()
                    made += 1
        if writer.raw:
            yield out()

    return decided.withColumn("_part", F.spark_partition_id()).mapInArrow(run, BUNDLES)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records, each taken from its frame by the index. Revisits give the digest and size of the full payload;
    responses are hashed anew, and a digest that differs from the record's raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                            ("record", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("bundle")[i].as_py(), batch.column("data")[i].as_py()
                frames, number, frame, rows = seek_table(data), -1, b"", []
                for entry in batch.column("index")[i].as_py():
                    if entry["frame"] != number:
                        number = entry["frame"]
                        start, packed = frames[number]
                        frame = unpack.decompress(data[start:start + packed])
                    fields, body = read_record(frame, entry["offset"], entry["length"])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {entry['record']} is damaged")
                    page = fields["WARC-Record-ID"].split(":")[2]
                    refers = fields.get("WARC-Refers-To")
                    rows.append({"page_id": None if page == "null" else int(page), "payload_digest": digest,
                                 "payload_bytes": len(body) if kind == "response" else int(fields["WARC-Payload-Length"]),
                                 "record_type": kind, "refers_to": refers and int(refers.split(":")[2]),
                                 "url": fields["WARC-Target-URI"], "record": entry["record"], "bundle": name,
                                 "frame": number, "offset": entry["offset"]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return bundles.mapInArrow(run, RECORDS)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<folder>/<bundle>.warc.zst``; the folder must be mounted on every executor.

    A file appears under its name only when it is whole, and reruns replace it by the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("bundle").to_pylist()
            for name, data in zip(names, batch.column("data")):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data.as_py())
                os.replace(f.name, path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["bundle"])

    return bundles.mapInArrow(run, "bundle string")


def archive(pages: DataFrame) -> DataFrame:
    """Bundles of all pages (``page_id``, ``url``, ``html``; other columns are left out). Null html is an empty payload;
    a null page_id is written as ``null``; repeated rows give repeated records; no pages give no bundles."""
    return keep(write_bundles(decide(pages)))


def op9(spark, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back."""
    return read_bundles(archive(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
                  sha256(encode(coalesce(html, ''))) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first then first end as refers_to
from f
"""
