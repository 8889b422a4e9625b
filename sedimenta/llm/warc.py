"""WARC archives under per-archive Zstandard dictionaries.

Each task gathers records up to `archive_bytes`, builds a dictionary from a spread of them, and makes one archive: a skippable frame
(0x184D2A5D) with the dictionary, then one Zstandard frame for each record, so that any record can be read by its offset. Archives are
rows (name, bytes) of a table below the shared folder, which any Hadoop file system holds; `export_archives` writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import batches_of, table, written

MAGIC = 0x184D2A5D
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES, LEVEL, SLICE = 16 << 20, 64 << 10, 2 << 20, 3, 16 << 10
#: The records' date; pages have none of their own.
DATE = "1970-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, revisit: bool, url: str | None) -> str:
    """Of a response by page and digest alone, so that a revisit can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{digest}:{url if revisit else chr(0)}')}>"


def _block(payload: bytes) -> bytes:
    """An HTTP response that carries the payload."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has headers only and names the record, digest and length of the payload it repeats."""
    body = b"" if revisit else _block(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, revisit, url)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {length}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c else "%%%02X" % ord(c) for c in url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, False, None)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info_record(date: str = DATE) -> bytes:
    """The warcinfo record that leads an archive."""
    body = b"software: sedimenta\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, 'warcinfo')}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload); the payload of a response is the body of its HTTP message."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) < n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("broken record")
    body = rest[:n]
    return fields, body.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else body


def make_dictionary(records: list[bytes], dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Trained on a spread of at most sample_bytes; where too little is there to train on, the raw bytes of the sample's end."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    sample, total = [], 0
    for r in records[::step]:
        r = r[: 64 << 10]
        if total + len(r) > sample_bytes:
            break
        sample.append(r)
        total += len(r)
    if len(sample) >= 8:
        try:
            return zstandard.train_dictionary(min(dict_bytes, max(1024, total // 8)), sample, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[-dict_bytes:]


def archive(records: list[bytes]) -> bytes:
    words = make_dictionary(records)
    out = [struct.pack("<II", MAGIC, len(words)), words]
    tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)
    out += [tool.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of all frames; the dictionary comes from the leading skippable frame. Bounded slices go in, so the time is linear."""
    magic, n = struct.unpack("<II", data[:8])
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    words, at, view = data[8 : 8 + n], 8 + n, memoryview(data)
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while at < len(data):
        one, got, fed = tool.decompressobj(), [], at
        while not one.eof:
            if fed >= len(data):
                raise ValueError("broken frame")
            part = view[fed : fed + SLICE]
            got.append(one.decompress(part))
            fed += len(part)
        yield at, b"".join(got)
        at = fed - len(one.unused_data)


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """records (page_id, url, payload, refers_to, revisit) -> written table (name, n_records, data). The leading warcinfo record isn't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            data, n = archive([info_record(date), *held]), len(held)
            name = hashlib.sha1(data).hexdigest() + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["name", "n_records", "data"])

        for batch in batches:
            for page, url, payload, refers, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page, url, payload, digest32(payload), len(payload), refers, again, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return written(batches_of(records.select("page_id", "url", "payload", "refers_to", "revisit"), run, "name string, n_records long, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset), digests taken anew from the payloads read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
        for k, batch in ((k, batch) for batch in batches for k in range(batch.num_rows)):  # one archive in memory at a time
            for name, data in ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()),):
                rows = []
                for at, got in read_archive(data):
                    f, payload = parse(got)
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    if f["WARC-Type"] == "response":
                        digest, n = digest32(payload), len(payload)
                        if f["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{name}: the digest at {at} doesn't fit the payload")
                    else:
                        digest, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Bytes"])
                    rows.append((number("X-Page-Id"), n, digest, f["WARC-Type"], number("X-Refers-To-Page-Id"), name, at))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return batches_of(archives.select("name", "data"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file into a folder that is mounted on all executors (no object store: there, read the table itself); returns (name, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, data in zip(names, datas, strict=True):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(d) for d in datas], pa.int64())], names=["name", "n_bytes"])

    return archives.select("name", "data").mapInArrow(run, "name string, n_bytes long")


def dedup_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, payload, refers_to, revisit), a row each.

    Payloads are html in UTF-8, null as empty, of any length. Equal payloads (SHA-1 and xxhash of them) of min_bytes or more: the smallest
    page_id answers (null ids are larger than all), the others revisit it. Of rows with equal id and payload the one with the least url (null
    last) is what the page is, and the rest revisit the same page as it does or the page itself, each with its own url. A payload with a
    third of all rows meets others as (id, digest) only, after aggregation. Other columns, of any name, play no part; an empty table gives an
    empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.concat_ws("-", F.sha1("payload"), F.hex(F.xxhash64("payload"))))
    light = rows.select("page_id", "digest", F.length("payload").alias("n")).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    light = written(light, "warc-digests")
    first = light.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("copies").alias("all")).where("all > 1")
    again = light.join(first, "digest").where("copies > 1 OR NOT page_id <=> first_id").select("page_id", "digest", "first_id", "copies")
    # only the ids of repeats meet the payloads
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (rows["digest"] == F.col("again_digest"))
    keep = rows.join(again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first_id", "copies"), same, "left")
    other = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    single = keep.where("coalesce(copies, 1) = 1").select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"), other.alias("revisit"))
    if not light.where((F.col("copies") > 1) & (F.col("n") >= min_bytes)).head(1):
        return single
    order = Window.partitionBy("page_id", "digest").orderBy(F.col("url").asc_nulls_last())
    several = keep.where("copies > 1").withColumn("k", F.row_number().over(order))
    return single.unionByName(several.select("page_id", "url", "payload", F.when(other | (F.col("k") > 1), F.col("first_id")).alias("refers_to"), (other | (F.col("k") > 1)).alias("revisit")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(dedup_records(pages)))

