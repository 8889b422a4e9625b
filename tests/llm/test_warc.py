import base64
import hashlib
import struct
from collections import Counter

from sedimenta.llm import warc as W

PAGES = [(5, "http://a/1", "<p>one</p>"), (3, "http://a/2", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "http://b", None), (2, "http://c", ""), (4, "http://d\r\nX: y", "é" * 500), (None, "http://e", "<p>one</p>"), (6, "http://f", "<b>" + "x " * 30_000), (7, "http://g", "solo"), (7, "http://g", "solo")]


def brute(pages):
    by = {}
    for i, _, h in pages:
        by.setdefault((h or "").encode(), []).append(i)
    out = Counter()
    for raw, ids in by.items():
        ids = sorted(ids, key=lambda x: (x is None, x))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for n, i in enumerate(ids):
            out[(i, len(raw), digest, "revisit" if n else "response", ids[0] if n else None)] += 1
    return out


def test_rows_of_one_page_and_payload_keep_their_urls(spark):
    rows = [(1, "http://b", "x"), (1, "http://a", "x"), (1, None, "x"), (2, "http://c", "x")]
    made = W.dedup_records(spark.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, html string, payload string, digest int")).collect()
    assert sorted((r["page_id"], r["url"] or "", r["revisit"], r["refers_to"]) for r in made) == [(1, "", True, 1), (1, "http://a", False, None), (1, "http://b", True, 1), (2, "http://c", True, 1)]


def test_reading_takes_linear_time():
    import time

    record, took = W.record(1, "http://h", b"<p>" + b"word " * 150, "D", 0, None, False), []
    for n in (2_000, 16_000):
        data, began = W.archive([record + str(k).encode() for k in range(n)]), time.perf_counter()
        assert sum(1 for _ in W.read_archive(data)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 0.2  # eight times the records; square would be 64


def test_long_payloads_and_standard_fields(spark):
    long_ = "<p>" + "Wört " * 4_000_000  # 20 MB and more
    pages = spark.createDataFrame([(1, "http://h", long_), (2, "http://i", long_)], "page_id long, url string, html string")
    archives = W.write_archives(W.dedup_records(pages))
    got = {r["page_id"]: r for r in W.read_archives(archives).collect()}
    assert got[1]["payload_bytes"] == len(long_.encode()) == got[2]["payload_bytes"] and got[2]["refers_to"] == 1
    records = [W.parse(r) for a in archives.collect() for _, r in W.read_archive(bytes(a["data"]))]
    ids = {f["WARC-Record-ID"]: f for f, _ in records}
    revisit = next(f for f, _ in records if f["WARC-Type"] == "revisit")
    assert ids[revisit["WARC-Refers-To"]]["X-Page-Id"] == "1" and any(f["WARC-Type"] == "warcinfo" for f, _ in records)
    assert next(f for f, _ in records if f["WARC-Type"] == "response")["Content-Type"] == "application/http; msgtype=response"


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.op3_warc(spark, str(tmp_path)).collect())
    assert got == brute(PAGES)


def test_query_on_the_tables(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.op3_warc(spark, sf).collect())
    assert got == brute(pages)


def test_archive_layout_and_random_access():
    records = [W.record(k, f"http://h/{k}", f"<html>{'word ' * 50}{k}</html>".encode(), "D", 0, None, False) for k in range(200)]
    data = W.archive(records)
    magic, n = struct.unpack("<II", data[:8])
    assert magic == W.MAGIC and 0 < n <= W.DICT_BYTES
    read = list(W.read_archive(data))
    assert [r for _, r in read] == records
    at = read[77][0]
    one = next(W.read_archive(data[: 8 + n] + data[at:]))
    assert one[1] == records[77]
    assert len(data) < sum(map(len, records)) / 2


def test_small_payloads_may_stay_responses_and_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = W.write_archives(W.dedup_records(pages, min_bytes=100))
    assert {r["record_type"] for r in W.read_archives(archives).collect()} == {"response"}
    n = W.export_archives(archives, str(tmp_path)).count()
    assert n == len(list(tmp_path.iterdir()))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(W.dedup_records(pages))).collect() == []
