import hashlib
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(payload):
    d = M.decode(M.encode(payload))
    assert d["payload"] == payload and d["bad_crc"] == 0 and d["skipped"] == 0
    assert d["vbr_frames"] == d["frames"] and d["samples"] == 1152 * d["frames"]


def test_offsets_point_at_frames_and_table_size_fits():
    data = M.encode(b"payload " * 2000)
    d = M.decode(data)
    assert all(M.header_size(data, at) for at in d["offsets"])
    _, start = M.parse_tag(data)
    assert d["vbr_bytes"] == len(data) - start


def test_resynchronises_after_foreign_bytes_and_sees_broken_checksums():
    data = M.encode(b"x" * 5000)
    d = M.decode(data)
    at = d["offsets"][2]
    noisy = M.decode(data[:at] + b"\x00\xff\x13noise\xff\xfb" + data[at:])
    assert noisy["frames"] + 1 >= d["frames"] and noisy["skipped"] >= 9
    broken = bytearray(data)
    broken[at + 6] ^= 1
    assert M.decode(bytes(broken))["bad_crc"] == 1


def test_tags():
    tags, at = M.parse_tag(M._tag(77))
    assert tags == {"payload_bytes": "77"} and at == len(M._tag(77))
    assert M.parse_tag(b"no tag") == ({}, 0)


def test_query_against_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in M.op2_mpeg_audio(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[(i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert got == want


def test_equal_texts_have_equal_media(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = M.op2_mpeg_audio(spark, str(tmp_path)).where("doc_id IN (72, 73)").select("media_sha256", "feature", "media_bytes").distinct()
    assert out.count() == 1


def test_hostile_tags():
    odd = "\u00b2".encode("latin-1")  # a digit to isdigit(), no number to int()
    body = b"\x00payload_bytes\x00" + odd
    frame = b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body
    data = b"ID3\x03\0\0" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame + M.encode(b"abc")[len(M._tag(3)) :]
    assert M.decode(data)["payload"][:3] == b"abc"
    for junk in (b"ID3", b"ID3\x04\0\x40\0\0\0\x05abc", b"ID3\x02\0\0\0\0\0\x7fTXX\xff\xff\xff", b"\xff" * 50):
        M.decode(junk)


def test_tags_of_all_versions():
    text = b"\x03key\x00value"
    old = b"TXX" + len(text).to_bytes(3, "big") + text
    assert M.parse_tag(b"ID3\x02\0\0\0\0\0" + bytes([len(old)]) + old)[0] == {"key": "value"}
    new = b"TXXX" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
    extended = bytes([0, 0, 0, 6, 1, 0])
    assert M.parse_tag(b"ID3\x04\0\x40\0\0\0" + bytes([6 + len(new)]) + extended + new)[0] == {"key": "value"}


def test_tables_of_both_kinds_and_durations_of_mixed_rates():
    data = M.encode(b"q" * 3000)
    at = len(M._tag(3000))
    vbri = bytearray(data)
    vbri[at + M.HEAD : at + M.HEAD + 120] = bytes(120)
    vbri[at + 36 : at + 54] = b"VBRI" + bytes(6) + (777).to_bytes(4, "big") + (5).to_bytes(4, "big")
    d = M.decode(bytes(vbri))
    assert (d["vbr_bytes"], d["vbr_frames"]) == (777, 5)
    plain = M.decode(data)
    assert plain["ticks"] * 48_000 == plain["samples"] * M.TICKS
    other = M._head(9, 0) + bytes(M.frame_bytes(9, 0, 0) - M.HEAD)  # 44.1 kHz
    both = M.decode(data + other)
    assert both["ticks"] - plain["ticks"] == 1152 * M.TICKS // 44_100 and both["rate"] == 48_000


def test_columns_that_clash_empty_tables_and_long_media(spark):
    df = spark.createDataFrame([(1, b"x" * 100, "mine", 7), (1, b"x" * 100, "mine", 7), (2, None, None, None), (3, b"long" * 5_000_000, "", 0)], "doc_id long, payload binary, feature string, payload_bytes int")
    coded = M.encode_column(df, "payload").drop("payload")
    out = M.decode_column(coded)
    assert {"feature", "_feature", "payload_bytes", "_payload_bytes"} <= set(out.columns)
    got = sorted((r["doc_id"], r["_payload_bytes"], r["payload_bytes"]) for r in out.collect())
    assert [x[:2] for x in got] == [(1, 100), (1, 100), (2, 0), (3, 20_000_000)]
    assert M.decode_column(coded.limit(0)).collect() == []
