import hashlib

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import ingest
from sedimenta.sources import blobs


def test_blob_store_round_trip_and_orphans(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),), (None,)], "content binary")
    first = blobs.write_objects(df, str(tmp_path)).collect()
    assert sorted(r["length"] for r in first) == [3, 3] and all(r["written"] for r in first)
    assert not any(r["written"] for r in blobs.write_objects(df, str(tmp_path)).collect())
    (tmp_path / ".tmp").write_bytes(b"junk")
    all_ = blobs.stored(spark, str(tmp_path), content=True)
    hashes = {r["hash"] for r in all_.collect()}
    assert hashes == {"sha256:" + hashlib.sha256(x).hexdigest() for x in (b"one", b"two")}
    one = "sha256:" + hashlib.sha256(b"one").hexdigest()
    events = spark.createDataFrame([('{"parts":[{"blob_hash": "%s"}],"blob_hash":"%s"}' % (one, one),), ('{"text":"inline"}',), ('{"blob_hash":"sha256:%s"}' % ("0" * 64),)], "payload string")
    used = blobs.reachable(events, "payload")
    later = F.current_timestamp() + F.expr("INTERVAL 2 DAYS")
    assert {r["hash"] for r in blobs.orphaned(all_, used, later).collect()} == hashes - {one}
    assert blobs.orphaned(all_, used, F.current_timestamp()).count() == 0
    out = {r["payload"]: (r["text"], r["unavailable"]) for r in blobs.rehydrate(events, all_).collect()}
    assert sorted(out.values(), key=str) == [("inline", False), ("one", False), (None, True)]


def test_export_and_import(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "remember"), (2, "b", "observe")], "id long, text string, kind string")
    edges = spark.createDataFrame([(7, 8, None)], "a long, b long, note string")
    path = str(tmp_path / "out")
    ingest.write_export({"event": (events, ["id"]), "edge": (edges, ["a", "b"])}, path)
    rows, counts = ingest.import_lines(spark, path)
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"event": 2, "edge": 1, "manifest": 1}
    back = rows.where("kind = 'event'").select(F.from_json("line", "id long, text string, event_kind string").alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect())) == [(1, "a", "remember"), (2, "b", "observe")]
    lines = [ln for f in sorted((tmp_path / "out").glob("part-*")) for ln in __import__("gzip").open(f, "rt").read().splitlines()]
    assert "manifest" in lines[-1]


def test_cut_off_exports_are_refused(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"kind":"event","id":1}\nnot json\n')
    with pytest.raises(ValueError):
        ingest.import_lines(spark, str(tmp_path))
