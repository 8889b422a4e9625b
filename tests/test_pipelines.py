import numpy as np
from pyspark.sql import functions as F

from sedimenta.operators import canonical, embedding, maintenance
from sedimenta.sources import extractors


def test_embedding_pools_chunks(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "word " * 300)], "id long, text string")
    out = {r["id"]: np.array(r["embedding"]) for r in embedding.embed_documents(df, "id", "text", size=200, overlap=20).collect()}
    assert abs(np.linalg.norm(out[1]) - 1) < 1e-6 and np.linalg.norm(out[2]) == 0 and abs(np.linalg.norm(out[3]) - 1) < 1e-6
    done = spark.createDataFrame([(1,)], "id long")
    assert {r["id"] for r in embedding.missing_embeddings(df, done, "id", "text").collect()} == {2, 3}


def test_extractors_report_broken_files(spark):
    df = spark.createDataFrame([("a", "other", bytearray(b"text")), ("b", "pdf", bytearray(b"no pdf")), ("c", "image", bytearray(b""))], "path string, modality string, content binary")
    got = {r["path"]: (r["text"], r["error"] is None) for r in extractors.extract(df).collect()}
    assert got == {"a": ("text", True), "b": (None, False), "c": (None, False)}


def test_canonicalisation_cascade(spark):
    ents = spark.createDataFrame([("e1", "person", "Ada Lovelace"), ("e2", "person", "Charles Babbage"), ("e3", "person", "Gone")], "entity string, kind string, name string")
    alias = canonical.gazetteer(spark.createDataFrame([("e2", "person", "Charles Babbage", "Charlie"), ("e1", "person", "Ada Lovelace", "AL")], "entity string, kind string, name string, alias string"))
    m = spark.createDataFrame([(1, " ada lovelace ", "person"), (2, "charlie", "person"), (3, "Ada Lovelase", "person"), (4, "Nobody", "person"), (5, "Gone", "person")], "mention long, surface string, kind string")
    got = {r["mention"]: (r["method"], r["entity"]) for r in canonical.canonicalize(m, ents, alias, spark.createDataFrame([("e3",)], "entity string")).collect()}
    assert got[1] == ("exact", "e1") and got[2] == ("alias", "e2") and got[3] == ("embedding", "e1") and got[4][0] == got[5][0] == "new"


def test_edge_gates(spark):
    kind = "n int, event_kind string, transient_confidence double, predicate string, evidence string, text string, subject string, object string, subject_new boolean, object_new boolean"
    t = "Ada works at the Engine Company"
    rows = [(1, "remember", None, "works at", "Ada works at the engine", t, "a", "b", False, True), (2, "observe", None, "runs", "x", t, "a", "b", False, False), (3, "remember", 0.7, "runs", "x", t, "a", "b", False, False), (4, "remember", 0.1, "mentions", "x", t, "a", "b", False, False), (5, "remember", None, "runs", "not in there", t, "a", "b", False, False), (6, "remember", None, "runs", "ada works at", t, "a", "a", False, False), (7, "remember", None, "runs", "ada works at", t, "a", "b", True, True), (8, "remember", None, "runs", "ada works at", t, None, "b", True, True)]
    got = {r["n"]: r["gate"] for r in canonical.gate_edges(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: None, 2: "observed", 3: "transient", 4: "not_durable", 5: "no_evidence", 6: "same_entity", 7: "both_new", 8: "unresolved"}


def test_rebuild_keeps_live_sources(spark):
    ev = spark.createDataFrame([("1", "h1", "remember", 1, []), ("2", "h2", "remember", 2, []), ("3", "h3", "invalidate", 3, ["h1"]), ("4", "h4", "consolidation", 4, []), ("5", "h5", "observe", 5, [])], "id string, content_hash string, kind string, created_at long, parent_hashes array<string>")
    assert [r["id"] for r in maintenance.sources_to_keep(ev).collect()] == ["2", "5"]
    assert [r["id"] for r in maintenance.sources_to_keep(ev, drop_superseded=False).collect()] == ["1", "2", "3", "5"]


def test_reprocessing_and_batches(spark):
    ev = spark.createDataFrame([("1", "h1"), ("2", "h2"), ("3", "h3")], "id string, content_hash string")
    it = spark.createDataFrame([("h1", 1, 1, "ok", "p"), ("h2", 1, 1, "ok", "p"), ("h2", 2, 1, "failed", "q")], "event_hash string, produced_at int, version int, status string, produced_by string")
    assert {r["id"] for r in maintenance.to_reprocess(ev, it).collect()} == {"2", "3"}
    assert [r["id"] for r in maintenance.unscored(ev, it, "p", None, 5).collect()] == ["3"]
    left = [3]

    def step():
        left[0] = max(0, left[0] - 1)
        return left[0]

    assert maintenance.drain(step) == 2


def test_checkup(spark):
    e = spark.createDataFrame([("a", "N", "x"), ("entity:v2:b", "n", "y"), ("c", "n", "x")], "id string, canonical_name string, kind string")
    m = spark.createDataFrame([("exact",), ("llm",)], "match_method string")
    merges = spark.createDataFrame([("m1", "c"), ("m2", "a")], "id string, from_entity_id string")
    got = {r["metric"]: r["value"] for r in maintenance.checkup(e, m, merges, spark.createDataFrame([("m2",)], "merge_id string")).collect()}
    assert got == {"entities": 3, "entities_v2": 1, "clusters": 1, "clusters_cross_kind": 1, "mentions": 2, "mentions_exact": 1, "merges": 2}
    assert maintenance.prune_older(merges, F.lit(1), F.lit(2)).count() == 0
