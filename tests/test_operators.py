import math
import zlib

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import ids, scoring, text
from sedimenta.operators import corrections, graph, ingest, latest, quality, recall, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_edge_confidence_of_strong_and_weak_edges(spark):
    def p(*signals):
        return one(spark, scoring.edge_confidence(*[F.lit(s).cast("double") if not isinstance(s, bool) else F.lit(s) for s in signals]))

    assert 0.78 <= p(0.9, 1.0, 1.0, True, 0, False) <= 0.86
    assert p(None, 0.5, None, False, 0, False) < 0.5
    assert p(1.0, 1.0, 1.0, True, 1000, False) <= 0.99 and p(0.0, 0.0, 0.0, False, 0, True) >= 0.05


def test_temporal_classes(spark):
    def f(class_, age=0.0, nxt=None, past=None, closure=None):
        return one(spark, scoring.temporal_factor(F.lit(class_), F.lit(closure), F.lit(age), F.lit(nxt).cast("double"), F.lit(past).cast("double")))

    assert f("superseded") == 0.15 and f("evergreen", 1000.0) == 1.0
    assert f("transient", 2.0) == pytest.approx(0.5) and f("decaying", 600.0) == 0.15
    assert f("commitment", closure="fulfilled") == pytest.approx(0.3) and f("commitment") == 1.0
    assert f("recurring", nxt=20.0) == 0.5 and f("recurring", nxt=3.0) == 1.0
    assert f("one_off", past=14.0) == pytest.approx(0.5) and f("one_off", past=-1.0) == 1.0


@pytest.mark.parametrize(("p", "crisp", "durable"), [("runs", True, True), ("is design partner for", True, True), ("is similar to", True, False), ("was  Mentioned in", True, False), ("about", True, False), ("", False, True), ("is", True, True), ("shares a role with many of them", False, True), ("aboutness", True, True)])
def test_predicates(spark, p, crisp, durable):
    assert one(spark, text.predicate_is_crisp(F.lit(p))) == crisp and one(spark, text.predicate_is_durable(F.lit(p))) == durable


@pytest.mark.parametrize(("name", "want"), [("AB-12", True), ("/a/b", True), ("./bin", True), ("docs/x-y.md", True), ("notes.md", True), ("site.dev.toml", True), ("example.team", False), ("Ada Lovelace", False), ("", False)])
def test_structural_names(spark, name, want):
    assert one(spark, text.is_structural_name(F.lit(name))) == want


def test_verdicts_slugs_and_routes(spark):
    assert one(spark, text.normalize_verdict(F.lit(" Contradicts "))) == "conflicts" and one(spark, text.normalize_verdict(F.lit("?"))) == "unsure"
    assert one(spark, text.enforce_floor(F.lit("conflicts"), F.lit(0.6))) == "unsure"
    assert one(spark, text.slugify(F.lit(" Sub-Genre  x!"))) == "sub_genre_x" and one(spark, text.slugify(F.lit("9"))) is None
    assert one(spark, text.client_slug(F.lit("--Acme Inc.--"))) == "acme-inc" and one(spark, text.client_slug(F.lit(None).cast("string"))) == "unknown"
    for q, d in (("", "shallow"), ("sha256:ab cd", "shallow"), ("one", "shallow"), ("two words", "normal")):
        assert one(spark, text.route_depth(F.lit(q))) == d


def test_content_hash_ignores_parent_order(spark):
    h = [one(spark, ids.content_hash(F.lit("k"), F.lit("o"), F.lit("p"), F.array(*map(F.lit, x)))) for x in (["a", "b"], ["b", "a"])]
    none = one(spark, ids.content_hash(F.lit("k"), F.lit("o"), F.lit("p"), F.array().cast("array<string>")))
    assert h[0] == h[1] != none and none.startswith("sha256:") and len(none) == 71


def test_resolution_hops_and_cycles(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 100)], "id long, into long")
    nodes = spark.createDataFrame([(1,), (20,), (30,), (100,), (7777,)], "id long")
    got = {r["id"]: (r["canonical"], r["depth"]) for r in graph.resolve(nodes, links).collect()}
    assert got == {1: (17, 16), 20: (30, 10), 30: (30, 0), 100: (100, 16), 7777: (7777, 0)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8, 9)], "id long")
    assert {r["id"]: r["component"] for r in graph.connected_components(e, nodes).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8}
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {1}


def test_lineage_and_merging(spark):
    rows = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "child long, parent long")
    assert {tuple(r) for r in graph.lineage_edges(rows).collect()} == {(2, 1), (3, 1), (4, 1), (3, 2), (4, 2)}
    assert graph.merge_overlapping([("a", {1, 2, 3}), ("x", {7, 8, 9}), ("b", {1, 2, 3, 4}), ("c", {9})]) == [{1, 2, 3, 4}, {7, 8, 9}]


def test_latest_wins_and_appends(spark):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k long, t long, v string")
    assert {tuple(r) for r in latest.latest_by(rows, ["k"], ["t"], ["v"]).collect()} == {(1, "new"), (2, "only")}
    fresh = latest.append_new(rows.where("k = 2"), rows, ["k"], [F.col("t")])
    assert [r["v"] for r in fresh.collect()] == ["old"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue")], "id long, text string")
    q = spark.createDataFrame([(1, "red"), (2, "fox-red")], "query_id int, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25(docs, q, "id", "text").collect()}
    idf = max(math.log((3 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    avg = 2.0
    assert got[(1, 2)] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)))
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[(2, 1)] > got[(2, 2)]


def test_phrases_are_adjacent(spark):
    docs = spark.createDataFrame([(1, "foo bar foo bar"), (2, "bar foo")], "id long, text string")
    p = spark.createDataFrame([(1, "foo.bar")], "phrase_id int, phrase string")
    assert [(r["id"], r["n"]) for r in retrieval.phrase_hits(docs, p, "id", "text").collect()] == [(1, 2)]


def test_fusion_keeps_a_single_list_and_prefers_both(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 5, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    got = [(r["query_id"], r["id"]) for r in retrieval.fused_top(retrieval.rrf([a, b]), 10).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11), (1, 10), (1, 12), (2, 5)]


def test_knn_blocks_agree(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), float(k * k % 7)]) for k in range(40)], "id long, vector array<double>")
    q = v.where("id < 10").selectExpr("id AS query_id", "vector")
    want = {tuple(r) for r in retrieval.knn(v, q, 3).select("query_id", "id", "rank").collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert {tuple(r) for r in retrieval.knn(v, q, 3).select("query_id", "id", "rank").collect()} == want


def test_chunks():
    t = ("A sentence here. Another one there!\n\n" * 300)[:9000]
    parts = retrieval.chunks(t, 2000, 600)
    assert [a for a, _ in parts] == list(range(0, 9000, 1400))[: len(parts)] and parts[-1][1] == len(t)
    assert all(t[b - 2 : b] == "\n\n" for _, b in parts[:-1]) and retrieval.chunks("short") == [(0, 5)] and retrieval.chunks("") == [(0, 0)]
    assert retrieval.find_boundary("aa! bb. cc? dd", 0, 14) == 8 and retrieval.find_boundary("aaaa", 0, 4) == 4


def test_decisions(spark):
    p = spark.createDataFrame([(1, "proposed"), (2, "applied"), (3, "expired"), (4, "proposed"), (5, "proposed")], "id long, status string")
    d = spark.createDataFrame([(1, "confirm", 2), (1, "reject", 1), (2, "confirm", 1), (3, "confirm", 1), (5, "what", 1)], "id long, verdict string, decided_at long")
    got = {r["id"]: (r["outcome"], r["new_status"]) for r in corrections.decide(p, d).collect()}
    assert got == {1: ("decided", "rejected"), 2: ("already_decided", "applied"), 3: ("decided", "applied"), 4: ("none", "proposed"), 5: ("invalid_verdict", "proposed")}


def test_reviews_append_on_change_only(spark):
    old = spark.createDataFrame([(1, "suppress", 3)], "k long, verdict string, version int")
    new = spark.createDataFrame([(1, "suppress"), (2, "suppress")], "k long, verdict string")
    assert [tuple(r) for r in corrections.versioned_reviews(old, new, "k").select("k", "version").collect()] == [(2, 1)]


def test_watermarks_only_grow(spark):
    w = lambda *r: spark.createDataFrame(list(r), "worker string, through_at long, through_id string")
    got = ingest.monotonic_watermarks(w(("a", 5, "05")), w(("a", 3, "03"), ("b", 1, "01"))).collect()
    assert {(r["worker"], r["through_id"]) for r in got} == {("a", "05"), ("b", "01")}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 4)], "query_id long, id long, rank int")
    rel = spark.createDataFrame([(1, 11), (2, 12), (2, 13), (3, 1)], "query_id long, id long")
    got = {r["query_id"]: (r["hit1"], r["hit3"], r["mrr"], r["recall_k"]) for r in quality.ranking_metrics(ranked, rel, 3).collect()}
    assert got == {1: (0.0, 1.0, 0.5, 1.0), 2: (0.0, 0.0, 0.25, 0.0), 3: (0.0, 0.0, 0.0, 0.0)}
    sets = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 2, "b"), ("h", 1, "x")], "g string, m long, i string")
    assert {r["g"]: r["consistency"] for r in quality.mean_pairwise_jaccard(sets, "g", "m", "i").collect()} == {"g": 0.5, "h": 1.0}


def test_memory_cases(spark):
    claim = lambda i, cites, mode="fact": (i, cites, mode)
    good = ([claim("a", ["e1"])], False, True)
    stale = ([claim("a", ["e2"]), claim("old", [])], False, False)
    rows = [
        ("c1", "f", [("e1", True), ("e2", False)], ["a"], ["old"], {"a": ["e1"]}, True, True, [good, stale]),
        ("c2", "f", [], [], [], {}, False, False, [([], True, False), ([], True, False)]),
    ]
    got = {r["id"]: r for r in quality.memory_quality(spark.createDataFrame(rows, quality.MEMORY_CASE)).collect()}
    assert all(got["c2"][m] == 1.0 for m in (*quality.MEMORY_METRICS, "cross_tool_consistency"))
    want = {"truth_precision": 0.5, "current_recall": 1.0, "stale_exclusion": 0.5, "citation_coverage": 0.75, "citation_validity": 1.0, "conflict_honesty": 0.5, "abstention_accuracy": 1.0, "cross_tool_consistency": 0.5}
    assert {m: got["c1"][m] for m in want} == want


def test_leaks(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 12)], "query_id long, id long, rank int")
    bad = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, id long")
    assert {r["query_id"]: r["leak"] for r in quality.leaks(ranked, bad).collect()} == {1: False, 2: False}


def test_document_vectors_are_means_of_their_chunks(spark, sf):
    from sedimenta.plans import catalog

    def vector(text):
        v = [0.0] * 64
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 31 else -1
        return unit(v)

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    got = {r["id"]: r["embedding"] for r in catalog.QUERIES["embed_documents"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and any(len(t) > 4000 for t in texts.values())
    for i, t in texts.items():
        parts = [vector(t[a:z]) for a, z in retrieval.chunks(t, 4000, 200)]
        want = parts[0] if len(parts) == 1 else unit([sum(x) / len(parts) for x in zip(*parts, strict=True)])
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_recent_context_and_conflicts(spark):
    events = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, 1)], "id long, at long")
    mentions = spark.createDataFrame([(1, 10), (2, 20), (2, None), (3, 30), (4, 40)], "id long, entity long")
    merges = spark.createDataFrame([(30, 31), (31, 32)], "id long, into long")
    see = lambda n: {r["canonical"] for r in recall.recent_context(events, mentions, merges, n).collect()}
    assert see(0) == set() and see(1) == {32} and see(2) == {32, 20} and see(9) == {32, 20, 10, 40}
    flags = spark.createDataFrame([(1, "REVERTS"), (1, "conflicts"), (2, "unsure"), (3, None)], "id long, verdict string")
    assert {r["id"]: r["conflicted"] for r in recall.conflicted(events.select("id"), flags).collect()} == {1: True, 2: False, 3: False, 4: False}
