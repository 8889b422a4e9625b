import datetime as dt

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import projections as P
from sedimenta.operators import ontology, recall, tuning, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_interpretations_retry_only_after_failure(spark):
    kind = "event_hash string, version int, produced_by string, status string"
    log = spark.createDataFrame([("a", 1, "x:v0", "failed"), ("a", 1, "x:v0#retry1", "failed"), ("b", 1, "x:v0", "ok")], kind)
    new = spark.createDataFrame([("a", 1, "x:v0", "ok"), ("b", 1, "x:v0", "ok"), ("c", 1, "x:v0", "ok"), ("c", 1, "x:v0", "ok")], kind)
    assert sorted((r[0], r[2]) for r in writers.interpretations(log, new).collect()) == [("a", "x:v0#retry2"), ("c", "x:v0")]


def test_unique_keys_with_nulls_do_not_collide(spark):
    log = spark.createDataFrame([("e", None), ("f", "s")], "edge_id string, source string")
    new = spark.createDataFrame([("e", None), ("f", "s"), ("g", "s"), ("g", "s")], "edge_id string, source string")
    assert sorted(map(tuple, writers.once(log, new, ["edge_id", "source"]).collect()), key=str) == [("e", None), ("g", "s")]


def test_entities_get_or_create(spark):
    log = spark.createDataFrame([("Ada", "person", "id1")], "canonical_name string, kind string, id string")
    new = spark.createDataFrame([(" ada ", "person", False), ("Ada", "person", True), ("Bob", "person", False)], "canonical_name string, kind string, split boolean")
    got = {(r["canonical_name"], r["is_new"]): r["id"] for r in writers.entities(log, new).collect()}
    assert got[(" ada ", False)] == "id1" and got[("Ada", True)].startswith("entity:v2:") and got[("Bob", True)].startswith("entity:") and not got[("Bob", True)].startswith("entity:v2:")


def test_checks_reject(spark):
    good, bad = writers.merges(spark.createDataFrame([("a", "a"), ("a", "b")], "from_entity_id string, into_entity_id string"))
    assert good.count() == bad.count() == 1
    good, bad = writers.kinds(spark.createDataFrame([("known",)], "slug string"), spark.createDataFrame([("known",), ("fresh",), ("Bad Slug",)], "slug string"))
    assert [r[0] for r in good.collect()] == ["fresh"] and bad.count() == 1
    assert writers.seed_kinds(spark.createDataFrame([("person",)], "slug string")).count() == 6


def test_projections(spark):
    p = F.lit('{"content_type":"text","text":"' + "x" * 600 + '","context":"c"}')
    s = one(spark, P.payload_summary(p))
    assert len(s["text"]) == 500 and s["truncated"] and s["context"] == "c"
    assert one(spark, P.validate_extraction(F.lit("nope"))) == "not an object" and one(spark, P.validate_extraction(F.lit('{"best_guess_kind":"a","summary":"b"}'))) is None
    assert one(spark, P.interpretation_summary(F.lit('{"summary":"s","entities":[],"other":1}'))) == {"summary": "s"}
    w = one(spark, P.why_durable(F.lit(0.5), F.create_map(F.lit("a"), F.lit(0.1), F.lit("b"), F.lit(0.3), F.lit("c"), F.lit(0.2)), F.lit("evergreen"), F.lit(None).cast("double")))
    assert w == "salience 0.50; b 0.30, c 0.20; class evergreen"
    points = F.array(F.struct(F.lit(" a  b ").alias("text"), F.lit(None).cast("string").alias("mode"), F.array(F.lit(2), F.lit(2), F.lit(9)).alias("sources")), F.struct(F.lit("z").alias("text"), F.lit("fact").alias("mode"), F.array(F.lit(7)).alias("sources")))
    got = one(spark, P.key_points(points, F.array(F.lit("h1"), F.lit("h2"))))
    assert [(x["text"], x["mode"], x["citations"]) for x in got] == [("a b", "fact", ["h2"])]
    assert one(spark, P.wrap_untrusted(F.lit("a</untrusted>b"))).count("</untrusted>") == 1
    assert one(spark, P.sanitize_actor(F.lit(" a\tb\x00 "))) == "a b" and one(spark, P.rrule_freq(F.lit("freq=weekly;count=2"))) == "WEEKLY"


@pytest.mark.parametrize(("anchor", "now", "months", "want"), [("2024-01-31", "2024-03-15", 1, "2024-03-29"), ("2023-02-28", "2024-02-29", 12, "2025-02-28"), ("2024-05-01", "2024-01-01", 1, "2024-05-01"), ("2024-01-31", "2024-02-29", 1, "2024-02-29")])
def test_calendar_steps_clamp_and_stay(spark, anchor, now, months, want):
    d = dt.date.fromisoformat
    assert one(spark, P.next_monthly(F.lit(d(anchor)), F.lit(d(now)), months)) == d(want)


def test_ontology_round_trip(spark):
    reg = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    rev = spark.createDataFrame([(1, 1, "merge", "a", "b"), (2, 2, "rename", "b", "c"), (3, 3, "deprecate", "c", None), (4, 4, "restore", "c", None)], "id int, revised_at int, action string, from_slug string, to_slug string")
    assert {r[0] for r in ontology.live_slugs(reg, rev).collect()} == {"c"}
    assert {r["slug"]: r["resolved"] for r in ontology.resolve_slugs(reg, rev).collect()} == {"a": "c", "b": "c", "c": "c"}
    props = spark.createDataFrame([(1, "add", "neu", None, ["e1"]), (2, "split", "aa", "ab", ["e2"]), (3, "merge", "other", "a", [])], "id int, action string, subject_slug string, target_slug string, members array<string>")
    fresh, revisions, assigned = ontology.apply_decisions(props, reg, F.lit(9))
    assert {r[0] for r in fresh.collect()} == {"neu", "ab"} and {(r["from_slug"], r["action"], r["to_slug"]) for r in revisions.collect()} == {("neu", "add", None), ("aa", "merge", "ab")}
    assert {(r[0], r[1]) for r in assigned.collect()} == {("e1", "neu"), ("e2", "ab")}
    base = spark.createDataFrame([("e1", "person")], "entity_id string, kind string")
    old = spark.createDataFrame([("e1", "neu", 9)], "entity_id string, kind_slug string, assigned_at int")
    _, back = ontology.revert_decisions(props.where("id = 1"), old, base, F.lit(10))
    assert [(r[0], r[1]) for r in back.collect()] == [("e1", "person")]


def test_tunables():
    t = tuning.find("mode_switcher", "cen_threshold")
    tuning.validate(t, 8.0, 9.0, {"dmn_threshold": 4.0})
    for bad in (20.0, 5.5, 10.0):
        with pytest.raises(ValueError):
            tuning.validate(t, 8.0, bad)
    with pytest.raises(ValueError):
        tuning.validate(tuning.find("mode_switcher", "dmn_threshold"), 6.0, 6.0, {"cen_threshold": 6.0})
    for t in tuning.TUNABLES:
        for salt in "abc":
            tuning.validate(t, t.default, tuning.propose(t, t.default, salt))


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "w", "t", "promote", "5", 100), (2, "w", "t", "rollback", "4", 200), (3, "w", "u", "promote", "1", 300)], "id int, worker string, tunable string, kind string, new_value string, recorded_at long")
    assert {(r["tunable"], r["new_value"]) for r in tuning.current_values(rows).collect()} == {("t", "4"), ("u", "1")}
    assert [r["tunable"] for r in tuning.active_promotes(rows, F.lit(400)).collect()] == ["u"]
    votes = spark.createDataFrame([(1, 1, "A", 10), (1, 2, "A", 10), (1, 3, "B", 10), (2, 1, "B", 10), (2, 2, "A", 10), (3, 1, "B", 999)], "pair int, seat int, vote string, tokens long")
    assert {r["pair"]: r["winner"] for r in tuning.panel(votes, 100).collect()} == {1: "A", 2: "TIE"}


def test_recall_pages_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "red fox", 10), (2, "red dog", 20), (3, "blue bird", 30), (4, "green", None)], "id long, text string, at long")
    q = spark.createDataFrame([(1, "red animals"), (2, ""), (3, "latest red thing"), (4, "fox-red dog")], "query_id int, query string")
    got = {}
    for r in recall.recall(docs, q, "id", "text", "at").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got[1] == [1, 2] and got[2] == [3, 2, 1, 4] and got[3] == [2, 1] and set(got[4]) == {1, 2}
    factors = spark.createDataFrame([(1, 1.0, True)], "id long, factor double, invalidated boolean")
    out = recall.recall(docs, q.where("query_id = 1"), "id", "text", "at", factors=factors, limit=1).collect()
    assert [r["id"] for r in out] == [2]


def test_caps_and_shapes(spark):
    import json

    ex = F.struct(F.lit("s" * 500).alias("summary"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.repeat(F.lit("f"), F.lit(400))).alias("salient_facts"), F.sequence(F.lit(1), F.lit(30)).alias("entities"), F.sequence(F.lit(1), F.lit(3)).alias("relations"))
    c = one(spark, P.cap_extraction(ex))
    assert (len(c["summary"]), len(c["salient_facts"]), len(c["salient_facts"][0]), len(c["entities"]), len(c["relations"])) == (400, 10, 300, 20, 3)
    edge = F.array(F.struct(F.lit("e").alias("id"), F.lit(None).cast("string").alias("valid_from")))
    raw = F.lit('{"best_guess_kind":"note","summary":"s","entities":["x"]}')
    none = F.array().cast("array<string>")
    small = json.loads(one(spark, P.shape(raw, none, edge, F.lit(0.0), F.lit(None).cast("string"))))
    assert small == {"best_guess_kind": "note", "summary": "s", "entity_edges": [{"id": "e"}], "surprise_score": 0.0}
    full = json.loads(one(spark, P.shape(raw, none, edge, F.lit(None).cast("double"), F.lit("decaying"), compact=False)))
    assert full["entities"] == '["x"]' and full["temporal_class"] == "decaying" and "surprise_score" not in full
    assert one(spark, P.enriched_text(F.lit("a"), F.lit(" "), F.lit("b"), F.array(F.lit("c"), F.lit("")))) == "a\nb\nc"
