import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sedimenta.llm import fingerprints as P


def test_canonical_form(spark):
    rows = [("Straße  ﬁne X\n",), ("STRASSE FINE x",), ("éA",), ("Éa",), (None,), ("",), (" \t",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.canonical(F.col("t"))).collect()]
    assert out[0] == out[1] == "strasse fine x" and out[2] == out[3] and out[4:] == ["", "", ""]


def brute_edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t, *_) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest(), t, t[: len(t) - half] + nxt[:half], nxt)
    return out


def check(spark, rows, folder):
    from sedimenta.llm.fingerprints import op8_fingerprints

    got = {r["doc_id"]: r for r in op8_fingerprints(spark, folder).collect()}
    want = brute_edited(rows)
    assert got.keys() == want.keys()
    prints = {}
    for i, (n, sha, text, edited, nxt) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, f) == f
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"])
    for i, (_, _, _, _, nxt) in want.items():
        assert got[i]["near_next"] == float(got[i]["fingerprint"] == prints[nxt])


def test_query_against_brute_force(spark, rows, tmp_path):
    own = [r for n, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:n]}]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, own, str(tmp_path))


def test_query_on_the_tables(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], sf)


def test_different_texts_of_one_hash_are_told_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(P, "wide_hash", lambda c: F.substring(F.hex(F.xxhash64(c)), 1, 1))
    out = P.fingerprints(docs.select("doc_id", "text")).collect()
    text = {r["doc_id"]: r["c"] for r in docs.select("doc_id", P.canonical(F.col("text")).alias("c")).where("doc_id IS NOT NULL").collect()}
    prints = {}
    for r in out:
        if r["doc_id"] is not None:
            prints.setdefault(r["fingerprint"], set()).add(text[r["doc_id"]])
    assert all(len(x) == 1 for x in prints.values()) and len(prints) == len(set(text.values()))


def test_repeated_rows_nulls_and_empty(spark, docs, rows, empty):
    assert Counter(r["doc_id"] for r in P.fingerprints(docs).collect()) == Counter(r[0] for r in rows)
    assert P.fingerprints(empty).collect() == []
    assert P.with_next(docs.select("doc_id", "text"), ["text"]).count() == len(rows)


def test_next_rows_over_many_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(P, "_ranges", lambda docs: 40)
    ids = random.Random(2).sample(range(-10_000, 10_000), 700)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(9)
    order = sorted(ids, reverse=True)
    want = {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert {r["doc_id"]: r["next_text"] for r in P.with_next(df, ["text"]).collect()} == want


def test_next_rows_with_clashing_names_and_repeated_ids(spark):
    rows = [(i // 2, f"text {i}", "mine", i) for i in range(40)] + [(None, "no id", "mine", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _range string, range_of int").repartition(5)
    out = P.with_next(docs, ["text"])
    assert out.columns == [*docs.columns, "next_text"] and out.count() == 41 and {r["_range"] for r in out.collect()} == {"mine"}
    follow = {r["text"]: r["next_text"] for r in out.collect()}
    assert sorted(follow) == sorted(follow.values())


def test_a_text_of_many_megabytes(spark, tmp_path):
    long_ = "Größe ﬁ " * 2_000_000
    spark.createDataFrame([(1, long_), (2, long_.upper()), (3, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in P.op8_fingerprints(spark, str(tmp_path)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"] and got[2]["near_next"] == 1.0
