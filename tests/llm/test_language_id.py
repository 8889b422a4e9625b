import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import language_id as L


def slow_marginals(psi, step):
    t, n = psi.shape
    a, b = np.zeros((t, n)), np.ones((t, n))
    a[0] = psi[0] / psi[0].sum()
    for k in range(1, t):
        a[k] = (a[k - 1] @ step) * psi[k]
        a[k] /= a[k].sum()
    for k in range(t - 2, -1, -1):
        b[k] = step @ (b[k + 1] * psi[k + 1])
        b[k] /= b[k].sum()
    g = a * b
    return (g / g.sum(axis=1, keepdims=True)).sum(axis=0)


def test_marginals_are_those_of_the_chain():
    rng = np.random.default_rng(0)
    step = np.exp(rng.normal(size=(3, 3)))
    counts = np.array([1, 5, 0, 32, 33, 64, 200, 2])
    psi = np.exp(rng.normal(size=(counts.sum(), 3)))
    got = L.marginals(psi, counts, step)
    at = 0
    for k, n in enumerate(counts):
        want = slow_marginals(psi[at : at + n], step) if n else np.zeros(3)
        assert got[k] == pytest.approx(want, abs=1e-8)
        at += n


def test_features_of_a_word_do_not_depend_on_its_place():
    def scores(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return L.Features(data, np.array([0, len(data)])).scores(np.random.default_rng(1).normal(size=(1 << L.HASH_BITS, 2)))

    a, b = scores("  alpha BETA gamma "), scores("x beta\talpha")
    assert a[0] == pytest.approx(b[2]) and a[1] == pytest.approx(b[1])


def test_code_switching_is_followed():
    rng = np.random.default_rng(0)
    en = ["".join(rng.choice(list("aeth"), 5)) for _ in range(80)]
    de = ["".join(rng.choice(list("uozk"), 5)) for _ in range(80)]
    text = lambda w, n: " ".join(rng.choice(w, n))
    model = L.train([text(en, 300).encode() for _ in range(5)] + [text(de, 300).encode() for _ in range(5)], ["en"] * 5 + ["de"] * 5, sequences=200)
    both = (text(en, 30) + " " + text(de, 10)).encode()
    got = model.shares(np.frombuffer(both, np.uint8), np.array([0, len(both)]))[0]
    assert got[model.labels.index("en")] == pytest.approx(0.75, abs=0.05)


def test_query_accuracy_and_undetermined(spark, sf):
    big = sf.replace("0.001", "0.01")
    out = {r["doc_id"]: r for r in L.op9_language_id(spark, big).collect()}
    docs = spark.read.parquet(f"{big}/documents.parquet").collect()
    assert len(out) == len(docs)
    held = [d for d in docs if out[d["doc_id"]]["held_out"]]
    right = sum(out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held if d["lang"])
    assert right / len(held) > 0.97 and 0.1 < len(held) / len(docs) < 0.3
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_nulls_letters_and_columns(docs, empty, rows):
    d = docs.withColumn("score", F.lit("mine")).withColumn("has_letter", F.lit(1))
    out = L.predict(d, L.fit(docs))
    assert out.columns == [*d.columns, "lang_pred", "_score"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de")
    assert L.predict(empty, L.fit(empty)).collect() == [] and L.fit(empty) is None
    assert {r["lang_pred"] for r in L.predict(docs, None).collect()} == {"und"}
    assert L.keep_known(d).columns == d.columns


def test_long_texts_are_labelled_in_parts_exactly():
    import numpy as np

    texts = [b"the quick brown fox jumps over a lazy dog and runs away from the house " * 30, b"der schnelle braune fuchs springt ueber den faulen hund und rennt weg vom haus " * 30]
    model = L.train(texts, ["en", "de"], sequences=100, epochs=1)
    data = np.frombuffer((texts[0][:900] + texts[1][:500]) * 8 + b"x" * 5000 + b"\n" + texts[0][:700], np.uint8)
    want = model.shares(data, np.array([0, len(data)]))[0]
    for most in (300, 1000, 4000, 100_000):
        cuts = L.word_cuts(data, most)
        assert cuts[0] == 0 and cuts[-1] == len(data) and cuts == sorted(set(cuts))
        assert np.allclose(model.long_shares(data, most), want, atol=1e-9)


def test_a_text_of_many_megabytes(spark):
    long_ = "the quick brown fox jumps over the lazy dog " * 120_000
    docs = spark.createDataFrame([(1, long_, "en"), (2, "der schnelle fuchs " * 50, "de"), (3, "the dog " * 50, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, L.train([b"the quick brown fox and the dog " * 20, b"der schnelle braune fuchs und hund " * 20], ["en", "de"], sequences=60, epochs=1)).collect()}
    assert got == {1: "en", 2: "de", 3: "en"}
