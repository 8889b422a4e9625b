import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import common as C
from sedimenta.llm import suffix_tree as S

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def brute(rows):
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = Counter()
    for i, x in rows:
        w = tokens(x)
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)
        out[(i, held(i), len(w), sum(c[t] > 0 for t in w), n, round(base, 4))] += 1
    return out


def rounded(out):
    return Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out)


def test_query_against_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert rounded(S.op4_suffix_tree(spark, str(tmp_path)).collect()) == brute([r[:2] for r in rows])


def test_query_on_the_tables(spark, sf):
    big = sf.replace("0.001", "0.01")
    out = S.op4_suffix_tree(spark, big).collect()
    assert rounded(out) == brute([tuple(r) for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()])
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in out)


class Plain:
    """The tree by its definition: dictionaries of tuples."""

    def __init__(self, texts, depth, least, discount=S.DISCOUNT, gain=S.GAIN):
        self.n, self.kept, self.discount = Counter(), {}, discount
        for t in texts:
            w = tokens(t)
            for k in range(1, depth + 2):
                self.n.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        words = [g for g in self.n if len(g) == 1]
        self.total, self.size = sum(self.n[g] for g in words), len(words)
        for k in range(1, depth + 1):
            after = {}
            for g, n in self.n.items():
                if len(g) == k + 1 and n >= least:
                    after.setdefault(g[:-1], []).append(g)
            found = {}
            for c, grams in after.items():
                p, q = [self.n[g] / self.n[c] for g in grams], [self.prob(g[1:-1], g[-1]) for g in grams]
                other, other_q = max(0.0, 1 - sum(p)), max(1e-12, 1 - sum(q))
                kl = sum(x * math.log(x / y) for x, y in zip(p, q, strict=True)) + (other * math.log(other / other_q) if other > 1e-12 else 0)
                if self.n[c] * kl >= gain:
                    rest = min(1, max(1e-9, 1 - sum((self.n[g] - discount) / self.n[c] for g in grams)))
                    found[c] = (rest, {g[-1]: (self.n[g] - discount) / self.n[c] for g in grams})
            if not found:
                break
            self.kept |= found

    def prob(self, context, w):
        p = (self.n[(w,)] + 1) / (self.total + self.size + 1)
        for k in range(len(context)):
            if got := self.kept.get(tuple(context[len(context) - 1 - k :])):
                p = got[1].get(w, 0.0) + got[0] * p
        return p

    def score(self, text, depth):
        w = tokens(text)
        return sum(math.log10(self.prob(w[max(0, i - depth) : i], x)) for i, x in enumerate(w))


def corpus(seed, n, words):
    rng = np.random.default_rng(seed)
    parts = ["a b c", "x b d", "b c a", "d e e", "e a", "x e b a"]
    return [" ".join([*(parts[k] for k in rng.integers(0, len(parts), words)), f"only{i}"]) for i in range(n)]


@pytest.mark.parametrize(("depth", "least"), [(1, 2), (3, 5), (6, 3)])
def test_scores_are_those_of_the_plain_tree(spark, depth, least):
    texts = [*corpus(0, 40, 25), "", None, "A B c\tD", "x", "never seen"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Plain([t for i, t in enumerate(texts) if i % 5], depth, least)
    assert {len(c) for c in want.kept} >= set(range(1, min(depth, 3) + 1))
    for r in S.score_documents(df, F.col("doc_id") % 5 == 0, depth=depth, least=least).collect():
        assert r["score"] == pytest.approx(want.score(texts[r["doc_id"]], depth), abs=1e-6)


def test_distributions_sum_to_one():
    tree = Plain(corpus(1, 30, 20), 3, 5)
    words = [g[0] for g in tree.n if len(g) == 1]
    for context in (["a"], ["b"], ["a", "b"], ["x", "b"], ["e", "x", "b"], []):
        assert sum(tree.prob(context, w) for w in words) + tree.prob(context, "unknown") == pytest.approx(1, abs=1e-9)


def test_the_tree_grows_with_the_corpus(spark):
    states = []
    for n in (20, 200):
        df = spark.createDataFrame([(t,) for t in corpus(2, n, 30)], "text string").select(F.col("text").cast("binary"))
        states.append(S.learn(df, depth=8).lookup().where("rest IS NOT NULL").count())
    assert states[1] > 1.5 * states[0]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(corpus(3, 20, 20))), "doc_id long, text string")
    want = sorted(S.score_documents(df, F.lit(False)).collect())
    monkeypatch.setattr(S, "filter_bits", lambda codes: np.full(S.FILTER_BITS // 8, 255, np.uint8))
    got = sorted(S.score_documents(df, F.lit(False)).collect())
    assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in want] and all(math.isclose(x["score"], y["score"], rel_tol=1e-9) for x, y in zip(got, want, strict=True))


def test_context_stops_at_the_start_of_a_text(spark):
    df = spark.createDataFrame([(i, "x y") for i in range(40)] + [(40 + i, "y x") for i in range(3)] + [(50, "x"), (51, "y"), (52, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in S.score_documents(df, F.col("doc_id") >= 50).collect()}
    plain = Plain(["x y"] * 40 + ["y x"] * 3, 3, 5)
    for i, t in ((50, "x"), (51, "y"), (52, "x y")):
        assert got[i] == pytest.approx(plain.score(t, 3), abs=1e-9)
    assert got[52] > got[50] + got[51]


def test_columns_that_clash_and_long_texts(spark):
    long_ = " ".join(f"w{i % 977} v{i % 13}" for i in range(400_000))
    df = spark.createDataFrame([(1, long_, "a", "b", 1.0), (2, "w1 v1", "a", "b", 1.0)], "doc_id long, text string, held string, block string, n double")
    got = {r["doc_id"]: r for r in S.score_documents(df, F.col("doc_id") == 2).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[2]["n_known"]) == (800_001, 800_001, 3)


def test_empty_tables(spark, empty):
    held = C.remainder("doc_id", 7) == 2
    assert S.score_documents(empty, held).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = S.score_documents(one, F.lit(True)).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_word_hashes_do_not_depend_on_the_place():
    texts = [b"Alpha beta", b"", b"\x0bBETA\x0c\xc3\x84 alpha", b"x"]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, first = C.word_hashes(data, offs)
    assert list(first) == [0, 2, 2, 5, 6] and h[0] == h[4] and h[1] == h[2]
    assert (C.hash_words([b"alpha", b"beta"]) == h[:2]).all()
