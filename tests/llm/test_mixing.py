from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import mixing as M


def words(text):
    return [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]


def test_targets():
    assert M.targets([100, 100], [3, 1], 300, 2) == [200.0, 100.0]
    assert M.targets([10, 1000, 50], [3, 1, 2], 1590, 2) == pytest.approx([20, 1470, 100])
    assert M.targets([5, 5], [1, 1], 100, 2) == [10.0, 10.0]
    assert M.targets([0, 10], [3, 1], 15, 2) == pytest.approx([0, 15])


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_one(n):
    got = M.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
    assert sorted(got) == list(range(n))
    assert all(M._place_of(int(v), n, 12345) == k for k, v in enumerate(got))


def test_shards_split_the_quota():
    quota = np.array([700, 3, 0, 250])
    shards, slots = 10, 100
    seen = np.zeros(4, int)
    for s in range(shards):
        counts, before = M.shard_counts(s, shards, slots, quota, 9)
        assert (before == seen).all() and counts.sum() == min(slots, quota.sum() - s * slots)
        seen += counts
    assert (seen == quota).all()
    big = np.array([1_500_000_000, 700_000_000])
    counts, _ = M.shard_counts(3, 7, 400_000_000, big, 1)
    assert counts.sum() <= 400_000_000 and (counts >= 0).all()


def run_query(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return M.op1_mixing(spark, folder).collect()


def test_query(spark, rows, tmp_path):
    out = run_query(spark, rows, str(tmp_path))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    source = {}
    for r in rows:
        source[(r[0], len(words(r[1])))] = r[3]
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    for r in out:
        s = source[(r["doc_id"], r["size"])]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[s]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = M.targets([size[s] for s in names], [[3, 1, 2][k % 3] for k in range(len(names))], 1.5 * sum(size.values()))
    assert [target[s] for s in names] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in names)
    again = M.op1_mixing(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_documents_of_the_mix(spark, docs, rows, empty):
    out = M.mixed_documents(docs.withColumn("size", F.lit(7)), block=64).collect()
    placed, drawn, _ = M.mix(docs.select("doc_id", "source", "text"), block=64)
    want, got = Counter(), Counter()
    for r in M.taken(placed, drawn, 64).collect():
        want[r["doc_id"]] += r["taken"]
    for r in out:
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["size"] == 7
    assert got == Counter({k: v for k, v in want.items() if v})
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    assert all(any(r["text"] in (t or "") for t in texts[r["doc_id"]]) for r in out)
    assert M.mixed_documents(empty).collect() == []


def test_split_has_the_variance_of_draws_without_return():
    import numpy as np

    for good, bad, drawn in ((40, 25, 30), (3_000, 5_000, 2_000), (2 * 10**9, 10**9, 15 * 10**8)):
        rng = np.random.default_rng(4)
        got = np.array([M.hypergeometric(rng, good, bad, drawn) for _ in range(3000)], float)
        total = good + bad
        mean, var = drawn * good / total, drawn * (good / total) * (bad / total) * (total - drawn) / (total - 1)
        assert abs(got.mean() - mean) < 5 * (var / 3000) ** 0.5 and 0.85 < got.var() / var < 1.15


def test_shards_share_out_the_quota_exactly():
    import numpy as np

    quota, seen = np.array([700, 0, 55, 1200]), {}
    shards = [M.shard_counts(k, 20, 100, quota, 3, seen) for k in range(20)]
    assert (sum(c for c, _ in shards) == quota).all() and all(c.sum() == 100 for c, _ in shards[:19])
    for k in range(1, 20):
        assert (shards[k][1] == shards[k - 1][0] + shards[k - 1][1]).all() and (shards[k][0] == M.shard_counts(k, 20, 100, quota, 3)[0]).all()


def test_columns_that_clash(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40)), "ab"[i % 2], "s", i, "t") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, mix_tie int, _cuts string")
    out = M.mixed_documents(docs, block=8, slots=16)
    assert out.columns == docs.columns and out.count() > 0 and {r["_size"] for r in out.collect()} == {"s"}
