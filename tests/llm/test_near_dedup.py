import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import near_dedup as N


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(docs, rows, n):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, n).where("doc_id IS NOT NULL").collect()}
    assert got == brute({r[0]: r[1] for r in rows if r[0] is not None}.items(), n)


def test_query_on_the_tables(spark, sf):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.op5_near_dedup(spark, sf).collect()}
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 2)


def test_chains_of_near_copies(spark):
    """Each document is like the next one only; a chain is one component."""
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 140])) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2) and {v[1] for v in got.values()} == {0}


def test_pigeonhole_keys_meet_within_the_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (200, N.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    radius = 2 * (N.SYMBOLS // N.CHUNK) - 1
    for r in b:
        r[rng.permutation(N.SYMBOLS)[:radius]] ^= 1
    assert (N.chunk_keys(a, N.CHUNK) == N.chunk_keys(b, N.CHUNK)).any(axis=1).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1800, dtype=np.uint64)
    a, b = np.unique(base[:1000]), np.unique(base[110:1110])
    s = N.signatures([a, b], 4000)
    assert abs((s[0] == s[1]).mean() - 890 / 1110) < 0.03


def test_dropping_keeps_columns_and_one_of_each_group(docs, rows, empty):
    out = N.drop_near_duplicates(docs.withColumn("n", F.lit(1)).withColumn("gone_id", F.lit("x")), 5)
    assert out.columns == [*docs.columns, "n", "gone_id"]
    kept = {r[0] for r in out.select("doc_id").collect()}
    want = brute({r[0]: r[1] for r in rows if r[0] is not None}.items(), 5)
    assert kept - {None} == {i for i, v in want.items() if v[2]}
    assert N.near_duplicates(empty).collect() == []


def test_pairs_that_no_pivot_meets(spark, monkeypatch):
    """Two families under common passages: members link to their own kind only, whichever class is the pivot."""
    import random

    rng = random.Random(5)
    common = [f"c{k}" for k in range(70)]
    rows, i = [], 0
    for fam in range(6):
        own = [f"f{fam}x{k}" for k in range(50)]
        for _ in range(8):
            w = common + own
            for _ in range(4):
                w[rng.randrange(len(w))] = f"edit{i}_{rng.random()}"
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "KEY_TILE", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2)


def test_components_by_rounds_of_stars(spark):
    import random

    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, 501)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {r["id"]: r["component"] for r in N.components(df).collect()}
    assert {r["id"]: r["component"] for r in N.components(df, per_task=0).collect()} == want
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert want == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_rows_of_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z")]
    got = sorted((r["doc_id"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_all_pairs_that_meet_may_be_confirmed_and_hot_pivots_are_salted(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 300)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["component_id"]) for r in df.collect())
    want = key(N.near_duplicates(docs, words=2))
    assert key(N.near_duplicates(docs, words=2, far=None)) == want
    monkeypatch.setattr(N, "PIVOT_PAIRS", 8)
    monkeypatch.setattr(N, "SALTS", 4)
    assert key(N.near_duplicates(docs, words=2)) == want
