import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import line_dedup as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=5):
    holders = defaultdict(set)
    for n, (i, t, *_) in enumerate(rows):
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\r\x0b\x0c").translate(FOLD)
            if len(key) >= 40:
                holders[key].add((i if i is not None else -(1 << 63), n))
    keeper = {k: max(h)[0] for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        own = i if i is not None else -(1 << 63)
        kept = [x for x in lines if keeper.get(x.strip(" \t\n\r\x0b\x0c").translate(FOLD), own) == own]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("bytes_", [L.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("shard_keys", [L.SHARD_KEYS, 1])
def test_against_brute_force(docs, rows, bytes_, shard_keys):
    if bytes_ == -1:  # the other way takes rows of the same id and text as one
        docs, rows = docs.dropDuplicates(["doc_id", "text"]), list({(r[0], r[1]): r for r in rows}.values())
    out = L.dedup_lines(docs, broadcast_bytes=bytes_, shard_keys=shard_keys).select("doc_id", "text", "n_lines", "n_dropped")
    assert Counter(map(tuple, out.collect())) == brute(rows)


def test_columns_that_clash_and_empty_tables(docs, empty):
    out = L.dedup_lines(docs.withColumn("n_lines", F.lit("mine")).withColumn("low", F.lit(1)))
    assert out.columns == [*docs.columns, "n_lines", "low", "_n_lines", "n_dropped"]
    assert {r[0] for r in out.select("n_lines").collect()} == {"mine"}
    assert L.dedup_lines(empty).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    h = L.PerfectHash.load(*L.PerfectHash.build(keys).dump())
    assert sorted(h.index(keys)) == list(range(len(keys))) and h.size == len(keys)


def test_query_on_the_tables(spark, sf):
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.op6_line_dedup(spark, sf).collect()}
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert out == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in want}
    assert re.fullmatch("[0-9a-f]{64}", next(iter(out.values()))[2])


def test_both_ways_agree_with_clashing_names_and_salts(spark, docs):
    own = docs.selectExpr("*", "'x' AS gone", "1 AS block", "'y' AS n_lines", "2.0 AS shard")
    frequent = L.written(L.count_lines(own).where("docs >= 3"), "lines")
    arrays = L.written(L.build_shards(frequent, 2), "arrays")
    names = ["_n_lines", "n_dropped"]
    one = L._by_broadcast(own, arrays, 2, 40, names)
    two = L._by_shard(own, arrays, 2, 40, names, block_bytes=2000, most_asks=10)
    key = lambda df: sorted(map(repr, df.collect()))
    assert one.columns == two.columns and key(one) == key(two) and one.where("n_dropped > 0").count() > 0
