"""Pools of like names against a plain loop over difflib."""

import difflib
import heapq
import random
import time

import duckdb

from sedimenta.plans import catalog


def _parts(path, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_type VARCHAR, p_name VARCHAR)")
    con.executemany("INSERT INTO part VALUES (?, ?, ?)", rows) if len(rows) < 3000 else con.execute("INSERT INTO part SELECT i, 'K', n FROM (SELECT unnest(?) AS i, unnest(?) AS n)", [[r[0] for r in rows], [r[2] for r in rows]])
    con.execute(f"COPY part TO '{path}/part.parquet' (FORMAT parquet)")


def _pool(rows, i):
    kind, name = next((k, n.lower()) for x, k, n in rows if x == i)
    like = {n: difflib.SequenceMatcher(None, name, n.lower()).ratio() for n in {n for _, k, n in rows if k == kind and n is not None}}
    best = heapq.nsmallest(8, ((-like[n], x) for x, k, n in rows if k == kind and x != i and n is not None))
    return [(i, x, round(-s, 6), r + 1) for r, (s, x) in enumerate(best)]


def test_pools_equal_a_plain_loop(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, r.choice("AB"), "".join(r.choice("abcdeF ") for _ in range(r.randint(0, 9)))) for k in range(1200)] + [(1201, "A", None), (1202, None, "abc"), (1250, "C", "alone")]
    _parts(tmp_path, rows)
    got = sorted(map(tuple, catalog.QUERIES["candidate_pool"](spark, str(tmp_path)).collect()), key=lambda x: (x[0], x[3]))
    assert got == [x for i in range(0, 1200, 50) for x in _pool(rows, i)]


def test_many_equal_names_are_matched_once(spark, tmp_path):
    words = [f"{a} {b}" for a in ("hot", "cold", "blue", "large") for b in ("bolt", "ring", "plate", "valve")]
    rows = [(k, "K", words[k * 7 % 16]) for k in range(60_000)]
    _parts(tmp_path, rows)
    start = time.monotonic()
    got = sorted(map(tuple, catalog.QUERIES["candidate_pool"](spark, str(tmp_path)).collect()), key=lambda x: (x[0], x[3]))
    assert time.monotonic() - start < 40
    assert len(got) == 1200 * 8 and got[:16] == _pool(rows, 0) + _pool(rows, 50)
