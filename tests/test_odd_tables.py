"""Queries against their SQL on small tables with what the test tables seldom hold: equal sort keys, large keys, times within a second."""

import functools
import math
import operator
import random

import duckdb
import pytest

from sedimenta.operators import incremental
from sedimenta.plans import catalog


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables (name -> SELECT), runs a query on them, and returns its rows if they equal those of its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, rows in tables.items():
            con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        found = con.execute(catalog.SQL[name])
        order = [[d[0] for d in found.description].index(c) for c in df.columns]
        want = sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)
        got = sorted(map(tuple, df.collect()), key=repr)
        assert got == want
        return got

    return run


def _reviews(rows):
    return f"SELECT o::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, p::BIGINT AS l_partkey, v AS l_returnflag FROM (VALUES {rows}) AS t(o, n, p, v)"


def test_reviews_with_parts_beyond_a_million(same):
    """1 * 1000000 + 1500000 is later than 2 * 1000000 + 7."""
    got = same("versioned_reviews", lineitem=_reviews("(1, 1, 1500000, 'A'), (1, 2, 7, 'R'), (1, 4, 1, 'R'), (2, 3, 1, 'N'), (2, 4, 2000000, 'N'), (2, 5, 5, 'A')"))
    assert got == [(1, "R", 3)]


def test_equal_reviews_go_by_the_files_order(same):
    rows = ", ".join(f"({o}, 5, 9, '{v}')" for o in range(200) for v in ("ANR" if o % 2 else "RNA"))
    got = same("versioned_reviews", lineitem=_reviews(f"{rows}, (500, 4, 2, 'N'), (500, 6, 1, NULL), (501, 2, 2, NULL), (501, 4, 2, 'A')"))
    assert got[:2] == [(0, "R", 1), (1, "A", 1)]


def _events(rows):
    return f"SELECT i::BIGINT AS event_id, t::TIMESTAMP AS ts, u::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '{{\"k\": 1}}' AS props FROM ({rows}) AS t(i, t, u, v)"


def test_frontier_counts_parts_of_a_second(same):
    rows = "VALUES (1, '2024-01-01 00:00:00', 1, 1), (2, '2024-01-01 00:00:10.2', 1, 1), (3, '2024-01-01 00:00:10.5', 1, 1), (4, '2024-01-01 00:01:10.4', 1, 1)"
    assert same("frontier", events=_events(rows)) == [(2,)]


RISES = [207.63, 33.84, 16.87, 32.4, 6.5, 48.6, 29.3, 17.34, 76.1, 87.67, 0.66, 38.02, 16.0, 136.86, 76.14, 14.1, 15.58, 8.41, 224.7, 13.28]
FALLS = [17.35, 46.83, 32.18, 51.76, 46.3, 68.03, 6.29, 71.44, 17.88, 38.12, 20.48, 17.61, 37.74, 31.21, 22.4, 68.33, 44.68, 1.86, 14.55, 144.96]


def test_amounts_that_reach_a_bound_exactly(spark, tmp_path):
    """Added one by one these doubles come to 1099.9999999999998 and 800.0000000000001; the SQL decides by exact amounts when they are decimals."""
    assert functools.reduce(operator.add, RISES) < 1100 and functools.reduce(operator.add, FALLS) > 800
    amounts = [(u, v) for u, vs in ((1, RISES), (2, [1200.0, *FALLS])) for v in vs]
    rows = ", ".join(f"({i}, '2024-01-01 00:00:{i}', {u}, {v})" for i, (u, v) in enumerate(amounts))
    con = duckdb.connect()
    con.execute(f"COPY ({_events('VALUES ' + rows)}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (value::DECIMAL(12, 2) AS value) FROM '{tmp_path}/events.parquet'")
    want = dict(con.execute(catalog.SQL["mode_hysteresis"]).fetchall())
    got = {r["id"]: r["mode"] for r in catalog.QUERIES["mode_hysteresis"](spark, str(tmp_path)).collect()}
    assert got == want and (got[18], got[19], got[39], got[40]) == ("dmn", "cen", "cen", "dmn")


def test_rolling_sums_are_rounded_once(spark):
    r = random.Random(3)
    values = [r.choice((1, -1)) * r.random() * 10.0 ** r.randint(-6, 7) for _ in range(300)]
    values[50:53] = [None, 1e300, 1e12]
    values[100], values[200] = float("inf"), float("nan")
    df = spark.createDataFrame(list(enumerate(values)), "id long, value double")
    got = {x["id"]: x["total"] for x in df.select("id", incremental.rolling(df, "value", ["id"], 20).alias("total")).collect()}
    for i in range(300):
        held = [v for v in values[max(0, i - 19) : i + 1] if v is not None]
        want = math.fsum(held)
        assert got[i] == want or (math.isnan(got[i]) and math.isnan(want)) or (max(held) >= 1e12 and got[i] == pytest.approx(want, rel=1e-15))


def test_no_relevant_among_the_first_hundred_has_no_hits(same):
    rows = "SELECT i::BIGINT AS vec_id, [i, 0]::FLOAT[] AS embedding, (CASE WHEN i IN (0, 150) THEN 1 ELSE 2 END)::INTEGER AS label FROM range(160) t(i)"
    got = same("retrieval_metrics", embeddings=rows)
    assert [r[0] for r in got if r[1] is None] == [0, 150] and got[0] == (0, None, None, 0.0, 0.0)
