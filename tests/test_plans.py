"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from terraloom import plans
from terraloom.plans.base import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "None"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 6) + 0.0)
    return str([_plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    if name not in plans.ORACLES:
        assert got
        return
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(map(_plain, r)) for r in want.select(*columns).fetchall())


def _both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over small tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = con.sql(plans.ORACLES[name]).select(*sorted(df.columns)).fetchall()
    return sorted(tuple(map(_plain, r)) for r in df.select(*sorted(df.columns)).collect()), sorted(tuple(map(_plain, r)) for r in want)


def test_tiers_of_lines_with_one_number(spark, tmp_path):
    """Lines may share order and number; then the smaller value counts, in whatever order they come."""
    lines = [(2, 1, 36 * i, s, float(q), "1997-01-01") for i in range(1, 6) for s in (1, 2) for q in ((9, 4, 7) if i % 2 else (3, 8, 5))]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, d string").selectExpr("* except (d)", "CAST(d AS date) AS l_shipdate")
    got, want = _both(spark, tmp_path, "d09_provenance_tiers", lineitem=lines)
    assert got == want and [r[2] for r in got] == ["3.0", "3.0"]


def test_a_total_on_the_edge_of_a_band_reaches_it(spark, tmp_path):
    """All parts come to 50 exactly (but for the last set, a tenth below): in any order of adding that is the same band."""
    sets = [(11, 15, 34, 23, 17, 22, 23, 35, 8, 16, 50, 19, 9, 26, 43, 20, 13, 24), (1, 24, 13, 46, 48, 10, 10, 7, 24, 47, 35, 34, 18, 2, 49, 25, 26, 6), (39, 42, 45, 36, 1, 40, 39, 43, 3, 48, 23, 19, 46, 12, 39, 8, 20, 5)]
    sets += [(11, 38, 11, 17, 36, 16, 24, 23, 35, 5, 13, 2, 1, 21, 15, 22, 15, 5), (36, 30, 10, 18, 15, 31, 40, 6, 19, 7, 12, 27, 7, 18, 33, 12, 3, 44), (46, 14, 3, 1, 45, 29, 5, 37, 15, 34, 23, 4, 41, 50, 27, 42, 8, 1)]
    sets.append(tuple(q - (m == 0) for m, q in enumerate(sets[0])))
    lines = [((18 * s + m) * 5 + 2, 1, m, s, float(q), "1997-01-01") for s in range(140) for m, q in enumerate(sets[s % 7])]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, d string").selectExpr("* except (d)", "CAST(d AS date) AS l_shipdate")
    for name, df in (("lineitem", lines), ("part", spark.range(36).withColumnRenamed("id", "p_partkey"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.company: (r.total, r.band) for r in plans.QUERIES["c18_market_report"](spark, str(tmp_path)).collect()}
    assert got == {f"c{s}": (49.866667, "laggard") if s % 7 == 6 else (50.0, "average") for s in range(140)}


def test_spans_at_half_seconds(spark, tmp_path):
    """Halves go to the even second on both sides."""
    stamps = [f"2024-01-0{d} 00:00:0{s}.{f}" for d in (1, 5) for s in (0, 1, 2, 3) for f in ("500000", "499999", "500001")]
    events = spark.createDataFrame([(i, i, s) for i, s in enumerate(stamps)], "event_id long, user_id long, s string").selectExpr("event_id", "user_id", "CAST(s AS timestamp_ntz) AS ts")
    got, want = _both(spark, tmp_path, "w09_interval_merge", events=events)
    assert got == want and len(got) == len(stamps)


def test_windows_of_a_word_said_over_and_over(spark, tmp_path):
    """A term of twice one word doesn't overlap itself: three words are one hit, four are two."""
    terms = spark.createDataFrame([(i, "the the") for i in range(4)], "item_id long, text string")
    pad = "pad " * 120
    texts = [f"{pad}{' '.join([w] * n)} {pad}" for n in range(1, 7) for w in ("the", "The")] + [f"{pad}the the, the the the {pad}the the  the the {pad}", None, "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("l07_candidate_windows", "l06_gated_prediction"):
        got, want = _both(spark, tmp_path / name, name, benchmark=terms, documents=docs)
        assert got == want and got


def test_verification_reads_claims_twice(spark, monkeypatch):
    """Best claims are chosen once for all that needs them, and once more among the claims that are read again."""
    from terraloom.plans import review

    chosen, plain = [], review._contributions
    monkeypatch.setattr(review, "_contributions", lambda t, claims=None: chosen.append(claims) or plain(t, claims))
    df = plans.QUERIES["c11_verification"](spark, FOLDER)
    assert len(chosen) == 2 and "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_routed_scores_choose_claims_once(spark, monkeypatch):
    from terraloom.plans import anchors

    chosen, plain = [], anchors._placed
    monkeypatch.setattr(anchors, "_placed", lambda t: chosen.append(t) or plain(t))
    df = plans.QUERIES["c09_routed_scores"](spark, FOLDER)
    # Claims are read again for the route alone.
    assert len(chosen) == 1 and df._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey") <= 4
