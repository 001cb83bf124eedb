"""What steps move, so that they keep to their limits on larger tables."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from terraloom import plans
from terraloom.operators import record_rules, validation


def plan_of(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_claims_stay_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("c01_full_validation", "m19_cluster_severity"):
            plan = plan_of(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))
            assert not re.search(r"Exchange hashpartitioning\([^)]*(?:source_tag|pillar)", plan), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joined_where_it_holds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (None, "a")], "n int, k string")
    other = spark.createDataFrame([("a", 7), (None, 9)], "k string, v int")
    got = validation.joined_where(rows, F.col("n") != 2, other, ["k"])
    assert sorted(((r.n, r.k, r.v) for r in got.collect()), key=str) == sorted([(1, "a", 7), (2, "a", None), (3, "b", None), (4, None, None), (None, "a", None)], key=str)


def test_records_are_thinned_before_they_meet_companies(spark):
    """Rows that say the same of one name are one row by then, and years are looked for in kept rows only."""
    rule = record_rules.RecordRule("f", "t", ("name", "name", "other"), "strict", ("what", "null"), "id", "id < 9", "what", 2000, distinct=True)
    rows = [(i, "Customer#000000001 Inc", None, "x") for i in range(20)] + [(30, "Customer#000000001 Inc", None, "y"), (-1, None, None, "x"), (-2, "Customer#000000001", None, " ")]
    tables = {"t": spark.createDataFrame(rows, "id int, name string, other string, what string")}
    companies = spark.createDataFrame([("a", "Customer#000000001"), ("b", "Customer#000000002")], "company string, name string")
    out = record_rules.record_signals([rule], tables, companies)
    assert [tuple(r) for r in out.collect()] == [("a", "f", "negative", 1, "x")]
    plan = plan_of(out)
    assert plan.index("HashAggregate(keys=[tag") > 0 and re.search(r"hashpartitioning\(tag#\d+, match#\d+, name#\d+", plan)
