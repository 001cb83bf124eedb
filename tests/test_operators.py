"""Edge rows: ties, nulls, gates, budgets, spans."""

from pyspark.sql import functions as F

from terraloom.functions import names, scoring, text
from terraloom.operators import chunks, claims, ranking, spans
from terraloom.sources import keyed


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_best_claim_prefers_confidence_then_method_then_first(spark):
    df = spark.createDataFrame([("a", 0.5, "extracted", 3), ("a", 0.5, "dataset_lookup", 9), ("a", 0.5, "dataset_lookup", 8), ("b", 0.0, "odd", 1)], "factor string, confidence double, method string, seq long")
    assert rows(claims.best_claims(df, ["factor"]).select("factor", "seq"), "factor") == [("a", 8), ("b", 1)]


def test_gate_keeps_the_score_at_the_baseline(spark):
    df = spark.createDataFrame([("x", "E", 2.0, 1.0, "dataset_lookup", 1.0), ("y", "E", 2.5, 1.0, "dataset_lookup", 1.0)], "company string, pillar string, weight double, confidence double, method string, delta double")
    sums = spark.createDataFrame([("E", 10.0)], "pillar string, weight_sum double")
    got = {r.company: (r.gate_fired, round(r.score, 6)) for r in claims.pillar_reduction(df, sums, baseline=100.0).collect()}
    assert got["x"] == (True, 51.0)
    assert got["y"][0] is False and got["y"][1] > 70


def test_reconciled_votes(spark):
    df = spark.createDataFrame([(1, "E", 50.0, None, 0.0), (2, "E", 50.0, 60.0, 15.0), (3, "S", 0.0, 100.0, 15.0), (4, "G", None, None, 0.0)], "k int, pillar string, formula double, holistic double, mass double")
    got = {r.k: r for r in claims.reconciled(df).collect()}
    assert (got[1].label, got[1].high - got[1].low) == ("low", 10)
    assert got[2].label == "high" and got[3].label == "low"
    assert got[4].score == 50.0 and got[4].label == "low"


def test_midrank_and_average_rank_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "k int, v double").withColumn("g", F.lit(1))
    assert rows(ranking.midrank_percentile(df, ["g"], "v").select("k", F.round("percentile", 4)), "k") == [(1, 33.3333), (2, 33.3333), (3, 83.3333)]
    assert rows(ranking.with_average_rank(df, ["g"], "v", "place").select("k", "place"), "k") == [(1, 1.5), (2, 1.5), (3, 3.0)]


def test_spearman_needs_rows_and_variance(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 3.0, 1.0)], "g string, a double, b double")
    assert [(g, n, rho if rho is None else round(rho, 9)) for g, n, rho in rows(ranking.spearman(df, ["g"], "a", "b"), "g")] == [("a", 2, None), ("b", 3, None), ("c", 3, -1.0)]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 80), (1, 2, 30), (1, 3, 15), (1, 4, 5)], "g int, n int, size int")
    assert rows(ranking.budgeted(df, ["g"], "size", 100, [F.col("n")]).select("n", "chosen"), "n") == [(1, True), (2, False), (3, True), (4, False)]


def test_spans_touching_nested_and_apart(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 1, 2), (1, 11, 12)], "g int, lo int, hi int")
    assert rows(spans.merge_spans(df, ["g"], "lo", "hi"), "lo") == [(1, 0, 9, 3), (1, 11, 12, 1)]


def test_keyword_windows_at_both_ends(spark):
    df = spark.createDataFrame([(1, "Key and more words and a key")], "k int, t string")
    assert rows(spans.keyword_windows(df, ["k"], "t", ["key"], 2, 5), "start") == [(1, 0, 5, 1), (1, 23, 28, 1)]


def test_names(spark):
    form = lambda s: one(spark, names.normal_form(F.lit(s)))
    assert form("Foo-Bar, Ltd. Co") == "foo bar"
    assert form("S.A. Works") == "s a works"
    assert form("Ltd") == ""
    assert form("Société Générale SA") == "société générale"


def test_text(spark):
    assert one(spark, text.is_recent(F.lit("fined in 2019 and 2023"), 2021)) is True
    assert one(spark, text.is_recent(F.lit("no year"), 2021)) is True
    assert one(spark, text.is_recent(F.lit("in 2010"), 2021)) is False
    assert one(spark, text.quote_holds(F.lit("a  b c"), F.lit("B C"), F.lit(""))) is True
    assert one(spark, text.occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(spark, text.money(F.lit("$1,234.50"))) == 1234.5 and one(spark, text.money(F.lit("none"))) == 0.0
    assert one(spark, text.freshness(F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"))) == 0.6


def test_scoring_edges(spark):
    assert one(spark, scoring.band_score(F.lit(7.0), F.lit(3.0), F.lit(3.0))) == 50.0
    assert one(spark, scoring.band_delta(F.lit(99.0), F.lit(10.0), F.lit(0.0))) == 1.0
    assert one(spark, scoring.mean_of(F.lit(None).cast("double"), F.lit(4.0))) == 4.0
    assert one(spark, scoring.mean_of(F.lit(None).cast("double"))) is None
    assert one(spark, scoring.overlay(F.lit(0.0))) == 0.0


def test_keyed_writes(spark):
    old = spark.createDataFrame([(None, 1, 1), (2, 2, None)], "k int, a int, b int")
    new = spark.createDataFrame([(None, 5, None), (3, 3, 3)], "k int, a int, b int")
    assert sorted(map(str, rows(keyed.upsert(old, new, ["k"])))) == ["(2, 2, None)", "(3, 3, 3)", "(None, 5, None)"]
    assert rows(keyed.insert_ignoring(old.where("k = 2"), new.where("k = 3"), ["k"]), "k") == [(2, 2, None, False), (3, 3, 3, True)]
    assert rows(keyed.replace_scope(old.where("k = 2"), new.where("k = 3"), ["k"]), "k") == [(2, 2, None), (3, 3, 3)]


def test_chunks_and_json(spark):
    df = spark.createDataFrame([(1, 0, "h", "aaaa"), (1, 1, "h", "bbbb"), (1, 2, "i", "c"), (1, 3, "i", "dddddd")], "d int, n int, h string, t string")
    assert rows(chunks.chunked(df, ["d"], "n", "h", "t", 6, 2), "chunk_no") == [(1, 0, "h", "aaaa"), (1, 1, "h", "bbbb"), (1, 2, "i", "dddddd")]
    texts = spark.createDataFrame([('x {"a": "}"} y {"b": {"c": 1}} z',), ("none",), (None,)], "t string")
    assert [r[0] for r in texts.select(chunks.last_json_object("t")).collect()] == ['{"b": {"c": 1}}', None, None]


def test_trained_head_on_rows_it_has_not_seen(spark):
    """The labels of the given vectors don't depend on them, so these are made to: the side of a plane, and some of them missing."""
    import random

    from terraloom.operators import vectors

    rng = random.Random(3)
    points = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    truth = {i: v[0] + v[1] - v[2] > 0.5 for i, v in points}
    df = spark.createDataFrame([(i, v, None if i % 10 == 0 else truth[i]) for i, v in points], "id int, v array<double>, label boolean")
    rows = vectors.trained_head(df, "id", "v", "label", F.col("id") % 4 == 1).collect()
    unseen = [r for r in rows if r.held_out and r.answer != "abstain"]
    assert len(rows) == 400 and sum(r.held_out for r in rows) == 100 and len(unseen) > 80
    assert sum((r.answer == "yes") == truth[r.id] for r in unseen) >= 0.95 * len(unseen)


def test_chunks_of_rows_that_have_their_blocks(spark):
    """Texts aren't shuffled, and give what their blocks give."""
    rows = [(1, [("h", "aaaa"), ("h", "bbbb"), ("i", "c"), ("i", "dddddd")]), (2, []), (3, None), (4, [(None, "xx"), (None, ""), ("h", "é" * 9)])]
    df = spark.createDataFrame(rows, "d int, b array<struct<heading: string, text: string>>")
    out = chunks.chunked_blocks(df, ["d"], "b", 6, 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    blocks = df.select("d", F.posexplode("b").alias("n", "x")).select("d", "n", F.col("x.heading").alias("h"), F.col("x.text").alias("t"))
    want = [(1, 0, "h", "aaaa"), (1, 1, "h", "bbbb"), (1, 2, "i", "dddddd"), (4, 0, None, "xx\n"), (4, 1, "h", "é" * 9)]
    assert rows_of(out) == want == rows_of(chunks.chunked(blocks, ["d"], "n", "h", "t", 6, 2))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_term_weights_of_equal_documents(spark):
    """A document that stands for equal ones has the weight that each of them has."""
    from terraloom.operators import vectors

    df = spark.createDataFrame([(1, "red bolt red"), (2, "red bolt red"), (3, "old bolt"), (4, "red bolt red")], "k int, t string")
    once = spark.createDataFrame([(1, "red bolt red", 3), (3, "old bolt", 1)], "k int, t string, n long")
    tokens = F.split("t", " ")
    own = lambda w: rows(w.where("k in (1, 3)").select("k", "term", F.round("w", 12)), "k", "term")
    assert own(vectors.term_weights(df, "k", tokens)) == own(vectors.term_weights(once, "k", tokens, F.col("n")))
