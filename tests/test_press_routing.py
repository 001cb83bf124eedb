"""Feeds, press mentions, validation, routes and uplift on edge rows."""

import math

from pyspark.sql import functions as F

from terraloom.operators import claims, press, routing, validation, vectors
from terraloom.sources import feeds


def test_feed_items_and_broken_ones(spark):
    good = "<item><title><![CDATA[A &amp; <b>B</b>]]></title><link> http://x </link><pubDate>Mon, 01 Jan 2024 08:00:00</pubDate><content:encoded>\n full </content:encoded><description>short</description></item>"
    rows = [(1, good + "<item><title>t</title><description></description></item>"), (2, "<item><title>open<description>d</description><item><title>next</title><description>e</description></item>"), (3, ""), (4, None), (5, "<item>never closed"), (6, good)]
    got = [tuple(r) for r in feeds.feed_items(spark.createDataFrame(rows, "k int, xml string"), ["k"], "xml").orderBy("k", "nth").collect()]
    whole = ("A & B", "http://x", "Mon, 01 Jan 2024", "full", False)
    assert got == [(1, 0, *whole), (1, 1, "t", "", "", "", True), (2, 0, "open d next", "", "", "d", True), (6, 0, *whole)]


def test_table_rows_of_a_width(spark):
    html = "<table><tr><th>a</th></tr><TR class='x'><td>1</td><TD>2 &amp; 3</TD>\n<td><i>4</i></td></TR><tr><td>1</td></tr></table>"
    got = feeds.table_rows(spark.createDataFrame([(1, html), (2, ""), (3, None)], "k int, h string"), ["k"], "h", 3).collect()
    assert [tuple(r) for r in got] == [(1, 1, ["1", "2 & 3", "4"])]


def test_file_index(spark, tmp_path):
    for name in ("part=1/Acme_Corp__report__1.pdf", "part=2/acme corp__other__2.pdf", "part=2/Beta__x.pdf", "__none__3.pdf", "notes.txt", "plain.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.name: r.n for r in feeds.file_index(spark, str(tmp_path)).collect()}
    assert got == {"acme corp": 2, "beta": 1, "plain.pdf": 1}


def test_press_mentions(spark):
    articles = [
        (1, "Amazon forest", "The Amazon burns"), (2, "Amazon grows", "The retailer says AMAZON grows"), (3, "News", "über Acmefoods and Acmefood; then Acmefood"), (4, "Green Tank", "green tank of Climate"), (5, "IBM up", "IBM"),
        (6, None, None), (7, "", ""), (8, "acmefood", "acmefood only in small letters"), (9, "Blue Acmefood", "Acmefood is Blue"),
    ]
    companies = [("a", "Amazon Inc"), ("f", "Acmefood"), ("g", "Green Tank"), ("i", "IBM"), ("s", "Ibm"), ("n", None), ("b", "Blue Acmefood Ltd"), ("e", "The Ltd")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {(r.article, r.company): (r["at"], r.in_title) for r in press.press_mentions(make(articles, "article int, title string, body string"), make(companies, "company string, name string")).collect()}
    assert got == {
        (1, "a"): (4, False), (2, "a"): (18, True), (3, "f"): (19, False), (5, "i"): (0, True), (9, "f"): (0, True), (9, "b"): (0, True),
    }


def test_validation_in_order(spark):
    rules = validation.FactorRules(percentages=["pct"], totalled=["co2"], negative=["fine"], corroborated=["fine", "spill"])
    columns = "seq int, company string, pillar string, factor string, method string, source_tag string, polarity int, confidence double, value double, text_length int, present array<string>, country_total double"
    rows = [
        (1, "a", "E", "pct", "extracted", "s", 0, 0.9, 101.0, 300, ["pct"], None),
        (2, "a", "E", "pct", "extracted", "s", 0, 0.9, math.nan, 300, [], None),
        (3, "a", "E", "pct", "dataset_lookup", "s", 0, 0.9, -1.0, 300, [], None),
        (4, "a", "E", "co2", "extracted", "s", 0, 0.9, 50.0, 10, ["E"], 40.0),
        (5, "a", "G", "fine", "extracted", "s", 1, 0.9, None, 10, ["fine"], None),
        (6, "a", "G", "fine", "extracted", "report_pdf_e", -1, 0.8, None, 500, ["fine"], None),
        (7, "a", "G", "fine", "extracted", "report_pdf_s", -1, 0.8, None, 500, ["fine"], None),
        (8, "b", "E", "spill", "extracted", "x", -1, 0.8, None, None, None, None),
        (9, "b", "E", "spill", "extracted", "y", -1, 0.8, None, 0, [], None),
        (10, "b", "S", "other", "extracted", "y", 1, 0.9, math.inf, 10, [], None),
    ]
    out = validation.validate(spark.createDataFrame(rows, columns), rules, ["pct", "fine", "E"])
    got = {r.seq: (round(r.confidence, 6), r.value, r.flags) for r in out.collect()}
    assert got == {
        1: (0.9, None, ["numeric_bounds"]), 3: (0.9, None, ["numeric_bounds"]), 4: (0.3, 50.0, ["numeric_bounds"]), 5: (0.45, None, ["polarity_consistency"]), 6: (0.56, None, ["corroboration"]), 7: (0.56, None, ["corroboration"]),
        8: (0.8, None, []), 9: (0.5, None, ["known_failure_shape"]), 10: (0.5, None, ["numeric_bounds", "known_failure_shape"]),
    }
    assert validation.validate(spark.createDataFrame([], columns), rules, []).count() == 0
    texts = spark.createDataFrame([("A Spill, and FINES",), ("",), (None,)], "t string")
    lists = {"none": [], "fine": ["fine"], "spill": ["spill"], "both": ["fines", "spill"]}
    assert [r[0] for r in texts.select(validation.lists_present(F.col("t"), lists)).collect()] == [["spill", "both"], [], None]


def test_routes_and_ladder(spark):
    priors = [("a", "E", None, 80.0, 70.0, 60.0), ("a", "S", None, 80.0, None, 60.0), ("a", "G", 90.0, 80.0, None, None), ("b", "E", 20.0, 1.0, 1.0, 1.0)]
    priors = spark.createDataFrame(priors, "company string, pillar string, industry_median double, exio_structural double, peer_upright double, country double")
    assert {(r.company, r.pillar): (r.rung, r.prior) for r in routing.climbed(priors).collect()} == {("a", "E"): ("exio_structural", 80.0), ("a", "S"): ("country", 60.0), ("a", "G"): ("none", None), ("b", "E"): ("industry_median", 20.0)}
    scored = spark.createDataFrame([("a", p, 40.0) for p in "ESG"] + [("b", "E", 40.0), ("c", "E", 1.0)], "company string, pillar string, score double")
    given = spark.createDataFrame([("b", "E"), ("c", "E"), ("c", "E")], "company string, pillar string")
    parts = [("a", "E", "fine", 10.0, 1.0, -1.0), ("a", "E", "fine", 10.0, 1.0, 1.0), ("b", "E", "other", 10.0, 1.0, -1.0), ("c", "E", "fine", 90.0, 1.0, -1.0)]
    bad = routing.severities(spark.createDataFrame(parts, "company string, pillar string, factor string, weight double, confidence double, delta double"), ["fine"])
    got = {(r.company, r.pillar): (r.route, r.rung, round(r.score, 6)) for r in routing.routed(scored, given, priors, bad).collect()}
    fall = 20 * math.tanh(1.2 * 10 / 20)
    assert got == {("a", "E"): ("thin", "exio_structural", round(59 - fall, 6)), ("a", "S"): ("thin", "country", 53.0), ("a", "G"): ("thin", None, 50.0), ("b", "E"): ("rich", None, 40.0), ("c", "E"): ("rich", None, 0.0)}


def test_uplift_on_top_of_verdicts(spark):
    columns = "company string, pillar string, verdict string, mode string, score double, low double, high double, label string, needs_review boolean, reason string"
    rows = [(c, "E", v, "range", 40.0, 35.0, 45.0, "low", True, "x") for c, v in (("a", "refuted"), ("b", None), ("c", "passed"), ("d", "passed"))]
    uplift = spark.createDataFrame([("a", "E", True, 61.25, "listed"), ("b", "E", True, 62.0, "listed"), ("c", "E", False, 63.0, "no"), ("a", "S", True, 1.0, "other pillar")], "company string, pillar string, applied boolean, corrected double, reasoning string")
    got = {r.company: (r.verdict, r.mode, r.score, r.low, r.needs_review, r.label, r.reason) for r in routing.uplifted(spark.createDataFrame(rows, columns), uplift, ["company", "pillar"]).collect()}
    assert got["a"] == ("refuted+uplifted", "point", 61.25, 61.25, False, "low", "public-company uplift: 40.0 -> 61.3 (listed)") and got["b"][0] == "uplifted"
    assert got["c"] == got["d"] == ("passed", "range", 40.0, 35.0, True, "low", "x")


def test_saturation_with_anchor_and_closed_gate(spark):
    parts = [("a", "E", "f", 10.0, 1.0, 1.0, "extracted"), ("a", "E", "_peer_anchor", 10.0, 0.5, -1.0, "peer_anchor"), ("b", "E", "f", 1.0, 1.0, 1.0, "extracted"), ("b", "E", "_peer_anchor", 10.0, 0.5, -1.0, "peer_anchor"), ("c", "E", "_industry_median", 10.0, 0.3, 1.0, "exio_structural")]
    parts = spark.createDataFrame(parts, "company string, pillar string, factor string, weight double, confidence double, delta double, method string")
    scored = spark.createDataFrame([(c, "E", 80.0) for c in "abcd"], "company string, pillar string, baseline double")
    sums = spark.createDataFrame([("E", 20.0)], "pillar string, weight_sum double")
    got = {r.company: r for r in claims.saturated(parts, scored, sums).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.mass, a.gate_fired, a.coverage, a.n_claims) == (9.0, False, 0.5, 1) and round(a.delta, 9) == round((9 - 5) / 20, 9)
    assert b.gate_fired and b.delta == -0.5 and b.coverage == 0 and b.n_claims == 0 and b.anchored  # behind a closed gate the anchor moves alone
    assert not c.gate_fired and c.n_claims == 1 and not c.anchored  # the industry's vote counts as a claim
    assert d.score == 50 + 0.02 * 30 and d.mass == 0


def test_nearest_centre_with_many_centres(spark, monkeypatch):
    points = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    centres = spark.range(0, 50, 7).select(F.col("id").alias("centre"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("c"))
    want = {i: min(range(0, 50, 7), key=lambda c: (abs(c - i), c)) for i in range(50)}
    assert {r.id: r.centre for r in vectors.nearest(points, "id", "v", centres).collect()} == want
    monkeypatch.setattr(vectors, "MOST_CENTRES", 3)
    assert {r.id: r.centre for r in vectors.nearest(points, "id", "v", centres).collect()} == want


def test_answers_of_models(spark):
    from terraloom.functions import answers

    rows = ['{"a": 1, "b": 2}', '```json\n{"a": 1, "b": {"c": 2}}\n```', '{"a": 1, "b": 2} and {"a": 3, "b": 4} but {"a": 5}', '{"a": 1} {"a": 1, "b": ', "", None, "none", '[{"a": 1, "b": 2}]']
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(answers.object_with(F.col("t"), ["a", "b"])).collect()]
    assert got == ['{"a": 1, "b": 2}', '{"a": 1, "b": {"c": 2}}', '{"a": 3, "b": 4}', None, None, None, None, '{"a": 1, "b": 2}']
    rows = ['{"companies": [" A ", "", "B"]}', '["A", " "]', 'x {"n": 1, "companies": ["C"]} y', '{"companies": "no list"}', '{"other": ["A"]}', "", None, "[broken"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(answers.name_list(F.col("t"))).collect()]
    assert got[:3] == [["A", "B"], ["A"], ["C"]] and got[4:] == [[], [], [], []]
    rows = [('{"corrected_score": 70.5, "reasoning": "  big "}', 50.0), ('{"corrected_score": "70"}', 50.0), ('{"corrected_score": 60}', 50.0), ('{"corrected_score": 100.5}', 50.0), ('{"corrected_score": 70}', 80.0), ('{"corrected_score": "much"}', 1.0), (None, 1.0), ("", None)]
    df = spark.createDataFrame(rows, "t string, o double")
    got = [tuple(r[0]) for r in df.select(answers.correction(F.col("t"), F.col("o"))).collect()]
    no = (False, None, None)
    assert got == [(True, 70.5, "big"), (True, 70.0, "(no reasoning given)"), no, no, no, no, no, no]


def test_report_coverage(spark):
    from terraloom.operators import reports

    terms = reports.ReportTerms({"E": ["carbon", "water"], "S": ["safety"]}, ["effective tax rate"])
    real = "carbon fell by 12 % and water use was 3.5 million " * 6
    contents = "\n".join(f"carbon page {i}" for i in range(9))
    money = "carbon and the Effective Tax Rate " * 10
    text = "\n\n".join([contents, money, "letter about carbon " * 3, real, "x" * 2500 + " safety"])
    rows = [(1, text), (2, ""), (3, None), (4, "safety first"), (5, f"{real}<<page>>{contents}<<page>> <<page>>" + "safety " * 60)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {(r.k, r.pillar): r for r in reports.coverage(df, ["k"], "t", terms, page_mark="<<page>>").collect()}
    e = got[1, "E"]
    assert e.verdict == "strong" and e.financial_hits == 0 and e.selection == "letter about carbon letter about carbon letter about carbon\n\n" + real.strip()
    assert got[1, "S"].verdict == "none" and got[1, "S"].selection.endswith("safety")  # the last piece of the long block
    assert all(got[k, p].verdict == "none" and got[k, p].density == 0 for k in (2, 3, 4) for p in "ES")
    assert got[5, "E"].selection == real.strip() and got[5, "S"].verdict == "strong"
    assert reports.coverage(df.limit(0), ["k"], "t", terms).count() == 0


def test_assessed_scores_step_by_step(spark):
    from terraloom.operators import calculators

    parts = [("a", "E", 5.0, 0.6, 10.0, 0.0), ("a", "E", 5.0, 0.6, 0.0, 0.005), ("a", "G", 20.0, 0.6, -10.0, 2.0), ("b", "E", 1.0, 0.6, 3.0, 0.0), ("c", "E", 5.0, 0.9, -200.0, 0.0)]
    parts = spark.createDataFrame(parts, "company string, pillar string, weight double, confidence double, points double, beyond double")
    rows = [("a", "E", 40.0, 60.0, 20.0, True, None), ("a", "G", None, 80.0, 20.0, True, False), ("b", "E", 50.0, None, 20.0, None, None), ("c", "E", None, None, 20.0, None, None), ("d", "G", None, None, 20.0, True, True), ("e", "S", None, None, 20.0, None, None)]
    pillars = spark.createDataFrame(rows, "company string, pillar string, country_baseline double, industry_baseline double, registered double, x boolean, y boolean")
    got = {(r.company, r.pillar): r for r in calculators.assessed(parts, pillars, calculators.badge_points(F.col("x"), F.col("y"))).collect()}
    a = got["a", "E"]  # 40 + 10, + 10 for the industry's half, then 10 more points fade out over the 40 left
    assert round(a.score, 9) == round(60 + 40 * math.tanh(10 / 40), 9) and (a.label, a.penalty, a.n_claims) == ("high", 0.0, 2)
    g = got["a", "G"]  # 50 - 10, + 30 for the industry, all factors supplied, 2 off, badges even out
    assert round(g.score, 9) == 68.0 and (round(g.low, 9), round(g.high, 9)) == (60.0, 76.0)
    assert round(got["b", "E"].score, 9) == round(53 + 47 * math.tanh(9 / 47), 9)  # four times at most
    assert got["c", "E"].score == 0 and got["c", "E"].label == "low"
    assert got["d", "G"].score == 56 and (got["e", "S"].score, got["e", "S"].low, got["e", "S"].high) == (50.0, 0.0, 100.0)
