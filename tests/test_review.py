"""Verification, windows, clusters, countries, registers, records and ranks on edge rows and against brute force."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from terraloom.functions import text
from terraloom.operators import candidates, clusters, countries, peers, ranking, record_rules, registers, verification
from terraloom.streaming.verification import verified_stream

KEYS = ["company", "pillar"]
VERDICTS = "company string, pillar string, seq int, round int, critic string, verdict string, flagged string, objection string"


def verdict_rows(company, first, second=(), flags=("f", "f", "f")):
    """Rows of both rounds; each critic says one thing, in order."""
    rows = []
    for r, said in ((1, first), (2, second)):
        rows += [(company, "E", 10 * r + i, r, verification.CRITICS[i], v, flags[i], f"{company}{r}{i}") for i, v in enumerate(said) if v]
    return rows


R, P, A = "refute", "pass", "abstain"
CASES = {
    "high": ([R, R, R], []),
    "silent": ([A, A, P], []),
    "passed": ([P, P, R], []),
    "split": ([P, R, P], []),
    "fixed": ([R, R, P], []),
    "unflagged": ([R, A, R], []),
    "failed": ([R, R, P], [P, P, P]),
    "noop": ([R, P, R], [P, P, P]),
    "settled": ([R, R, P], []),
    "thinned": ([R, R, P], []),
    "again": ([R, R, P], [P, A, P]),
    "final": ([R, R, P], [R, P, R]),
    "open2": ([R, R, P], [A, A, R]),
    "prior": ([R, R, R], []),
}


@pytest.fixture(scope="module")
def review(spark):
    flags = {"unflagged": ("f", "f", "g")}
    rows = [row for c, (a, b) in CASES.items() for row in verdict_rows(c, a, b, flags.get(c, ("f", "f", "f")))]
    scores = [(c, "E", "range" if c == "low" else "point", "prior" if c == "prior" else "evidence", {"high": "high", "low": "low"}.get(c, "medium"), 50.0, 45.0, 55.0, c == "low") for c in [*CASES, "low", "unheard"]]
    scores = spark.createDataFrame(scores, "company string, pillar string, mode string, basis string, label string, score double, low double, high double, needs_review boolean")
    methods = spark.createDataFrame([(c, "E", "f", "dataset_lookup" if c == "fixed" else "extracted") for c in CASES], "company string, pillar string, factor string, method string")
    new = {"noop": (True, "point", "medium"), "settled": (False, "point", "high"), "thinned": (False, "range", "low"), "again": (False, "point", "medium"), "final": (False, "point", "medium"), "open2": (False, "point", "medium")}
    rescored = spark.createDataFrame([(c, "E", *v, 60.0, 58.0, 62.0, v[1] == "range") for c, v in new.items()], "company string, pillar string, same boolean, mode string, label string, score double, low double, high double, needs_review boolean")
    return rows, scores, methods, rescored


WANT = {
    "high": ("skipped", "point", "high", False, False, 0), "low": ("skipped", "range", "low", True, False, 0), "prior": ("skipped", "point", "medium", False, False, 0), "unheard": ("inconclusive", "point", "medium", True, False, 3),
    "silent": ("inconclusive", "point", "medium", True, False, 3), "passed": ("passed", "point", "medium", False, False, 2), "split": ("passed", "point", "medium", False, False, 3),
    "fixed": ("refuted", "range", "low", True, False, 2), "unflagged": ("refuted", "range", "low", True, False, 3), "failed": ("refuted", "range", "low", True, True, 2), "noop": ("refuted", "range", "low", True, True, 3),
    "settled": ("passed_after_retry", "point", "high", False, True, 2), "thinned": ("refuted", "range", "low", True, True, 2), "again": ("passed_after_retry", "point", "medium", False, True, 5),
    "final": ("refuted", "range", "low", True, True, 5), "open2": ("inconclusive", "point", "medium", True, True, 5),
}


def outcome(rows):
    return {r.company: (r.verdict, r.mode, r.label, r.needs_review, r.retried, r.critic_calls) for r in rows}


def test_verification_states(spark, review):
    rows, scores, methods, rescored = review
    late = [("passed", "E", 99, 1, verification.CRITICS[0], R, "f", "again"), ("split", "E", 98, 1, verification.CRITICS[2], R, "f", "again"), ("passed", "E", 97, 3, verification.CRITICS[1], R, "f", "no such round"), ("passed", "E", 96, 1, "somebody", R, "f", "no such critic")]
    verdicts = spark.createDataFrame(rows + late + rows, VERDICTS)
    panels = verification.panels(verdicts, KEYS)
    out = verification.verified(scores, panels, methods, rescored, KEYS).collect()
    assert outcome(out) == WANT
    said = {r.company: r.objections for r in out}
    assert said["final"] == ["final10", "final11", "final20", "final22"] and said["passed"] == said["high"] == []
    score = {r.company: (r.score, r.low) for r in out}
    assert score["thinned"] == (60.0, 58.0) and score["noop"] == (50.0, 45.0)
    asked = {r.company: (r.factor, r.objections) for r in verification.retry_requests(scores, panels, methods, KEYS).collect()}
    assert set(asked) == {"failed", "noop", "settled", "thinned", "again", "final", "open2"} and asked["noop"] == ("f", ["noop10"])
    empty = verification.verified(scores.limit(0), verification.panels(verdicts.limit(0), KEYS), methods, rescored, KEYS)
    assert empty.count() == 0


def test_verification_stream_ends_where_the_table_does(spark, review, tmp_path):
    rows, scores, methods, rescored = review
    rng = random.Random(2)
    rows = rows + rng.sample(rows, 10)
    rng.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], VERDICTS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(VERDICTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def keep(batch, _):
        out.update(outcome(batch.collect()))

    job = verified_stream(scores, stream, methods, rescored, KEYS).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert job.awaitTermination(120)
    assert out == {c: w for c, w in WANT.items() if c in CASES}


def test_same_reading_ignores_order(spark):
    make = lambda rows: spark.createDataFrame(rows, "company string, pillar string, reading string")
    old = make([("a", "E", "x"), ("a", "E", "y"), ("b", "E", "x"), ("c", "E", "x"), ("d", "E", None)])
    new = make([("a", "E", "y"), ("a", "E", "x"), ("b", "E", "x"), ("b", "E", "x"), ("d", "E", None)])
    assert {r.company: r.same for r in verification.same_reading(old, new, KEYS).collect()} == {"a": True, "b": False, "c": False, "d": True}


# --- windows -------------------------------------------------------------------------------------------------------


def brute_windows(t, lists):
    out, seen = [], set()
    for factor, pillar, terms in lists:
        hits = sorted(((m.start(), i, m.end(), m.group(0)) for i, w in enumerate(terms) for m in re.finditer(r"\b" + re.escape(w) + r"\b", t, re.I)), key=lambda h: h[:2])
        spans = []
        for start, _, end, word in hits:
            low, high = max(0, start - 300), min(len(t), end + 300)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high, word])
        for low, high, word in spans:
            window = t[low:high].strip()
            if window[:200] not in seen:
                seen.add(window[:200])
                out.append((factor, pillar, low, high, word, window))
    return out


def test_candidate_windows_match_brute_force(spark):
    rng = random.Random(4)
    words = ["net", "zero", "net zero", "Über", "fine", "fines", "e-mail", "x.", "co2", "ß", "filler", "and", "more"]
    texts = ["", None, "fine", "fine " + "z" * 500, "\n" * 350 + "fine" + "\n" * 350, "İstanbul " * 50 + "net zero " + "q " * 300 + "NET ZERO."]
    for _ in range(60):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", ", ", "_"]) + "pad " * rng.choice([0, 0, 1, 150]) for _ in range(rng.randrange(120))))
    lists = [("climate", "E", ["net zero", "zero", "CO2"]), ("fines", "G", ["fine", "über", "e-mail", "x."]), ("none", "S", []), ("G", "G", ["fine", "ß", "net"])]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.w for r in df.select("k", candidates.candidate_windows(F.col("t"), lists).alias("w")).collect()}
    for k, t in enumerate(texts):
        want = None if t is None else brute_windows(t, lists) if len(t) >= 400 else []
        assert (got[k] if got[k] is None else [tuple(w) for w in got[k]]) == want, t


def test_gated_prediction(spark):
    index = "Item 1. Business 3 Item 1A. Risk factors 12 Item 3. Legal Proceedings 31 " + "zero " * 100
    texts = [index, "zero " + "pad " * 200 + "sure", "pad " * 200, "", None, "zero sure"]

    def predict(t):
        p = F.regexp_count(t, F.lit("sure")) * 100.0 / (F.length(t) + 1)
        return F.struct(F.lit("hit").alias("label"), p.alias("probability"), (p == 0).alias("abstained"))

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.prediction for r in candidates.gated_prediction(df, "t", [("f", "E", ["sure", "zero"])], predict).collect()}
    assert tuple(got[0]) == ("no_evidence", 1.0, True, None)
    assert got[1].factor == "f" and not got[1].abstained and got[1].probability > 100 / len(texts[1])
    assert got[2].abstained and got[3].abstained and got[4].abstained and got[5].factor is None and not got[5].abstained
    assert candidates.gated_prediction(df.limit(0), "t", [], predict).count() == 0


def test_table_of_contents(spark):
    rows = ["Item 3. Legal Proceedings 31 Item 4. Mine Safety 31 Item 5A. Other 7", "Item 3 of our report discusses litigation", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.table_of_contents(F.col("t"))).collect()]
    assert got == [True, False, False, None]


# --- clusters ------------------------------------------------------------------------------------------------------


def test_clusters_against_pairs(spark):
    rng = random.Random(6)
    topics = [["spill", "fine", "river"], ["board", "vote", "seat"], ["wind", "solar", "grid"]]
    texts = [("g", i, " ".join(rng.choice(topics[i % 3] + ["the", "plant"]) for _ in range(12))) for i in range(30)] + [("g", 99, "unseen"), ("h", 1, "spill spill"), ("h", 2, "spill fine fine"), ("h", 3, "fine spill")]
    df = spark.createDataFrame(texts, "group string, key int, text string")
    counts = clusters.term_counts(df, ["the"])
    points = clusters.unit_vectors(counts, clusters.vocabulary(df, counts))
    w = {}
    for r in points.collect():
        w.setdefault((r.group, r.key), {})[r.term] = r.w
    assert ("g", 99) not in w and all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for v in w.values())
    # Two texts of group h have both words and none a pair of words twice but "fine spill"/"spill fine" once each.
    assert set(w["h", 2]) <= {"spill", "fine", "spill fine"}
    seeds = spark.createDataFrame([("g", i, " ".join(t)) for i, t in enumerate(topics)], "group string, key int, text string")
    index = clusters.centre_index(seeds, clusters.vocabulary(df, counts), 3, ["the"])
    of, centres = clusters.seeded_clusters(points, df, index, 3, 4)
    found = {(r.group, r.key): r.cluster for r in of.collect()}
    assert all(found["g", i] == i % 3 for i in range(30)) and ("h", 1) not in found
    got = {r.group: (r.n, r.silhouette) for r in clusters.silhouettes(points, of, 3).collect()}
    dot = lambda a, b: sum(x * w.get(b, {}).get(t, 0) for t, x in w.get(a, {}).items())
    values = []
    for a in found:
        gaps = {c: [1 - dot(a, b) for b in found if found[b] == c and b != a] for c in range(3)}
        own = sum(gaps[found[a]]) / len(gaps[found[a]])
        other = min(sum(g) / len(g) for c, g in gaps.items() if c != found[a])
        values.append((other - own) / max(own, other))
    assert got["g"][0] == 31 and abs(got["g"][1] - sum(values) / len(values)) < 1e-9
    assert clusters.representatives(points, of, centres, 3).groupBy("cluster").count().where("count <> 4").count() == 0
    assert clusters.top_terms(centres, 3).where("place = 1").count() == 3
    assert clusters.silhouettes(points, of.limit(0), 3).count() == 0


def test_severity_of_claims(spark):
    rows = [(1, "x" * 30, 0, 0.5, 0.75), (2, "x" * 29, 0, 0.5, 0.75), (3, "x" * 30, 0, 0.11, 0.75), (4, "x" * 30, 0, 0.5, None), (5, None, None, None, None), (6, "x" * 40, 1, 0.12, 1.0)]
    df = spark.createDataFrame(rows, "seq int, text string, cluster int, similarity double, severity double").withColumn("strength", F.lit(0.3)).withColumn("confidence", F.lit(0.8))
    got = {r.seq: (r.strength, r.confidence) for r in clusters.with_severity(df, "text", "cluster", "similarity", "severity").collect()}
    assert got == {1: (0.75, 0.8), 2: (0.3, 0.8), 3: (0.3, 0.8), 4: (0.3, 0.8), 5: (0.3, 0.8), 6: (1.0, 0.624)}
    levels = spark.createDataFrame([(x,) for x in (0.0, 0.375, 0.38, 0.625, 0.9, 7.0, None, math.nan)], "v double")
    assert [r[0] for r in levels.select(clusters.snapped(F.col("v"))).collect()] == [0.25, 0.25, 0.5, 0.5, 1.0, 1.0, None, None]


# --- countries and registers ---------------------------------------------------------------------------------------


def test_first_named_country_of_ties(spark):
    names = ["Niger", "Nigeria", "Guinea", "Guinea-Bissau", "Korea, Rep.", "oman", ""]
    texts = ["from NIGERIA and Niger", "niger, nigeria", "Guinea-Bissau", "a woman in Niger", "korea, rep.", "nowhere", "", None]
    want = ["Nigeria", "Niger", "Guinea-Bissau", "oman", "Korea, Rep.", None, None, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (5000, 1):  # one expression, and the automaton
        assert [r[0] for r in df.select(countries.first_named(F.col("t"), names, most)).collect()] == want
    assert df.select(countries.first_named(F.col("t"), []).alias("c")).where("c is not null").count() == 0


def test_country_ladder(spark):
    codes = spark.createDataFrame([("USA", "United States"), ("KOR", "Korea, Republic of"), ("NER", "Niger"), ("NGA", "Nigeria"), ("GBR", "United Kingdom")], "code string, name string")
    aliases = spark.createDataFrame([("us", "USA"), ("south korea", "KOR"), ("puerto rico", "USA")], "alias string, code string")
    parts = spark.createDataFrame([("Texas", "USA"), ("Kano", "NGA"), ("Lima", "PER"), ("Lima", "USA")], "part string, code string")
    rows = ["**U.S.", " usa ", "Niger", "NIGERIA.", "Puerto Rico (US)", "Niger, the", "global", "texas", "12 Texas", "texas global", "kingdom", "united", "Lima", "a b c d texas e", "", "  ", None, "Korea, Republic of"]
    want = ["USA", "USA", "NER", "NGA", "USA", "NER", None, "USA", None, None, "GBR", None, None, None, None, None, None, "KOR"]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, raw string")
    got = countries.resolved(df, "raw", codes, aliases, parts, ["global"])
    assert [r.iso3 for r in got.orderBy("k").collect()] == want
    assert {r.raw: r.iso3 for r in countries.resolved(df, "raw", codes, aliases, parts, ["global"], fuzzy=False).where("k in (7, 10)").collect()} == {"texas": None, "kingdom": None}


def test_register_prefixes(spark):
    register = spark.createDataFrame([("Bonduelle", 1, 1), ("Wise", 2, 2), ("ABB Ltd", 3, 3), ("Nike, Inc.", 4, 4), ("NIKE", 5, 5), ("", 6, 6), (None, 7, 7), ("Bonduelle Americas", 8, 0)], "name string, id int, seq int")
    names = ["Bonduelle Americas US", "Wise Investments Ltd", "Wise UK", "abb india", "nike corp", "", None, "Bonduelle"]
    got = {r.name: r.id for r in registers.by_prefix(spark.createDataFrame([(n,) for n in names], "name string"), "name", register).collect()}
    assert got == {"Bonduelle Americas US": 8, "Wise Investments Ltd": None, "Wise UK": 2, "abb india": None, "nike corp": 5, "": None, None: None, "Bonduelle": 1}


def test_register_cores(spark):
    index = spark.createDataFrame([("agricultural bank of china", 9, 1), ("acme holdings", 2, 2), ("acme group", 2, 1), ("group holdings", 1, 3)], "name string, n int, seq int")
    names = ["Bank of China", "ACME", "Acme Holdings", "holdings", "of", "", None]
    got = {r.name: r.found for r in registers.by_core(spark.createDataFrame([(n,) for n in names], "name string"), "name", index).collect()}
    assert got == {"Bank of China": None, "ACME": "acme group", "Acme Holdings": "acme holdings", "holdings": "group holdings", "of": None, "": None, None: None}


def test_most_like_names_against_brute_force(spark):
    import difflib

    rng = random.Random(8)
    word = lambda: rng.choice(["acme", "zürich", "re", "holding", "north", "a", "ab", "Foods", "labs"])
    targets = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(40)] + ["", None, "   ", "a very long name that goes on and on"]
    names = [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(80)] + ["", None, "A very long name that goes elsewhere"]
    make = lambda rows: spark.createDataFrame([(x,) for x in rows], "n string")
    for least, by_words in ((0.6, False), (0.5, True)):
        want = {}
        for t in {x for x in targets if x is not None}:
            pool = {n for n in names if n is not None}
            hits = {n for n in pool if t and t[:20].lower() in n.lower()}
            first = t.split()[0] if t.split() else t
            hits = hits or {n for n in pool if first and first.lower() in n.lower()}

            def score(n, t=t):
                gain = 0.0
                if by_words:
                    own, other = set(t.lower().split()), set(n.lower().split())
                    gain = 0.15 if own and own <= other else -0.05 * len(other - own)
                return round(difflib.SequenceMatcher(None, t.lower().strip(), n.lower().strip()).ratio() + gain, 6)

            best = min(((-score(n), n) for n in hits), default=None)
            if best and (-best[0] > least if by_words else -best[0] >= least):
                want[t] = (best[1], -best[0])
        got = {r.target: (r.name, r.score) for r in registers.most_like(make(targets), make(names), least, by_words).collect()}
        assert got == want and len(want) > 10


def test_record_rules_on_edge_rows(spark):
    rule = record_rules.RecordRule
    tables = {"t": spark.createDataFrame([(1, "Acme Industries Corp", None, "x", "1999"), (2, "ACME industries", "Shein", "x", "2020"), (3, None, None, "y", "2021"), (4, "Acme", None, "z", None), (5, "the Shein tracker", "Acme Industries", " ", ""), (6, "Shein", "Shein", "w" * 3000, "n/a")], "id long, name string, other string, said string, day string")}
    companies = spark.createDataFrame([("a", "Acme Industries Inc."), ("s", "Shein"), ("t", "The Group"), ("n", None), ("e", "")], "company string, name string")
    rules = [
        rule("strict", "t", ("name", "other"), "strict", ("said", "day"), "id", dated="day", since=2000, head="H: ", link=" <l>"),
        rule("neutral", "t", ("name", "other"), "neutral", ("said",), "id", distinct=True, cap=1),
        rule("part", "t", ("name",), "substring", ("id",), "id", where="id < 6"),
    ]
    got = {(r.company, r.tag): (r.n_records, r.text) for r in record_rules.record_signals(rules, tables, companies).collect()}
    assert got["a", "strict"] == (1, "H: x; 2020 <l>") and ("s", "strict") not in got
    assert got["a", "neutral"] == (1, "x") and got["s", "neutral"] == (2, "x")
    assert got["s", "part"] == (1, "5") and not {k for k in got if k[0] in "tne"}
    assert record_rules.record_signals(rules, {"t": tables["t"].limit(0)}, companies).count() == 0


# --- ranks and peers -----------------------------------------------------------------------------------------------


def test_ranks_of_one_hot_key(spark):
    values = spark.range(3000).select((F.col("id") % 700).cast("double").alias("v"), F.lit("k").alias("g"), "id")
    want = sorted(i % 700 for i in range(3000))
    for r in ranking.value_ranks(values, ["g"], "v").collect():
        assert (r.below, r.equal, r.total) == (want.index(r.v), want.count(r.v), 3000)
    got = ranking.positions(values, ["g"], ["v", "id"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3000)) and [r.v for r in got] == want
    asked = spark.createDataFrame([("k", 0.5), ("k", -1.0), ("k", 1e9), ("x", 1.0), ("k", None)], "g string, v double")
    found = {(r.g, r.v): (r.below, r.equal, r.total) for r in ranking.ranks_among(asked, values, ["g"], "v").collect()}
    assert found["k", 0.5] == (want.index(1), 0, 3000) and found["k", 1e9] == (3000, 0, 3000) and found["x", 1.0] == found["k", None] == (None, None, None)
    assert ranking.value_ranks(values.limit(0), ["g"], "v").count() == 0


def test_medians_without_own_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([None, 1.0, 2.0, 5.0, 7.5]), i) for i in range(60)] + [("c", "x", 3.0, 99)]
    owners = list(itertools.product("abcd", "wxyz"))
    df = spark.createDataFrame(rows, "k string, name string, v double, id int")
    got = {(r.k, r.name): (r.n_others, r.n_valued, r.middle) for r in ranking.medians_without_own(df, "k", "name", "v", "id", spark.createDataFrame(owners, "k string, name string")).collect()}
    for k, name in owners:
        others = [v for k2, n2, v, _ in rows if k2 == k and n2 != name]
        valued = sorted(v for v in others if v is not None)
        middle = (valued[(len(valued) - 1) // 2] + valued[len(valued) // 2]) / 2 if valued else None
        assert got[k, name] == (len(others), len(valued), middle)


def test_peer_votes_on_edge_rows(spark):
    people = [(i, f"p{i}", "steel", "fr", float(i), float(i), float(i)) for i in range(6)] + [(9, None, None, "fr", 1.0, 1.0, 1.0)]
    first = spark.createDataFrame(people, "id int, name string, sector string, country string, E double, S double, G double")
    pool = spark.createDataFrame([(i, f"q{i}", "Metals", "de", 10.0 * i, None, 50.0) for i in range(9)], "id int, name string, sector string, country string, overall double, E double, S double")
    rows = [("own", "p0", "fr", ["steel"], None), ("far", "x", "it", ["steel"], "Metals"), ("bare", None, None, [], None), ("second", "x", "fr", ["none", "steel"], None)]
    companies = spark.createDataFrame(rows, "company string, name string, country string, sectors array<string>, label string")
    got = {(r.company, r.pillar): (r.tier, r.percentile, r.n_peers) for r in peers.peer_votes(companies, first, pool).collect()}
    assert got["own", "E"] == ("sector_country", pytest.approx(100 * 4.5 / 7), 5)  # 3 of 1 to 5, among 0 1 1 2 3 4 5
    assert got["second", "S"] == ("sector_country", pytest.approx(100 * 4 / 7), 6)  # 2.5 among the same
    assert got["far", "E"] == ("abstain", None, 0) and got["far", "S"] == ("fuzzy_global", 50.0, 9) and got["far", "G"] == ("fuzzy_global", 40.0, 9)
    assert all(got["bare", p] == ("abstain", None, 0) for p in "ESG") and len(got) == 12


def test_vocabulary_without_a_row_a_text_and_term(spark):
    """Pairs are counted only behind chosen words; that leaves the same terms, ties and small texts included."""
    rng = random.Random(8)
    words = ["spill", "Fine", "river", "the", "wind", "grid", "vote", "ab", "a", "über"]
    texts = [(rng.choice("gh"), i, " ".join(rng.choice(words[: 3 + i % 8]) for _ in range(i % 9))) for i in range(60)] + [("g", 90, None), ("h", 91, ""), ("i", 92, "spill alone"), (None, 93, "spill spill"), (None, 94, "spill")]
    df = spark.createDataFrame(texts, "group string, key int, text string")
    counts = clusters.term_counts(df, ["the"])
    plain = lambda frame, *c: sorted((tuple(r[x] if not isinstance(r[x], float) else round(r[x], 9) for x in c) for r in frame.collect()), key=str)
    for least, most in ((2, 5000), (2, 7), (1, 3), (3, 1)):
        want = clusters.vocabulary(df, counts, least, most)
        terms = clusters.text_vocabulary(df, ["the"], least, most)
        assert plain(terms, "group", "term", "id", "idf") == plain(want, "group", "term", "id", "idf")
        vectors = clusters.text_vectors(df.where("group is not null"), terms, ["the"])
        assert plain(clusters.unpacked(vectors), "group", "key", "id", "w") == plain(clusters.unit_vectors(counts, want), "group", "key", "id", "w")
        assert vectors.count() == 63 and "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    assert clusters.text_vocabulary(df.limit(0), ["the"]).count() == 0
    assert clusters.text_vectors(df, terms.limit(0), ["the"]).where("size(ids) > 0").count() == 0
