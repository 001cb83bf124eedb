"""Rules that vote, periodic runs and spelling variants: against brute force, SQL and planted cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import kdtree, periodic, queries, spelling, voting
from terraloom.llm.squares import SquareCatchers

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c d e f g", 7), (1, "a b c d e f g", 7), (2, None, 1), (3, "", 1), (4, " \n\t ", None), (None, "x " * 40, 1), (5, "so " * 3000 + "end", 1), (6, "\n".join(["same line here"] * 9), 1), (7, "é" * 30, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long").withColumns({c: F.lit(1) for c in ("votes", "quality", "start", "length", "period", "word", "n", "run", "docs")})


# --- rules that vote -----------------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_match_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = sorted((r.doc_id or -1, *brute_measures(r.text)) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in voting.measures(docs).collect())
    assert got == texts


def test_quality_sql(spark):
    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    df = queries.op11_quality_votes(spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES["op11_quality_votes"])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.select(*columns).fetchall())


def test_votes_find_junk_and_keep_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = voting.quality_digest(docs).join(labels, "doc_id").where("not base_failed").groupBy("label", "kept").count().collect()
    n = {(r.label, r.kept): r["count"] for r in rows}
    assert n.get((0, False), 0) >= 0.9 * sum(v for (q, _), v in n.items() if q == 0)
    assert n.get((1, False), 0) <= 0.01 * sum(v for (q, _), v in n.items() if q == 1)


def test_votes_on_odd_rows(spark, odd):
    got = voting.quality_votes(odd)
    assert got.count() == odd.count() and got.where("n_words = 0 and not base_failed").count() == 0
    assert {r.doc_id for r in got.where("kept").collect()} <= {None, 1, 5, 6, 7}
    empty = voting.quality_votes(odd.limit(0))
    assert empty.count() == 0 and voting.fit_rules(voting.measures(odd.limit(0))) == voting.FIRST


# --- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(words, power=4, least=6):
    out = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in out.items()), key=lambda r: (r[0], r[2]))


def test_square_catchers_online_and_at_once():
    rng = random.Random(7)
    for _ in range(300):
        power, size, words = rng.choice([2, 3, 4]), rng.choice([10, 60, 200]), []
        while len(words) < size:
            piece = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20]))]
            words += (piece * rng.randrange(1, 9))[: rng.randrange(1, 100)]
        want = brute_runs(words, power, 1)
        stream = np.array(words, np.uint64)
        whole = SquareCatchers(power)
        whole.append(stream)
        assert whole.finish() == want
        online, at = SquareCatchers(power), 0
        while at < len(stream):
            step = rng.choice([1, 1, 2, 7, 30])
            for run in online.append(stream[at : at + step]):
                assert run in want
            at += step
        assert online.finish() == want


def test_long_periodic_texts_take_no_square_of_steps():
    catchers = SquareCatchers(4)
    catchers.append(np.zeros(300_000, np.uint64))
    assert catchers.finish() == [(0, 300_000, 1)]


def test_periodic_query_matches_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 2500:
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        some += len(runs)
        keep = set(range(n)) - {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i in keep)
        assert got[r.doc_id] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert some > 20


def test_periodic_runs_of_a_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    from terraloom.llm.textkit import NONSPACE, Words

    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(70)) + " x y z" * 40, "", "end " * 9]
    words = Words(pa.array(texts), NONSPACE, fold=False)
    whole = periodic.runs_of_texts(words)
    assert whole == {i: r for i, t in enumerate(texts) if (r := brute_runs(t.split()))}
    monkeypatch.setattr(periodic, "APPENDED", 7)
    assert periodic.runs_of_texts(words) == whole


def test_periodic_runs_on_odd_rows(spark, odd):
    found = [tuple(r) for r in periodic.find_runs(odd).collect()]
    assert sorted(found, key=str) == sorted([(None, 0, 40, 1), (5, 0, 3000, 1), (6, 0, 27, 3)], key=str)
    texts = {r.doc_id: r.text for r in periodic.collapse_runs(odd).collect()}
    assert texts[5] == "so end" and texts[6] == "same line here" and texts[2] is None and texts[4] == " \n\t " and texts[None] == "x"
    assert periodic.collapse_runs(odd).columns == odd.columns and periodic.runs_digest(odd).count() == odd.count()
    none = odd.limit(0)
    assert periodic.find_runs(none).count() == periodic.collapse_runs(none).count() == periodic.runs_digest(none).count() == 0


# --- spelling variants ---------------------------------------------------------------------------------------------


def brute_groups(n, factor=10):
    near = {w: set() for w in n}
    keys = {}
    for w in n:
        for i in range(len(w)):
            keys.setdefault(("replace", w[:i], w[i + 1 :]), []).append(w)
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for same in keys.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query_matches_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    want = brute_groups({w: n for w, n in counts.items() if n >= 2})
    assert as_dict(queries.op13_spelling_variants(spark, SF)) == want and sum(v[3] for v in want.values()) > 100


def test_spelling_with_many_cells_and_odd_words(spark, monkeypatch):
    rng = random.Random(5)
    words = set()
    while len(words) < 1500:  # anagrams, equal counts, letters of other scripts, chains of forms
        w = "".join(rng.choice("abcdé日") for _ in range(rng.choice([1, 2, 5, 6, 7])))
        words.add(w)
    words |= {"q" * 300, "q" * 301, "z"}
    n = {w: rng.choice([1, 2, 30, 500, 9000]) for w in sorted(words)}
    monkeypatch.setattr(spelling, "CELL", 60)
    monkeypatch.setattr(spelling, "LEAST", 4)
    rows = [*n.items(), ("", 5), (None, 5), *list(n.items())[:20]]
    df = spark.createDataFrame(rows, "word string, n int").withColumn("near", F.lit("x")).withColumn("cell", F.lit(0))
    assert as_dict(spelling.spelling_groups(df)) == brute_groups(n)
    cells = spelling.Cells(sorted(w for w in n if len(w) == 6), {6: len(n)})
    assert sum(left < 0 for left in cells.trees[6][1].left) > 3
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_word_counts_on_odd_rows(spark, odd):
    assert spelling.word_counts(odd).count() == 0  # no word of seven letters stands there twice
    got = {r.word: r.n for r in spelling.word_counts(odd, least_letters=2, least_count=1).collect()}
    assert got["so"] == 3000 and got["same"] == 9 and got["é" * 30] == 1
    assert spelling.word_counts(odd.limit(0)).count() == 0


def test_kd_tree_boxes(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 3, (400, 6)).astype(np.int16)
    tree = kdtree.KdTree(vectors, 4)
    found = {(int(p), int(m)) for points, leaves in tree.reach(vectors, 1, 1) for p, leaf in zip(points, leaves, strict=True) for m in tree.members[leaf]}
    more = np.maximum(vectors[None] - vectors[:, None], 0).sum(2)
    fewer = np.maximum(vectors[:, None] - vectors[None], 0).sum(2)
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero((more <= 1) & (fewer <= 1)), strict=True)} <= found
