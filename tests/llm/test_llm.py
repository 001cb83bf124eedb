"""Each operator against brute force or a round trip on small tables with nulls, empties, ties, repeats and extra columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraloom.llm import decontaminate, langid, licenses, mixing, neardup, onebit, pii, repeats, tokens, toxicity
from terraloom.llm.boosting import BoostedTrees
from terraloom.llm.components import components
from terraloom.llm.fmindex import FMIndex
from terraloom.llm.mph import PerfectHash
from terraloom.llm.queries import tokenizer_path
from terraloom.llm.suffixes import neighbour_prefixes, two_stage_order
from terraloom.llm.textkit import Words, shingles

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def fold(t):
    return (t or "").translate(ASCII_LOWER)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empties, ties, repeats, a long text, and columns named like the operators' own."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    long = " ".join(f"w{i}" for i in range(6000))
    rows = [
        (1, base, "en", "b"), (2, base, "en", None), (3, base + " extra", "en", "a"), (4, None, "en", "a"), (5, "", None, "c"), (6, "  \n ", "fr", "b"),
        (7, "one", "fr", "b"), (8, "ONE", "fr", "b"), (9, long, "de", "hot"), (10, long + " end", "de", "hot"), (None, "stray words here", "de", "hot"), (12, "é" * 300, None, "hot"), (1, base, "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("mix", "leaks", "n", "node", "key", "size", "word", "spans", "score")})


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)


# --- helpers ---------------------------------------------------------------------------------------------------


def test_words_and_shingles():
    w = Words(pa.array(["Ab, ab 9é", None, "", "x"]))
    assert [w.word(i) for i in range(4)] == ["ab", "ab", "9é", "x"] and w.hash[0] == w.hash[1] != w.hash[2]
    assert w.counts.tolist() == [3, 0, 0, 1]
    h, n = shingles(w, 2)
    assert n.tolist() == [2, 0, 0, 1] and len(set(h.tolist())) == 3


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    seq = rng.integers(1, 4, 400)
    patterns = np.array([[1, 2, 0], [3, 0, 0], [1, 1, 1], [2, 3, 1]])
    lengths = np.array([2, 1, 3, 3])
    index = FMIndex(seq, 5)
    low, high = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high, strict=True):
        want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_two_stage_order_and_prefixes():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 200):
        x = rng.integers(97, 97 + min(k, 26), 80).astype(np.uint8)
        order = two_stage_order(x, 100)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: bytes(x[i:]))
    x = np.frombuffer(b"abcabcab", np.uint8)
    assert neighbour_prefixes(x, np.array([0, 3, 1]), 4).tolist() == [4, 0]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(31)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[0] != got[100]


# --- 1 ---------------------------------------------------------------------------------------------------------


def test_nearest_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[50:120] = v[50]  # many equal vectors: ties go to smaller ids
    rows = [(i, v[i].tolist(), "x") for i in range(300)] + [(None, v[0].tolist(), "x"), (400, None, "x"), (401, [0.0] * 16, "x"), (402, [float("nan")] * 16, "x"), (403, [None] * 16, "x"), (404, [1.0], "x")]
    index, how = onebit.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string"))
    got = defaultdict(list)
    for r in onebit.search(index, how, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 300, 20):
        s = (v.astype(float) * v[q].astype(float)).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        assert len(got[q]) == 20
        hit += len({x for x, _ in got[q]} & set(want.tolist()))
    assert hit >= 0.95 * 20 * 15
    few, how = onebit.build_index(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, code string"))
    assert onebit.search(few, how, F.col("id") == 0).count() == 2
    none, how = onebit.build_index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert onebit.search(none, how, F.col("id") == 0).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    coder = tokens.Encoder(tokenizer_path())
    for t in ["a  b \n c\n\n d", "   x  ", "", " lead", "it's  'll go", "tail ", "<|endoftext|> a", "\tx \t y", "日本 語 x", "e  f", "naïve, café. Ünï", "don't, we'll.", "x,. y.,"]:
        assert coder.encode([t])[0].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_shards_round_trip(spark, odd_docs, no_docs):
    manifest = tokens.write_token_shards(odd_docs, tokenizer_path(), shard_bytes=4000)
    got = sorted(tokens.read_token_shards(manifest).collect(), key=lambda r: r.start)
    tokenizer = tokens.Encoder(tokenizer_path()).tokenizer
    at, want = 0, defaultdict(list)
    for r in odd_docs.collect():
        want[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    assert [r.key for r in got] == [None, 1, 1, *range(2, 11), 12]
    for r in got:
        ids = next(x for x in want[r.key] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    found = tokens.lookup_tokens(manifest, spark.createDataFrame([(1,), (9,), (77,)], "doc_id long")).collect()
    assert sorted(r.key for r in found) == [1, 1, 9] and all(list(r.ids) in want[r.key] for r in found)
    assert tokens.read_token_shards(tokens.write_token_shards(no_docs, tokenizer_path())).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_leaks(docs, items, size=10):
    windows = defaultdict(set)
    for name, t in items:
        w = WORD.findall(fold(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(name))
    for t in docs:
        w = WORD.findall(fold(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        yield len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 22, 60])
def test_leaks_match_brute_force(spark, odd_docs, pass_bytes):
    items = [(1, "Beta gamma, DELTA epsilon zeta eta theta iota kappa lambda mu"), (2, "one"), (3, None), (4, ""), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (5, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (10, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leak_digest(odd_docs.coalesce(1), bench, pass_bytes=pass_bytes).collect()
    assert [tuple(r)[1:] for r in got] == list(brute_leaks([r.text for r in odd_docs.coalesce(1).collect()], items))
    cut = {r.doc_id: r for r in decontaminate.remove_leaks(odd_docs, bench, pass_bytes=pass_bytes).collect()}
    assert cut[1].text == "alpha nu xi omicron pi rho sigma tau upsilon phi chi psi omega" and cut[7].text == "" and cut[4].text is None
    assert cut[None].text == "stray words here"
    assert decontaminate.leak_digest(odd_docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.leak_digest(odd_docs.limit(0), bench).count() == 0


# --- 4, 5: SQL holds them on the tables; odd rows here ------------------------------------------------------------


def test_license_scan_of_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "x MIT  License. y"), (1, "x MIT  License. y"), (2, "Under CC: licensed (BY-NC) 4.0!\nrest"), (3, None), (4, ""), (5, "mit\nlicense"), (6, "Apache license mit license"), (None, "General Public License")], "doc_id long, text string")
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=str)
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert by[1] == [(4, 1, 1, 1, "mit", "mit", 1.0)] * 2
    assert by[2] == [(8, 0, None, None, "", "cc-by-nc", 1.0)]
    assert by[3] == by[4] == [(0, 0, None, None, "", "", 0.0)]
    assert by[5][0][1] == 1 and by[6] == [(4, 2, 0, 2, "apache,mit", "apache,mit", 1.0)] and by[None][0][4] == "gpl"
    assert licenses.scan_licenses(odd_docs).count() == 13 and licenses.scan_licenses(no_docs).count() == 0


def test_mixing_of_odd_rows(odd_docs, no_docs):
    planned = mixing.mixing_plan(odd_docs).select("doc_id", "source", "mix.*").collect()
    assert len(planned) == 13 and {r["size"] for r in planned if r.doc_id in (4, 5, 6)} == {0}
    targets = {r.source: (r.source_size, r.target) for r in planned}
    assert abs(sum(t for _, t in targets.values()) - sum(s for s, _ in targets.values())) < 1e-3
    assert all(t <= 3 * s + 1e-6 for s, t in targets.values()) and all(r.copies <= 3 for r in planned)
    once, again = (sorted(r.doc_id or -1 for r in mixing.mix(odd_docs).collect()) for _ in range(2))
    assert once == again and mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs).columns == [c for c in odd_docs.columns if c != "mix"]


# --- 6 ---------------------------------------------------------------------------------------------------------


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(ids[x]), root(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 3000))
    passage = [word() for _ in range(60)]
    docs, n = [], 0
    for size in (1, 3, 4, 5, 6, 8, 12, 30, 65, 80, 200, 260, 400):
        seed = [word() for _ in range(size)]
        for _ in range(10):  # copies with a few edits each, near the threshold and at band edges
            own = list(seed)
            for _ in range(int(rng.integers(0, max(1, size // 24) + 1))):
                own[int(rng.integers(0, len(own)))] = word()
            own = own[: len(own) - int(rng.integers(0, max(1, size // 8)))]
            docs.append((n, " ".join(own)))
            n += 1
    for _ in range(40):  # a passage that many texts share doesn't link them
        docs.append((n, " ".join(passage + [word() for _ in range(60)])))
        n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, docs[3][1].upper())]
    want = brute_components(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.jaccard_components(df).collect()} == want
    kept = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_of_odd_rows(odd_docs, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.jaccard_components(odd_docs).collect()]
    assert sorted(c for i, _, c in got if i in (1, 2, 3)) == [1, 1, 1, 1] and (8, 1, 7) in got and (5, 0, 5) in got and (10, 5997, 9) in got
    assert neardup.jaccard_components(no_docs).count() == 0
    assert sorted(r.doc_id or -1 for r in neardup.keep_one(odd_docs).collect()) == [-1, 1, 4, 5, 6, 7, 9, 12]


# --- 7 ---------------------------------------------------------------------------------------------------------


def brute_repeats(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in raw:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] += 1
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(b), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize(("many", "hot"), [(1, 4000), (500, 4000), (1, 2), (500, 1)])
def test_repeats_match_brute_force(spark, many, hot):
    rng = np.random.default_rng(6)
    junk = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    p, q, line = junk(230), "né " * 90, junk(150)
    texts = [junk(300) + p + junk(80), p, junk(40) + p[5:], p[:199], q + junk(9), "x" + q, None, "", "a" * 450, junk(500), p, line * 2, *(junk(70) + line + junk(90) for _ in range(6)), junk(60) + p[:120] + junk(60) + p[60:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("x"))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_digest(df, many=many, hot=hot).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_repeats_of_a_passage_with_different_neighbours(spark):
    passage = " ".join(f"shared{i}" for i in range(30))
    texts = [" ".join(f"left{k}x{i}" for i in range(40)) + passage[: 190 + k] + " ".join(f"right{k}y{i}" for i in range(40)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = dict(enumerate(brute_repeats(texts)))
    for hot in (10, 4000):
        assert {r.doc_id: tuple(r)[1:] for r in repeats.repeat_digest(df, many=5, hot=hot).collect()} == want


def test_repeats_of_odd_rows(odd_docs, no_docs):
    got = [tuple(r)[1:] for r in repeats.repeat_digest(odd_docs.coalesce(1)).collect()]
    assert sorted(got) == sorted(brute_repeats([r.text for r in odd_docs.collect()]))
    assert repeats.repeat_digest(no_docs).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_forward_pass_sums_all_segmentations():
    m = langid.LanguageModels([b"\x01a", b"ab", b"b", b"\x01ab"], ["x"])
    p = m.p[0, 0]
    got = m.word_scores(Words(pa.array(["ab"])), np.array([0]))[0, 0]
    # mark|a|b, mark|ab, marka|b, markab
    assert np.isclose(np.exp(got), p**3 + p**2 + p**2 + p)


def test_language_id_held_out(spark, odd_docs, no_docs):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = toxicity.fold("doc_id", 4) == 2
    models = langid.fit_languages(docs.where(~out), public_tokenizers.path("piece_bpe_32k.model"))
    got = langid.identify_languages(docs.where(out), models).select(F.col("lang").alias("true"), "language.lang").collect()
    assert np.mean([r.lang == r.true for r in got]) > 0.97
    odd = {r.doc_id: r.language for r in langid.identify_languages(odd_docs, models).collect()}
    assert odd[4].lang == odd[5].lang == odd[6].lang == "und" and odd[7].lang in models.langs
    assert all(0 <= x.score <= 1 for x in odd.values()) and langid.identify_languages(no_docs, models).count() == 0
    nothing = langid.fit_languages(no_docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.language.lang for r in langid.identify_languages(odd_docs, nothing).collect()} == {"und"}


# --- 9 ---------------------------------------------------------------------------------------------------------


def test_toxicity_search_is_exact_and_holds_out(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    votes = toxicity.fit_from_labels(docs, labels)
    dense = np.zeros((len(votes.label), len(votes.terms)))
    for t in range(len(votes.terms)):
        for b in range(votes.most.shape[1]):
            lo, hi = votes.begin[t * votes.most.shape[1] + b], votes.begin[t * votes.most.shape[1] + b + 1]
            dense[votes.example[lo:hi], t] = votes.weight[lo:hi]
    for i in range(0, len(dense), 7):
        term = np.flatnonzero(dense[i])
        if len(term):
            found, sims = votes.nearest(term, dense[i, term])
            every = dense @ dense[i]
            assert np.allclose(sims, np.sort(every)[::-1][: len(sims)])
            assert len(sims) == min(votes.k, int((every > 1e-12).sum()))
    held = labels.where(toxicity.fold("doc_id", 3) == 1)
    got = toxicity.score_toxicity(docs, votes).join(held, "doc_id").select("toxic", "toxicity.predicted").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) > 0.6 and np.mean([r.predicted for r in got if r.toxic == 0]) < 0.05
    odd = toxicity.score_toxicity(odd_docs, votes).select("toxicity.*").collect()
    assert len(odd) == 13 and all(0 <= r.score < 0.7 for r in odd)
    empty = toxicity.fit_from_labels(no_docs, labels)
    assert toxicity.score_toxicity(odd_docs, empty).where("toxicity.predicted = 1").count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return pii.ordered(out)


def test_base_spans_match_plain_patterns():
    rng = np.random.default_rng(8)
    letters = list("ab129.@+- ()%_05é")
    for _ in range(20000):
        t = "".join(rng.choice(letters, int(rng.integers(1, 40))))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("call +1 (415) 555-0134 or a@b.co, 4111 1111 1111 1111, 10.0.0.1")[0][0] == "phone"


def test_pii_digest_and_redaction(spark, odd_docs, no_docs):
    texts = ["mail é a.b@c.org, ip 1.2.3.4", None, "", "no data", "+1 (415) 555-0134", "4111 1111 1111 1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit(1))
    detector = pii.fit_detector(docs)
    for r in pii.pii_digest(docs, detector).collect():
        want = brute_pii(texts[r.doc_id] or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(shown.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
    cut = {r.doc_id: r.text for r in pii.redact(docs, detector).collect()}
    assert cut[0] == "mail é [email], ip [ip]" and cut[1] is None and cut[3] == "no data" and cut[4] == "[phone]"
    assert pii.pii_digest(odd_docs, detector).count() == 13 and pii.pii_digest(no_docs, pii.fit_detector(no_docs)).count() == 0


def test_boosted_trees_learn():
    rng = np.random.default_rng(9)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    score = BoostedTrees().fit(x[:1000], y[:1000]).score(x[1000:])
    assert np.mean((score > 0.5) == y[1000:]) > 0.95


# --- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from terraloom.llm.shared import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stored(stages["toxicity"](spark, docs, SF))
    assert clean.columns == columns and clean.count() >= 0.85 * docs.count()
    single = stored(stages["near_copies"](spark, clean, SF))
    want = brute_components([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if c == i} and single.columns == columns
    cut = stored(stages["decontamination"](spark, single, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: x for r, x in zip(single.collect(), brute_leaks([r.text for r in single.collect()], items), strict=True)}
    after = {r.doc_id: r for r in cut.collect()}
    texts = {r.doc_id: r.text for r in single.collect()}
    for i, (n_words, n_hit, *_) in before.items():
        if n_hit == 0:
            assert after[i].text == texts[i]
        elif i in after:
            assert len(WORD.findall(fold(after[i].text))) == n_words - n_hit and after[i].n_chars == len(after[i].text)
    mixed = stored(stages["mixing"](spark, cut, SF))
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    planned = {r.doc_id: r.mix.copies for r in mixing.mixing_plan(cut).collect()}
    assert copies == {i: n for i, n in planned.items() if n} and mixed.columns == columns
    written = stages["tokens"](spark, mixed, SF).orderBy("start").collect()
    assert len(written) == mixed.count() and written[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(written, written[1:], strict=False))
