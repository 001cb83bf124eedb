"""Whole jobs of the llm operators: what an earlier form of each left out."""

import math
import re

from terraloom.llm import decontaminate, langid, licenses, neardup, onebit, pii, tokens
from terraloom.llm.queries import tokenizer_path

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""


def test_license_notices_across_line_breaks(spark):
    spread = "\n".join(w + " filler" * 9 for w in BSD.split())
    docs = [(1, MIT), (2, BSD), (3, "some words before\n\n" + BSD.replace(" ", "\n * ") + "and after"), (4, spread), (5, "Released\nunder the\nMIT-License"), (6, None), (7, "")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == got[3] == ("bsd", 1.0) and got[5][0] == "mit"
    assert got[4] == got[6] == got[7] == ("", 0.0)


def test_license_windows_match_brute_force(spark):
    import random

    rng = random.Random(3)
    known = sorted({w for _, words in licenses.template_sets(licenses.TEMPLATES + licenses.NOTICES) for w in words})
    docs = []
    for i in range(60):
        words = re.split(r"\s+", rng.choice(licenses.TEMPLATES + licenses.NOTICES)[1])
        words = [w for w in words if rng.random() > 0.12]
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(known + ["x"] * 20))
        words = [rng.choice(known + ["other"]) for _ in range(rng.randrange(8))] + words
        docs.append((i, "".join(w + rng.choice([" ", "\n", ", "]) for w in words)))
    templates = licenses.TEMPLATES + licenses.NOTICES
    want = set()
    for i, t in docs:
        words = [w for w in re.split(licenses.GAP, t.lower()) if w]
        for (label, own), (_, text) in zip(licenses.template_sets(templates), templates, strict=True):
            size = len([w for w in re.split(licenses.GAP, text.lower()) if w])
            for at in range(len(words)):
                common = len(set(words[at : at + size]) & set(own))
                if words[at] in own and common >= math.ceil(0.8 * len(own) - 1e-9):
                    want.add((i, at, label, round(common / len(own), 9)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.word, r.label, round(r.containment, 9)) for r in licenses.window_matches(df).collect()} == want and len(want) > 30


def test_encoder_equals_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh, coder = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    assert coder.encode(["<|endoftext|>"])[0].tolist() == [fresh.token_to_id("<|endoftext|>")]
    for t in ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "a  <|endoftext|>  b\n<|endoftext|>\n", "<|endoftext|><|endoftext|>, x.", "x <|endoftext|>. y", "<|endoftext |>", "plain words, only."]:
        assert coder.encode([t])[0].tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_encoder_gives_the_library_each_word_once(monkeypatch):
    import itertools

    from tokenizers import Tokenizer

    fresh, coder = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    words = ["".join(w) for w in itertools.product("bdé", "aeiou", "klmÑ", "aeiou")]
    signs = ["", ";", ":", ")", "!", "-1", ".\nAnd", "<|endoftext|>", "'s", " \t ", "\n", "\u3000\x1c "]
    texts = [" ".join(w + s for w in words) for s in signs] + ["", *signs, *words[:9]]
    given, encoded = [], coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda texts: given.extend(texts) or encoded(texts))
    coder.encode([t for t, s in zip(texts, signs, strict=False) if s.strip() == s and "<" not in s])
    assert sum(map(len, given)) < 1.2 * sum(len(w) + 1 for w in words)
    ids, n = coder.encode(texts, 0)
    want = [fresh.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == list(itertools.chain(*want))


def test_encoder_groups_keep_rows_in_order():
    import pyarrow as pa

    keys, texts = list(range(3000)), [f"text {i} " * (i % 7) for i in range(3000)]
    batches = pa.table({"key": keys, "text": texts}).to_batches(max_chunksize=700)
    groups = list(tokens.in_groups(batches, 20_000))
    assert len(groups) > 4 and sum((k for k, _ in groups), []) == keys and sum((t.to_pylist() for _, t in groups), []) == texts
    assert list(tokens.in_groups([])) == []


def test_encoder_keeps_pieces_between_groups_in_bounded_memory(monkeypatch):
    import itertools

    import pyarrow as pa
    from tokenizers import Tokenizer

    fresh, coder = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    text = " ".join("".join(w) + s for w in itertools.product("bdé", "aeiou", "klm", "aeiou") for s in ("", ".", "\n"))
    want, given, encoded = fresh.encode(text, add_special_tokens=False).ids, [], coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda texts: given.extend(texts) or encoded(texts))
    for most, again in ((tokens.MET_BYTES, False), (100, True)):
        monkeypatch.setattr(tokens, "MET_BYTES", most)
        for turn in range(2):
            given.clear()
            assert coder.encode([text])[0].tolist() == want
            assert (sum(map(len, given)) > 100) == (again or not turn) and coder.met.nbytes + coder.met_ids.nbytes <= most
        coder._forget()


def test_encoder_takes_bounded_memory_of_arrow():
    import subprocess
    import sys

    script = """if True:
        import pyarrow as pa
        from terraloom.llm import tokens
        from terraloom.llm.queries import tokenizer_path

        texts = [" ".join(f"{(i * 7919 + k) % 9973:x}" for k in range(400)) for i in range(8000)]
        batches = pa.table({"key": list(range(8000)), "text": texts}).to_batches(max_chunksize=1000)
        coder, held = tokens.Encoder(tokenizer_path()), pa.total_allocated_bytes()
        for _, group in tokens.in_groups(batches):
            coder.encode(group, 0)
        print(pa.default_memory_pool().max_memory() - held)"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout) < 40 << 20


def test_leaks_are_cut_by_the_workers_that_find_them(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    cut = decontaminate.remove_leaks(docs, spark.createDataFrame([("x", "b c d e f g h i j k")], "item_id string, text string"))
    assert str(cut._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    assert cut.collect() == [(1, "a")]


def test_jaccard_at_half_with_sets_of_different_sizes(spark):
    import random

    rng = random.Random(4)
    docs = []
    for i in range(12):  # each long text and its beginning: Jaccard is the ratio of the sizes, from 0.44 to 0.85
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: round(100 * (0.44 + 0.037 * i)) + 4]))]
    sizes = [(100, len(t.split()) - 4) for i, t in docs if i % 2]
    want = {2 * i + 1: 2 * i if 100 * n >= 50 * m else 2 * i + 1 for i, (m, n) in enumerate(sizes)} | {2 * i: 2 * i for i in range(12)}
    got = neardup.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), percent=50)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and 0 < sum(i != c for i, c in want.items()) < 12


def test_pii_adds_spans_of_other_formats_and_few_others(spark):
    import random
    import time

    rng = random.Random(5)
    words = "some plain words stand here and there in a text of no use".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    number = lambda: str(rng.randrange(10**15, 10**16))

    def card():
        while not pii.luhn(c := number()):
            pass
        return c

    kinds = [lambda: f"{rng.choice(words)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card, lambda: f"+1 ({rng.randrange(100, 1000)}) 555-{rng.randrange(1000, 10000)}", lambda: f'token = "{rng.randrange(16**39, 16**40):x}"', lambda: f"{number()[:7]}.{number()[:3]}", lambda: f"{rng.randrange(1999, 2030)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"]
    docs = [(i, f"{say(9)} {rng.choice(kinds)()} {say(9)}") for i in range(1500)]
    detector = pii.fit_detector(spark.createDataFrame(docs, "doc_id long, text string"))
    assert all(found >= 0.9 * there > 0 and precision >= 0.9 for there, found, precision in detector.held_out.values())
    for text, kind in [("write to joe.7 (at) mail3.example (dot) com now", "email"), ("here and 415-555-0134 there", "phone"), ("plain 10[.]20[.]3[.]4 words", "ip"), ('and token = "681c09b8e90e7e8c9575180f595f646cf2969054" here', "secret")]:
        base, spans = detector.spans(text)
        assert not base and [k for k, _, _ in spans] == [kind], text
    for text in ["plain words here 2024-01-02 12:30 and 3.14159", "see 12345 and 1.2.3 there", "no use at home in there"]:
        assert detector.spans(text)[1] == [], text
    took = []
    for n in (2000, 8000):  # four times the text, about four times the time
        began = time.thread_time()
        detector.spans("a1b2 415-555-0134, x@y.zz 1.2.3.4 4111.1111.1111.1112; " * n)
        took.append(time.thread_time() - began)
    assert took[1] < 9 * took[0]


def test_words_of_any_length_are_scored_whole():
    import numpy as np
    import pyarrow as pa
    from terraloom.llm.textkit import Words

    rng = np.random.default_rng(3)
    models = langid.LanguageModels([b"\x01a", b"ab", b"ba", b"abababababababababab"], ["x", "y"])
    models.p = rng.dirichlet(np.ones(models.pieces.n), 2).T

    def brute(word):
        """The same sum with whole numbers' exponents kept apart, by bytes."""
        raw = b"\x01" + word.encode()
        place = {h: i for i, h in enumerate(models.pieces.hashes.tolist())}
        of = lambda p: place.get(int(models.pieces._hash(models.pieces._totals(np.frombuffer(p, np.uint8)), np.array([0]), np.array([len(p)]))[0]))
        at = [np.zeros(2)]
        for t in range(1, len(raw) + 1):
            terms = [at[t - n] + np.log(models.p[i]) for n in range(1, min(t, 20) + 1) if (i := of(raw[t - n : t])) is not None]
            at.append(np.logaddexp.reduce(terms))
        return at[-1]

    words = ["ab", "abba" * 5, "ab" * 60, "é" * 100, "ab" * 1200, "b"]
    got = models.word_scores(Words(pa.array(words)), np.arange(len(words)))
    assert np.allclose(got, [brute(w) for w in words])


def test_language_of_texts_without_letters_is_unknown(spark):
    docs = [(i, t, "xx" if i % 2 else "yy") for i, t in enumerate(["la le li lo lu", "der die das und ein"] * 20)]
    import public_tokenizers

    models = langid.fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    odd = [(1, "²"), (2, "½ ①"), (3, "12 -"), (4, "²a"), (5, None), (6, ""), (7, "漢" * 5000), (7, "漢" * 5000)]
    got = [(r.doc_id, r.language.lang) for r in langid.identify_languages(spark.createDataFrame(odd, "doc_id long, text string"), models).collect()]
    assert {i for i, lang in got if lang == "und"} == {1, 2, 3, 5, 6} and len(got) == 8


def test_base_phrases_after_unicode_line_ends(spark):
    docs = [(i, f"a{c}b c apache license") for i, c in enumerate("\u0085  \n \x0b")] + [(9, "x mit license " + "y " * 50_000 + "  mit license")]
    got = {r.doc_id: (r.first_word, r.last_word) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [k for k in range(len(words)) if words[k : k + 2] in (["apache", "license"], ["mit", "license"])]
        assert got[i] == (at[0], at[-1])


def test_nearest_vectors_of_huge_and_repeated_values(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 8)) * 10.0 ** rng.integers(-3, 26, (60, 1))
    v[:10] = rng.standard_normal((10, 8)) * 1e25
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist()), (5, v[5].tolist())]
    for some in (rows[:10], rows):
        index, how = onebit.build_index(spark.createDataFrame(some, "vec_id long, embedding array<double>"))
        got = {}
        for r in onebit.search(index, how, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        n = len({i for i, _ in some})
        for q in range(0, n, 20):
            score = (v[:n] * v[q]).sum(1)
            want = [i for i in np.lexsort((np.arange(n), -score)).tolist() if i != q][:20]
            assert [i for i, _ in got[q]] == want and np.allclose([s for _, s in got[q]], score[want], rtol=1e-12)


def test_one_harsh_word_in_a_long_text_is_not_toxic(spark):
    import numpy as np
    from terraloom.llm import toxicity

    rng = np.random.default_rng(8)
    bad = ["idiot", "moron", "scum", "trash", "loser"]
    clean = lambda n: [f"w{int(x)}" for x in rng.zipf(1.4, n) % 5000]
    docs = []
    for i in range(600):
        words = clean(int(rng.integers(20, 300)))
        if i % 5 == 0:
            words += [bad[int(x)] for x in rng.integers(0, 5, max(2, len(words) // 40))]
        docs.append((i, " ".join(rng.permutation(words)), int(i % 5 == 0)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    votes = toxicity.fit_votes(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    new = [(0, " ".join([*clean(4000), "idiot"]), 0), (1, " ".join([*clean(100), *bad]), 1), (2, " ".join(clean(200)), 0), (3, " ".join([*clean(4000), *(bad * 20)]), 1)]
    got = toxicity.score_toxicity(spark.createDataFrame(new, "doc_id long, text string, want int"), votes).select("want", "toxicity.predicted", "toxicity.evidence").collect()
    assert all(r.want == r.predicted for r in got) and all(len(r.evidence) > 0 for r in got if r.want)


def test_pii_very_long_runs():
    assert pii.base_spans("x " + "0" * 5000 + "1.2.3.4 y 9" + "0" * 5000 + ".1.1.1") == [("ip", 2, 5009)]
    secret = "a1" * 150
    assert ("secret", 9, 309) in pii.candidates(f'token = "{secret}"')
