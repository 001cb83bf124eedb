"""Queries and operators that have no SQL read whole tables: against brute force."""

import difflib
import random

from terraloom import plans
from terraloom.operators import alike, chunks

FOLDER = "/root/testdata/sf0.001"


def best_of_all(own, others, least):
    want = {}
    for x in own:
        best = min(((-round(difflib.SequenceMatcher(None, x, y).ratio(), 6), y) for y in others), default=None)
        if best and -best[0] >= least:
            want[x] = (best[1], -best[0])
    return want


def test_name_similarity_compares_queries_with_all_names(spark):
    own = [r.c_name for r in spark.read.parquet(f"{FOLDER}/customer.parquet").where("c_custkey % 50 = 0").collect()]
    assert own
    others = [r.s_name for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").collect()]
    got = {r.a: (r.b, r.ratio) for r in plans.QUERIES["x06_name_similarity"](spark, FOLDER).collect()}
    assert got == best_of_all(own, others, 0.5)


def test_most_similar_across_tiles(spark):
    own = ["Acme Holding", "acme", "", "Zürich Re", "qqq", None, "acme", "abc" * 80]
    others = ["Acme Holdings", "Holding Acme", "acne", "came", "", "Zurich Re AG", "", None, "cba" * 80]
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in (own, others))
    want = best_of_all({x for x in own if x is not None}, {y for y in others if y is not None}, 0.5)
    for tiles in ((500, 1000), (2, 1)):
        assert {r.a: (r.b, r.ratio) for r in chunks.most_similar(a, b, 0.5, tiles).collect()} == want


def test_ties_of_one_bag_of_letters(spark):
    """Names of the same letters have one bound; the smaller of the best ones is found, whatever comes first."""
    own, others = ["abcd", "dcba", "aabb"], ["badc", "abdc", "abcd", "dcab", "cdba", "bbaa", "abab", "baab"]
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in (own, others))
    for tiles in ((500, 1000), (2, 3)):
        assert {r.a: (r.b, r.ratio) for r in chunks.most_similar(a, b, 0.5, tiles).collect()} == best_of_all(own, others, 0.5)


def test_tree_of_names_is_brute_force(monkeypatch):
    """Names with one head longer than the tree, of more than 200 letters, with a zero letter; walks of one query and of many."""
    rng = random.Random(11)
    for case in range(30):
        letters, most = rng.choice(["ab", "abcd", "abcdeé世\0"]), rng.choice([4, 20, 75, 210])
        made = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))  # noqa: B023, E731
        head = made()
        own, others = ([rng.choice([head, ""]) + made() for _ in range(n)] for n in (4, rng.choice([0, 1, 25])))
        least = rng.choice([0.0, 0.3, 0.5, 0.8])
        monkeypatch.setattr(alike, "FRONT", rng.choice([1, 30, 200_000]))
        got = {}
        for x, y, ratio in alike.NameTree(sorted(set(others))).best(own, least):
            got[x] = min(got.get(x, (1, "")), (-round(ratio, 6), y))
        assert {x: (y, -r) for x, (r, y) in got.items()} == best_of_all(own, others, least), case


def test_few_names_are_met(monkeypatch):
    """Where names share prefixes, a query is compared with hardly any of them, and few get through a walk."""
    met, compared, reach, plain = [], [], alike.NameTree.reach, difflib.SequenceMatcher

    def counted(self, *args):
        out = reach(self, *args)
        met.extend(len(part[0]) for part in out or [])
        return out

    monkeypatch.setattr(alike.NameTree, "reach", counted)
    monkeypatch.setattr(alike.difflib, "SequenceMatcher", lambda *args: compared.append(args) or plain(*args))
    own = [f"Customer#{50 * i:09d}" for i in range(0, 6000, 60)]
    found = alike.NameTree([f"Supplier#{i:09d}" for i in range(20_000)]).best(own, 0.5)
    assert {x for x, _, _ in found} == set(own)
    assert len(compared) < 5 * len(own) and sum(met) < 200 * len(own)
