"""Spelling variants: words one edit apart, found by box searches in k-d trees over letter counts.

An edit changes the counts of one letter by one (insertion, deletion) or of two (replacement). So the near words of a word
lie in a small box around its counts, among words of its length and of lengths one apart. Cells (the leaves of one tree a
length, cut on a sample) spread the words over tasks; each word visits the cells that its box meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kdtree import KdTree, letter_counts, letters
from .shared import discard, stored

#: About so many words a cell; the cuts are set by a sample of about so many words, of which a cell has at least LEAST.
CELL, SAMPLE, LEAST = 15_000, 100_000, 24
#: Longer words don't take part in the sample: each of their lengths has one cell.
LONGEST_SAMPLED = 255
#: Words a leaf of a cell's own tree, and letters compared at a time.
LEAF, STEP = 8, 1 << 23

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, near long, best_n long, best string"


def word_counts(docs: DataFrame, text_col: str = "text", least_letters: int = 7, least_count: int = 2, change: Callable[[Column], Column] | None = None) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, A-Z lower-cased, and how often they stand in all texts.

    `change` maps a lower-cased run to the word that is counted (it may use other columns of docs, whose columns aren't named
    __run); runs and words of fewer letters go. Null and empty texts have no words; equal rows count each.
    """
    least = max(1, least_letters)
    runs = docs.select("*", F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("__run"))
    run = F.translate("__run", UPPER, LOWER)
    words = runs.select((change(run) if change else run).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Cells:
    """Which cell holds a word, and which cells may hold words near it."""

    def __init__(self, sample: list[str], counts: dict[int, int]):
        self.trees: dict[int, tuple[np.ndarray, KdTree, int]] = {}
        by_length: dict[int, list[str]] = {}
        for w in sample:
            by_length.setdefault(len(w), []).append(w)
        first = 0
        for length, own in sorted(by_length.items()):
            codes = letters(sorted(own), length)
            alphabet = np.unique(codes)
            leaf = max(LEAST, CELL * len(own) // max(1, counts.get(length, 0)))
            tree = KdTree(letter_counts(codes, alphabet), leaf, tight=False)
            tree.members = []
            self.trees[length] = (alphabet, tree, first)
            first += len(tree.left)

    def home(self, codes: np.ndarray) -> np.ndarray:
        length = codes.shape[1]
        if length not in self.trees:
            return np.full(len(codes), -length)
        alphabet, tree, first = self.trees[length]
        return tree.home(letter_counts(codes, alphabet)) + first

    def visited(self, codes: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the cells of words `longer` (0 or 1) letters longer that a box meets."""
        length = codes.shape[1] + longer
        if length not in self.trees:
            return np.arange(len(codes)), np.full(len(codes), -length)
        alphabet, tree, first = self.trees[length]
        # The tree counts the letters of its sample only, so an edit may change fewer of its counts, never more.
        found = list(tree.reach(letter_counts(codes, alphabet), more=1, fewer=1 - longer))
        return np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]) + first


def _cells(words: DataFrame) -> Cells:
    sized = words.where(F.length("word") <= LONGEST_SAMPLED)
    counts = {r["length"]: r["count"] for r in sized.groupBy(F.length("word").alias("length")).count().collect()}  # LONGEST_SAMPLED rows at most
    every = max(1, -(-sum(counts.values()) // SAMPLE))
    sample = sized.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").limit(2 * SAMPLE).collect()
    return Cells([r["word"] for r in sample], counts)


def _visits(words: DataFrame, cells: Cells) -> DataFrame:
    """(cell, kind, word, n): kind 0 are the cell's own words, 1 words of the same length that search it, 2 of one letter less."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length = frame["word"].str.len().to_numpy()
            for size in np.unique(length):
                own = frame[length == size]
                codes = letters(own["word"].tolist(), int(size))
                parts = [(np.arange(len(own)), cells.home(codes)), cells.visited(codes, 0), cells.visited(codes, 1)]
                for kind, (row, cell) in enumerate(parts):
                    yield pd.DataFrame({"cell": cell.astype(np.int32), "kind": np.int8(kind), "word": own["word"].to_numpy()[row], "n": own["n"].to_numpy()[row]})

    return words.mapInPandas(run, "cell int, kind byte, word string, n long")


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of `long` without one of its letters is the row of `short`."""
    length = short.shape[1]
    ahead = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return ahead + behind >= length


def near_pairs(own: np.ndarray, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking row, own row) of words one edit apart; asking words are as long as the own ones or one letter shorter."""
    shorter = own.shape[1] - asking.shape[1]
    alphabet = np.unique(own)
    points = letter_counts(asking, alphabet)
    # Letters of an asking word that no own word has must go by the edit.
    foreign = asking.shape[1] - points.sum(1)
    ask = np.flatnonzero(foreign <= 1 - shorter)
    counts = letter_counts(own, alphabet)
    tree = KdTree(counts, LEAF)
    sizes = np.array([len(m) for m in tree.members])
    starts, members = np.cumsum(sizes) - sizes, np.concatenate(tree.members)
    compare, most = (one_inserted, 1) if shorter else (one_replaced, 2)
    step = max(1, STEP // own.shape[1])
    for point, leaf in tree.reach(points[ask], more=1, fewer=1 - shorter):
        total = np.cumsum(sizes[leaf])
        ends = np.searchsorted(total, np.arange(step, total[-1] + step, step), "left") + 1 if len(total) else []
        for begin, end in zip([0, *ends], ends, strict=False):
            size = sizes[leaf[begin:end]]
            x = np.repeat(ask[point[begin:end]], size)
            y = members[np.repeat(starts[leaf[begin:end]] - (np.cumsum(size) - size), size) + np.arange(len(x))]
            close = np.abs(points[x] - counts[y]).sum(1) + foreign[x] == most
            x, y = x[close], y[close]
            close = compare(asking[x], own[y])
            yield x[close], y[close]


def _near(visits: DataFrame) -> DataFrame:
    """NEAR rows: parts of a word's number of near words and its most frequent one."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        own, found = frame[frame["kind"] == 0], []
        for kind in (1, 2) if len(own) else ():
            asking = frame[frame["kind"] == kind]
            if not len(asking):
                continue
            length = len(own["word"].iloc[0])
            none = np.zeros(0, np.int64)
            pairs = [(none, none), *near_pairs(letters(own["word"].tolist(), length), letters(asking["word"].tolist(), length - (kind == 2)))]
            x, y = np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs])
            found.append((asking.iloc[x], own.iloc[y]))
            if kind == 2:
                found.append((own.iloc[y], asking.iloc[x]))
        if not found:
            return pd.DataFrame({"word": [], "near": [], "best_n": [], "best": []}).astype({"word": str, "near": np.int64, "best_n": np.int64, "best": str})
        a, b = pd.concat([f[0] for f in found]), pd.concat([f[1] for f in found])
        pairs = pd.DataFrame({"word": a["word"].to_numpy(), "best_n": b["n"].to_numpy(), "best": b["word"].to_numpy()})
        pairs = pairs.sort_values(["word", "best_n", "best"], ascending=[True, False, True], kind="stable")
        groups = pairs.groupby("word", sort=False)
        out = groups.first().reset_index()
        out.insert(1, "near", groups.size().to_numpy())
        return out

    return visits.groupBy("cell").applyInPandas(search, NEAR)


def spelling_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    Two words are near when one inserted, deleted or replaced code point turns one into the other. A word's form is its near
    word of largest n (of equal ones the first in code-point order), if that is at least `factor` (2 or more) times its own n;
    else null. root follows forms to the last one. Null and empty words are left out; of a repeated word the largest n counts.
    Other columns are left out; an empty table gives an empty one.
    """
    words = stored(words.where(F.length("word") > 0).groupBy("word").agg(F.max(F.col("n").cast("long")).alias("n")), "words")
    near = _near(_visits(words, _cells(words)))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    parts = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    parts = parts.unionByName(near.withColumn("n", F.lit(None).cast("long")))
    grouped = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    kept = F.col("b.n") <= -factor * F.col("n")
    grouped = stored(grouped.select("word", "n", "n_near", F.when(kept, F.col("b.word")).alias("form"), F.when(kept, -F.col("b.n")).alias("form_n")), "forms")
    roots = _roots(grouped.where("form is not null").select("word", F.col("form").alias("root")))
    discard(words)
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): each round doubles the links followed. n grows with each link, so a chain has at most log(n) of them."""
    links = stored(links, "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("on"))
        further = stored(links.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        discard(links)
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        links = further.drop("moved")
        links._stored_at = further._stored_at
