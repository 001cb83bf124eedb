"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, calibrated votes.

The examples are a bounded sample of labelled rows (PER_CLASS of each label, the smallest hashes of the id). Their
terms that depend on the label are the vocabulary; document frequencies are counted over the whole corpus. A query's upper bound for a block
of examples is the sum of its term weights times the terms' largest weights in that block; blocks are scored
exactly, best bound first, until no bound exceeds the k-th best cosine. Votes weighted by similarity, corrected for
how rare the labels are, are mapped to probabilities by a logistic curve, fitted to each example's votes from the
other examples and to the share of its words that are terms: one term in a long text tells little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, batchwise, slices

#: Most examples of each label.
PER_CLASS = 1500
#: A term of the vocabulary stands in this many examples at least, and in at most half of the corpus.
LEAST_EXAMPLES = 5
#: Least chi-square of a term and the label (1 degree of freedom, one chance in 100,000).
CHI_SQUARE = 19.5
NEIGHBOURS = 15
BLOCK = 64
CUT = 0.7
#: Terms in a thousand words from which a text counts as full of them.
DENSE = 5


def _bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, count), by document."""
    doc, h = words.docs(), words.hash
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


@dataclass
class Votes:
    """Examples as inverted lists with block maxima, and the calibration of their votes."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    begin: np.ndarray  # of each (term, block) in example and weight
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray  # terms x blocks
    label: np.ndarray
    ids: np.ndarray
    share: np.ndarray  # weight of a vote by its label
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))  # of nothing, the vote, and the terms' share
    k: int = NEIGHBOURS

    def vectors(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of documents: bounds per document, terms, weights."""
        n = len(words.counts)
        at = np.minimum(np.searchsorted(self.terms, words.hash), max(0, len(self.terms) - 1))
        known = self.terms[at] == words.hash if len(self.terms) else np.zeros(len(words.hash), bool)
        cell, count = np.unique(words.docs()[known] * len(self.terms) + at[known], return_counts=True)
        doc, term = cell // max(1, len(self.terms)), cell % max(1, len(self.terms))
        w = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, n))
        return np.searchsorted(doc, np.arange(n + 1)), term, w / norm[doc]

    def nearest(self, term: np.ndarray, q: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine (ties: smaller number) and their cosines, exactly; none of cosine 0."""
        blocks = self.most.shape[1]
        bound = q @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        found, sims, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 8
        while at < blocks and bound[order[at]] > 0:
            if len(sims) >= self.k and bound[order[at]] < sims[self.k - 1] - 1e-9:
                break
            some = order[at : at + step]
            at, step = at + step, step * 2
            cell = (term[:, None] * blocks + some[None, :]).ravel()
            lo, n = self.begin[cell], self.begin[cell + 1] - self.begin[cell]
            total = int(n.sum())
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
            s = np.bincount(self.example[place], np.repeat(np.repeat(q, len(some)), n) * self.weight[place], len(self.label))
            if but >= 0:
                s[but] = 0
            near = np.flatnonzero(s > 0)
            found, sims = np.concatenate([found, near]), np.concatenate([sims, s[near]])
            best = np.lexsort((found, -sims))[: self.k]
            found, sims = found[best], sims[best]
        return found, sims

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic among the votes, each weighted by squared similarity; the prior where there are none."""
        w = sims**2 * self.share[self.label[found]]
        return float(w[self.label[found] == 1].sum() / w.sum()) if len(w) and w.sum() > 0 else 0.0

    def density(self, words: Words) -> np.ndarray:
        """How many of a thousand words of each document are terms, as a logarithm; 0 for none. Over DENSE, more tell no more."""
        at = np.minimum(np.searchsorted(self.terms, words.hash), max(0, len(self.terms) - 1))
        known = self.terms[at] == words.hash if len(self.terms) else np.zeros(len(words.hash), bool)
        n = np.bincount(words.docs(), known, len(words.counts))
        return np.log1p(np.minimum(1000 * n / np.maximum(words.counts, 1), DENSE))

    def probability(self, vote: np.ndarray, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(vote, density) @ self.curve, -30, 30)))


def _inputs(vote: np.ndarray, density: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(vote), vote, vote * density], 1)


def _logistic(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of y on a by Newton steps, with a weak pull to 0."""
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (w * (y - p)) - 1e-2 * b
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(b))
        b = b + np.linalg.solve(h, g)
    return b


def fit_votes(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Votes:
    """Fits on the rows of docs that examples (id and a label 0 or 1) names; repeated ids count once, label 1 first."""
    spark = docs.sparkSession
    named = examples.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label")).where("__id is not null")
    totals = {r["__label"]: r["count"] for r in named.groupBy("__label").count().collect()}
    parts = [named.where(F.col("__label") == y).orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(per_class) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(sample), "__id").where("length(__text) > 0")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                words = Words(part.column("__text"))
                doc, h, _ = _bags(words)
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                n = [words.hash[words.first[i] : words.first[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("__id").cast(pa.string()), part.column("__label"), pa.array([h[edge[i] : edge[i + 1]].tobytes() for i in range(part.num_rows)]), pa.array(n)], names=["id", "label", "terms", "words"])

    got = texts.mapInArrow(batchwise(bags), "id string, label int, terms binary, words binary").collect()
    kept = {bytes(r["words"]): r for r in sorted(got, key=lambda r: (r["label"], r["id"]))}  # a text counts once
    rows = sorted(kept.values(), key=lambda r: (r["id"], r["label"]))
    terms = _telling_terms([np.frombuffer(r["terms"], np.uint64) for r in rows], np.array([r["label"] for r in rows], bool))
    shipped = spark.sparkContext.broadcast(terms)  # a few thousand: at most what 2 * per_class texts repeat

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(shipped.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, "__text"):
                words = Words(part.column("__text"))
                if len(shipped.value):
                    at = np.minimum(np.searchsorted(shipped.value, words.hash), len(shipped.value) - 1)
                    on = shipped.value[at] == words.hash
                    seen += np.bincount(np.unique(words.docs()[on] * len(seen) + at[on]) % len(seen), minlength=len(seen))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(seen[there], n))], names=["term", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(batchwise(counts), "term long, n long")
    n_docs, df = 0, np.zeros(len(terms), np.int64)
    for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term at most, and one for all documents
        if r["term"] < 0:
            n_docs = r["n"]
        else:
            df[r["term"]] = r["n"]
    use = df <= max(1, n_docs) / 2
    terms, df = terms[use], df[use]
    idf = np.log((1 + n_docs) / (1 + df))

    label = np.array([r["label"] for r in rows], np.int64)
    votes = Votes(terms, idf, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((len(terms), 0)), label, np.array([r["id"] for r in rows], object), np.ones(2))
    here = np.array([max(1, (label == y).sum()) for y in (0, 1)], float)
    there = np.array([max(1, totals.get(y, 0)) for y in (0, 1)], float)
    true = there / here
    words = _from_hashes([np.frombuffer(r["words"], np.uint64) for r in rows])
    edge, term, w = votes.vectors(words)
    example = np.repeat(np.arange(len(rows)), np.diff(edge))
    blocks = max(1, -(-len(rows) // BLOCK))
    cell = term * blocks + example // BLOCK
    order = np.lexsort((example, cell))
    votes.example, votes.weight = example[order], w[order]
    votes.begin = np.searchsorted(cell[order], np.arange(len(terms) * blocks + 1))
    votes.most = np.zeros((len(terms), blocks))
    np.maximum.at(votes.most.reshape(-1), cell, w)
    if len(rows):
        votes.share = np.where(here > 1, here.max() / here, 1.0)
        own = np.array([votes.vote(*votes.nearest(term[a:b], w[a:b], i)) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))])
        weights = true[label]
        votes.curve = _logistic(_inputs(own, votes.density(words)), label.astype(float), weights / weights.mean())
    return votes


def _telling_terms(bags: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Terms whose presence and the label depend on each other by a chi-square test over the examples."""
    every = np.concatenate([np.zeros(0, np.uint64), *bags])
    terms, at = np.unique(every, return_inverse=True)
    n, yes = len(bags), int(label.sum())
    if not yes or yes == n:
        return terms
    df = np.bincount(at, minlength=len(terms))
    both = np.bincount(at, np.repeat(label, [len(b) for b in bags]), len(terms))
    odds = df * yes / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (both - odds) ** 2 * n**3 / (df * (n - df) * yes * (n - yes))
    return terms[(df >= min(LEAST_EXAMPLES, max(1, n // 20))) & (chi >= CHI_SQUARE)]


def _from_hashes(rows: list[np.ndarray]) -> Words:
    words = Words.__new__(Words)
    words.hash = np.concatenate([np.zeros(0, np.uint64), *rows])
    words.counts = np.array([len(r) for r in rows], np.int64)
    words.first = np.concatenate([[0], np.cumsum(words.counts)])
    return words


def score_toxicity(docs: DataFrame, votes: Votes, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs with struct column `toxicity`: score, predicted and evidence (ids and cosines of the votes).

    Null and empty texts, and those without a known term, get the score of no votes. Whole texts count. Of examples
    with equal cosines those of smaller ids vote first; a score equal to the cut is toxic. Equal rows get equal scores,
    and an empty table gives no rows. The votes (bounded by the sample) are broadcast; there is no shuffle. A column
    `toxicity` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(votes)
    docs = docs.drop("toxicity")
    found = "toxicity struct<score:double,predicted:int,evidence:array<struct<id:string,cosine:double>>>"
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value
        for batch in batches:
            for part in slices(batch, text_col):
                words = Words(part.column(text_col))
                edge, term, w = v.vectors(words)
                near = [v.nearest(term[a:b], w[a:b]) if b > a else (np.zeros(0, np.int64), np.zeros(0)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                p = v.probability(np.array([v.vote(*x) for x in near]), v.density(words))
                rows = [{"score": float(s), "predicted": int(s >= cut), "evidence": [{"id": str(v.ids[i]), "cosine": float(c)} for i, c in zip(*x, strict=True)]} for s, x in zip(p, near, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=[*part.schema.names, "toxicity"])

    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(found).fields])
    return docs.mapInArrow(batchwise(run), schema)


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def fit_from_labels(docs: DataFrame, labels: DataFrame, **options) -> Votes:
    """Fits on the labelled rows outside the held-out fold (crc32(doc_id) mod 3 = 1)."""
    return fit_votes(docs, labels.where(fold("doc_id", 3) != 1), **options)
