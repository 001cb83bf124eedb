"""Language ID: per-language unigram models over a fixed vocabulary of pieces, summed over all segmentations.

A word's probability in a language is the sum, over every way to cut it into pieces of the vocabulary, of the
product of the pieces' probabilities; a forward pass over its bytes computes it. Bytes are pieces too, so every
word has a probability. Words of any length are read whole: products of short ones stay above the least double, longer
ones are summed as logarithms. Piece probabilities come from expectation-maximisation over the words of a bounded sample
(about PER_LANG documents of each language, drawn by id hash). A text's score sums over all of its words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textkit import ALNUM, Words, _powers, batchwise, mix64, slices

#: Documents of each language that a model is fitted to, about.
PER_LANG = 250
ROUNDS = 4
#: Bytes of a word whose products can't fall below the least double, and of one that is still scored together with others.
SHORT, MEDIUM = 40, 2000
#: Cells (bytes of the longest word times words) that are scored at once.
CELLS = 1 << 19
FLOOR = 1e-6
SLICE = 1 << 21
#: Words whose scores a task keeps.
MOST_REMEMBERED = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Begins a word; a byte that no word has, in place of the vocabulary's own mark.
MARK = b"\x01"
_KEY = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Pieces:
    """The pieces of a vocabulary by hash, and the lattice of words cut into them."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({p.lower() for p in pieces if ALNUM[np.frombuffer(p, np.uint8)[p[:1] == MARK :]].all() and p} | {bytes([b]) for b in range(256)})  # others are in no word
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        hashes = self._hash(self._totals(flat), end - [len(p) for p in pieces], end)
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], len(pieces)
        self.maybe = np.zeros(1 << 20, bool)  # by the top bits of a hash: most strings are no pieces
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.lengths = sorted({len(p) for p in pieces})

    @staticmethod
    def _totals(flat: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flat) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_KEY[flat] * _powers("up", len(flat)), out=total[1:])
        return total

    @staticmethod
    def _hash(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((total[end] - total[begin]) * _powers("down", int(begin.max(initial=0)) + 1)[begin] + (end - begin).astype(np.uint64))

    def edges(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """By end and length, the pieces in words: (end in word, length, words, piece ids). Words come by falling size."""
        total = self._totals(flat)
        for t in range(1, int(size.max(initial=0)) + 1):
            on = int(np.searchsorted(-size, -t, "right"))
            for length in self.lengths[: bisect_right(self.lengths, t)]:
                h = self._hash(total, begin[:on] + t - length, begin[:on] + t)
                there = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.hashes, h[there]), self.n - 1)
                same = self.hashes[at] == h[there]
                if same.any():
                    yield t, length, there[same], at[same]


def _lattice(texts: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words led by the mark: their bytes, begins and sizes, in the order given."""
    lo, n = texts.start[chosen], texts.end[chosen] - texts.start[chosen]
    size = n + 1
    at = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint8)
    flat[at] = MARK[0]
    inner = np.repeat(at + 1 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    flat[inner] = _LOWER[texts.data[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]]
    return flat, at, size


class Remembered:
    """Scores of words seen before, by hash; dropped as a whole when they are many."""

    def __init__(self, n_langs: int):
        self.hash, self.score = np.zeros(0, np.uint64), np.zeros((0, n_langs))

    def scores(self, hashes: np.ndarray, compute) -> np.ndarray:
        """Scores of sorted distinct hashes; compute(places) gives those of the unknown ones."""
        out = np.zeros((len(hashes), self.score.shape[1]))
        at = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == hashes[inside]
        out[known] = self.score[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = compute(new)
            if len(self.hash) + len(new) > MOST_REMEMBERED:
                self.hash, self.score = self.hash[:0], self.score[:0]
            if len(new) <= MOST_REMEMBERED:
                both = np.concatenate([self.hash, hashes[new]])
                order = np.argsort(both, kind="stable")
                self.hash, self.score = both[order], np.concatenate([self.score, out[new]])[order]
        return out


class LanguageModels:
    """Piece probabilities of each language."""

    def __init__(self, vocabulary: list[bytes], langs: list[str]):
        self.pieces, self.langs = Pieces(vocabulary), langs
        self.p = np.full((self.pieces.n, len(langs)), 1 / self.pieces.n)

    def _groups(self, texts: Words, chosen: np.ndarray) -> Iterator[np.ndarray]:
        """Places in chosen that are scored together, by falling size."""
        size = texts.end[chosen] - texts.start[chosen]
        order = np.argsort(-size, kind="stable")
        size, at = size[order], 0
        kind = (size <= SHORT).astype(int) + (size <= MEDIUM)
        while at < len(order):
            most = max(1, CELLS // int(size[at] + 1))
            to = min(at + most, int(np.searchsorted(kind, kind[at], "right")))
            yield order[at:to]
            at = to

    def _forward(self, edges: list, size: np.ndarray) -> np.ndarray:
        """By place in word, word and language: the sum over all segmentations up to there; logarithms if a word is not short."""
        shape = (int(size.max()) + 1, len(size), len(self.langs))
        if size.max() <= SHORT + 1:
            alpha = np.zeros(shape)
            alpha[0] = 1
            for t, length, there, piece in edges:
                alpha[t, there] += alpha[t - length, there] * self.p[piece]
            return alpha
        alpha, p = np.full(shape, -np.inf), np.log(self.p)
        alpha[0] = 0
        for t, length, there, piece in edges:
            alpha[t, there] = np.logaddexp(alpha[t, there], alpha[t - length, there] + p[piece])
        return alpha

    def _long(self, flat: np.ndarray) -> np.ndarray:
        """Log probability of one very long word: the same sum, place by place, scaled as it falls."""
        total, pieces = self.pieces._totals(flat), self.pieces
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(flat) + 1)]
        for length in pieces.lengths:
            begin = np.arange(len(flat) - length + 1)
            h = pieces._hash(total, begin, begin + length)
            at = np.minimum(np.searchsorted(pieces.hashes, h), pieces.n - 1)
            for t in np.flatnonzero(pieces.hashes[at] == h).tolist():
                found[t + length].append((length, int(at[t])))
        longest, low = pieces.lengths[-1], np.zeros(len(self.langs))
        alpha = np.zeros((longest + 1, len(self.langs)))  # the last places, newest last
        alpha[-1] = 1
        for here in found[1:]:
            alpha[:-1] = alpha[1:]
            alpha[-1] = 0
            for length, piece in here:
                alpha[-1] += alpha[-1 - length] * self.p[piece]
            if alpha[-1].min() < 1e-100:
                scale = alpha.max(0)
                alpha /= scale
                low += np.log(scale)
        return low + np.log(alpha[-1])

    def word_scores(self, texts: Words, chosen: np.ndarray) -> np.ndarray:
        """Log probability of each chosen word in each language: the forward pass over all segmentations."""
        out = np.zeros((len(chosen), len(self.langs)))
        for group in self._groups(texts, chosen):
            flat, begin, size = _lattice(texts, chosen[group])
            if size[0] > MEDIUM + 1:
                for i, a, n in zip(group, begin, size, strict=True):
                    out[i] = self._long(flat[a : a + n])
                continue
            last = self._forward(self.pieces.edges(flat, begin, size), size)[size, np.arange(len(size))]
            out[group] = np.log(last) if size[0] <= SHORT + 1 else last
        return out

    def fit(self, texts: Words, counts: np.ndarray, rounds: int = ROUNDS) -> None:
        """Expectation-maximisation on words (one row of counts per word, one column per language). Words over MEDIUM bytes don't teach."""
        parts = []
        for group in self._groups(texts, np.arange(len(counts))):
            flat, begin, size = _lattice(texts, group)
            if size[0] <= MEDIUM + 1:
                parts.append((group, size, list(self.pieces.edges(flat, begin, size))))
        for _ in range(rounds):
            used = np.zeros_like(self.p)
            for group, size, edges in parts:
                self._expect(edges, size, counts[group], used)
            everything = used.sum(1, keepdims=True) / max(1e-9, used.sum())
            used += 20 * everything + 1e-3  # towards what all languages share
            self.p = np.maximum(used / used.sum(0), FLOOR)

    def _expect(self, edges: list, size: np.ndarray, counts: np.ndarray, used: np.ndarray) -> None:
        """Adds to `used` how often each piece is expected in the words."""
        alpha, n = self._forward(edges, size), len(size)
        back = sorted(edges, key=lambda e: (-e[0], e[1]))
        if size[0] <= SHORT + 1:
            beta = np.zeros_like(alpha)
            beta[size, np.arange(n)] = 1
            for t, length, there, piece in back:
                beta[t - length, there] += beta[t, there] * self.p[piece]
            per = counts / alpha[size, np.arange(n)]
            for t, length, there, piece in edges:
                np.add.at(used, piece, alpha[t - length, there] * self.p[piece] * beta[t, there] * per[there])
            return
        beta, p = np.full_like(alpha, -np.inf), np.log(self.p)
        beta[size, np.arange(n)] = 0
        for t, length, there, piece in back:
            beta[t - length, there] = np.logaddexp(beta[t - length, there], beta[t, there] + p[piece])
        whole = alpha[size, np.arange(n)]
        for t, length, there, piece in edges:
            np.add.at(used, piece, np.exp(alpha[t - length, there] + p[piece] + beta[t, there] - whole[there]) * counts[there])


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a SentencePiece model; bytes, unknown and control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i).replace("▁", "\x01").encode() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i))]


def fit_languages(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> LanguageModels:
    """Fits on a sample of the rows with a text and a language; without any there are no languages."""
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text")).where("__lang is not null and length(__text) > 0")
    sizes = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}  # a row per language
    langs = sorted(sizes)
    models = LanguageModels(load_pieces(vocabulary), langs)
    if not langs:
        return models
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "__id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < rate[F.col("__lang")]).select("__lang", "__text").collect()
    texts = Words(pa.array([r["__text"] for r in sample], pa.string()), ALNUM)
    lang = np.repeat(np.array([langs.index(r["__lang"]) for r in sample], np.int64), texts.counts)
    _, first, at = np.unique(texts.hash, return_index=True, return_inverse=True)
    counts = np.zeros((len(first), len(langs)))
    np.add.at(counts, (at, lang), 1)
    texts.start, texts.end = texts.start[first], texts.end[first]
    models.fit(texts, counts)
    return models


def identify_languages(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """The rows of docs with struct column `language`: lang and score (its probability; languages alike before).

    A text that is null or has no letter (of Unicode's L categories) is `und` with score 0, and so is every text if no
    language was learned. Whole texts count, each distinct word of a slice once. Of languages with equal scores the
    first by name is taken. Equal rows get equal results, and an empty table gives no rows. No shuffle; a column
    `language` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    docs = docs.drop("language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        seen = Remembered(len(m.langs))
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                words = Words(part.column(text_col), ALNUM)
                total = np.zeros((part.num_rows, len(m.langs)))
                if len(words.hash):
                    distinct, first, at = np.unique(words.hash, return_index=True, return_inverse=True)
                    scores = seen.scores(distinct, lambda new: m.word_scores(words, first[new]))
                    run = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(scores[at], 0)])
                    total = run[words.first[1:]] - run[words.first[:-1]]
                rows = []
                for text, s in zip(part.column(text_col).to_pylist(), total, strict=True):
                    if not text or not m.langs or not any(map(str.isalpha, text)):
                        rows.append({"lang": "und", "score": 0.0})
                    else:
                        p = np.exp(s - s.max())
                        k = int(s.argmax())
                        rows.append({"lang": m.langs[k], "score": float(p[k] / p.sum())})
                found = pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "language"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("language struct<lang:string,score:double>").fields])
    return docs.mapInArrow(batchwise(run), schema)
