"""Personal data: spans of fixed formats, and further candidates that boosted trees accept.

Base spans follow fixed patterns and checks. Generators with loose patterns propose overlapping candidates, of the
same kinds in other formats (spelled-out addresses, dotted or bare numbers) and secrets (long mixed strings). Trees
score a candidate by its format and the words around it. Their positive examples are made from the corpus: in a
bounded sample of texts each base span is rewritten into a loose format where it stands, and mixed strings that a
text assigns to a name like token or password are secrets. Their negative ones are the candidates that the texts
have otherwise, and rewritten spans whose digits were changed so that the checks fail. Scores are calibrated on the
half of the examples that the trees did not see, and a kind's threshold is the least calibrated score at which that
half's precision is high enough.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .boosting import BoostedTrees
from .shared import stored
from .textkit import batchwise, slices

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Most texts that examples are made from, and most examples, about: those of the smallest hashes.
MOST_TEXTS, MOST_EXAMPLES = 20_000, 20_000
LEAST_PRECISION = 0.9
CONTEXT = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms of the fixed patterns: a run of digits is taken whole, so long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_AT, _DOT = r"(?: ?@ ?| ?[(\[]at[)\]] ?| at )", r"(?:\.| ?[(\[]dot[)\]] ?| dot )"
_LOOSE = {
    "email": re.compile(rf"(?<![\w.%+-])[\w%+-]++(?:\.[\w%+-]++)*{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|[.,:-])[0-9]{1,3}+){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._/-]?[0-9]){13,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?[(]?[0-9](?:[ ().-]{0,2}[0-9]){8,14}(?![0-9])"),
    "secret": re.compile(r"(?<![\w+/=-])(?=[\w+/=-]*[0-9])(?=[\w+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{20,}+(?![\w+/=-])"),
}
#: Where a loose span of the kind can be at all.
_SIGN = {"email": re.compile(r"@|\bat\b", re.I)} | {k: re.compile(r"[0-9]") for k in ALL_KINDS[1:]}
_ASSIGNED = re.compile(r"(?:token|secret|passw\w*|pwd|api_?key|access_?key)\w*[\"']?\s*[:=]\s*[\"']?$", re.I)
_CUES = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.I),
    "card": re.compile(r"card|visa|pay|account|credit", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|sms", re.I),
    "secret": re.compile(r"key|token|secret|passw|auth|credential", re.I),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, start)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats by start, then kind: leftmost and non-overlapping within a kind."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[Span]:
    """Spans that the loose generators propose; they may overlap."""
    return ordered([(kind, *m.span()) for kind, pattern in _LOOSE.items() if _SIGN[kind].search(text) for m in pattern.finditer(text)])


class Taken:
    """The stretches of a text that some spans cover."""

    def __init__(self, spans: list[Span]):
        self.spans: list[tuple[int, int]] = []
        for a, b in sorted(s[1:] for s in spans):
            if self.spans and a < self.spans[-1][1]:
                a, b = self.spans[-1][0], max(b, self.spans.pop()[1])
            self.spans.append((a, b))

    def meets(self, a: int, b: int) -> bool:
        at = bisect_left(self.spans, (b,))
        return at > 0 and self.spans[at - 1][1] > a

    def add(self, a: int, b: int) -> None:
        insort(self.spans, (a, b))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s = text[a:b]
    digits = "".join(_DIGIT.findall(s))
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    edge = lambda c: float(not c or c.isspace() or c in ".,;:()|\"'")
    letters = sum(c.isalpha() for c in s)
    parts = re.split(r"[^0-9]+", s.strip("()[]+ "))
    return [
        float(ALL_KINDS.index(kind)), len(s), len(digits), letters, s.count("."), s.count("-"), s.count(" "), s.count("("),
        float(s.startswith("+")), len(set(digits)), len(re.split(r"[^A-Za-z0-9]+", s)[-1]), float("@" in s), float("[" in s),
        edge(before[-1:]), edge(after[:1]), float(bool(_CUES[kind].search(before))), float(bool(_CUES[kind].search(after))), float("\n" in before), len(_DIGIT.findall(before)),
        float(luhn(digits)) if kind == "card" else 0.0, float(all(len(p) < 4 and int(p or 0) < 256 for p in parts)) if kind == "ip" else 0.0,
        len(set(s)), float(len(parts)), float(max(map(len, parts))), float(bool(_ASSIGNED.search(before))) if kind == "secret" else 0.0, float(s != s.lower()),
    ]


def rewritten(kind: str, s: str, turn: int) -> str:
    """A base span in one of the loose formats of its kind."""
    digits = "".join(_DIGIT.findall(s))
    if kind == "email":
        at, dot = [(" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", ".")][turn % 5]
        name, host = s.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", ["[.]", "(.)", "-"][turn % 3])
    if kind == "card":
        return [".", "/", "_"][turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return [f"00{digits}", f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}", f"{last[:3]} {last[3:6]} {last[6:]}"][turn % 5]


def spoiled(kind: str, s: str, turn: int) -> str | None:
    """A rewritten span with digits that the kind's checks don't allow; null where no digits are checked."""
    if kind == "card":
        return s[:-1] + str((int(s[-1]) + 1 + turn % 9) % 10)
    return re.sub(r"^[0-9]+", str(256 + turn % 744), s) if kind == "ip" else None


def examples(text: str, seed: int) -> Iterator[tuple[str, bool, list[float]]]:
    """(kind, is personal data, features): what the trees learn from a text."""
    base = base_spans(text)
    taken = Taken(base)
    for c in candidates(text):
        if not taken.meets(c[1], c[2]):
            yield c[0], c[0] == "secret" and bool(_ASSIGNED.search(text[max(0, c[1] - CONTEXT) : c[1]])), features(text, c)
    for nth, (kind, a, b) in enumerate(base):
        turn = zlib.crc32(f"{seed}:{nth}".encode())
        good = rewritten(kind, text[a:b], turn)
        for what, yes in ((good, True), (spoiled(kind, good, turn), False)):
            if what is not None:
                before, after = text[max(0, a - 2 * CONTEXT) : a], text[b : b + 2 * CONTEXT]
                made = before + what + after
                for c in candidates(made):
                    if c[1] < len(before) + len(what) and c[2] > len(before) and (c[0] == kind or not yes):
                        yield c[0], yes and (len(before), len(before) + len(what)) == c[1:], features(made, c)


N_FEATURES = 26


@dataclass
class Detector:
    """Trees, the calibration of their scores, a threshold for each kind (over 1: none is added), and what it does on held-out examples."""

    trees: BoostedTrees
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(ALL_KINDS, 2.0))
    #: By kind, of the held-out examples: how many are personal data, how many of those are found, and the precision.
    held_out: dict[str, tuple[int, int, float]] = field(default_factory=dict)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.score(x), self.knots, self.values)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans: base ones and accepted candidates that overlap none of them, best first."""
        base = base_spans(text)
        taken = Taken(base)
        more = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
        if not more:
            return base, base
        score = self.calibrated(np.array([features(text, c) for c in more], float))
        kept = list(base)
        for i in np.argsort(-score, kind="stable").tolist():
            c = more[i]
            if score[i] >= self.thresholds[c[0]] and not taken.meets(c[1], c[2]):
                taken.add(c[1], c[2])
                kept.append(c)
        return base, ordered(kept)


def _isotonic(y: np.ndarray) -> np.ndarray:
    """Closest rising sequence to y (pool adjacent violators)."""
    levels: list[list[float]] = []
    for v in y:
        levels.append([float(v), 1])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            v2, n2 = levels.pop()
            v1, n1 = levels[-1]
            levels[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]
    return np.repeat([v for v, _ in levels], [n for _, n in levels])


def fit_detector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_texts: int = MOST_TEXTS, most: int = MOST_EXAMPLES) -> Detector:
    """Fits on about `most` examples of `most_texts` texts of docs; without any, nothing is added to the base spans."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(seed, nth, *x) for seed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for nth, x in enumerate(examples(text, seed))]
            kinds = {"seed": pa.int64(), "nth": pa.int64(), "kind": pa.string(), "yes": pa.bool_(), "x": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    draw = lambda *c: F.pmod(F.xxhash64(F.lit("pii"), *c), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("seed"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    texts = texts.where(draw("seed") < min(1.0, most_texts / max(1, texts.count())))
    made = stored(texts.mapInArrow(batchwise(make), "seed long, nth long, kind string, yes boolean, x array<double>"), "examples")
    rows = made.where(draw("seed", "nth") < min(1.0, most / max(1, made.count()))).collect()  # about `most`
    rows.sort(key=lambda r: zlib.crc32(f"{r['seed']}:{r['nth']}".encode()))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_FEATURES)
    y = np.array([r["yes"] for r in rows], float)
    half = np.arange(len(rows)) % 2 == 0
    detector = Detector(BoostedTrees().fit(x[half], y[half]))
    rest = np.flatnonzero(~half)
    if len(rest) and y[rest].any():
        score = detector.trees.score(x[rest])
        order = np.argsort(score, kind="stable")
        detector.knots, at = np.unique(score[order], return_index=True)
        detector.values = _isotonic(y[rest][order])[at]
        p = detector.calibrated(x[rest])
        for k, kind in enumerate(ALL_KINDS):
            own, yes = p[x[rest, 0] == k], y[rest][x[rest, 0] == k]
            for t in np.unique(own)[::-1]:
                if t < 0.5 or yes[own >= t].mean() < LEAST_PRECISION:
                    break
                detector.thresholds[kind] = float(t)
            found = own >= detector.thresholds[kind]
            detector.held_out[kind] = (int(yes.sum()), int(yes[found].sum()), float(yes[found].mean()) if found.any() else 1.0)
    return detector


def find_pii(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """The rows of docs with struct column `pii`: base and spans, each a list of (kind, start, end) in code points.

    Whole texts are read; null and empty ones have no spans. Repeated rows are found alike, and an empty table gives
    no rows. No shuffle; a column `pii` is replaced. The time grows with a text's length times its logarithm at most.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(detector)
    docs = docs.drop("pii")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("base", span), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shipped.value
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            for part in slices(batch, text_col):
                found = [d.spans(t or "") for t in part.column(text_col).to_pylist()]
                rows = pa.array([{"base": named(b), "spans": named(s)} for b, s in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*part.schema.names, "pii"])

    one = "array<struct<kind:string,start:long,end:long>>"
    return docs.mapInArrow(batchwise(run), StructType([*docs.schema.fields, *StructType.fromDDL(f"pii struct<base:{one},spans:{one}>").fields]))


def redact(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the first start and furthest end count."""
    found = find_pii(docs, detector, text_col)
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        lo = F.greatest(acc["at"], s["start"] + 1)
        fresh = s["end"] + 1 > acc["at"]
        text = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"], lo - acc["at"]), F.when(s["start"] + 1 >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        return F.struct(F.when(fresh, s["end"] + 1).otherwise(acc["at"]).alias("at"), F.when(fresh, text).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("pii.spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"], F.length(F.col(text_col)))))
    return found.withColumn(text_col, F.when(F.size("pii.spans") > 0, done).otherwise(F.col(text_col))).drop("pii")


def pii_digest(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, the hash of their list, all spans as text, how many were added and how many there are."""
    found = find_pii(docs.select(id_col, text_col), detector, text_col)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    more = (F.size("pii.spans") - F.size("pii.base")).cast("long").alias("n_added")
    return found.select(id_col, *map(count, KINDS), F.sha2(shown(F.col("pii.base")), 256).alias("base_sha256"), shown(F.col("pii.spans")).alias("spans"), more, F.size("pii.spans").cast("long").alias("n_spans"))
