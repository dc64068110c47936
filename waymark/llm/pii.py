"""Personal data: high-recall generators, boosted trees and calibrated redaction.

The base patterns give four kinds of spans.  Generators propose overlapping
candidates: anything with an at sign, runs of digits with and without
separators, dotted numbers.  Gradient-boosted trees judge a candidate by its
format and its context, but never see the plus sign and the check digit by which
the base patterns decide: so what looks like their spans in all else, a number
without its plus or with a wrong digit, scores like them.  They learn from all
distinct vectors, weighted by their counts: those of base spans against those that
touch none.  Where a kind has too many for the driver, alike ones are merged and
their counts added, so every candidate of every text counts.  Calibration on held-out candidates chooses a
threshold for each shape of candidate (with an at sign, dotted, like a phone
number, plain digits) such that nearly all above it are base spans; the few others
above it that lie outside all base spans are added as spans of kind ``likely``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.boosting import Calibrated
from waymark.llm.spans import Cover, Span, digest, joined
from waymark.llm.text import byte_slices
from waymark.plans.staging import Stage

KINDS = ["email", "ip", "card", "phone"]
ADDED, NONE = "likely", "none"
#: Bound of the rows that the trees learn from (more vectors are merged, none left out), and the share of base spans that held-out rows must have above a threshold.
SAMPLE_CANDIDATES, PRECISION = 20_000, 0.95
#: Powers of two by which the bins of a feature's values are merged, at most: 32 bins to one.
LEVELS = 5
#: Distinct vectors that a worker counts before it sends them on.
MOST_VECTORS = 20_000
CONTEXT = 24

# The base patterns of the four kinds.  A look-behind only spares
# attempts that start inside a run of digits, which fail wherever its start fails.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_AT = re.compile(r"[^\s@<>(),;:\"]{1,64}@[^\s@<>(),;:\"]{1,253}")
_GENERATORS = [
    re.compile(r"\+?\(?[0-9][0-9() .-]{5,30}[0-9]"),
    re.compile(r"(?<![0-9])[0-9]{7,}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){2,3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,7}(?![0-9])"),
]
_WORDS = re.compile(r"(?i)\b(phone|tel|call|fax|mobile|card|visa|account|mail|contact|address|ip|host|from)\b")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of local part and domain, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        end = found.end() if found else at + 1
        if found:
            out.append(("email", start, end))
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass the kind's test."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that any generator proposes; they may overlap."""
    found = set()
    if "@" in text:
        found.update(m.span() for m in _AT.finditer(text))
    if _DIGIT.search(text):
        for g in _GENERATORS:
            found.update(m.span() for m in g.finditer(text))
    return sorted(found)


def features(text: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate, without a leading plus sign."""
    s = text[a:b].removeprefix("+")
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    around = text[max(0, a - CONTEXT) : a]
    longest = max(map(len, groups), default=0)
    small = all(len(g) <= 3 and int(g) <= 255 for g in groups)
    head, _, tail = s.partition("@")
    return [
        len(s), len(digits), len(digits) / len(s), sum(c.isalpha() for c in s) / len(s), len(groups), longest,
        min(map(len, groups), default=0), s.count("."), s.count("-") + s.count(" "), s.count("("), float(s[:1] == "0"),
        float("@" in s), len(head), tail.count("."), len(tail.rpartition(".")[2]), len(set(digits)), float(small and s.count(".") == 3),
        float(before.isalnum()), float(after.isalnum()), float(before.isspace() or not before), float(bool(_WORDS.search(around))), float(before in (".", "-", "/", "=")),
    ]


def shapes(x: np.ndarray) -> np.ndarray:
    """The shape of each candidate by its features: 0 at sign, 1 dotted, 2 like a phone number (in groups, 13 digits at most), 3 other digits."""
    return np.select([x[:, 11] > 0, x[:, 7] >= 2, (x[:, 1] < 14) & ((x[:, 4] > 2) | (x[:, 9] > 0))], [0, 1, 2], 3)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors of each kind, and of candidates that touch no base span (kind ``none``), with counts."""
    counts: Counter[tuple[str, tuple[float, ...]]] = Counter()

    def made() -> pa.RecordBatch:
        cols = [k for k, _ in counts], [x for _, x in counts], list(counts.values())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.float64()), pa.int64()), strict=True)], ["kind", "x", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            base = base_spans(text)
            real, taken = {(x, y): k for k, x, y in base}, Cover(base)
            for a, b in candidates(text):
                if (a, b) in real or not taken.touches(a, b):
                    counts[real.get((a, b), NONE), tuple(features(text, a, b))] += 1
            if len(counts) >= MOST_VECTORS:
                yield made()
    yield made()


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many of each group are taken, ``most`` at most in all: small groups whole, large ones alike."""
    out = {}
    for i, k in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[k] = min(sizes[k], (most - sum(out.values())) // (len(sizes) - i))
    return out


def folds(kinds: list[str], vectors: list[tuple[float, ...]]) -> np.ndarray:
    """Every fourth distinct vector of a kind is fold 0; a vector with several kinds is in one fold."""
    fold: dict[tuple[float, ...], int] = {}
    n: Counter[str] = Counter()
    for k, x in zip(kinds, vectors, strict=True):
        if x not in fold:
            n[k] += 1
            fold[x] = n[k] % 4
    return np.array([fold[x] for x in vectors])


def _bins(vectors: DataFrame) -> dict[tuple[str, int], tuple[list[float], list[int]]]:
    """For each kind and feature the values at which a bin begins and the bins' numbers, 0 to 2**LEVELS - 1, by all vectors' values in order."""
    at = Window.partitionBy("kind", "f").orderBy("v")
    values = vectors.select("kind", F.posexplode("x").alias("f", "v")).groupBy("kind", "f", "v").agg(F.count("*").alias("c"))
    share = (F.sum("c").over(at) - F.col("c")) / F.sum("c").over(Window.partitionBy("kind", "f"))
    out: dict[tuple[str, int], tuple[list[float], list[int]]] = {}
    for r in values.withColumn("bin", F.floor(share * 2**LEVELS)).groupBy("kind", "f", "bin").agg(F.min("v").alias("v")).orderBy("kind", "f", "bin").collect():
        lows, bins = out.setdefault((r["kind"], r["f"]), ([], []))
        lows.append(r["v"]), bins.append(r["bin"])
    return out


def _binned(bins: dict[tuple[str, int], tuple[list[float], list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, groups = [], []
            for kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells.append([bins[kind, f][1][bisect_right(bins[kind, f][0], v) - 1] for f, v in enumerate(x)])
                groups.append(int(shapes(np.array([x]))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "shape", "c"])

    return run


def merged(vectors: DataFrame, quota: dict[str, int]) -> DataFrame:
    """``vectors(kind, x, n)`` such that a kind has its quota of rows at most: alike vectors of one shape become the most common one of them, with all their counts.

    Vectors are alike if each feature is in the same bin; bins are merged by twos until a kind's cells fit.
    """
    stage = Stage(vectors.sparkSession, "merged")
    binned = stage.put(vectors.mapInArrow(_binned(_bins(vectors)), "kind string, x array<double>, n long, shape int, c array<int>"), "binned")
    levels = binned.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).select("kind", "s", "shape", F.expr("transform(c, v -> shiftright(v, s))").alias("cell"))
    fits = {k: LEVELS for k in quota}
    for r in levels.distinct().groupBy("kind", "s").count().orderBy(F.desc("s")).collect():
        if r["count"] <= quota[r["kind"]]:
            fits[r["kind"]] = r["s"]
    shift = F.create_map(*(F.lit(v) for item in fits.items() for v in item))[F.col("kind")]
    cells = binned.withColumn("s", shift).groupBy("kind", "shape", F.expr("transform(c, v -> shiftright(v, s))").alias("cell"))
    return cells.agg(F.max_by("x", F.struct("n", "x")).alias("x"), F.sum("n").alias("n")).select("kind", "x", "n")


def learn_redaction(docs: DataFrame) -> Calibrated | None:
    """Fit on the distinct vectors of all candidates, weighted by their counts; None if only one class is there.

    The driver gets SAMPLE_CANDIDATES rows at most: half for vectors of base spans, shared
    out to their kinds, half for the others.  A kind with more vectors is ``merged`` to its share.
    """
    half = SAMPLE_CANDIDATES // 2
    stage = Stage(docs.sparkSession, "candidates")
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_samples, "kind string, x array<double>, n long")
    found = stage.put(found.groupBy("kind", "x").agg(F.sum("n").alias("n")), "vectors")
    total = {r["kind"]: (r["v"], r["n"]) for r in found.groupBy("kind").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    quota = shares({k: v for k, (v, _) in total.items() if k != NONE}, half) | {NONE: half}
    large = [k for k, (v, _) in total.items() if v > quota[k]]
    taken = found.where(~F.col("kind").isin(large)).union(merged(found.where(F.col("kind").isin(large)), {k: quota[k] for k in large})) if large else found
    rows: dict[str, list[tuple[tuple[float, ...], int]]] = {}
    for r in taken.select("kind", "x", "n", F.xxhash64("x").alias("h")).orderBy("h").collect():  # SAMPLE_CANDIDATES at most
        rows.setdefault(r["kind"], []).append((tuple(r["x"]), r["n"]))
    stage.drop(found)
    if NONE not in rows or len(rows) < 2 or sum(n for _, n in total.values()) < 20:
        return None
    kinds, vectors, weight = [], [], []
    for k in sorted(rows):
        for x, n in rows[k]:
            kinds.append(k), vectors.append(x), weight.append(float(n))
    y = np.array([float(k != NONE) for k in kinds])
    fold = folds(kinds, vectors)
    if len(set(y[fold == 0])) < 2:  # few vectors of each kind: every fourth of a class
        fold = folds([str(v) for v in y], vectors)
    if len(set(y[fold == 0])) < 2 or len(set(y[fold != 0])) < 2:
        return None
    return Calibrated(np.array(vectors), y, fold, PRECISION, np.array(weight), shapes(np.array(vectors)))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_candidates long, n_above long, scores string"

#: A candidate that was judged: its span, the probability that it is personal data, and whether that passes its shape's threshold.
Judged = tuple[int, int, float, bool]


def judged_spans(texts: list[str], model: Calibrated | None) -> list[tuple[list[Span], list[Span], list[Judged]]]:
    """Base spans, added spans and all judged candidates of each text, base spans among them."""
    out, covers, open_, rows = [], [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, [], []))
        covers.append(Cover(base))
        if model is not None:
            for a, b in sorted({*candidates(text), *((a, b) for _, a, b in base)}):
                open_.append((i, a, b)), rows.append(features(text, a, b))
    if rows:
        p = model.probability(np.array(rows))
        above = p >= model.thresholds[shapes(np.array(rows))]
        for (i, a, b), chance, passes in zip(open_, p.tolist(), above.tolist(), strict=True):
            out[i][2].append((a, b, chance, passes))
        good = np.flatnonzero(above)
        for k in good[np.argsort(-p[good], kind="stable")]:
            i, a, b = open_[k]
            if not covers[i].touches(a, b):
                covers[i].add(a, b)
                out[i][1].append((ADDED, a, b))
    return out


def _scan(model: Calibrated | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, to in byte_slices(batch.column(1)):
                ids, texts = (c.slice(at, to - at).to_pylist() for c in batch.columns)
                for doc_id, (base, added, judged) in zip(ids, judged_spans([t or "" for t in texts], model), strict=True):
                    n = Counter(k for k, _, _ in base)
                    scores = ",".join(f"{a}:{b}:{p:.3f}" for a, b, p, _ in judged)
                    rows.append((doc_id, *(n[k] for k in KINDS), digest(base, KINDS), joined(base + added, [*KINDS, ADDED]), len(judged), sum(j[3] for j in judged), scores))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs(doc_id, text)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, which
    also holds the added spans of kind ``likely``; n_candidates, n_above (those over
    their shape's threshold) and scores (start:end:probability of every candidate, base
    spans included) say what the trees made of each.  Null text is empty; repeated
    rows and null doc_ids are rows of their own; an empty table gives no rows;
    other columns are ignored.  Without both classes nothing is judged or added.
    """
    model = learn_redaction(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(model), _FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``[KIND]``; null and clean texts, other columns and all rows stay."""
    model = learn_redaction(docs)

    def clean(texts: list[str | None]) -> list[str | None]:
        out = []
        for text, (base, added, _) in zip(texts, judged_spans([t or "" for t in texts], model), strict=True):
            if not base and not added:
                out.append(text)
                continue
            parts, end = [], 0
            for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                if a >= end:
                    parts += [text[end:a], f"[{kind.upper()}]"]
                end = max(end, b)
            out.append("".join([*parts, text[end:]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for at, to in byte_slices(batch.column(column)):
                part = batch.slice(at, to - at)
                yield part.set_column(column, part.schema.field(column), pa.array(clean(part.column(column).to_pylist()), part.schema.field(column).type))

    return docs.mapInArrow(run, docs.schema)
