"""Language of words by a linear-chain conditional random field.

A word's emission comes from hashed features: its affixes and n-grams (up to four
bytes of its letters between word marks) and the word itself as a lexicon entry.
All distinct words of a batch are featurised at once.  Transitions between neighbouring words' languages are
learned too, from plain and from artificially code-switched texts.  Forward-
backward runs over each whole text: transfer matrices of short segments are
chained first, then all segments run in parallel from exact boundary messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.sampling import smallest
from waymark.llm.text import as_bytes, byte_slices, span_hashes

#: Bounds of the labelled sample that the field is fitted on: distinct texts per language, characters of such a text,
#: and languages (those of most texts).  Prediction reads whole texts.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARACTERS, MOST_LANGUAGES = 60, 20_000, 200
#: Bits of a hashed feature, and the longest n-gram in bytes.
FEATURE_BITS, LONGEST = 18, 4
ROUNDS, RATE, PENALTY = 20, 0.4, 1e-6
#: Words per segment of the forward-backward pass, per batch of it, and emissions a worker keeps.
SEGMENT, BATCH_BYTES, KEPT_WORDS = 32, 1 << 19, 50_000
#: Words after which an artificially code-switched training text changes its language.
SWITCH = 15
UNKNOWN = "und"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct white-space separated words, each word's number among them, and each text's offsets."""
    raw = b"\n".join([b"", *texts, b""])
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(_SPACE[data].view(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    begin = 1 + np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, inverse, np.searchsorted(starts, begin)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = np.zeros(256, bool)  # bytes of letters, and of anything beyond ASCII
_PART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def featurise(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and hashed features of all words, and whether each has a letter.

    Letters are lowered in ASCII and Latin-1; words without a letter have no features.
    """
    data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    keep = _PART[data]
    ascii_letter = keep & (data < 128)
    has = np.add.reduceat(ascii_letter.astype(np.int64), bounds[:-1]) > 0 if len(words) else np.empty(0, bool)
    wide = np.add.reduceat((data > 127).astype(np.int64), bounds[:-1]) > 0 if len(words) else has
    for i in np.flatnonzero(wide & ~has).tolist():
        has[i] = any(c.isalpha() for c in words[i].decode("utf-8", "replace"))
    word = np.repeat(np.arange(len(words)), sizes)
    keep[bounds[:-1]] = keep[bounds[1:] - 1] = True
    keep &= has[word]
    low = _LOWER[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = np.where(latin, low + 32, low)[keep].astype(np.uint64)
    word = word[keep]
    rows, found = [], []
    gram = np.zeros(len(low), np.uint64)
    for n in range(1, LONGEST + 1):
        gram = gram[: len(low) - n + 1] << np.uint64(8) | low[n - 1 :]
        same = word[: len(gram)] == word[n - 1 :]
        rows.append(word[: len(gram)][same])
        found.append(gram[same] * np.uint64(8) + np.uint64(n))
    own = np.flatnonzero(has)
    if len(own):
        first = np.searchsorted(word, own)
        last = np.append(first[1:], len(word))
        rows.append(own)
        found.append(span_hashes(low.astype(np.uint8), first, last))
    spread = np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate(rows), (spread >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), has


def forward_backward(emit: np.ndarray, offsets: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word of every text, and expected transition counts.

    ``emit`` are positive word potentials, ``move`` positive transition
    potentials; each text starts from a uniform state.
    """
    n, size = emit.shape
    sizes = np.diff(offsets)
    per_text = -(-sizes // SEGMENT)
    total = int(per_text.sum())
    if not n:
        return emit, np.zeros((size, size))
    first = np.concatenate(([0], np.cumsum(per_text)))
    text = np.repeat(np.arange(len(sizes)), per_text)
    at = offsets[:-1][text] + SEGMENT * (np.arange(total) - first[:-1][text])
    left = np.minimum(SEGMENT, offsets[1:][text] - at)
    steps = np.arange(SEGMENT)
    real = steps < left[:, None]
    place = np.minimum(at[:, None] + steps, n - 1)
    e = emit[place]  # segment, step, state

    chain = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for j in range(SEGMENT):
        nxt = (chain.reshape(-1, size) @ move).reshape(total, size, size) * e[:, j, None, :]
        nxt /= nxt.sum((1, 2), keepdims=True)
        chain = np.where(real[:, j, None, None], nxt, chain)

    start, end = np.full((total, size), 1 / size), np.full((total, size), 1.0)
    order = np.argsort(-per_text, kind="stable")
    depth = per_text[order]
    for k in range(1, int(depth[0])):
        own = order[: np.searchsorted(-depth, -k)]  # texts with more than k segments
        s = first[:-1][own] + k
        a = np.einsum("ni,nij->nj", start[s - 1], chain[s - 1])
        start[s] = a / a.sum(1, keepdims=True)
        s = first[1:][own] - 1 - k
        b = np.einsum("nij,nj->ni", chain[s + 1], end[s + 1])
        end[s] = b / b.sum(1, keepdims=True)

    before, alpha = np.empty_like(e), np.empty_like(e)
    a = start
    for j in range(SEGMENT):
        before[:, j] = a
        nxt = (a @ move) * e[:, j]
        a = np.where(real[:, j, None], nxt / nxt.sum(1, keepdims=True), a)
        alpha[:, j] = a
    beta = np.empty_like(e)
    b = end
    for j in range(SEGMENT - 1, -1, -1):
        beta[:, j] = b
        nxt = (e[:, j] * b) @ move.T
        b = np.where(real[:, j, None], nxt / nxt.sum(1, keepdims=True), b)
    before, alpha, beta, e = before[real], alpha[real], beta[real], e[real]
    posterior = alpha * beta
    posterior /= posterior.sum(1, keepdims=True)
    ahead = e * beta
    z = ((before @ move) * ahead).sum(1, keepdims=True)
    return posterior, before.T @ (ahead / z) * move


class LanguageField:
    """The learned field: feature weights, transitions and language names."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.kept: dict[bytes, int] = {}
        size = len(self.langs)
        self.rows = np.empty((0, size + 1))
        if not size:
            return
        label = np.array([self.langs.index(x) for x in langs])
        words, inverse, offsets = split_words(as_bytes(texts))
        rows, cols, _ = featurise(words)

        # whole texts, and the same texts cut and interleaved so that languages alternate
        pieces = [(label[t], np.arange(a, min(a + SWITCH, offsets[t + 1]))) for t in range(len(texts)) for a in range(offsets[t], offsets[t + 1], SWITCH)]
        by_lang = [[p for p in pieces if p[0] == k] for k in range(size)]
        most = max(map(len, by_lang), default=0)
        mixed = [part[i % len(part)] for i in range(most) for part in by_lang if part]
        place = np.concatenate([np.arange(len(inverse)), *(p for _, p in mixed)]).astype(int)
        gold = np.concatenate([np.repeat(label, np.diff(offsets)), *(np.full(len(p), k) for k, p in mixed)]).astype(int)
        chain = np.append(offsets, len(place)) if mixed else offsets
        word = inverse[place]
        use = np.concatenate([[True], np.ones(max(0, len(gold) - 1), bool)])[: len(gold)]
        use[chain[:-1][np.diff(chain) > 0]] = False
        seen_moves = np.bincount(gold[:-1][use[1:]] * size + gold[1:][use[1:]], minlength=size * size).reshape(size, size) if len(gold) > 1 else np.zeros((size, size))
        target = np.zeros((len(words), size))
        np.add.at(target, (word, gold), 1)

        weights, moves = np.zeros((1 << FEATURE_BITS, size)), np.zeros((size, size))
        sq_w, sq_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
        for _ in range(ROUNDS):  # adaptive gradient steps on the conditional likelihood
            emit = self._emissions(weights, rows, cols, len(words))
            posterior, expected = forward_backward(emit[word], chain, np.exp(moves))
            model = np.stack([np.bincount(word, posterior[:, k], len(words)) for k in range(size)], 1)
            diff = (target - model) / max(1, len(word))
            grad = np.stack([np.bincount(cols, diff[rows, k], 1 << FEATURE_BITS) for k in range(size)], 1) - PENALTY * weights
            move = (seen_moves - expected) / max(1, len(word)) - PENALTY * moves
            sq_w += grad**2
            sq_m += move**2
            weights += RATE * grad / np.sqrt(sq_w)
            moves += RATE * move / np.sqrt(sq_m)
        self.weights = weights.astype(np.float32)
        self.moves = np.exp(moves)

    @staticmethod
    def _emissions(weights: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        size = weights.shape[1]
        raw = np.stack([np.bincount(rows, weights[cols, k], n) for k in range(size)], 1)
        return np.exp(raw - raw.max(1, keepdims=True)) + 1e-12

    def _potentials(self, words: list[bytes]) -> np.ndarray:
        """Word potentials, and in the last column whether the word has a letter."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.rows = {}, self.rows[:0]
        fresh = [w for w in words if w not in self.kept]
        if fresh:
            rows, cols, has = featurise(fresh)
            self.kept.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            emit = self._emissions(self.weights, rows, cols, len(fresh))
            self.rows = np.concatenate([self.rows, np.hstack([emit, has[:, None]])])
        return self.rows[[self.kept[w] for w in words]]

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean posterior of each text over its words with letters, number of those words, and switches between them."""
        size = len(self.langs)
        words, inverse, offsets = split_words(texts)
        if not size or not len(inverse):
            return np.zeros((len(texts), size)), np.zeros(len(texts), int), np.zeros(len(texts), int)
        rows = self._potentials(words)[inverse]
        posterior, _ = forward_backward(np.ascontiguousarray(rows[:, :size]), offsets, self.moves)
        has = rows[:, size] > 0
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))[has]
        own = posterior[has]
        n = np.bincount(text, minlength=len(texts))
        share = np.stack([np.bincount(text, own[:, k], len(texts)) for k in range(size)], 1) / np.maximum(n, 1)[:, None]
        best = own.argmax(1)
        change = (best[1:] != best[:-1]) & (text[1:] == text[:-1])
        return share, n, np.bincount(text[1:][change], minlength=len(texts))


_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def _judged(field: LanguageField, column: pa.Array) -> Iterator[tuple[str, float, int, int]]:
    """Language, score, words with letters and switches of each text, a bounded number of bytes at a time."""
    for at, to in byte_slices(column, most=BATCH_BYTES):
        shares = field.label(as_bytes(column.slice(at, to - at).to_pylist()))
        for row, n, s in zip(*(x.tolist() for x in shares), strict=True):
            best = max(row) if n else 0.0
            yield (field.langs[row.index(best)] if n else UNKNOWN), min(1.0, best), n, s


def _predict(field: LanguageField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*_judged(field, batch.column("text")), strict=True)) or [()] * 4
            columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PREDICTED.split(", ")])

    return run


def _accept(field: LanguageField, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            if field.langs:
                keep = [lang != UNKNOWN and score >= least for lang, score, _, _ in _judged(field, column)]
            else:  # nothing was labelled: nothing can be told apart but texts without a letter
                keep = [any(c.isalpha() for c in t or "") for t in column.to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def learn_languages(docs: DataFrame) -> LanguageField:
    """Fit on SAMPLE_PER_LANGUAGE labelled texts of each language that are not held out: distinct ones, chosen by hash."""
    rows = docs.where("not held_out and lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    known = rows.groupBy("lang", "h").agg(F.count("*").alias("n"))
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    known = known.where(F.col("lang").isin(langs)).select("lang", "h")
    chosen = {(r["lang"], r["h"]) for r in smallest(known, "lang", "h", SAMPLE_PER_LANGUAGE).collect()}
    found = rows.where(F.col("h").isin(sorted({h for _, h in chosen}))).select("lang", "h", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text")).distinct().collect() if chosen else []
    picked = sorted((r["lang"], r["h"], r["text"]) for r in found if (r["lang"], r["h"]) in chosen)
    return LanguageField([t for _, _, t in picked], [lang for lang, _, _ in picked])


def _labelled(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return docs.withColumn("held_out", F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 0"))


def accepted_documents(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text has a known language with a score of ``least`` or more, all columns unchanged.

    Null texts and those without a letter go; where nothing is labelled, all others stay.  An empty table gives no rows.
    """
    return docs.mapInArrow(_accept(learn_languages(_labelled(docs)), least), docs.schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """The language of every whole text of ``docs(doc_id, text, lang)``.

    Learns from documents whose crc32(doc_id as text) mod 5 is not 0; a
    prediction depends on the text alone.  Returns doc_id, held_out, lang_pred,
    score (mean posterior of that language over the words with letters), n_words
    (such words) and n_switches (changes of language from word to word).

    Null text or no letter: ``und`` with score 0, as for every text if nothing
    is labelled.  A null doc_id counts as the empty string.  Repeated rows are
    rows of their own; an empty table gives no rows; other columns are ignored.
    """
    docs = _labelled(docs)
    field = learn_languages(docs)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(field), _PREDICTED)
