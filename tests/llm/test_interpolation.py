"""The interpolated model against a plain one made of dictionaries."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import made_text
from waymark.llm import interpolation


class Plain:
    """The same model with dictionaries: counts of k-grams, buckets, EM on counted cells, scores."""

    def __init__(self, docs, order):
        self.order = order
        part = [zlib.crc32(str(i).encode()) % 5 for i, _ in docs]
        self.all = self.counts([t for (_, t), r in zip(docs, part, strict=True) if r != 1])
        rest = self.counts([t for (_, t), r in zip(docs, part, strict=True) if r > 1])
        cells = Counter()
        for (_, t), r in zip(docs, part, strict=True):
            if r == 0:
                for bucket, p in self.places(t, rest):
                    cells[bucket, *(round(-math.log2(x) * interpolation.CELLS) if x > 0 else -1 for x in p)] += 1
        listed = np.array(sorted(cells)).reshape(-1, order + 1)
        self.weights = interpolation.learn_weights(listed, np.array([cells[tuple(c)] for c in listed.tolist()], float), rest[2])

    def tokens(self, text):
        return ["<"] * self.order + (text or "").encode().lower().split() + [">"]

    def counts(self, texts):
        grams = Counter()
        for t in texts:
            w = self.tokens(t)
            for i in range(self.order - 1, len(w)):  # the last start mark is a place too
                for k in range(1, self.order + 1):
                    grams[tuple(w[i - k + 1 : i + 1])] += 1
        known = {g: c for g, c in grams.items() if len(g) == 1 and g != ("<",)}
        return grams, sum(known.values()), len(known)

    def estimates(self, context, word, model):
        grams, n, _ = model
        p, seen = [], 0
        for k in range(self.order, 0, -1):
            before = tuple(context[len(context) - k + 1 :])
            below = grams[before] if before else n
            seen += below > 0
            p.append(grams[(*before, word)] / below if below else 0.0)
            if k == self.order:
                longest = below
        bucket = int(math.floor(math.log2(longest))) + 1 if seen == self.order else interpolation.BUCKETS + seen
        return bucket, p

    def places(self, text, model):
        w = self.tokens(text)
        return [self.estimates(w[:i], w[i], model) for i in range(self.order, len(w))]

    def chance(self, bucket, p):
        w = self.weights[bucket]
        return sum(a * b for a, b in zip(w, p, strict=False)) + w[self.order] / (self.all[2] + 1)

    def score(self, text):
        return sum(math.log10(self.chance(*x)) for x in self.places(text, self.all))


@pytest.fixture(scope="module")
def corpus():
    docs = [(i, made_text(i % 37, 20 + i % 13) + (f" rare{i} rare{i % 9}" if i % 3 else "")) for i in range(150)]
    return [*docs, (150, None), (151, ""), (152, "never seen words only"), (153, docs[0][1]), (153, docs[0][1])]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_plain_model(spark, corpus, order):
    plain = Plain(corpus, order)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in interpolation.interpolated_scores(df, order).collect())
    want = sorted((i, len((t or "").split()) + 1, plain.score(t)) for i, t in corpus)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 1e-6


@pytest.mark.parametrize("order", [2, 3])
def test_chances_of_all_words_sum_to_one(corpus, order):
    plain = Plain(corpus, order)
    grams = plain.all[0]
    vocabulary = [g[0] for g in grams if len(g) == 1 and g != ("<",)]
    for context in (["<"] * order, ["<"] * order + vocabulary[:1], ["<"] * order + vocabulary[5:7], ["<"] * order + [b"unseen"], ["<"] * order + [b"unseen", vocabulary[3]]):
        total = sum(plain.chance(*plain.estimates(context, w, plain.all)) for w in [*vocabulary, b"none of them"])
        assert abs(total - 1) < 1e-9


def test_unseen_contexts_lose_nothing_without_examples():
    """No cell has an unseen context: its bucket still weighs only the orders that are left."""
    w = interpolation.learn_weights(np.array([[3, 4, 8], [4, -1, 8]]), np.array([90.0, 10.0]), 1000.0)
    unseen = w[interpolation.BUCKETS + 1]
    assert unseen[0] == 0 and abs(unseen.sum() - 1) < 1e-12 and w[interpolation.BUCKETS].tolist() == [0, 0, 1]


def test_blocks_are_bounded_whatever_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "same words again")] * 400, "doc_id long, text string").coalesce(1)
    rows = docs.selectExpr("cast(doc_id as string) doc_id", "text", "1 part")
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", 200)
    made = rows.mapInArrow(lambda b, run=interpolation._blocks, n=200: _bounded(run, n, b), interpolation._BLOCK).collect()
    assert sum(len(r["texts"]) for r in made) == 400 and max(len(r["texts"]) for r in made) <= 12 and len({r["block"] for r in made}) == len(made)


def _bounded(run, n, batches):
    interpolation.BLOCK_BYTES = n
    yield from run(batches)
