"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context frequency.

``P(w | context) = sum_k lambda_k[b] * c(k-gram) / c(its context) + lambda_0[b] / (V + 1)``
where b is the power-of-two bucket of the longest context's count.  An order whose
context was never seen has no estimate: such places have buckets of their own, in
which the absent orders weigh nothing, so the mixture always sums to one.  The
weights are learned by expectation-maximisation on the counts of a deleted part of
the training documents against the counts of the rest; scoring then uses all counts.

Texts are gathered into blocks of bounded size, whatever repeats, and the blocks
are written once, in pieces, as Spark copies a row whole at each step.  A block
sends its distinct n-grams (sorted hashes and counts) to hash ranges, a range adds up
what all blocks sent and answers each block in the order of its request, so an answer
needs no keys.  Only messages with n-grams are sent: never more rows than blocks times
ranges, nor more than the blocks have n-grams.  A block whose pieces are read by
several tasks asks once for each run of pieces.  Nothing that grows with the corpus
reaches the driver or one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.text import U64, as_bytes, give_back, mix, word_hashes
from waymark.plans.staging import Stage

#: Bytes of text per block and per hash range (what a worker holds at once), and the least number of tasks and of ranges.
BLOCK_BYTES, RANGE_BYTES, LEAST_TASKS, LEAST_RANGES = 12_000_000, 24_000_000, 40, 32
#: Bytes of text in a row of a block, and of n-grams in a batch that a worker returns.
PIECE_BYTES = 1_000_000
#: Bytes that go to a worker at once and pieces that are read at once; Spark's own limits (64 MB, 4,096 rows) would take all that a task reads.
SENT_BYTES, READ_PIECES = 4_000_000, 4
#: Steps per factor of two in which the deleted part's estimates are counted, so
#: the histogram that EM reads has at most buckets * cells ** order rows.
CELLS = 4
EM_ROUNDS = 60
#: Buckets of seen contexts; those after it are for places whose longest context is unseen, by the orders that are left.
BUCKETS = 64
START, END = U64(0x51A7E0000000001D), U64(0xE9D000000000002B)
TEST, TRAIN, DELETED = 0, 1, 2

_BLOCK = "block long, piece int, part int, ids array<string>, texts array<string>"
# run: the first of the block's pieces that ask together
_REQUEST = "level int, rng int, block long, run int, part int, keys binary, counts binary"
_ANSWER = "block long, run int, part int, level int, rng int, counts binary, rest binary, n double, v double, n_rest double, v_rest double"
_CELLS = "cell array<int>, n long"
_SCORE = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """Columns, each a list or an array, under the names and types of ``schema``."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _batches(schema: str, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of PIECE_BYTES of their binary columns, or one row more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= PIECE_BYTES:
            yield _batch(schema, list(zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _batch(schema, list(zip(*held, strict=True)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part gathered up to BLOCK_BYTES, in pieces that follow each other; a longer text is a block of its own."""
    first = TaskContext.get().partitionId() << 32
    made = 0
    held: dict[int, tuple[list, list]] = {}
    size: dict[int, int] = {}

    def flush(part: int) -> Iterator[pa.RecordBatch]:
        nonlocal made
        ids, texts = held.pop(part)
        made += 1
        ends = np.cumsum([len(t or "") + 1 for t in texts])
        at = piece = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right")))
            yield _batch(_BLOCK, [[first + made], [piece], [part], [ids[at:to]], [texts[at:to]]])
            at, piece = to, piece + 1

    for batch in batches:
        for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(text or "")
            if part in held and size[part] + n > BLOCK_BYTES:
                yield from flush(part)
            ids, texts = held.setdefault(part, ([], []))
            ids.append(doc_id), texts.append(text)
            size[part] = n if len(ids) == 1 else size[part] + n
    for part in sorted(held):
        yield from flush(part)
    give_back()


def _pack(values: np.ndarray) -> bytes:
    """Integers as the number of byte planes that are not all zeros, and these planes."""
    used = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([used]) + values.view(np.uint8).reshape(len(values), -1)[:, :used].T.tobytes()


def _unpack(data: pa.BinaryScalar) -> np.ndarray:
    data = np.frombuffer(data.as_buffer(), np.uint8)
    planes = data[1:].reshape(data[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : len(planes)] = planes.T
    return values.reshape(-1).view(U64)


def ngrams(texts: list, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each k up to ``order`` the k-gram ending at every place of start, words, end; and each text's first place."""
    words, offsets = word_hashes(as_bytes(texts))
    n = len(texts)
    first = offsets[:-1] + 2 * np.arange(n)
    tokens = np.empty(len(words) + 2 * n, U64)
    inner = np.ones(len(tokens), bool)
    last = offsets[1:] + 2 * np.arange(n) + 1
    tokens[first], tokens[last] = START, END
    inner[first] = inner[last] = False
    tokens[inner] = words
    grams, edge = [tokens], START
    for _ in range(2, order + 1):
        before = np.roll(grams[-1], 1)
        before[first] = edge
        grams.append(mix((before * U64(0xD1342543DE82EF95)) ^ tokens))
        edge = mix((np.array([edge]) * U64(0xD1342543DE82EF95)) ^ START)[0]
    return [g if k == 0 else g >> U64(8) for k, g in enumerate(grams)], first


def _bounds(level: int, ranges: int) -> np.ndarray:
    """The least key of every hash range."""
    shift = (64 if level == 1 else 56) - ranges.bit_length() + 1
    return np.arange(ranges, dtype=U64) << U64(shift)


def _messages(grams: list[list[np.ndarray]], block: int, run: int, part: int, ranges: int) -> Iterator[tuple]:
    for level in range(1, len(grams[0]) + 1):
        keys, counts = np.unique(np.concatenate([g[level - 1] for g in grams]), return_counts=True)
        counts = counts.astype(np.uint32)
        bounds = _bounds(level, ranges)
        cuts = np.append(np.searchsorted(keys, bounds), len(keys))
        for rng in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[rng], cuts[rng + 1]
            yield level, rng, block, run, part, _pack(np.diff(keys[a:b], prepend=bounds[rng])), _pack(counts[a:b])


def _request(order: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        first = last = (0, 0, 0)  # block, piece and part of the pieces held

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _batches(_REQUEST, _messages(held, *first, ranges))
            held.clear()
            give_back()

        for batch in batches:
            for row in range(batch.num_rows):
                block, piece, part, texts = (batch.column(c)[row].as_py() for c in ("block", "piece", "part", "texts"))
                if held and (block, piece) != (last[0], last[1] + 1):
                    yield from flush()
                last = (block, piece, part)
                first = first if held else last
                held.append(ngrams(texts, order)[0])
        if held:
            yield from flush()

    return run


def _answer(ranges: int):
    def run(g: pa.Table) -> pa.Table:
        level, rng = g["level"][0].as_py(), g["rng"][0].as_py()
        least = _bounds(level, ranges)[rng]
        keys = [np.cumsum(_unpack(k), dtype=U64) for k in g["keys"]]
        sizes = [len(k) for k in keys]
        distinct, inverse = np.unique(np.concatenate(keys) + least, return_inverse=True)
        del keys
        counts = np.concatenate([_unpack(c).astype(np.uint32) for c in g["counts"]])
        part = np.repeat(g["part"].to_numpy(), sizes)
        total = np.bincount(inverse, np.where(part == TEST, 0, counts), len(distinct)).astype(U64)
        rest = np.bincount(inverse, np.where(part == TRAIN, counts, 0), len(distinct)).astype(U64)
        del counts, part
        real = distinct != START if level == 1 else np.zeros(len(distinct), bool)
        sums = [float(total[real].sum(dtype=np.int64)), float((total[real] > 0).sum()), float(rest[real].sum(dtype=np.int64)), float((rest[real] > 0).sum())]

        def rows() -> Iterator[tuple]:
            at = 0
            for block, first, p, size in zip(*(g[c].to_pylist() for c in ("block", "run", "part")), sizes, strict=True):
                own = inverse[at : at + size]
                yield block, first, p, level, rng, _pack(total[own]), _pack(rest[own]) if p == DELETED else None, *(sums if at == 0 else [0.0] * 4)
                at += size

        answers = pa.Table.from_batches(list(_batches(_ANSWER, rows())))
        give_back()
        return answers

    return run


def _each(keys: np.ndarray, found: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The count of every n-gram; sorted ones are found several times faster."""
    order = np.argsort(grams)
    counts = np.empty(len(grams))
    counts[order] = found[np.searchsorted(keys, grams[order])]
    return counts


def _looked_up(docs: pa.Table, answers: pa.Table, order: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """For each piece of a block its row, the count of the k-gram at every place, from the answers to the block's requests, and each text's first place."""
    pieces = docs["piece"].to_numpy()
    by_piece = np.argsort(pieces)
    run, level, rng = (answers[c].to_numpy() for c in ("run", "level", "rng"))
    asked = np.unique(run)
    for a, rows in zip(asked, np.split(by_piece, np.searchsorted(pieces[by_piece], asked[1:])), strict=True):
        grams, firsts = zip(*(ngrams(docs["texts"][int(row)].as_py(), order) for row in rows), strict=True)
        keys, found = [], []
        for k in range(order):
            keys.append(np.unique(np.concatenate([g[k] for g in grams])))
            own = np.flatnonzero((run == a) & (level == k + 1))
            found.append(np.concatenate([_unpack(answers["counts"][int(i)]) for i in own[np.argsort(rng[own])]]))
            if len(found[k]) != len(keys[k]):
                raise RuntimeError(f"block has {len(keys[k])} {k + 1}-grams and {len(found[k])} answers")
        for row, own, first in zip(rows.tolist(), grams, firsts, strict=True):
            yield row, [_each(*x) for x in zip(keys, found, own, strict=True)], first
    give_back()


def _estimates(counts: list[np.ndarray], first: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens, maximum-likelihood estimates from the longest k-gram to the shortest, and context buckets."""
    token = np.ones(len(counts[0]), bool)
    token[first] = False
    at = np.flatnonzero(token)
    rows, seen = [], np.zeros(len(at), int)
    bucket = np.zeros(len(at), int)
    for k in range(len(counts), 0, -1):
        below = counts[k - 2][at - 1] if k > 1 else np.full(len(at), n)
        if k == len(counts):
            bucket = np.floor(np.log2(np.maximum(below, 1))).astype(int) + 1
        seen += below > 0  # a context that is seen has all its shorter ones seen
        rows.append(np.divide(counts[k - 1][at], below, out=np.zeros(len(at)), where=below > 0))
    return at, np.stack(rows), np.where(seen == len(counts), bucket, BUCKETS + seen)


def _histogram(order: int, n_rest: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        listed, ns = [], []
        for _, counts, first in _looked_up(docs, answers, order):
            _, p, bucket = _estimates(counts, first, n_rest)
            cells = np.where(p > 0, np.rint(-np.log2(np.where(p > 0, p, 1)) * CELLS), -1).astype(np.int32)
            cells, n = np.unique(np.vstack([bucket.astype(np.int32), cells]), axis=1, return_counts=True)
            listed.append(cells), ns.append(n)
        cells, at = np.unique(np.hstack(listed), axis=1, return_inverse=True)
        n = np.bincount(at.reshape(-1), np.concatenate(ns)).astype(np.int64)
        return pa.Table.from_batches([_batch(_CELLS, [list(cells.T), n])])

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, v: float) -> np.ndarray:
    """Weights per context bucket, by EM on counted cells (bucket, then -log2 estimates); rows sum to one.

    Buckets without a cell take the mixture of all, or the next lower bucket's
    weights; orders that are absent from a bucket weigh nothing there.
    """
    order = cells.shape[1] - 1
    present = np.ones((BUCKETS + order, order + 1), bool)
    for seen in range(order):
        present[BUCKETS + seen, : order - seen] = False
    p = np.where(cells[:, 1:] < 0, 0.0, np.exp2(-cells[:, 1:] / CELLS))
    p = np.hstack([p, np.full((len(p), 1), 1 / (v + 1))])
    weights = present / present.sum(1, keepdims=True)
    everyone = weights[0].copy()
    for _ in range(EM_ROUNDS):
        share = everyone * p
        everyone = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum() if len(n) else everyone
        share = weights[cells[:, 0]] * p
        share = share / share.sum(1, keepdims=True) * n[:, None]
        weights = np.stack([np.bincount(cells[:, 0], share[:, k], len(weights)) for k in range(order + 1)], 1).astype(float)
        weights += everyone  # one token's worth of the mixture of all buckets
        weights = np.maximum(weights, 1e-12) * present
        weights /= weights.sum(1, keepdims=True)
    known = cells[cells[:, 0] < BUCKETS, 0] if len(cells) else np.array([0])
    top = int(known.max(initial=0))
    weights[top + 1 : BUCKETS] = weights[top]
    return weights


def _score(order: int, n: float, v: float, weights: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        scored = []
        for row, counts, first in _looked_up(docs, answers, order):
            at, p, bucket = _estimates(counts, first, n)
            own = counts[0][at]
            chance = weights[bucket, order] / (v + 1)
            for k in range(order):
                chance = chance + weights[bucket, k] * p[k]
            begin = first - np.arange(len(first))  # the start places are left out of ``at``
            columns = [
                docs["ids"][row].as_py(),
                np.full(len(first), docs["part"][row].as_py() == TEST),
                np.diff(np.append(begin, len(at))),
                np.add.reduceat((own > 0).astype(np.int64), begin),
                np.full(len(first), int(n)),
                np.add.reduceat(np.log10((own + 0.5) / (n + 0.5 * (v + 1))), begin),
                np.add.reduceat(np.log10(chance), begin),
            ]
            scored.append(_batch(_SCORE, columns))
        return pa.Table.from_batches(scored)

    return run


@contextmanager
def _settings(spark: SparkSession, **values: int) -> Iterator[None]:
    """Jobs that run inside have these settings of ``spark.sql``, with ``__`` for a dot."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def interpolated_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Score whole texts under an interpolated ``order``-gram model of the corpus.

    ``docs(doc_id, text)``: documents whose crc32(doc_id as text) mod 5 is 1 are
    held out of all counts, and those with 0 are the deleted part for the weights.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (additive
    smoothing of single tokens) and score, both log10 of the whole text.

    Null text is empty: one end token.  A null doc_id counts as the empty string.
    Repeated rows are separate documents.  An empty table gives no rows; a corpus
    without training documents gives every token the uniform share.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "interpolation")
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, 1 << math.ceil(math.log2(max(1, order * size / RANGE_BYTES))))
    rest = F.expr("crc32(cast(coalesce(doc_id, '') as binary)) % 5")
    docs = docs.withColumn("part", F.when(rest == 1, TEST).when(rest == 0, DELETED).otherwise(TRAIN).cast("int"))
    # small input partitions are read together, so that blocks are full
    docs = docs.coalesce(max(LEAST_TASKS, math.ceil(size / (4 * BLOCK_BYTES))))
    with _settings(spark, execution__arrow__maxBytesPerBatch=SENT_BYTES):
        blocks = stage.put(docs.mapInArrow(_blocks, _BLOCK), "blocks")
    with _settings(spark, execution__arrow__maxBytesPerBatch=SENT_BYTES, parquet__columnarReaderBatchSize=READ_PIECES):
        scored = _scored(stage, blocks, order, ranges)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def _scored(stage: Stage, blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    requests = blocks.drop("ids").mapInArrow(_request(order, ranges), _REQUEST)
    answers = stage.put(requests.groupBy("level", "rng").applyInArrow(_answer(ranges), _ANSWER), "answers")
    n, v, n_rest, v_rest = (x or 0.0 for x in answers.agg(*(F.sum(c) for c in ("n", "v", "n_rest", "v_rest"))).first())

    def meet(blocks: DataFrame, answers: DataFrame, column: str):
        answers = answers.select("block", "run", "level", "rng", F.col(column).alias("counts"))
        return blocks.groupBy("block").cogroup(answers.groupBy("block"))

    deleted = meet(blocks.where(f"part = {DELETED}").drop("ids"), answers.where(f"part = {DELETED}"), "rest")
    cells = deleted.applyInArrow(_histogram(order, n_rest), _CELLS).groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    listed = np.stack(cells["cell"].to_numpy()).astype(int) if len(cells) else np.empty((0, order + 1), int)
    weights = learn_weights(listed, cells["n"].to_numpy(float), v_rest)
    scored = stage.put(meet(blocks, answers, "counts").applyInArrow(_score(order, n, v, weights), _SCORE), "scores")
    stage.drop(blocks, answers)
    return scored
