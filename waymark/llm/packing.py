"""Best-fit packing of whole documents into sequences, certified by dual-feasible bounds.

Documents are dealt into partitions by hash and packed by best-fit decreasing.
Dual-feasible functions of the lengths give each partition a lower bound of its
number of sequences.  Partitions with a gap, and the emptiest sequences of all,
exchange documents: these are pooled, dealt into fewer partitions and packed
again, with wider pools until the bound of all lengths is met or a pool of all
sequences that aren't full saves none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import byte_slices
from waymark.llm.tokens import encoder
from waymark.plans.staging import Stage

#: Pieces per partition (one task's memory) and the least number of partitions.
PARTITION_ROWS, LEAST_PARTITIONS = 100_000, 24
#: Each round of exchange pools this many times as many sequences as the one before.
WIDER = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# ids travel as text through pandas, which would round large ones beside a null
_PACKED = _PIECES.replace("doc_id long", "doc_id string") + ", turn int, part int, bin int, offset long, fill long, open boolean"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at, to in byte_slices(batch.column(1)):
                rows = batch.slice(at, to - at)
                ids, offsets = encode(rows.column(1).to_pylist())
                raw, bounds = ids.tobytes(), offsets.tolist()
                out = []
                for doc_id, a, b in zip(rows.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                    own = raw[4 * a : 4 * b] + b"\0\0\0\0"
                    n = b - a + 1
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out.append((doc_id, k, x, y - x, zlib.crc32(own[4 * x : 4 * y])))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, for lengths in falling order: the fullest bin in which it fits."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has room r
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def dual_feasible_bound(lengths: np.ndarray, capacity: int) -> float:
    """The largest total of three families of dual-feasible functions; its ceiling bounds the number of bins."""
    x, n = np.unique(lengths, return_counts=True)
    return _bound_of_counts(x, n, capacity)


def _bound_of_counts(x: np.ndarray, n: np.ndarray, capacity: int) -> float:
    best = float((x * n).sum()) / capacity
    for cut in x[x <= capacity // 2].tolist():
        # small items vanish, items that leave less than a small one count whole
        best = max(best, float((np.where(x > capacity - cut, capacity, np.where(x >= cut, x, 0)) * n).sum()) / capacity)
        # small items vanish, large ones count by how few of the cut still fit beside them
        whole = capacity // cut
        value = np.where(2 * x > capacity, whole - (capacity - x) // cut, np.where(x >= cut, 1, 0))
        best = max(best, float((value * n).sum()) / whole)
    for k in range(1, 21):  # rounding to parts of k + 1
        scaled = (k + 1) * x
        best = max(best, float((np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity) * n).sum()) / (capacity * k))
    return best


def _pack(capacity: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
        lengths = g["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(g), np.int64)
        offset[order] = total - lengths[order] - np.repeat(total[first] - lengths[order][first], np.diff(np.append(first, len(g))))
        fill = np.bincount(bins, lengths).astype(np.int64)
        gap = len(fill) - math.ceil(dual_feasible_bound(lengths, capacity) - 1e-9)
        is_open = np.zeros(len(fill), bool)
        is_open[np.lexsort((np.arange(len(fill)), fill))[: 8 * gap]] = True
        return g.assign(bin=bins, offset=offset, fill=fill[bins], open=is_open[bins])[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its sequence and place there.

    A document is its ids under the tokenizer file, then id 0.  Longer ones are
    cut into pieces of ``capacity`` ids of which the first may be shorter.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, and
    beside them the certificate: n_sequences, and least_sequences, the lower bound
    that dual-feasible functions of all lengths prove for any packing.

    Null and empty texts are the one id 0.  Repeated rows and null doc_ids are
    separate documents.  An empty table gives no rows; other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage.put(docs.mapInArrow(_pieces(tokenizer, capacity), _PIECES), "pieces")

    def packed(rows: DataFrame, parts: int, turn: int) -> DataFrame:
        rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), *pieces.columns[1:]).withColumn("turn", F.lit(turn))
        # dealt by place in the written table, so that rows that repeat are spread too
        rows = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)).cast("int"))
        return stage.put(rows.groupBy("part").applyInPandas(_pack(capacity), _PACKED), "packed")

    lengths = pieces.groupBy("length").count().toPandas()  # at most ``capacity`` rows
    state = packed(pieces, max(LEAST_PARTITIONS, math.ceil(lengths["count"].sum() / PARTITION_ROWS)), 0)
    bound = _bound_of_counts(lengths["length"].to_numpy(int), lengths["count"].to_numpy(float), capacity)
    least, turn, made, tried = math.ceil(bound - 1e-9), 0, 0, 0
    while True:  # pools widen to all sequences that aren't full; then the first one that saves none is the last
        turn += 1
        fills = state.groupBy("turn", "part", "bin").agg(F.max("fill").alias("fill"), F.max("open").alias("open"))
        by_fill = fills.groupBy("fill").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("int")).alias("n_open")).toPandas().sort_values("fill")
        made = int(by_fill["n"].sum())  # at most ``capacity`` rows again
        excess = made - least
        if excess <= 0:
            break
        partly = by_fill[by_fill["fill"] < capacity]
        total = partly["n"].cumsum()
        enough = partly[total >= WIDER**turn * 2 * excess]
        fewer = partly[total <= WIDER**turn * 2 * excess]
        if not len(enough):
            level = capacity - 1
        elif len(fewer) and int(fewer["fill"].iat[-1]) > tried:  # not yet the many of one fill that come next
            level = int(fewer["fill"].iat[-1])
        else:
            level = int(enough["fill"].iat[0])
        tried = level
        chosen = f"fill < {capacity} and (open or fill <= {level})"
        pool = state.where(chosen)
        again = packed(pool, max(1, math.ceil(pool.count() / PARTITION_ROWS)), turn)
        if again.select("part", "bin").distinct().count() < fills.where(chosen).count():
            state = state.where(f"not ({chosen})").unionByName(again)  # only what was pooled is written
            tried = 0
        elif not len(enough):
            break
    sequence = F.expr("shiftleft(cast(turn as bigint), 56) + shiftleft(cast(part as bigint), 28) + bin")
    certificate = [F.lit(made).cast("long").alias("n_sequences"), F.lit(least).cast("long").alias("least_sequences")]
    return state.select(F.col("doc_id").cast("long").alias("doc_id"), *pieces.columns[1:], sequence.alias("sequence_id"), "offset", *certificate)
