"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors of one dimension are centred and projected on their leading axes; then
rotations that balance the signs are learned on a bounded sample of distinct
vectors.  The signs are a binary code of fixed length, cut into substrings, each
an index table.  The number and the width of the tables follow from the
threshold and the number of vectors, so that a pair at the threshold is missed
in all tables with probability ``MISS`` at most if bits are independent.

Codes go first: members of a bucket (vectors of one label that agree on a
substring) compare codes in blocks of bounded size.  Only vectors with a close
code in a block are then fetched and reranked by cosine.  Equal vectors are one
class.  A pair is counted in the first table in which it meets, and blocks
return counts and spanning links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.graph import block_pairs, by_group, components
from waymark.llm.text import U64, mix
from waymark.plans.staging import Stage

#: Bound of the training sample, and alternations of a rotation's fit.
SAMPLE, ROUNDS = 5000, 40
#: Axes that are rotated at most (vectors of more dimensions are projected on these), and bits of a code at least.
AXES, BITS = 128, 128
#: Share of pairs at the threshold that all tables together may miss, and vectors of one label that a bucket should hold.
MISS, BUCKET = 0.01, 256
#: Members of a block, and rows of it that are compared at once (a worker's memory).
BLOCK, ROWS = 2048, 256


class Code:
    """Projection and rotations of one dimension, and the tables that the code is cut into."""

    def __init__(self, x: np.ndarray, least: float, n: int):
        dims = x.shape[1]
        self.width = max(4, math.ceil(math.log2(max(n, 1))) - int(math.log2(BUCKET)))
        same = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi  # chance that a bit of a pair at the threshold agrees
        self.tables = max(1, math.ceil(math.log(MISS) / math.log1p(-min(same**self.width, 1 - MISS))))
        self.bits_made = bits = max(BITS, self.width * self.tables)
        self.far = bits * (1 - same) + 6 * math.sqrt(bits * same * (1 - same)) + 1  # bits in which such a pair differs at most
        self.mean = x.mean(0) if len(x) > 1 else np.zeros(dims)
        centred = x - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : min(dims, AXES)]
        spread = centred @ axes
        turns = [learn_rotation(spread, seed) for seed in range(-(-bits // axes.shape[1]))]
        self.turn = (axes @ np.hstack(turns))[:, :bits]

    def bits(self, x: np.ndarray) -> np.ndarray:
        """The code bits of vectors."""
        return (x - self.mean) @ self.turn >= 0

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """One number per vector and table."""
        return bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))


def learn_rotation(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Alternate between signs and the nearest rotation to them, from a random rotation."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))
    for _ in range(ROUNDS if len(x) > x.shape[1] else 0):  # fewer vectors than axes say nothing of a rotation
        u, _, v = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
        turn = (u @ v).T
    return turn


def unit(raw: bytes, dims: int) -> np.ndarray:
    """A stored vector (single precision where that is exact) in double precision at length one."""
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dims else np.float64).astype(np.float64)
    x = x / np.abs(x).max()  # before the norm, which could overflow
    return x / np.linalg.norm(x)


_USABLE = "vec_id long, label string, dims int, raw binary, hi long, lo long"
_CODED = "class long, rep long, label string, n long, dims int, code binary"
_CLOSE = "bucket long, bi int, bj int, table int, _b int, class long, rep long, n long, dims int, code binary"
_LINKS = "class long, rep long, n_links long, root long"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold a usable vector, its bytes and their hash."""
    for batch in batches:
        rows, raws, dims = [], [], []
        for i, v in enumerate(batch.column("embedding").to_pylist()):
            if v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    with np.errstate(over="ignore", under="ignore"):
                        short = x.astype(np.float32)
                    rows.append(i), raws.append((short if (short == x).all() else x).tobytes()), dims.append(len(x))
        kept = batch.take(pa.array(rows, pa.int64()))
        hashes = [[int(np.add.reduce(mix(np.frombuffer(r, np.uint32).astype(U64) ^ (mix(np.arange(len(r) // 4, dtype=U64)) + U64(seed)))).view(np.int64)) for r in raws] for seed in (3, 11)]
        columns = [kept.column("vec_id"), kept.column("label"), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), *(pa.array(h, pa.int64()) for h in hashes)]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dims", "raw", "hi", "lo"])


def _code(fitted: dict[int, Code]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for raw, d in zip(batch.column("raw").to_pylist(), batch.column("dims").to_pylist(), strict=True):
                codes.append(np.packbits(fitted[d].bits(unit(raw, d)[None])).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "rep", "label", "n", "dims")), pa.array(codes, pa.binary())], ["class", "rep", "label", "n", "dims", "code"])

    return run


def _entries(fitted: dict[int, Code]):
    """An entry of every vector in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs: list = []
            for raw, d in zip(batch.column("code").to_pylist(), batch.column("dims").to_pylist(), strict=True):
                code = fitted[d]
                subs.append(code.substrings(np.unpackbits(np.frombuffer(raw, np.uint8))[None])[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(subs, pa.list_(pa.int64()))], [*batch.schema.names, "subs"])

    return run


class _Block:
    """A block or a pair of blocks of one bucket: its two sides and what their codes say."""

    def __init__(self, g: pd.DataFrame, code: Code):
        self.table = int(g["table"].iat[0])
        packed = np.stack([np.frombuffer(c, np.uint8) for c in g["code"]])
        self.bits = np.unpackbits(packed, axis=1)[:, : code.bits_made]
        self.subs = code.substrings(self.bits)
        b = g["_b"].to_numpy()
        self.left = np.flatnonzero(b == g["bi"].iat[0])
        self.inner = g["bi"].iat[0] == g["bj"].iat[0]
        self.right = self.left if self.inner else np.flatnonzero(b == g["bj"].iat[0])

    def near(self, test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (rows of the group) that ``test(left rows, right rows)`` finds and that meet in this table first."""
        for at in range(0, len(self.left), ROWS):
            own = self.left[at : at + ROWS]
            i, j = np.nonzero(test(own, self.right))
            i, j = own[i], self.right[j]
            if self.inner:
                i, j = i[i < j], j[i < j]
            first = np.ones(len(i), bool)
            for t in range(self.table):
                first &= self.subs[i, t] != self.subs[j, t]
            yield i[first], j[first]


def _close(fitted: dict[int, Code]):
    """The members of a block that have a close code in it."""

    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        code = fitted[int(g["dims"].iat[0])]
        block = _Block(g, code)
        bits = block.bits.astype(np.float32)
        ones = bits.sum(1)
        found = np.zeros(len(g), bool)
        for i, j in block.near(lambda a, b: ones[a][:, None] + ones[b] - 2 * (bits[a] @ bits[b].T) <= code.far):
            found[i] = found[j] = True
        return g[found]

    return lambda frames: by_group(frames, ["bucket", "bi", "bj"], work)


def _rerank(fitted: dict[int, Code], least: float):
    """Links of the members of a block by cosine: their numbers, and the least member that each reaches there."""

    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        dims = int(g["dims"].iat[0])
        block = _Block(g, fitted[dims])
        x = np.stack([unit(r, dims) for r in g["raw"]])
        rep, n = g["rep"].to_numpy(), g["n"].to_numpy()
        by_rep = np.argsort(rep, kind="stable")
        rank = np.argsort(by_rep)
        links, root = np.zeros(len(g), np.int64), np.arange(len(g))  # root[k]: a rank that rank k reaches
        for i, j in block.near(lambda a, b: x[a] @ x[b].T >= least):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            i, j = rank[i], rank[j]
            while True:  # hook the higher root of each pair below the lower one
                ri, rj = root[i], root[j]
                if (ri == rj).all():
                    break
                np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
                while (root[root] != root).any():
                    root = root[root]
        own = np.flatnonzero(links)
        return pd.DataFrame({"class": g["class"].to_numpy()[own], "rep": rep[own], "n_links": links[own], "root": rep[by_rep[root[rank[own]]]]})

    return lambda frames: by_group(frames, ["bucket", "bi", "bj"], work)


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors(vec_id, embedding, label)``.

    Linked are found pairs of one non-null label with cosine ``least`` or more in
    double precision.  Vectors that are null, empty, zero or hold a null or
    non-finite component, those without a label, and those of different
    dimensions link with nothing.  Rows without vec_id get no component and are
    kept.  Rows that repeat a vec_id are separate vectors with one identity: its
    links are those of its rows together.  An empty table gives no rows; other
    columns are ignored.
    """
    stage = Stage(vectors.sparkSession, "vectors")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = vectors.where("vec_id is not null and label is not null").mapInArrow(_usable, _USABLE)
    key = ["label", "dims", "hi", "lo"]
    classes = stage.put(usable.groupBy(*key, "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    # rows of classes of more than one vector; the others stand for themselves
    copies = stage.put(usable.select("vec_id", *key).join(classes.where("n > 1").select(*key, "class", "rep", "n"), key).select("vec_id", "class", "rep", "n"), "copies")

    sample = classes.select("dims", "raw", F.xxhash64("hi", F.lit(9)).alias("h")).orderBy("h").limit(SAMPLE).collect()
    sizes = classes.groupBy("label", "dims").count().groupBy("dims").agg(F.max("count").alias("most")).collect()
    fitted = {}
    for d, most in sizes:
        own = [unit(r["raw"], d) for r in sample if r["dims"] == d]
        fitted[d] = Code(np.stack(own) if own else np.zeros((1, d)), least, most)

    coded = stage.put(classes.select("class", "rep", "label", "n", "dims", "raw").mapInArrow(_code(fitted), _CODED), "codes")
    entries = coded.mapInArrow(_entries(fitted), _CODED + ", subs array<long>")
    entries = entries.select("class", "rep", "n", "dims", "code", "label", F.posexplode("subs").alias("table", "sub"))
    entries = entries.select("class", "rep", "n", "dims", "code", "table", F.xxhash64("label", "dims", "table", "sub").alias("bucket"))
    dealt = block_pairs(entries, "bucket", "class", BLOCK).repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    close = stage.put(dealt.select(*(c.split()[0] for c in _CLOSE.split(", "))).mapInPandas(_close(fitted), _CLOSE), "close")
    full = close.join(classes.select("class", "raw"), "class")
    full = full.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    found = stage.put(full.mapInPandas(_rerank(fitted, least), _LINKS), "found")

    per_class = found.groupBy("class").agg(F.sum("n_links").alias("m"))
    edges = found.selectExpr("rep a", "root b").unionByName(copies.where("vec_id <> rep").selectExpr("vec_id a", "rep b"))
    roots = components(edges.distinct(), stage)
    # a row of a class of n vectors has its n - 1 copies and all vectors of the classes linked with it
    several = copies.join(per_class, "class", "left").select("vec_id", F.expr("n - 1 + coalesce(m, 0)").alias("k"))
    single = classes.where("n = 1").join(per_class, "class").select(F.col("rep").alias("vec_id"), F.col("m").alias("k"))
    degree = several.unionByName(single).groupBy("vec_id").agg(F.sum("k").alias("n_links"))
    out = vectors.select("vec_id").join(degree, "vec_id", "left").join(roots.selectExpr("node vec_id", "root"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
