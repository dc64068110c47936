"""Hard negatives of anchor vectors by dual-tree search over exact integer inner products.

Vectors become integers ``floor(scale * x)``.  Candidates are ordered by label
and by a code (signs along principal axes of a bounded sample), dealt into parts
by range, and cut into leaves of one label; anchors likewise into groups.  Every
node knows its centre, radius and greatest length over all its rows, so a pair of
nodes has an interval that holds the inner product of every pair of their rows.

A search goes down both trees at once.  Above the parts the frontier of node
pairs is a DataFrame that an equi-join on the parent takes a level down; below,
a part's task holds its leaves, streams the groups sent to it, and halves both
nodes of a pair until leaves meet, which are scored exactly.  A pair goes as a
whole when no anchor of its group can gain by it.  The most promising parts of
each group come first, so that the others meet bounds that are already tight.

Two searches are run: the best rows of the anchor's own label (positives), then
for each positive the best rows of other labels inside its score window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.graph import by_group
from waymark.plans.staging import Stage

#: Rows of a candidate leaf, anchors of a leaf and of a group.
LEAF, FINE, GROUP = 512, 32, 1024
#: Bytes of a part's candidates that a task holds, and rows of a part at least.
PART_BYTES, PART_ROWS = 64 << 20, 4096
#: Bound of the sample that the order of rows is fitted on, and bits of the code.  Bounds of nodes use all rows.
SAMPLE, BITS = 20_000, 24
#: Children of a node above the parts; parts that a group meets first: one, and one of so many.
FAN, FIRST = 16, 16

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ROW = "vec_id long, label string, dims int, vec binary"
_NODE = "dims int, node long, n long, centre array<double>, radius double, norm double, lo string, hi string"
_LEAVES = f"{_NODE}, labels array<string>, ids binary, vecs binary"
_STATE = "node long, state binary, least long, most long"
_ENTRY = np.dtype([("row", "<i4"), ("window", "<i4"), ("score", "<i8"), ("id", "<i8")])


def _quantised(scale: float):
    """Rows with a usable vector as integers of two or eight bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(values * scale)
            rows, dims, raw = [], [], []
            for i, usable in enumerate(column.is_valid().to_pylist()):
                v = whole[offsets[i] : offsets[i + 1]]
                if usable and len(v) and np.isfinite(v).all() and (v @ v) < 2.0**62:
                    rows.append(i), dims.append(len(v))
                    raw.append(v.astype(np.int16 if np.abs(v).max() < 2**15 else np.int64).tobytes())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "dims", "vec"])

    return run


def _integers(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dims else np.int64).reshape(n, dims)


def _packed(vectors: list[np.ndarray]) -> bytes:
    return np.stack(vectors).tobytes() if len({v.dtype for v in vectors}) == 1 else np.stack([v.astype(np.int64) for v in vectors]).tobytes()


def inner(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products of integer rows; ``norms`` is the product of their greatest lengths, which bounds partial sums."""
    kind = np.float32 if norms < 2**24 else np.float64 if norms < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _order(fitted: dict[int, tuple]):
    """The code of each row: its side of the median along each axis, the widest axis first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            raw = batch.column("vec").to_pylist()
            code = np.zeros(len(raw), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                axes, medians = fitted.get(d, (np.zeros((d, 1)), np.zeros(1)))
                x = np.stack([_integers(raw[i], 1, d)[0].astype(np.float64) for i in at])
                code[at] = (x @ axes > medians) @ (1 << np.arange(len(medians), dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    return run


def _axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centred = x - x.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    return axes, np.median(x @ axes, axis=0)


def _bound(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    x = x.astype(np.float64)
    centre = x.mean(0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max())), float(np.sqrt((x**2).sum(1).max()))


def _cut(most: int, pure: bool):
    """Leaves of the rows of a range, in order: of one dimension, of one label if ``pure``, of ``most`` rows at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def leaf() -> dict:
            nonlocal made
            made += 1
            d = held[0][2]
            vectors = [_integers(v, 1, d)[0] for _, _, _, v in held]
            centre, radius, norm = _bound(np.stack(vectors))
            labels = [r[1] for r in held]
            ids = np.array([r[0] for r in held], np.int64).tobytes()
            number = shard if pure else (shard << 32) + made
            return {"dims": d, "node": number, "n": len(held), "centre": centre, "radius": radius, "norm": norm, "lo": min(labels), "hi": max(labels), "labels": labels[:1] if pure else labels, "ids": ids, "vecs": _packed(vectors)}

        for frame in frames:
            out = []
            for row in zip(*(frame[c] for c in ("vec_id", "label", "dims", "vec")), strict=True):
                if held and (len(held) >= most or row[2] != held[-1][2] or pure and row[1] != held[-1][1]):
                    out.append(leaf())
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out)
        if held:
            yield pd.DataFrame([leaf()])

    return run


def _merged(g: pd.DataFrame) -> pd.DataFrame:
    """One node that holds all nodes of the group."""
    n, centres = g["n"].to_numpy(), np.stack(g["centre"])
    centre = np.average(centres, axis=0, weights=n)
    radius = (np.sqrt(((centres - centre) ** 2).sum(1)) + g["radius"].to_numpy()).max()
    return pd.DataFrame([{"dims": g["dims"].iat[0], "node": g["up"].iat[0], "n": n.sum(), "centre": centre, "radius": radius, "norm": g["norm"].max(), "lo": g["lo"].min(), "hi": g["hi"].max()}])


def _parents(nodes: DataFrame, up: str) -> DataFrame:
    return nodes.selectExpr("dims", f"{up} up", "n", "centre", "radius", "norm", "lo", "hi").groupBy("dims", "up").applyInPandas(_merged, _NODE)


class Tree:
    """A binary tree over leaves in order, each level a set of arrays."""

    def __init__(self, centre: np.ndarray, radius: np.ndarray, norm: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.levels = [(centre, radius, norm, lo, hi)]
        while len(centre) > 1:
            if len(centre) % 2:
                centre, radius, norm, lo, hi = (np.concatenate([a, a[-1:]]) for a in (centre, radius, norm, lo, hi))
            mid = (centre[::2] + centre[1::2]) / 2
            reach = np.sqrt(((centre[::2] - centre[1::2]) ** 2).sum(1)) / 2
            radius = np.maximum(radius[::2], radius[1::2]) + reach
            centre, norm, lo, hi = mid, np.maximum(norm[::2], norm[1::2]), np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            self.levels.append((centre, radius, norm, lo, hi))


def leaf_pairs(a: Tree, c: Tree, least: np.ndarray, most: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an anchor leaf and a candidate leaf that may hold a score in the anchor leaf's ``[least, most]``.

    Both nodes of a pair are halved until their leaves are reached; ``same`` asks
    for equal labels, else for different ones.
    """
    bounds = [(least, most)]
    while len(bounds) < len(a.levels):
        low, high = bounds[-1]
        if len(low) % 2:
            low, high = np.append(low, low[-1]), np.append(high, high[-1])
        bounds.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    at, ct = len(a.levels) - 1, len(c.levels) - 1
    while True:
        (ac, ar, an, alo, ahi), (cc, cr, cn, clo, chi) = a.levels[at], c.levels[ct]
        low, high = bounds[at]
        cap = an[i] * cn[j]
        middle = (ac @ cc.T)[i, j] if len(i) * 4 > len(ac) * len(cc) else (ac[i] * cc[j]).sum(1)
        spread = np.sqrt((ac**2).sum(1))[i] * cr[j] + ar[i] * (np.sqrt((cc**2).sum(1))[j] + cr[j]) + 1e-9 * cap
        keep = (np.minimum(middle + spread, cap) >= low[i]) & (np.maximum(middle - spread, -cap) <= high[i])
        keep &= (alo[i] <= chi[j]) & (clo[j] <= ahi[i]) if same else ~((alo[i] == ahi[i]) & (clo[j] == chi[j]) & (alo[i] == clo[j]))
        i, j = i[keep], j[keep]
        if at == 0 and ct == 0 or not len(i):
            return i, j
        if at:
            at, n = at - 1, len(a.levels[at - 1][0])
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
            i, j = i[i < n], j[i < n]
        if ct:
            ct, n = ct - 1, len(c.levels[ct - 1][0])
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
            i, j = i[j < n], j[j < n]


class State:
    """Best rows of each anchor and window: scores and ids in order, and the window's ends."""

    def __init__(self, n: int, windows: int, keep: int):
        self.score, self.id = np.full((n, windows, keep), _LOW), np.full((n, windows, keep), _HIGH)
        self.low, self.high = np.full((n, windows), _LOW), np.full((n, windows), _HIGH)

    def pack(self) -> bytes:
        return np.array([*self.score.shape], np.int64).tobytes() + b"".join(x.tobytes() for x in (self.score, self.id, self.low, self.high))

    @classmethod
    def unpack(cls, raw: bytes) -> State:
        shape = tuple(np.frombuffer(raw, np.int64, 3))
        self, at = cls(*shape), 24
        for name in ("score", "id", "low", "high"):
            own = getattr(self, name)
            setattr(self, name, np.frombuffer(raw, np.int64, own.size, at).reshape(own.shape).copy())
            at += own.nbytes
        return self

    def need(self) -> np.ndarray:
        """Least score that can still change a window; an empty window needs more than any."""
        return np.where(self.low <= self.high, np.maximum(self.low, self.score[:, :, -1]), _HIGH)

    def add(self, row: np.ndarray, window: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Take entries in: the best scores of a window stay, ties by smaller id."""
        if not len(row):
            return
        n, w, k = self.score.shape
        key = row.astype(np.int64) * w + window
        touched = np.unique(key)
        r, v = np.divmod(touched, w)
        key = np.concatenate([key, np.repeat(touched, k)])
        score, ident = np.concatenate([score, self.score[r, v].ravel()]), np.concatenate([ident, self.id[r, v].ravel()])
        order = np.lexsort((ident, ~score, key))  # ~x orders integers downwards without overflow
        key, score, ident = key[order], score[order], ident[order]
        start = np.searchsorted(key, touched)[:, None] + np.arange(k)
        self.score[r, v], self.id[r, v] = score[start], ident[start]

    def row(self, node: int) -> dict:
        need = self.need()
        return {"node": node, "state": self.pack(), "least": int(need.min()), "most": int(np.where(self.low <= self.high, self.high, _LOW).max())}


class _Part:
    """The candidate leaves of a part and of one dimension."""

    def __init__(self, leaves: list):
        self.dims = leaves[0].dims
        self.names, place = np.unique([r.labels[0] for r in leaves], return_inverse=True)
        self.label = 2 * place  # labels as numbers in their order; odd ones are for labels that no leaf has
        self.ids = [np.frombuffer(r.ids, np.int64) for r in leaves]
        self.vecs = [_integers(r.vecs, len(i), self.dims) for r, i in zip(leaves, self.ids, strict=True)]
        self.norm = np.array([r.norm for r in leaves])
        self.tree = Tree(np.stack([r.centre for r in leaves]), np.array([r.radius for r in leaves]), self.norm, self.label, self.label)

    def search(self, g, same: bool) -> np.ndarray:
        """Entries that may enter the state of group ``g``."""
        known = State.unpack(g.state)
        ids, given = np.frombuffer(g.ids, np.int64), np.array(list(g.labels))
        place = np.searchsorted(self.names, given)
        labels = 2 * place - (self.names[np.minimum(place, len(self.names) - 1)] != given)
        vecs = _integers(g.vecs, len(ids), self.dims)
        n, windows, keep = known.score.shape
        local = State(n, windows, keep)
        local.low, local.high = known.need(), known.high
        cuts = range(0, n, FINE)
        made = [_bound(vecs[s : s + FINE]) for s in cuts]
        lo, hi = np.minimum.reduceat(labels, cuts), np.maximum.reduceat(labels, cuts)
        tree = Tree(np.stack([m[0] for m in made]), np.array([m[1] for m in made]), np.array([m[2] for m in made]), lo, hi)
        open_ = local.low <= local.high
        least, most = np.where(open_, local.low, _HIGH).min(1), np.where(open_, local.high, _LOW).max(1)
        i, j = leaf_pairs(tree, self.tree, np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), same)
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        met, first = np.unique(j, return_index=True)
        for leaf, mine in zip(met, np.split(i, first[1:]), strict=False):
            rows = (mine[:, None] * FINE + np.arange(FINE)).ravel()
            rows = rows[rows < n]
            rows = rows[(labels[rows] == self.label[leaf]) == same]
            rows = rows[least[rows] <= most[rows]]
            if not len(rows):
                continue
            score = inner(vecs[rows], self.vecs[leaf], float(self.norm[leaf] * g.norm))
            low, high = least[rows], most[rows]
            if score.dtype != np.int64:  # past the greatest exact value a bound holds for all or none
                low, high = (np.clip(x, -(2**53), 2**53).astype(score.dtype) for x in (low, high))
            r, c = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
            score, r, ident = score[r, c].astype(np.int64), rows[r], self.ids[leaf][c]
            if same:
                other = ident != ids[r]
                score, r, ident = score[other], r[other], ident[other]
            need = local.need()
            for w in range(windows):
                fits = (score >= need[r, w]) & (score <= local.high[r, w])
                local.add(r[fits], np.full(fits.sum(), w), score[fits], ident[fits])
            least = np.where(open_, local.need(), _HIGH).min(1)
        row, window, place = np.nonzero(local.score > _LOW)
        out = np.empty(len(row), _ENTRY)
        out["row"], out["window"], out["score"], out["id"] = row, window, local.score[row, window, place], local.id[row, window, place]
        return out


def _search(same: bool):
    """Streams parts: their leaves first, then the groups that were sent to each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaves, part = None, [], None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if at != (r.part, r.dims):
                    at, leaves, part = (r.part, r.dims), [], None
                if r.kind == 0:
                    leaves.append(r)
                    continue
                if part is None:
                    part, leaves = _Part(leaves), []
                found = part.search(r, same)
                if len(found):
                    out.append({"node": r.node, "entries": found.tobytes()})
            if out:
                yield pd.DataFrame(out)

    return run


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's state with the entries found for it."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        state = State.unpack(g["state"].dropna().iat[0])
        for raw in g["entries"].dropna():
            e = np.frombuffer(raw, _ENTRY)
            state.add(e["row"], e["window"], e["score"], e["id"])
        return pd.DataFrame([state.row(int(g["node"].iat[0]))])

    return by_group(frames, ["node"], work)


def _interval(left: str, right: str) -> tuple[str, str]:
    """SQL of the ends of the interval that holds all inner products of two nodes' rows."""
    dot = "aggregate(zip_with({0}.centre, {1}.centre, (x, y) -> x * y), 0e0, (s, x) -> s + x)"
    spread = f"(sqrt({dot.format(left, left)}) * {right}.radius + {left}.radius * (sqrt({dot.format(right, right)}) + {right}.radius) + 1e-9 * {left}.norm * {right}.norm)"
    cap = f"{left}.norm * {right}.norm"
    return f"greatest({dot.format(left, right)} - {spread}, -({cap}))", f"least({dot.format(left, right)} + {spread}, {cap})"


class _Searcher:
    def __init__(self, stage: Stage, leaves: DataFrame, groups: DataFrame, shards: int):
        self.stage, self.leaves, self.groups, self.shards = stage, leaves, groups, shards
        self.levels = [stage.put(_parents(leaves, "node"), "parts")]
        size = shards
        while size > FAN:
            size = -(-size // FAN)
            self.levels.append(stage.put(_parents(self.levels[-1], f"node div {FAN}"), "nodes"))

    def pairs(self, state: DataFrame, same: bool) -> DataFrame:
        """Pairs of a group and a part whose interval meets the group's bounds, the most promising first."""
        low, high = _interval("g", "c")
        label = "g.lo <= c.hi and c.lo <= g.hi" if same else "not (g.lo = g.hi and c.lo = c.hi and g.lo = c.lo)"
        bounded = self.groups.select("dims", "node", "centre", "radius", "norm", "lo", "hi").join(state.select("node", "least", "most"), "node")
        frontier = None
        for level in reversed(self.levels):
            if frontier is None:  # the top level has FAN nodes at most for each dimension
                met = bounded.alias("g").join(level.alias("c"), F.expr("g.dims = c.dims"))
            else:
                met = bounded.alias("g").join(frontier.alias("p"), F.expr("g.node = p.grp")).join(level.alias("c"), F.expr(f"c.dims = g.dims and c.node div {FAN} = p.child"))
            met = met.where(label).selectExpr("g.node grp", "c.node child", f"{low} low", f"{high} high", "g.least least", "g.most most")
            frontier = met.where("high >= least and low <= most").select("grp", "child", "low", "high")
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("high"), "child"))
        return frontier.withColumn("rank", rank)

    def run(self, state: DataFrame, same: bool) -> DataFrame:
        """``state`` after every pair of a group and a part was searched or ruled out."""
        pairs = self.stage.put(self.pairs(state, same), "pairs")
        first = 1 + self.shards // FIRST
        for some in (f"rank <= {first}", f"rank > {first}"):
            now = state.withColumnRenamed("node", "grp")
            todo = pairs.where(some).join(now, "grp").where("high >= least and low <= most").select("grp", F.col("child").alias("part"), "state")
            columns = ["part", "kind", "node", "dims", "labels", "ids", "vecs", "centre", "radius", "norm", "state"]
            sent = todo.join(self.groups.withColumnRenamed("node", "grp"), "grp").withColumnRenamed("grp", "node").withColumn("kind", F.lit(1)).select(columns)
            own = self.leaves.withColumn("part", F.col("node")).withColumn("kind", F.lit(0)).withColumn("state", F.lit(None).cast("binary")).select(columns)
            dealt = own.unionByName(sent).repartition(self.shards, "part").sortWithinPartitions("part", "dims", "kind", "node")
            found = dealt.mapInPandas(_search(same), "node long, entries binary")
            both = state.selectExpr("node", "state", "cast(null as binary) entries").unionByName(found.selectExpr("node", "cast(null as binary) state", "entries"))
            state = self.stage.put(both.repartition("node").sortWithinPartitions("node").mapInPandas(_fold, _STATE), "state")
        return state


def _start(positives: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([State(int(n), 1, positives).row(int(node)) for node, n in zip(frame["node"], frame["n"], strict=True)], columns=["node", "state", "least", "most"])

    return run


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of a score, rounded up or down, without overflow."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + (-(-rest * percent // 100) if up else rest * percent // 100)


def _windows(negatives: int, low: int, high: int):
    """A window for each positive that was found."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, raw in zip(frame["node"], frame["state"], strict=True):
                found = State.unpack(raw).score[:, 0]
                made = State(len(found), found.shape[1], negatives)
                there = found > _LOW
                made.low, made.high = np.where(there, share(found, low, True), 1), np.where(there, share(found, high, False), 0)
                out.append(made.row(int(node)))
            yield pd.DataFrame(out, columns=["node", "state", "least", "most"])

    return run


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for ids, raw_p, raw_n in zip(frame["ids"], frame["positives"], frame["negatives"], strict=True):
            anchor, p, n = np.frombuffer(ids, np.int64), State.unpack(raw_p), State.unpack(raw_n)
            row, window, place = np.nonzero(n.score > _LOW)
            yield pd.DataFrame({"anchor_id": anchor[row], "positive_id": p.id[row, 0, window], "rank": (place + 1).astype(np.int32), "negative_id": n.id[row, window, place], "positive_score": p.score[row, 0, window], "negative_score": n.score[row, window, place]})


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors(vec_id, label, embedding)``.

    Anchors are rows whose vec_id is divisible by ``every``.  Scores are inner
    products of ``floor(scale * x)``, exact; higher ones come first, ties by
    smaller vec_id.  An anchor's positives are its best rows of the same label
    and another vec_id; a positive's negatives are the best rows of another label
    whose score is ``low`` to ``high`` percent of the positive's.  A positive
    without a negative gives no row.

    Rows without vec_id, label or vector, with an empty one, with a null or
    non-finite component, or whose integers' squares sum to 2**62 or more, take
    no part.  Vectors of different dimensions have no inner product and never
    meet.  Rows that repeat a vec_id are separate rows; an anchor that stands
    twice gives its rows twice.  An empty table gives no rows; other columns are
    ignored.  Nothing is capped: a pair of rows is left out only where its
    nodes' interval proves that it changes nothing.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "hardneg")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage.put(given.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(_quantised(scale), _ROW), "rows")
    sample = rows.select("dims", "vec", F.xxhash64("vec_id", F.lit(5)).alias("h")).orderBy("h").limit(SAMPLE).collect()
    fitted = {}
    for d in {r["dims"] for r in sample}:
        fitted[d] = _axes(np.stack([_integers(r["vec"], 1, d)[0].astype(np.float64) for r in sample if r["dims"] == d]))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")), F.lit(0))).first()
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-size // PART_BYTES), min(cores, -(-n // PART_ROWS)), 1)
    ordered = rows.mapInArrow(_order(fitted), f"{_ROW}, code long")
    key = ["dims", "label", "code", "vec_id"]
    leaves = stage.put(ordered.repartitionByRange(shards, *key).sortWithinPartitions(*key).mapInPandas(_cut(LEAF, True), _LEAVES), "leaves")
    anchors = ordered.where(F.col("vec_id") % every == 0)
    teams = max(1, min(cores, -(-n // (every * GROUP))))
    groups = stage.put(anchors.repartitionByRange(teams, *key).sortWithinPartitions(*key).mapInPandas(_cut(GROUP, False), _LEAVES), "groups")
    searcher = _Searcher(stage, leaves, groups, shards)
    best = searcher.run(stage.put(groups.select("node", "n").mapInPandas(_start(positives), _STATE), "start"), True)
    hard = searcher.run(stage.put(best.mapInPandas(_windows(negatives, low, high), _STATE), "windows"), False)
    found = groups.select("node", "ids").join(best.selectExpr("node", "state positives"), "node").join(hard.selectExpr("node", "state negatives"), "node")
    return found.select("ids", "positives", "negatives").mapInPandas(_rows, _OUT)
