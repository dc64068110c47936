"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make all signature coordinates: one
places a shingle, the other, shifted circularly by ``k`` steps, ranks it for
coordinate ``k``.  Bands of coordinates are bucket keys.  Links are confirmed
on the full shingle sets and closed transitively.

Exact copies (equal sets) are one class with its least doc_id as representative,
so they never make pairs.  Within a bucket the members are first compared with
one leader, the member whose buckets are fullest; whatever is then in one
component needs no further comparison.  Buckets that still hold several
components look at the rest in blocks of bounded size.  There the comparison
with the leader bounds every pair: what two members share lies in the leader's
set, of which each carries a bitmap (an exact count), or among their few other
shingles, whose number is bounded exactly and by a small signature.  Only pairs
that these bounds and the signatures allow are verified, each from the first
bucket in which it meets.  A signature rules a pair out only where a pair with
the similarity it needs would agree so rarely with probability ``MISS`` at most.
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
from waymark.llm.text import U64, as_bytes, byte_slices, mix, shingle_hashes, sorted_sets, word_hashes
from waymark.plans.staging import Stage

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Members of a bucket compared with each other at once, and bits of their leader's set that a block's bitmaps may hold together.
BLOCK, BLOCK_BITS = 512, 1 << 28
#: Bytes of the bitmaps that are unpacked at once.
UNPACKED = 1024
#: Pairs that share a leader and are verified in one group of rows.
SALT_ROWS = 256
#: Chance at most, by the exact binomial tail, that signatures of a true pair agree so rarely that it isn't verified.
MISS = 1e-9
#: Coordinates of the signature of the shingles that a leader lacks.
OTHERS = 32

_FACTS = "doc_id long, n_shingles long, set_hi long, set_lo long, keys array<long>, sig binary"


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Circulant MinHash signatures (uint32) of non-empty sets given by offsets."""
    placed = (values >> U64(32)).astype(np.uint32)  # the first permutation: a bijection of 32 bits
    placed *= np.uint32(0x85EBCA6B)
    placed ^= placed >> np.uint32(13)
    placed *= np.uint32(0xC2B2AE35)
    placed ^= placed >> np.uint32(16)
    n = len(offsets) - 1
    out = np.empty((n, COORDINATES), np.uint32)
    step = 0x9E3779B1
    first = 0
    while first < n:  # chunks that stay in the processor's cache
        last = int(np.searchsorted(offsets, offsets[first] + (1 << 15), "right")) - 1
        last = max(last, first + 1)
        own = placed[offsets[first] : offsets[last]]
        cuts = offsets[first:last] - offsets[first]
        x, y = np.empty_like(own), np.empty_like(own)
        for k in range(COORDINATES):  # the second permutation, shifted by k steps
            np.add(own, np.uint32(k * step & 0xFFFFFFFF), out=x)
            np.multiply(x, np.uint32(0x7FEB352D), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x846CA68B), out=x)
            out[first:last, k] = np.minimum.reduceat(x, cuts)
        first = last
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of 16-bit coordinates; the band's number is part of the key."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(U64)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=U64) + U64(0xB5)), parts.shape[:2]).copy()
    for j in range(ROWS):
        keys = mix(keys ^ parts[:, :, j] * U64(0xD6E8FEB86659FD93))
    return keys.view(np.int64)


def _facts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in byte_slices(batch.column(1)):
                rows = batch.slice(at, to - at)
                values, offsets = sorted_sets(*shingle_hashes(*word_hashes(as_bytes(rows.column(1).to_pylist())), k))
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                hi, lo = np.zeros(len(sizes), U64), np.zeros(len(sizes), U64)
                keys, sigs = np.empty((0, BANDS), np.int64), np.empty((0, COORDINATES), np.uint16)
                if len(full):
                    cuts = np.append(offsets[full], offsets[-1])
                    hi[full] = np.add.reduceat(mix(values), cuts[:-1])
                    lo[full] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), cuts[:-1])
                    sigs = signatures(values, cuts).astype(np.uint16)
                    keys = band_keys(sigs)
                list_offsets = np.zeros(len(sizes) + 1, np.int32)
                list_offsets[full + 1] = BANDS
                bytes_offsets = np.zeros(len(sizes) + 1, np.int32)
                bytes_offsets[full + 1] = 2 * COORDINATES
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(sizes),
                        pa.array(hi.view(np.int64)),
                        pa.array(lo.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(list_offsets), pa.int32()), pa.array(keys.reshape(-1))),
                        pa.Array.from_buffers(
                            pa.binary(), len(sizes), [None, pa.py_buffer(np.cumsum(bytes_offsets, dtype=np.int32)), pa.py_buffer(sigs.tobytes())]
                        ),
                    ],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "keys", "sig"],
                )

    return run


def _others_signature(values: np.ndarray) -> bytes:
    """Low bytes of a MinHash signature of the shingles that the leader lacks."""
    if not len(values):
        return b""
    least = np.full(OTHERS, np.iinfo(U64).max, U64)
    for at in range(0, len(values), 1 << 14):  # a bounded part at once
        part = values[at : at + (1 << 14), None]
        shifted = mix((part + np.arange(1, OTHERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(-1))
        least = np.minimum(least, shifted.reshape(len(part), OTHERS).min(0))
    return least.astype(np.uint8).tobytes()


def tail(n: int, k: int, p: float) -> float:
    """The chance that of n trials with chance p no more than k succeed."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def most_likely_shares(n: int, miss: float = MISS) -> np.ndarray:
    """For each number k of n coordinates that agree, the largest similarity at which so few agree with a chance of ``miss`` or more."""
    out = []
    for k in range(n + 1):
        low, high = 0.0, 1.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if tail(n, k, middle) >= miss else (low, middle)
        out.append(high)
    return np.array(out)


_VERIFIED = "a long, b long, linked boolean, shared binary, others binary"


def _verify(k: int, percent: int, describe: bool):
    """Whether a and b are linked and, if asked, a's bitmap over b's set and the signature of its other shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_text, last_set = None, None, np.empty(0, U64)
        for whole in batches:
            for start, stop in byte_slices(whole.column(2)):  # texts of few pairs at once
                batch = whole.slice(start, stop - start)
                a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
                linked = np.zeros(len(a), bool)
                shared: list = [None] * len(a)
                others: list = [None] * len(a)
                own, offsets = sorted_sets(*shingle_hashes(*word_hashes(as_bytes(ta)), k))
                for r in range(len(a)):
                    if b[r] != last_id or tb[r] != last_text:
                        last_id, last_text = b[r], tb[r]
                        last_set = sorted_sets(*shingle_hashes(*word_hashes(as_bytes([last_text])), k))[0]
                    mine = own[offsets[r] : offsets[r + 1]]
                    at = np.searchsorted(last_set, mine)
                    at[at == len(last_set)] = 0
                    hit = last_set[at] == mine
                    both = int(hit.sum())
                    linked[r] = 100 * both >= percent * (len(mine) + len(last_set) - both)
                    if describe:
                        bits = np.zeros(len(last_set), bool)
                        bits[at[hit]] = True
                        shared[r], others[r] = np.packbits(bits).tobytes(), _others_signature(mine[~hit])
                columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked), pa.array(shared, pa.binary()), pa.array(others, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked", "shared", "others"])

    return run


def _close_pairs(percent: int):
    """Pairs of different components in one block pair that may be linked.

    Pruned exactly by sizes and by what both share with the bucket's leader, and
    by signatures where a linked pair would be ruled out with chance MISS at most.
    """
    allowed, allowed_others = most_likely_shares(COORDINATES), most_likely_shares(OTHERS)
    need = int(np.searchsorted(allowed, percent / 100))  # coordinates in which a linked pair agrees at least
    share = percent / (100 + percent)  # of the sizes' sum, which two linked sets have in common

    def work(g: pd.DataFrame) -> pd.DataFrame | None:
        if g["root"].nunique() < 2:
            return None
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), COORDINATES)
        keys = band_keys(sig)
        ids, root, n, blk = (g[c].to_numpy() for c in ("doc_id", "root", "n_shingles", "_b"))
        inner = g["bi"].iat[0] == g["bj"].iat[0]
        left = np.flatnonzero(blk == g["bi"].iat[0])
        right = left if inner else np.flatnonzero(blk == g["bj"].iat[0])
        told = g["shared"].notna().to_numpy()  # the others differ from the leader by size alone
        width = max((len(x) for x in g["shared"] if x is not None), default=0)
        bits = np.zeros((len(g), width), np.uint8)
        other = np.zeros((len(g), OTHERS), np.uint8)
        for i, (x, y) in enumerate(zip(g["shared"], g["others"], strict=True)):
            if x is not None:
                bits[i, : len(x)] = np.frombuffer(x, np.uint8)
                if y:
                    other[i] = np.frombuffer(y, np.uint8)
        inside, held = np.zeros((len(left), len(right)), np.float32), np.zeros(len(g), np.int64)
        for at in range(0, width, UNPACKED):
            part = np.unpackbits(bits[:, at : at + UNPACKED], axis=1).astype(np.float32)
            inside += part[left] @ part[right].T
            held += part.sum(1).astype(np.int64)
        rest = np.maximum(n - held, 0)  # the leader's own bitmap is padded
        found = []
        for row, i in enumerate(left):
            col = np.flatnonzero((root[right] != root[i]) & ((ids[right] > ids[i]) | (not inner)))
            at = right[col]
            least = share * (n[at] + n[i])
            ok = np.minimum(n[at], n[i]) >= least - 1e-9
            at, least, col = at[ok], least[ok], col[ok]
            if told[i] and len(at):
                both = inside[row, col]
                bound = both + np.minimum(rest[at], rest[i]) >= least - 1e-9
                want = np.maximum(least - both, 0)
                j = np.clip(want / np.maximum(rest[at] + rest[i] - want, 1), 0, 1)
                bound &= (want <= 0) | (j <= allowed_others[(other[at] == other[i]).sum(1)])
                at = at[bound | ~told[at]]
            if len(at):
                same = sig[at] == sig[i]
                bands = same.reshape(len(at), BANDS, ROWS).all(2).argmax(1)
                at = at[(same.sum(1) >= need) & (keys[i, bands] == g["key"].iat[0])]
                found.append(np.stack([np.maximum(ids[at], ids[i]), np.minimum(ids[at], ids[i])], 1))
        if not found:
            return None
        pairs = np.concatenate(found)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return lambda frames: by_group(frames, ["key", "bi", "bj"], work)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``.

    Links are pairs with ``100 * |A & B| >= percent * |A | B|`` on sets of
    ``shingle``-word shingles; component_id is the least doc_id reachable.

    Null or white text: an empty set, linked with nothing.  Null doc_id: a null
    component, linked with nothing, kept.  Rows that repeat a doc_id are one
    document that links by any of its texts.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = stage.put(docs.mapInArrow(_facts(shingle), _FACTS), "facts")
    sets = facts.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"))
    members = sets.select("doc_id", "set_hi", "set_lo").join(classes, ["set_hi", "set_lo"])
    copies = stage.put(members.where("doc_id <> rep").selectExpr("doc_id a", "rep b").distinct(), "copies")
    reps = sets.join(copies.selectExpr("a doc_id"), "doc_id", "left_anti")

    buckets = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stage.put(buckets.join(shared, "key"), "buckets")
    texts = docs.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = stage.put(texts, "texts")

    def verified(pairs: DataFrame, describe: bool) -> DataFrame:
        """The rows of ``pairs(a, b)`` verified on full sets; pairs that share b are dealt over salts."""
        pairs = stage.put(pairs, "pairs")
        counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("salts"))
        dealt = pairs.join(counts, "b").withColumn("salt", F.expr("cast(pmod(xxhash64(a), salts) as int)"))
        left = dealt.join(texts.selectExpr("doc_id a", "text ta"), "a").select("a", "b", "salt", "ta")
        right = counts.join(texts.selectExpr("doc_id b", "text tb"), "b").select("b", "tb", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
        both = left.join(right, ["b", "salt"]).select("a", "b", "ta", "tb")
        return stage.put(both.mapInArrow(_verify(shingle, percent, describe), _VERIFIED), "verified")

    fullness = buckets.groupBy("doc_id").agg(F.sum("n").alias("full"))
    led = buckets.join(fullness, "doc_id").groupBy("key").agg(F.max(F.expr("struct(full, -doc_id l, n_shingles)")).alias("m"))
    led = stage.put(led.selectExpr("key", "-m.l l", "m.n_shingles l_size"), "leaders")
    pairs = buckets.join(led, "key").where("doc_id <> l")
    pairs = pairs.where(f"100 * least(n_shingles, l_size) >= {percent} * greatest(n_shingles, l_size)")
    first = verified(pairs.selectExpr("doc_id a", "l b").distinct(), True)
    links = copies.unionByName(first.where("linked").select("a", "b"))
    roots = components(links, stage)

    rooted = buckets.select("key", "doc_id", "n_shingles").join(roots.selectExpr("node doc_id", "root"), "doc_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "doc_id"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"))
    members = stage.put(rooted.join(mixed.where("x < y and n > 2").select("key"), "key"), "members")
    if not members.isEmpty():
        sigs = reps.select("doc_id", "sig").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
        known = first.selectExpr("a doc_id", "b l", "shared", "others")
        dealt = members.join(sigs, "doc_id").join(led.select("key", "l", "l_size"), "key").join(known, ["doc_id", "l"], "left")
        whole = F.expr("cast(unhex(repeat('FF', cast(ceil(l_size / 8) as int))) as binary)")
        dealt = dealt.withColumn("shared", F.when(F.col("doc_id") == F.col("l"), whole).otherwise(F.col("shared"))).drop("l")
        size = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.lit(BLOCK_BITS) / F.max("l_size")))
        dealt = block_pairs(dealt, "key", "doc_id", size).drop("l_size")
        dealt = dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        pairs = dealt.mapInPandas(_close_pairs(percent), "a long, b long").distinct()
        tried = first.select("a", "b").unionByName(first.selectExpr("b a", "a b"))
        more = verified(pairs.join(tried, ["a", "b"], "left_anti"), False).where("linked")
        if not more.isEmpty():
            roots = components(links.unionByName(more.select("a", "b")), stage)

    out = facts.select("doc_id", "n_shingles").join(roots.selectExpr("node doc_id", "root"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id")).drop("root")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
