"""Connected components and grouped pair work, by joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.staging import Stage


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node reachable.

    Alternating large-star and small-star steps.  A hub may hold any share of
    the rows: minima are partial aggregates and the joins back to a hub leave
    one row on the other side, which Spark splits when it is skewed.
    """
    e = edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v")
    last = None
    while True:
        both = e.unionByName(e.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v")
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").selectExpr("v u", "m v")
        e = stage.put(small.unionByName(first.selectExpr("u", "m v")).distinct(), "edges")
        if last is not None:
            stage.drop(last)
        last = e
        # done when every node is either a root or has one parent
        seen = e.selectExpr("u node", "1 child", "0 parent").unionByName(e.selectExpr("v node", "0 child", "1 parent"))
        seen = seen.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        if seen.where("c > 1 or (c = 1 and p = 1)").isEmpty():
            break
    roots = e.selectExpr("u node", "v root")
    return roots.unionByName(e.selectExpr("v node", "v root").distinct())


def block_pairs(df: DataFrame, key: str, member: str, size: int | Column) -> DataFrame:
    """Deal the members of each key into blocks and pairs of blocks.

    Every pair of members of a key meets in exactly one group ``(key, bi, bj)``
    when one is in block bi and the other in bj (or both in one block, bi = bj).
    No group holds more than about ``2 * size`` members, whatever the key holds;
    ``size`` is a number or an aggregate of the key's rows.
    """
    size = F.lit(size) if isinstance(size, int) else size
    counts = df.groupBy(key).agg(F.count("*").alias("_n"), F.ceil(F.count("*") / size).cast("int").alias("_k")).where("_n > 1")
    dealt = (
        df.join(counts, key)
        .withColumn("_b", F.expr(f"cast(pmod(xxhash64({member}, 7), _k) as int)"))
        .withColumn("_o", F.explode(F.expr("sequence(0, _k - 1)")))
    )
    return dealt.selectExpr("*", "least(_b, _o) bi", "greatest(_b, _o) bj").drop("_n", "_k", "_o")


def by_group(frames: Iterator[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """Apply ``work`` to each group of key-sorted batches, holding one batch and one group."""
    held: list[pd.DataFrame] = []
    last = None
    out: list[pd.DataFrame] = []

    def flush() -> None:
        if held:
            made = work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
            if made is not None and len(made):
                out.append(made)

    for frame in frames:
        if not len(frame):
            continue
        change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        change[0] = last is None or tuple(frame.iloc[0][keys]) != last
        cuts = [*change.nonzero()[0].tolist(), len(frame)]
        if cuts[0] != 0:
            held.append(frame.iloc[: cuts[0]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            flush()
            held = [frame.iloc[a:b]]
        last = tuple(frame.iloc[-1][keys])
        if out:
            yield pd.concat(out, ignore_index=True)
            out = []
    flush()
    if out:
        yield pd.concat(out, ignore_index=True)
