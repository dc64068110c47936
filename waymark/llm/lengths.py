"""Exact length histogram: encoded lengths once, answers for every context limit.

One aggregate counts documents by encoded length.  Suffix sums over that
histogram give totals, quantiles and truncated totals for any limit: between two
lengths that occur, what is longer stays the same.  The sums run in two levels,
within ranges of lengths and over the ranges' totals, so no task holds more than
one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.text import byte_slices
from waymark.llm.tokens import encoder
from waymark.plans.staging import Stage

#: Lengths per range of the two-level sums.
RANGE = 1024


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            sizes = [np.diff(encode(batch.slice(at, to - at).column(0).to_pylist())[1]) for at, to in byte_slices(batch.column(0))]
            values, counts = np.unique(np.concatenate(sizes or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["length", "n"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length and n_docs, for every encoded length that ``docs(text)`` has; null texts have length 0.

    The texts are encoded once, and the counts written.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths(tokenizer), "length long, n long")
    return Stage(docs.sparkSession, "lengths").put(counted.groupBy("length").agg(F.sum("n").alias("n_docs")), "histogram")


def limit_report(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: what fits, what is cut, and the share of documents up to it.

    Returns context_limit, last_limit (the greatest limit before the next length;
    all limits up to it have the same longer documents; null for the longest),
    n_docs (of exactly that length), docs_over and tokens_over (of longer
    documents), truncated_total (tokens if every document is cut at the limit),
    total_docs, total_tokens and quantile (share of documents no longer than the
    limit).  An empty histogram gives no rows.  ``at_limits`` answers any other limit.
    """
    h = histogram.withColumn("rng", F.expr(f"length div {RANGE}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    ranges = h.groupBy("rng").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"), F.min("length").alias("first"))
    later = Window.partitionBy(F.lit(0)).orderBy("rng")  # one row per range of lengths
    all_ranges = Window.partitionBy(F.lit(0))
    ranges = ranges.select(
        "rng",
        (F.sum("d").over(all_ranges) - F.sum("d").over(later)).alias("d_later"),
        (F.sum("t").over(all_ranges) - F.sum("t").over(later)).alias("t_later"),
        F.sum("d").over(all_ranges).alias("total_docs"),
        F.sum("t").over(all_ranges).alias("total_tokens"),
        F.lead("first").over(later).alias("next_first"),
    )
    above = Window.partitionBy("rng").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    joined = h.join(ranges, "rng")
    docs_over = F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("d_later")
    tokens_over = F.coalesce(F.sum("tokens").over(above), F.lit(0)) + F.col("t_later")
    following = F.coalesce(F.lead("length").over(Window.partitionBy("rng").orderBy("length")), F.col("next_first"))
    out = joined.select(F.col("length").alias("context_limit"), (following - 1).alias("last_limit"), "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "total_docs", "total_tokens")
    truncated = F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")
    return out.withColumn("truncated_total", truncated).withColumn("quantile", (F.col("total_docs") - F.col("docs_over")) / F.col("total_docs"))


def at_limits(report: DataFrame, limits: DataFrame) -> DataFrame:
    """The totals at every limit of ``limits(context_limit)``, whether or not a document has that length.

    Returns context_limit, docs_over, tokens_over, truncated_total and quantile for
    each row; limits below the shortest document cut all, those beyond the longest
    none.  Without documents all are 0 and the quantile is null.  A null limit has null answers.
    """
    docs, tokens, least = report.agg(F.max("total_docs"), F.max("total_tokens"), F.min("context_limit")).first()
    asked = limits.select(F.col("context_limit").cast("long").alias("asked")).withColumn("rng", F.expr(f"asked div {RANGE}"))
    spans = report.select("context_limit", "last_limit", "docs_over", "tokens_over").where("last_limit is not null")
    spans = spans.withColumn("rng", F.explode(F.expr(f"sequence(context_limit div {RANGE}, last_limit div {RANGE})")))
    found = asked.join(spans, (asked["rng"] == spans["rng"]) & (asked["asked"] >= spans["context_limit"]) & (asked["asked"] <= spans["last_limit"]), "left")
    found = found.withColumns({"_d": F.lit(docs).cast("long"), "_t": F.lit(tokens).cast("long")})
    below = F.coalesce(F.col("asked") < F.lit(least), F.lit(False))
    d, t = (F.coalesce(c, F.when(below, F.col(all_)).otherwise(F.lit(0))) for c, all_ in (("docs_over", "_d"), ("tokens_over", "_t")))
    out = found.select(F.col("asked").alias("context_limit"), *(F.when(F.col("asked").isNotNull(), c).cast("long").alias(n) for c, n in ((d, "docs_over"), (t, "tokens_over"))), "_d", "_t")
    truncated = F.coalesce("_t", F.lit(0)) - F.col("tokens_over") + F.col("docs_over") * F.greatest("context_limit", F.lit(0))
    return out.withColumn("truncated_total", truncated).withColumn("quantile", (F.col("_d") - F.col("docs_over")) / F.col("_d")).drop("_d", "_t")


def length_quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the least length that this share of the documents does not exceed: columns share and length."""
    least = [F.min(F.when(F.col("total_docs") - F.col("docs_over") >= F.lit(float(x)) * F.col("total_docs"), F.col("context_limit"))) for x in shares]
    one = report.agg(F.array(*(F.struct(F.lit(float(x)).alias("share"), m.alias("length")) for x, m in zip(shares, least, strict=True))).alias("q"))
    return one.select(F.explode("q").alias("q")).select("q.share", "q.length")
