"""Token counts at any limit, and packing with its certificate."""

from __future__ import annotations

import math

import numpy as np
from tokenizers import Tokenizer

from tests.llm.conftest import TOKENIZER, made_text
from waymark.llm import lengths, packing, queries

SMALL = "/root/testdata/sf0.001"


def test_every_limit_and_quantile_is_answered(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    n = np.array([len(tokenizer.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()])
    rows = queries.op2_length_histogram(spark, SMALL).collect()
    report = spark.createDataFrame(rows)
    assert sorted(r["context_limit"] for r in rows) == sorted(set(n.tolist())) and {r["total_docs"] for r in rows} == {len(n)} and {r["total_tokens"] for r in rows} == {int(n.sum())}
    for r in rows:
        assert r["n_docs"] == (n == r["context_limit"]).sum() and abs(r["quantile"] - (n <= r["context_limit"]).mean()) < 1e-12
        later = n[n > r["context_limit"]]
        assert r["last_limit"] == (later.min() - 1 if len(later) else None)
    limits = [-3, 0, 1, 7, 100, 512, 1023, 1024, 1025, 2048, 4096, 8192, int(n.max()), int(n.max()) + 5, 10**7]
    got = {r["context_limit"]: r for r in lengths.at_limits(report, spark.createDataFrame([(x,) for x in [*limits, None]], "context_limit long")).collect()}
    for x in limits:
        r = got[x]
        assert (r["docs_over"], r["tokens_over"], r["truncated_total"]) == ((n > x).sum(), n[n > x].sum(), np.minimum(n, max(x, 0)).sum()), x
        assert abs(r["quantile"] - (n <= x).mean()) < 1e-12
    assert got[None]["docs_over"] is None
    for r in lengths.length_quantiles(report, [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r["length"] == min(x for x in n.tolist() if (n <= x).sum() >= r["share"] * len(n))


def test_reports_of_nothing(spark):
    nothing = lengths.limit_report(lengths.length_histogram(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER))
    assert nothing.collect() == []
    r = lengths.at_limits(nothing, spark.createDataFrame([(5,)], "context_limit long")).first()
    assert (r["docs_over"], r["tokens_over"], r["truncated_total"], r["quantile"]) == (0, 0, 0, None)


def test_packing_carries_its_certificate(spark):
    rows = queries.op5_best_fit_packing(spark, SMALL).collect()
    least, made = {r["least_sequences"] for r in rows}, {r["n_sequences"] for r in rows}
    assert made == {len({r["sequence_id"] for r in rows})} and len(least) == 1
    assert math.ceil(sum(r["length"] for r in rows) / 2048) <= min(least) <= min(made) <= 1.02 * min(least) + 1


def test_packing_spreads_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ROWS", 500)
    docs = spark.createDataFrame([(1, made_text(1, 30))] * 4000, "doc_id long, text string")
    rows = packing.pack_documents(docs, TOKENIZER, 512).collect()
    assert len(rows) == 4000 and all(r["offset"] + r["length"] <= 512 for r in rows)
    n = rows[0]["length"]
    assert rows[0]["n_sequences"] == math.ceil(4000 / (512 // n)) == len({r["sequence_id"] for r in rows})
