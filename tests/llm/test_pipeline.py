"""The pipeline's stages against plain versions, and on odd inputs."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import made_text
from tests.llm.test_corpus import SMALL, _classes


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())


def _words3(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_pipeline_stages_take_effect(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    planted = spark.createDataFrame([(900_001, None, None, "x", 0), (None, "1 2 3", None, "x", 5), (900_002, texts[1], "en", "x", 1), (900_003, made_text(5, 30) + " a@b.example.org", "en", "x", 1)], docs.schema)
    now = docs.unionByName(planted).repartition(2)
    for name, step in corpus_pipeline.STAGES[:4]:
        after = step(spark, now, SMALL).persist()
        assert after.columns == docs.columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "language_id":
            assert None not in kept and 900_001 not in kept and 900_003 in kept
        before = {r["doc_id"]: r["text"] or "" for r in now.select("doc_id", "text").collect()}
        if name == "minhash_near_dedup":
            assert 900_002 not in kept
            split = {i: t.encode().lower().split() for i, t in before.items()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in split.items()}
            assert kept == {i for i, root in _classes(sets, 80).items() if i == root}
        if name == "benchmark_decontamination":
            items = duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()
            listed = [_words3(t) for (t,) in items]
            windows = {tuple(w[k : k + 10]) for w in listed for k in range(max(len(w) - 9, 1)) if w}
            sizes = {len(w) for w in windows}
            own = {i: _words3(t) for i, t in before.items()}
            clean = {i for i, w in own.items() if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
            assert kept == clean and len(clean) < len(before)
        if name == "pii":
            assert after.where("doc_id = 900003").first()["text"].endswith(" [EMAIL]")
            assert after.where(F.col("n_chars") != F.length("text")).count() == 0
        now = after
    packed = corpus_pipeline.STAGES[4][1](spark, now, SMALL)
    assert packed.select("doc_id").distinct().count() == now.count()



def _ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_dedup_keeps_one_of_rows_that_repeat(spark):
    long, other = made_text(1, 60), made_text(2, 60)
    rows = [(1, long, "a"), (1, long, "b"), (None, long, "c"), (None, other, "d"), (None, other, "e"), (7, other + " end", "f"), (7, made_text(3, 60), "g"), (3, None, "h"), (3, "", "i"), (0, "short", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    got = corpus_pipeline.minhash_near_dedup(spark, df, SMALL)
    assert got.columns == df.columns
    kept = {r["_row"] for r in got.collect()}
    assert kept & {"f", "g", "h", "i", "j", "d", "e"} == {"f", "g", "h", "i", "j"} and len(kept & {"a", "b", "c"}) == 1 and "c" not in kept


def test_decontamination_judges_each_row(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(7, item, 1), (7, made_text(3, 60), 2), (None, f"see {item}", 3), (None, "clean", 4), (8, None, 5)]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string, _id int"), SMALL)
    assert sorted(r["_id"] for r in got.collect()) == [2, 4, 5]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, nothing, k):
    step = corpus_pipeline.STAGES[k][1]
    assert step(spark, nothing, SMALL).collect() == []
    got = step(spark, odd, SMALL)
    if k < 4:
        assert got.columns == odd.columns
    n = odd.count()
    assert {0: n - 5, 1: n - 2, 2: n, 3: n}.get(k, got.count()) == got.count()


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    df = spark.createDataFrame([(1, "plain words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert _ids(corpus_pipeline.language_id(spark, df, SMALL)) == ["1"]


def test_redaction_without_a_count_of_characters(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.example.org", "x")], "doc_id long, text string, root string")
    assert corpus_pipeline.personal_data(spark, df, SMALL).first()["text"] == "mail [EMAIL]"
