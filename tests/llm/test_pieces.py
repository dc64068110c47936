"""Blocks travel in pieces, a few at once, and a block that several tasks read asks once for each run of pieces."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import made_text
from waymark.llm import interpolation


def test_a_block_is_written_in_bounded_rows(spark):
    rows = spark.range(3000).coalesce(1).selectExpr("cast(id as string) doc_id", "repeat('word ', 200) text", "2 part")
    made = rows.mapInArrow(interpolation._blocks, interpolation._BLOCK).collect()
    assert [r["piece"] for r in made] == list(range(len(made))) and len({r["block"] for r in made}) == 1
    assert [i for r in made for i in r["ids"]] == [str(i) for i in range(3000)]
    assert max(sum(map(len, r["texts"])) for r in made) <= interpolation.PIECE_BYTES


def test_a_worker_gets_little_at_once(spark, tmp_path, monkeypatch):
    seen, real = f"{tmp_path}/seen", interpolation._request

    def counting(order, ranges):
        run = real(order, ranges)

        def counted(batches):
            def told():
                for batch in batches:
                    with open(seen, "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return run(told())

        return counted

    monkeypatch.setattr(interpolation, "_request", counting)
    docs = spark.range(12_000).coalesce(1).selectExpr("id doc_id", "repeat(concat('w', id % 7, ' '), 333) text")
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in names]
    assert interpolation.interpolated_scores(docs).count() == 12_000
    assert [spark.conf.get(k) for k in names] == before
    sizes = [int(line) for line in open(seen)]
    assert sum(sizes) > 11_000_000 and max(sizes) <= interpolation.SENT_BYTES + interpolation.PIECE_BYTES


def test_pieces_read_by_several_tasks_get_their_counts():
    texts = [[made_text(3 * k + i, 40) for i in range(4)] for k in range(3)]
    ranges, order = 4, 2
    docs = [interpolation._batch("block long, piece int, part int, ids array<string>, texts array<string>", [[7], [k], [interpolation.DELETED], [["0"] * 4], [t]]) for k, t in enumerate(texts)]
    asked = [*interpolation._request(order, ranges)(iter(docs[:2])), *interpolation._request(order, ranges)(iter(docs[2:]))]
    requests = pa.Table.from_batches(asked)
    assert set(requests["run"].to_pylist()) == {0, 2}
    groups = sorted(set(zip(requests["level"].to_pylist(), requests["rng"].to_pylist(), strict=True)))
    mask = [np.array([g == x for x in zip(requests["level"].to_pylist(), requests["rng"].to_pylist(), strict=True)]) for g in groups]
    answers = pa.concat_tables([interpolation._answer(ranges)(requests.filter(pa.array(m))) for m in mask])
    grams, _ = zip(*(interpolation.ngrams(t, order) for t in texts), strict=True)
    want = [Counter(np.concatenate([g[k] for g in grams]).tolist()) for k in range(order)]
    table = pa.Table.from_batches(docs[::-1])
    rows = list(interpolation._looked_up(table, answers, order))
    assert sorted(row for row, _, _ in rows) == [0, 1, 2]
    for row, counts, _ in rows:
        for k in range(order):
            assert counts[k].tolist() == [want[k][x] for x in grams[2 - row][k].tolist()]
