"""Formatting against a plain version, masks against spans character by character."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from tests.llm.conftest import TOKENIZER, made_text
from waymark.llm import chat as module
from waymark.llm.chat import LEARNED, MARKS, chat, format_conversations, read_back, under

PIECES = ["<turn>", "<text>", "</turn>", "<|endoftext|>", "\\", "<\\turn>", "<", "/turn>", "turn>", "\n", " ", "é", "中", "\U0001f600", "ok", "\\\\", "|", ">", "\x00", " "]
SCHEMA = "conv_id long, turn long, role string, text string, shard int, piece int, ids string, loss double, whole string"


def odd_text(seed):
    r = random.Random(seed)
    return "".join(r.choice(PIECES) for _ in range(r.randrange(12)))


@pytest.mark.parametrize("seed", range(60))
def test_escape_is_reversible_and_hides_marks(seed):
    c, text = chat(TOKENIZER), odd_text(seed)
    hidden = c.escape(text)
    assert c.unescape(hidden) == text
    assert not any(m in hidden for m in (*MARKS, "<|endoftext|>"))


@pytest.mark.parametrize("seed", range(20))
def test_mask_covers_learned_text_and_nothing_else(seed):
    c, r = chat(TOKENIZER), random.Random(seed)
    turns = [(r.choice(["user", LEARNED, "", "system", odd_text(i)]), odd_text(seed * 100 + i)) for i in range(r.randrange(1, 9))]
    text, spans = c.render(turns)
    ((ids, offsets),) = c.encode([text])
    mask = under(offsets, spans)
    assert mask.tolist() == [any(a < e and s < b for s, e in spans) for a, b in offsets.tolist()]
    covered = set().union(*(range(a, b) for (a, b), m in zip(offsets.tolist(), mask, strict=True) if m)) if mask.any() else set()
    assert covered == set().union(*(range(a, b) for a, b in spans.tolist())) if len(spans) else not covered
    assert c.read(ids, mask) == (turns, "".join(t for role, t in turns if role == LEARNED), len(text))


def test_ids_and_offsets_are_the_tokenizers_own():
    """The same as the library gives for the rendered text with the marks as added tokens."""
    own = Tokenizer.from_file(TOKENIZER)
    own.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
    c = chat(TOKENIZER)
    texts = [c.render([(LEARNED, odd_text(i)), ("user", made_text(i, 30)), ("", "")])[0] for i in range(40)]
    for text, (ids, offsets) in zip(texts, c.encode(texts), strict=True):
        e = own.encode(text, add_special_tokens=False)
        assert e.ids == ids.tolist()
        place = np.cumsum([0, *(len(ch.encode()) for ch in text)])  # of each character in bytes
        # within a character the library repeats its place
        assert all(place[a] <= s and t <= place[b] for (a, b), (s, t) in zip(e.offsets, offsets.tolist(), strict=True))


def plain(rows):
    """The digests of (conv_id, turn, role, text) rows."""
    c, out, groups = chat(TOKENIZER), [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:])
    for conv, turns in groups.items():
        turns.sort(key=lambda t: tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in t))
        own = [(role or "", text or "") for _, role, text in turns]
        learned = "".join(t for role, t in own if role == LEARNED)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{a}\n{b}\n" for a, b in own), learned)]
        out.append((str(conv), len(own), digest[0], len(learned), digest[1], len(c.render(own)[0])))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 9, 9, "x", 0.5, "y") for r in rows], SCHEMA).repartition(3)
    got = read_back(format_conversations(df, TOKENIZER), TOKENIZER)
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def test_equals_plain_version(spark):
    r = random.Random(2)
    rows = [(r.randrange(40), i % 7, r.choice(["user", LEARNED, "system"]), odd_text(i)) for i in range(300)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, LEARNED, "first"), (None, 0, "user", "no id"), (None, 1, LEARNED, "nor this"), (2, 0, LEARNED, ""), (3, 0, LEARNED, made_text(4, 30_000)), (3, 1, "user", "x")]
    rows += [(4, 0, LEARNED, "same")] * 5 + [(5, 1, "b", "tie"), (5, 1, "a", "tie"), (-7, 0, "user", "\\### Assistant: </turn> ok")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_long_conversation_is_cut_and_spread(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 400)
    rows = [(7, i, LEARNED if i % 2 else "user", made_text(i, 20)) for i in range(400)] + [(c, 0, LEARNED, "short") for c in range(20) if c != 7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    pieces = format_conversations(df, TOKENIZER).where("conv_id = 7").select("shard", "whole").collect()
    assert len({p.shard for p in pieces}) > 1
    assert not any(p.whole for p in pieces)
    assert found(spark, rows) == plain(rows)


def test_pieces_are_the_whole(spark):
    rows = [(1, i, LEARNED if i % 2 else "user", made_text(i, 5)) for i in range(30)]
    got = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENIZER).orderBy("shard", "piece").collect()
    text, spans = chat(TOKENIZER).render([r[2:] for r in rows])
    ((ids, offsets),) = chat(TOKENIZER).encode([text])
    assert "".join(r.text for r in got) == text
    assert np.concatenate([r.ids for r in got]).tolist() == ids.tolist()
    assert np.concatenate([r.loss for r in got]).tolist() == under(offsets, spans).tolist()


def test_conversation_of_marks_in_the_query(spark):
    from waymark.llm import queries

    row = queries.op13_offset_masks(spark, "/root/testdata/sf0.001").where(F.col("conv_id") == -7).first()
    text = "\\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
