r"""Chat formatting with a loss mask that is aligned by offsets.

A conversation is rendered whole: each turn as ``<turn>role<text>text</turn>``
and a line end.  The three marks are tokens beside the given tokenizer's own, so no
token crosses one.  Inside roles and texts a backslash is doubled, and a mark (or
an added token of the tokenizer file) gets a backslash after its first character;
dropping every backslash before a character undoes both.

The rendered text is encoded once with offsets; a token is under the mask if its
bytes meet a span of assistant text, found by binary search among the ends
of the sorted spans.

Turns are dealt by range in conversation order, so a conversation with very many
turns is spread over tasks.  It is then cut between turns, at a range's end or
where a piece is large; pieces give the same tokens as the whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tokens import byte_of_char, encoder

#: Characters after which a conversation goes on in another piece, and of pieces that are encoded at once.
PIECE, BATCH = 1 << 20, 1 << 20
TURN, TEXT, END = MARKS = ("<turn>", "<text>", "</turn>")
#: The role whose texts are learned.
LEARNED = "assistant"

_FORMATTED = "conv_id long, shard int, piece int, whole boolean, n_turns long, text string, ids array<int>, loss array<boolean>"
_READ = "conv_id long, shard int, piece int, whole boolean, n_turns long, turns string, loss string, learned long, chars long"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_chats: dict[str, Chat] = {}


class Chat:
    """The template under one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("offsets come from the bytes of each token: the file must be byte-level")
        self.encoder = encoder(path)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = byte_of_char()
        size = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
        self.turn, self.text, self.end = range(size, size + len(MARKS))
        self.bytes: list[bytes] = [b""] * (size + len(MARKS))
        for token, i in spec["model"]["vocab"].items():
            if token not in added:
                self.bytes[i] = bytes(of[c] for c in token)
        for token, i in [*added.items(), *zip(MARKS, (self.turn, self.text, self.end), strict=True)]:
            self.bytes[i] = token.encode()
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        controls = sorted({*added, *MARKS}, key=len, reverse=True)
        self._control = re.compile("|".join(map(re.escape, controls)))
        self._mark = re.compile("(" + "|".join(map(re.escape, MARKS)) + ")")

    def escape(self, value: str) -> str:
        return self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], value.replace("\\", "\\\\"))

    @staticmethod
    def unescape(value: str) -> str:
        return re.sub(r"\\(.)", r"\1", value, flags=re.DOTALL)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The text of (role, text) turns, and start and end (in bytes of UTF-8) of each text to learn that isn't empty."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{TURN}{self.escape(role)}{TEXT}", self.escape(text)
            first, size = at + len(head.encode()), len(body.encode())
            if role == LEARNED and size:
                spans.append((first, first + size))
            out += head, body, f"{END}\n"
            at = first + size + len(END) + 1
        return "".join(out), np.array(spans, np.int64).reshape(-1, 2)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of rendered texts, and start and end of each token in bytes: a byte-level token is as long as its bytes.

        A mark is one token, and no token crosses it, so what lies between marks is encoded by itself, all texts at once.
        """
        split = [self._mark.split(t) for t in texts]
        coded, offsets = self.encoder.encode([part for parts in split for part in parts[::2]])
        coded = coded.astype(np.int32)
        known = {TURN: self.turn, TEXT: self.text, END: self.end}
        out, at = [], 0
        for parts in split:
            bounds = offsets[at : at + len(parts[::2]) + 1]
            at += len(parts[::2])
            marks = np.array([known[m] for m in parts[1::2]], np.int32)
            ids = np.insert(coded[bounds[0] : bounds[-1]], bounds[1:-1] - bounds[0], marks)
            ends = np.cumsum(self.lengths[ids])
            out.append((ids, np.stack([ends - self.lengths[ids], ends], 1)))
        return out

    def read(self, ids: np.ndarray, loss: np.ndarray) -> tuple[list[tuple[str, str]], str, int]:
        """Turns, text under the mask and characters that tokens and mask stand for."""
        raw = b"".join([self.bytes[i] for i in ids.tolist()])
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))

        def plain(first: np.ndarray, last: np.ndarray) -> list[str]:
            return [self.unescape(raw[a:b].decode()) for a, b in zip(ends[first].tolist(), ends[last].tolist(), strict=True)]

        starts, texts, stops = (np.flatnonzero(ids == i) for i in (self.turn, self.text, self.end))
        edges = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        turns = list(zip(plain(starts + 1, texts), plain(texts + 1, stops), strict=True))
        return turns, "".join(plain(edges[:, 0], edges[:, 1])), len(raw.decode())


def chat(path: str) -> Chat:
    """The worker's template for a tokenizer file."""
    if path not in _chats:
        _chats[path] = Chat(path)
    return _chats[path]


def under(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens meet a span: of the sorted spans, the first that ends after the token's start, if it starts before its end."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    return (first < len(spans)) & (spans[np.minimum(first, len(spans) - 1), 0] < offsets[:, 1])


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = chat(path)
        shard = TaskContext.get().partitionId()
        ready: list[tuple] = []  # pieces to encode: conversation, number, whole, turns
        size = 0
        key, turns, held, piece, first = None, [], 0, 0, True

        def flush() -> pa.RecordBatch:
            rendered = [made.render(t) for *_, t in ready]
            coded = made.encode([text for text, _ in rendered])
            ids = [i for i, _ in coded]
            loss = [under(o, spans) for (_, o), (_, spans) in zip(coded, rendered, strict=True)]
            columns = [
                pa.array([r[0] for r in ready], pa.int64()), pa.array([shard] * len(ready), pa.int32()), pa.array([r[1] for r in ready], pa.int32()), pa.array([r[2] for r in ready], pa.bool_()),
                pa.array([len(r[3]) for r in ready], pa.int64()), pa.array([t for t, _ in rendered], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_())),
            ]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FORMATTED.split(", ")])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if (conv,) != key or held >= PIECE:
                    if turns:
                        # a range's first conversation may have begun in the one before
                        ready.append((key[0], piece, (conv,) != key and piece == 0 and not first, turns))
                        size += held
                        piece += 1
                    if (conv,) != key:
                        first, piece = key is None, 0
                    key, turns, held = (conv,), [], 0
                    if size >= BATCH:
                        yield flush()
                        size = 0
                role, text = role or "", text or ""
                turns.append((role, text))
                held += len(role) + len(text) + 20
        if turns:
            ready.append((key[0], piece, False, turns))  # may go on in the next range
        if ready:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Rendered text, token ids and loss mask of every conversation of ``conversations(conv_id, turn, role, text)``.

    Returns conv_id, shard, piece, whole, n_turns, text, ids and loss.  Most
    conversations are one ``whole`` row; the others are the rows of their conv_id in
    order of shard and piece, and their concatenation is the conversation.
    Turns go by ``turn`` (null first), then role and text.  A null role or text is
    an empty one; rows without conv_id are one conversation; repeated rows are
    separate turns.  An empty table gives no rows; other columns are ignored.
    """
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    shards = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that little text is not gathered into one task
    return given.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_format(tokenizer), _FORMATTED)


def _read(path: str):
    """Plain turns and learned text of each piece, from its ids and mask; of a whole conversation their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = chat(path)
        for batch in batches:
            turns, loss, learned, chars = [], [], [], []
            ids, mask, whole = batch.column("ids"), batch.column("loss"), batch.column("whole").to_pylist()
            for i in range(batch.num_rows):
                own, text, n = made.read(ids[i].values.to_numpy(), mask[i].values.to_numpy(zero_copy_only=False))
                plain = "".join(f"{r}\n{t}\n" for r, t in own)
                turns.append(sha256(plain.encode()).hexdigest() if whole[i] else plain), loss.append(sha256(text.encode()).hexdigest() if whole[i] else text)
                learned.append(len(text)), chars.append(n)
            columns = [*(batch.column(c) for c in ("conv_id", "shard", "piece", "whole", "n_turns")), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(learned, pa.int64()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _READ.split(", ")])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests over the pieces of each conversation, which come in order; only hashes are held."""
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    key, n, chars, learned, turns, loss = None, 0, 0, 0, sha256(), sha256()

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out = []
        for conv, whole, m, own, text, more, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "whole", "n_turns", "turns", "loss", "learned", "chars")), strict=True):
            if whole:
                out.append((conv, m, own, more, text, length))
                continue
            if (conv,) != key:
                if key is not None:
                    out.append((key[0], n, turns.hexdigest(), learned, loss.hexdigest(), chars))
                key, n, chars, learned, turns, loss = (conv,), 0, 0, 0, sha256(), sha256()
            n, chars, learned = n + m, chars + length, learned + more
            turns.update(own.encode()), loss.update(text.encode())
        if out:
            yield packed(out)
    if key is not None:
        yield packed([(key[0], n, turns.hexdigest(), learned, loss.hexdigest(), chars)])


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what :func:`format_conversations` made, from its tokens and masks alone.

    conv_id, n_turns, turns_sha256 (role and text of each turn, a line end after
    each), loss_chars and loss_sha256 (all text under the mask), formatted_chars.
    Digests of whole rows are taken where they lie; only pieces are shuffled, and a
    digest runs over a conversation's pieces in order without holding them.
    """
    read = formatted.select("conv_id", "shard", "piece", "whole", "n_turns", "ids", "loss").mapInArrow(_read(tokenizer), _READ)
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "shard", "piece")
    return dealt.mapInArrow(_joined, _DIGEST)
