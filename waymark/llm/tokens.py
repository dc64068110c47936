"""Token ids of whole texts under a public byte-level BPE file (``tokenizers`` JSON).

Texts are cut where no token of a byte-level BPE can cross: before white space
that follows something else, after a lone line end, and before a stop that
follows a letter.  So a piece's ids are the same in every text, and each worker
encodes a piece once.  Pieces are found, hashed and
gathered in numpy; Python sees each distinct piece of a chunk.  Where the file's merges are
in the order of their ids, new pieces go through ``tiktoken`` with ranks made
from that file, which gives the same ids faster; otherwise, and for pieces that
spell an added token, through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np

from waymark.llm.text import CHUNK, as_bytes, span_hashes

#: Pieces whose ids a worker keeps; beyond that it starts again (memory bound).
KEPT_PIECES = 150_000
# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.;:!?")] = True
_WIDE = np.zeros(256, bool)  # first bytes of the characters among which Unicode has white space
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_encoders: dict[str, PieceEncoder] = {}


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes batches of texts, keeping the ids of the pieces it has seen."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)
        self.known: dict[bytes, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        """The file's own tokenizer, loaded when a piece needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranked(self, spec: dict):
        """A tiktoken encoding of the same vocabulary, or None if its ids are not in merge order."""
        import tiktoken

        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        merged = [vocab[a + b] for a, b in pairs]
        if spec["model"].get("type") != "BPE" or merged != sorted(set(merged)):
            return None
        of = byte_of_char()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _new(self, pieces: set[bytes], plain: bool) -> None:
        known, fast = self.known, self.fast
        for piece in pieces:
            text = piece.decode("utf-8")
            if fast is None or not plain and any(t in text for t in self.added):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = fast(text)
            known[piece] = array("I", ids).tobytes()

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts and each text's offsets into them; a null text has none."""
        ids, counts = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        part: list[bytes] = []
        size = 0
        for t in as_bytes(texts):
            if part and size + len(t) > 4 * CHUNK:
                own, n = self._chunk(part)
                ids.append(own), counts.append(n)
                part, size = [], 0
            part.append(t)
            size += len(t)
        own, n = self._chunk(part)
        return np.concatenate([*ids, own]), np.cumsum(np.concatenate([*counts, n]))

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        raw = b"".join(texts)
        data = np.frombuffer(b"\n\n\n" + raw + b"\n", np.uint8)
        space, wide = _SPACE[data], _WIDE[data]
        n = len(raw)
        here, before, third = slice(3, 3 + n), slice(2, 2 + n), slice(1, 1 + n)
        solid = ~space & ~np.roll(wide, 1) & ~np.roll(wide, 2)  # ends a character that is surely no white space
        cut = space[here] & (data[here] < 128) & solid[before]
        cut |= (data[before] == 10) & ~space[here] & ~wide[here] & solid[third]
        cut |= _STOP[data[here]] & _LETTER[data[before]]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        cut = np.append(cut, False)
        cut[bounds[:-1]] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n) if len(starts) else starts
        _, at, inverse = np.unique(span_hashes(data[here], starts, ends), return_index=True, return_inverse=True)
        spans = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        self._new(set(spans).difference(self.known), not any(t.encode() in raw for t in self.added))
        packed = [self.known[p] for p in spans]
        pool = np.frombuffer(b"".join(packed), np.uint32)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.cumsum(sizes) - sizes
        own = sizes[inverse]
        place = np.concatenate(([0], np.cumsum(own)))
        ids = pool[np.repeat(first[inverse] - place[:-1], own) + np.arange(place[-1])]
        per_text = place[np.searchsorted(starts, bounds)]
        return ids, np.diff(per_text)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
