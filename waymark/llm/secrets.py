"""Secret scan: automata inferred from labelled credentials score every candidate.

The base patterns find credentials of three kinds.  A bounded sample of their
values, with ordinary tokens of the same texts as background, trains
probabilistic automata: prefix trees over character classes whose states are
merged where Hoeffding's bound does not tell their futures apart.  Ordinary
tokens hold unlabelled credentials too: those that the formats explain far better
leave the background, which is then inferred again.  Every other candidate of the
whole text is scored by its likelihood under each format against the background;
likely ones become spans of kind ``format``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.sampling import smallest
from waymark.llm.spans import Cover, Span, digest, joined

KINDS = ["assign", "access", "hex"]
ADDED = "format"
#: Bounds of the training sample: values per kind, and background tokens.
SAMPLE_VALUES, SAMPLE_BACKGROUND = 400, 4000
#: Confidence of the merge test.
ALPHA = 0.05
#: Bounds of the driver's memory in training only: characters of a value that travel, and symbols of a prefix tree.
#: Scoring reads every character.  A value that is cut here has no end there.
MOST_SENT, MOST_TREE = 4096, 400_000
#: Log-likelihood ratio (nats) of the whole candidate, and of it per character, from which it is a span: the first
#: stands for how rare credentials are among tokens, the second for how far models may err over a long token.
LEAST_ODDS, LEAST_PER_CHARACTER = 8.0, 0.15
#: Rounds at most in which the background sheds what the formats explain.
SHEDDING = 3

# The base patterns of the three kinds.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones fail either way
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")  # the shortest value of a kind has 8 characters
_PART = re.compile(r"[A-Za-z0-9+_-]{8,}")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def base_value(text: str, span: Span) -> str:
    """The credential itself, without the name it is assigned to."""
    found = text[span[1] : span[2]]
    return _ASSIGN.match(found)[2] if span[0] == "assign" else found


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens as long as the shortest credential; generous on purpose."""
    return [m.span() for m in _CANDIDATE.finditer(text)]


def _symbol(c: str) -> str:
    if c.isdigit():
        return "9"
    if "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "l"
    if "A" <= c <= "Z":
        return "U"
    return c


_SYMBOLS = str.maketrans({chr(c): _symbol(chr(c)) for c in range(128)})
_CLASS_SIZE = {"9": 10, "h": 6, "l": 20, "U": 26}


def symbols(word: str) -> str:
    """The character classes that an automaton reads."""
    return word.translate(_SYMBOLS)


def _limit(lengths: list[int], most: int) -> int:
    """The greatest length at which words may be cut so that ``most`` symbols are left; none is cut if all fit."""
    left, n = most, len(lengths)
    for i, x in enumerate(sorted(lengths)):
        if x * (n - i) > left:
            return left // (n - i)
        left -= x
    return max(lengths, default=0)


class Automaton:
    """A probabilistic automaton inferred by state merging from labelled strings."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        limit = _limit([len(w) for w in words], MOST_TREE)
        for word in words:
            state = 0
            for c in symbols(word[:limit]) + "$" * (len(word) <= min(limit, MOST_SENT)):
                self.count[state][c] += 1
                if c == "$":
                    break
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][c]
        self._merge(alpha)
        self.total = [sum(c.values()) for c in self.count]

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """Whether the futures of two states are told apart by Hoeffding's bound, one symbol at a time."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = sum(self.count[a].values()), sum(self.count[b].values())
            if not na or not nb:
                continue
            gap = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a][c] / na - self.count[b][c] / nb) > gap:
                    return True
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b] and self.next[a][c] != self.next[b][c]]
        return False

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    if self.next[a][c] != t:
                        todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if not self._differ(r, state, bound):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    blue += [(r, d) for d in sorted(self.next[r]) if self.next[r][d] not in red and (r, d) not in blue]
                    break
            else:
                red.append(state)
                blue += [(state, d) for d in sorted(self.next[state])]

    def log_likelihood(self, word: str) -> float:
        """Log probability of all characters and of ending there, smoothed for unseen symbols."""
        return self.log_likelihood_of(symbols(word))

    def log_likelihood_of(self, classes: str) -> float:
        """The same for a word's character classes."""
        state, out = 0, 0.0
        for c in classes + "$":
            out += math.log((self.count[state][c] + 0.05) / (self.total[state] + 0.05 * 40)) - math.log(_CLASS_SIZE.get(c, 1))
            state = self.next[state].get(c, 0)  # after an unseen symbol the rest is read from the start
        return out


class Formats:
    """Automata of the credential formats and of ordinary tokens."""

    def __init__(self, values: dict[str, list[str]], background: list[str]):
        self.formats = {k: Automaton(v) for k, v in sorted(values.items()) if v}
        self.background = Automaton(self._plain(background))
        self._known: dict[str, tuple[float, str]] = {}

    def _plain(self, background: list[str]) -> list[str]:
        """The background without what the formats explain far better; a half of it judges the other, as none knows its own tokens."""
        halves = [sorted(set(background))[k::2] for k in (0, 1)]
        plain = halves
        for _ in range(SHEDDING):
            other = [Automaton(part) for part in plain[::-1]]
            kept = [[w for w in part if not self._far(self._best(symbols(w)) - a.log_likelihood(w), len(w))] for part, a in zip(halves, other, strict=True)]
            if kept == plain or not all(kept):
                break
            plain = kept
        return plain[0] + plain[1]

    def _best(self, classes: str) -> float:
        return max((f.log_likelihood_of(classes) for f in self.formats.values()), default=-math.inf)

    @staticmethod
    def _far(odds: float, n: int) -> bool:
        return odds >= max(LEAST_ODDS, LEAST_PER_CHARACTER * (n + 1))

    def judged(self, token: str) -> tuple[float, str]:
        """Log-likelihood ratio of the best format against the background, over the whole token, and that format."""
        classes = symbols(token)
        out = self._known.get(classes)
        if out is None:
            best, kind = max((f.log_likelihood_of(classes), k) for k, f in self.formats.items())
            out = best - self.background.log_likelihood_of(classes), kind
            if len(classes) <= 64 and len(self._known) < 100_000:  # a worker's memory; others are computed again
                self._known[classes] = out
        return out

    def odds(self, token: str) -> float:
        return self.judged(token)[0]

    def is_likely(self, token: str) -> bool:
        """Whether a token is far more likely under a format than as an ordinary token."""
        return self._far(self.odds(token), len(token))

    def likely(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """The token itself if it is likely, else its likely parts between ``/``, ``=`` and ``.``."""
        if self.is_likely(text[a:b]):
            return [(a, b)]
        parts = [m.span() for m in _PART.finditer(text, a, b)]
        return [(x, y) for x, y in parts if (x, y) != (a, b) and self.is_likely(text[x:y])]


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class _Least:
    """The distinct values of least hash, SAMPLE_BACKGROUND at most; twice as many are held."""

    def __init__(self):
        self.held: dict[str, int] = {}
        self.top = math.inf

    def add(self, values: set[str]) -> None:
        for v in values:
            if v not in self.held and (h := _hash(v)) <= self.top:
                self.held[v] = h
                if len(self.held) >= 2 * SAMPLE_BACKGROUND:
                    self.cut()

    def cut(self) -> None:
        if len(self.held) > SAMPLE_BACKGROUND:
            self.held = dict(sorted(self.held.items(), key=lambda x: (x[1], x[0]))[:SAMPLE_BACKGROUND])
            self.top = max(self.held.values())


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each kind, and of all ordinary tokens, the distinct values of least hash in a partition."""
    least = {k: _Least() for k in [*KINDS, "background"]}
    for batch in batches:
        seen: dict[str, set[str]] = {k: set() for k in least}
        for text in batch.column(0):
            text = text.as_py()
            if not text:
                continue
            spans = base_spans(text)
            for s in spans:
                seen[s[0]].add(base_value(text, s))
            if spans:
                taken = Cover(spans)
                seen["background"].update(text[a:b] for a, b in candidates(text) if not taken.touches(a, b))
            else:
                seen["background"].update(_CANDIDATE.findall(text))
        for k, values in seen.items():
            least[k].add(values)
    for k, own in least.items():
        own.cut()
        values = [v[: MOST_SENT + 1] for v in own.held]
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(values), pa.string()), pa.array(values, pa.string()), pa.array(own.held.values(), pa.int64())], ["kind", "value", "h"])


def learn_formats(docs: DataFrame) -> Formats | None:
    """Infer the automata from a bounded sample of distinct values, chosen by hash; None without values or background."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_samples, "kind string, value string, h long")
    rows: dict[str, list[str]] = {}
    for r in sorted(smallest(found.distinct(), "kind", "h", SAMPLE_BACKGROUND).collect()):  # four kinds
        rows.setdefault(r["kind"], []).append(r["value"])
    background = rows.pop("background", [])
    if not rows or not background:
        return None
    return Formats({k: sorted(v, key=lambda x: zlib.crc32(x.encode()))[:SAMPLE_VALUES] for k, v in rows.items()}, background)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long, top_format string, top_odds double, odds_sha256 string"


def _scan(formats: Formats | None):
    order = [*KINDS, ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                base = base_spans(text)
                more, taken, top = [], Cover(base), None
                number, all_odds = 0, hashlib.sha256()
                for a, b in candidates(text) if formats else ():
                    odds, kind = formats.judged(text[a:b])
                    number += 1
                    all_odds.update(f"{a}:{b}:{kind}:{odds:.2f},".encode())
                    top = max(top or (odds, kind), (odds, kind))
                    if not taken.touches(a, b):
                        more += [(ADDED, x, y) for x, y in formats.likely(text, a, b)]
                n = Counter(k for k, _, _ in base)
                seen = (number, top and top[1], top and round(top[0], 4), all_odds.hexdigest())
                rows.append((doc_id, n["assign"], n["access"], n["hex"], digest(base, KINDS), joined(base + more, order), *seen))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of ``docs(doc_id, text)``.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans, which also
    holds the added spans of kind ``format``.  What the automata say of every candidate
    shows in n_candidates, in the largest log-likelihood ratio and its format
    (top_odds, top_format), and in odds_sha256, the digest of start:end:format:ratio
    (two decimals) and a comma for each in order.  Null text is empty; repeated rows
    and null doc_ids are rows of their own; an empty table gives no rows; other
    columns are ignored.  Without any labelled credential, or any ordinary token
    to tell it from, no span is added.
    """
    formats = learn_formats(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(formats), _FOUND)
