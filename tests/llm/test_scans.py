"""Results of the scans for secrets, personal data and licenses: digests by plain patterns, and judged additions."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from tests.llm.conftest import made_text
from tests.llm.test_corpus import SMALL, _plain8, _plain10
from waymark.llm import boosting, licenses, pii, queries, secrets


def _joined(spans, order):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))


@pytest.mark.parametrize(("name", "plain", "kinds", "added"), [("op8_grammar_inference", _plain8, secrets.KINDS, "format"), ("op10_candidate_boosting", _plain10, pii.KINDS, "likely")])
def test_query_results_equal_plain_patterns(spark, name, plain, kinds, added):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(_joined(base, kinds).encode()).hexdigest()
        own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert {s for s in own if s[0] != added} == set(base) and r["spans"] == _joined(own, [*kinds, added])
        assert not any(a < y and x < b for k, a, b in own if k == added for _, x, y in base)


def _drawn(r, letters, n):
    return "".join(r.choice(list(letters), n))


def test_op8_finds_unlabelled_credentials_and_leaves_plain_tokens(spark):
    """Values of the labelled formats without a name before them are found; numbers, ids, paths and long words are not."""
    r = np.random.default_rng(7)
    hexed, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def secret(k):
        return [lambda: _drawn(r, hexed, 30), lambda: base64.b64encode(r.bytes(30)).decode(), lambda: "tk_" + _drawn(r, hexed + "ghijklmnopqrstuvwxyz", 28)][k]()

    words = "configuration documentation international responsibility administration organisation understanding communication environment development".split()

    def plain(k):
        w = r.choice(words, 6)
        return [
            lambda: _drawn(r, "0123456789", int(r.integers(13, 20))), lambda: f"{w[0]}-{r.integers(1, 99)}", lambda: "/".join(w[:4]) + ".html", lambda: f"https://{w[0]}.example.org/{w[1]}/{w[2]}?page={r.integers(1, 500)}",
            lambda: f"2024-{r.integers(10, 12)}-{r.integers(10, 28)}", lambda: f"{w[0]}_{w[1]}", lambda: "-".join(w[:3]), lambda: f"ISBN-{_drawn(r, '0123456789', 13)}", lambda: f"{w[0].capitalize()}{w[1].capitalize()}", lambda: f"{w[0]}.{w[1]}.{w[2]}",
        ][k]()

    docs, planted, clean = [], {}, {}
    for i in range(900):
        body = f"{made_text(i, 6)} {plain(i % 10)} {r.choice(words)}"
        name = ["password", "token", "secret", "api_key"][i % 4]
        docs.append((i, f"{body} {name} = '{secret(i % 3)}' {plain((i + 3) % 10)} {_drawn(r, upper, 3)} AKIA{_drawn(r, upper, 16)}"))
    for i in range(1000, 1150):
        before, value = f"see {r.choice(words)} ", secret(i % 3)
        docs.append((i, f"{before}{value} {r.choice(words)}"))
        planted[i] = (len(before), len(before) + len(value))
    for i in range(2000, 2200):
        docs.append((i, f"see {plain(i % 10)} and {plain((i + 1) % 10)} end"))
        clean[i] = 1
    rows = {x["doc_id"]: [s.split(":") for s in x["spans"].split(",") if s] for x in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    found = sum(any(k == "format" and int(a) < e and s < int(b) for k, a, b in rows[i]) for i, (s, e) in planted.items())
    wrong = sum(any(k == "format" for k, _, _ in rows[i]) for i in clean)
    assert found >= 0.9 * len(planted), found
    assert wrong <= 0.1 * found, wrong


def test_op8_every_candidate_is_scored(spark):
    """Counts, best format and digest equal a plain evaluation of the automata."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    formats = secrets.learn_formats(docs)
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    for doc_id, text in docs.collect():
        digest, best = hashlib.sha256(), []
        for a, b in secrets.candidates(text):
            classes = secrets.symbols(text[a:b])
            likely = {k: f.log_likelihood_of(classes) for k, f in formats.formats.items()}
            kind = max(likely, key=lambda k: (likely[k], k))
            odds = likely[kind] - formats.background.log_likelihood_of(classes)
            best.append((odds, kind))
            digest.update(f"{a}:{b}:{kind}:{odds:.2f},".encode())
        r = rows[doc_id]
        assert (r["n_candidates"], r["odds_sha256"]) == (len(best), digest.hexdigest())
        assert (r["top_format"], r["top_odds"]) == ((max(best)[1], round(max(best)[0], 4)) if best else (None, None))
    # credentials of the base patterns stand out: the formats explain them better than ordinary tokens do
    hexes = [r["top_odds"] for r in rows.values() if r["n_hex"]]
    assert hexes and min(hexes) > 5


def test_op10_additions_are_right(spark):
    """Personal data just beyond the base patterns is found; order numbers, sums and versions are not."""
    r = np.random.default_rng(11)
    docs, planted, clean = [], {}, set()

    def phone(plus=True):
        a, b, c = r.integers(200, 999), r.integers(200, 999), r.integers(1000, 9999)
        return f"{'+' if plus else ''}1 ({a}) {b}-{c}"

    for i in range(3000):
        word = _drawn(r, "etaoinshrdlu", 6)
        kind = i % 6
        real = [f"call {phone()} now", f"mail {word}.{word[:3]}@{word[::-1]}.example.org please", f"from 10.{r.integers(256)}.{r.integers(256)}.{r.integers(256)} came"]
        other = [f"order {r.integers(10**7, 10**9)} of {word}", f"total {r.integers(10**7, 10**8)} units, {word}", f"version {r.integers(1, 20)}.{r.integers(1, 20)}.{r.integers(1, 20)} of {word}"]
        docs.append((i, (real + other)[kind]))
    for i in range(4000, 4010):  # few beside the right ones: a threshold stands for 95 %
        docs.append((i, f"call {phone(False)} now"))
        planted[i] = 5
    for i in range(5000, 5150):
        docs.append((i, f"order {r.integers(10**7, 10**9)} of {_drawn(r, 'etaoinshrdlu', 6)}"))
        clean.add(i)
    rows = {x["doc_id"]: x["spans"] for x in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    wrong = sum("likely" in rows[i] for i in clean)
    found = sum("likely" in rows[i] for i in planted)
    assert wrong <= 0.05 * len(clean), wrong
    # one format of each kind: enough to judge by
    assert found >= 0.9 * len(planted), (found, wrong)


def test_op10_finds_what_the_base_patterns_just_miss(spark):
    """Phone numbers without their plus and card numbers with a wrong digit, in texts like those of right ones, are found; order numbers are not."""
    r = np.random.default_rng(12)

    def grouped(digits):
        sep, n = r.choice([" ", "-", ""]), int(r.integers(3, 6))
        return sep.join(digits[i : i + n] for i in range(0, len(digits), n))

    def card(right):
        head = "4" + _drawn(r, "0123456789", int(r.integers(13, 18)))
        last = next(d for d in "0123456789" if pii.luhn(head + d))
        return f"{r.choice(['card', 'visa card', 'my card is', 'account:'])} {grouped(head + (last if right else str((int(last) + 3) % 10)))}{r.choice(['', ','])} now"

    def phone(right):
        n = str(r.integers(2, 99)) + " " + grouped(_drawn(r, "123456789", int(r.integers(9, 12))))
        return f"{r.choice(['call', 'phone', 'tel', 'mobile:'])} {'+' if right else ''}{n}{r.choice(['', ','])} today"

    def order():
        n = _drawn(r, "123456789", 16)
        return [f"order {n[: r.integers(7, 13)]} of {_drawn(r, 'etaoinshrdlu', 6)}", f"on 2024-{r.integers(10, 13)}-{r.integers(10, 29)} we sold {n[:8]} units", f"parcel {grouped(n[: r.integers(7, 13)])} sent"][r.integers(3)]

    texts = [card(True) for _ in range(800)] + [phone(True) for _ in range(800)] + [order() for _ in range(800)]
    near = [card(False) for _ in range(16)] + [phone(False) for _ in range(16)]
    far = [order() for _ in range(200)]
    docs = list(enumerate(texts + near + far))
    rows = {x["doc_id"]: x for x in pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    found = [i for i in range(len(texts), len(texts) + len(near)) if "likely" in rows[i]["spans"]]
    wrong = [i for i in range(len(texts) + len(near), len(docs)) if "likely" in rows[i]["spans"]]
    assert len(found) >= 0.9 * len(near), (len(found), len(wrong))
    assert len(wrong) <= 0.01 * len(far), [docs[i] for i in wrong]
    assert all(rows[i]["n_card"] + rows[i]["n_phone"] == 0 for i in found)


def test_op10_every_candidate_is_judged(spark):
    """The columns equal a plain evaluation of the model, base spans included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.learn_redaction(docs)
    assert (model.thresholds < 1).any()
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    judged = 0
    for doc_id, text in docs.collect():
        spans = sorted({*pii.candidates(text), *((a, b) for _, a, b in pii.base_spans(text))})
        x = np.array([pii.features(text, a, b) for a, b in spans])
        p = model.probability(x) if spans else np.zeros(0)
        row = rows[doc_id]
        assert row["scores"] == ",".join(f"{a}:{b}:{v:.3f}" for (a, b), v in zip(spans, p, strict=True))
        assert row["n_candidates"] == len(spans)
        assert row["n_above"] == ((p >= model.thresholds[pii.shapes(x)]).sum() if spans else 0)
        judged += len(spans)
    assert judged > 100


def test_op10_limits_of_a_share():
    low, high = boosting.limits(np.array([0, 5, 30, 300]), np.array([0, 10, 30, 300]))
    assert low[0] == pytest.approx(0, abs=1e-6) and high[0] == pytest.approx(1, abs=1e-6)
    assert low[1] < 0.5 < high[1]
    assert 0.93 < low[2] < 0.96 < low[3] < high[3] <= 1


def test_op10_thresholds_by_shape():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    group = np.arange(2000) % 2
    y = np.where(group == 0, x[:, 1] > 0, r.random(2000) < 0.5).astype(float)  # the second group can't be told
    m = boosting.Calibrated(np.hstack([x, group[:, None]]), y, np.arange(2000) // 2 % 4, 0.97, None, group)
    assert m.thresholds[0] < 1 < m.thresholds[1] == m.thresholds[5]


def _best_alignment(template, words, band):
    """The most words matched in order within the band of any diagonal, by the plain recurrence."""
    best = 0
    for d in range(-len(template) + 1, len(words)):
        t = {}
        for i in range(len(template) + 1):
            for j in range(len(words) + 1):
                if i and j and template[i - 1] == words[j - 1] and abs(j - 1 - (i - 1) - d) <= band:
                    t[i, j] = t[i - 1, j - 1] + 1
                else:
                    t[i, j] = max(t.get((i - 1, j), 0), t.get((i, j - 1), 0))
        best = max(best, t[len(template), len(words)])
    return best


def test_op6_edited_notices_by_brute_force(spark):
    """Notices with 10, 20 and 30 % of their words replaced; each reported stretch is as good as the best banded alignment."""
    r = np.random.default_rng(5)
    names = ["apache-2.0-notice", "mit", "gpl-notice", "mpl-2.0-notice", "isc-text"]
    docs, kind = [], {}
    for i in range(150):
        words = licenses.TEMPLATES[names[i % 5]].split()
        share = (0.1, 0.2, 0.3)[i // 5 % 3]
        for p in r.choice(len(words), int(share * len(words)), replace=False):
            words[p] = f"other{r.integers(100)}"
        docs.append((i, f"{made_text(i, 20)} {' '.join(words)} {made_text(i + 1, 20)}"))
        kind[i] = (names[i % 5], share)
    rows = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(x["doc_id"], x["template"]): x for x in rows}
    hit = {s: np.mean([(i, n) in got for i, (n, share) in kind.items() if share == s]) for s in (0.1, 0.2, 0.3)}
    assert hit[0.1] == 1 and hit[0.2] >= 0.95 and hit[0.3] >= 0.6, hit
    for i in (1, 6, 11):  # "mit", at each share
        name, text = kind[i][0], docs[i][1]
        x = got.get((i, name))
        if x is not None:
            template, words = licenses.TEMPLATES[name].lower().split(), text.lower().split()
            assert x["matched_words"] == _best_alignment(template, words, licenses.BAND)
            assert text[x["start"] : x["end"]].split()[0].lower() in template and x["template_words"] == len(template)


def test_op6_many_templates_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_TEMPLATE_WORDS", 40)
    parts = licenses.template_parts(licenses.TEMPLATES)
    assert len(parts) > 5 and sum(map(len, parts)) == len(licenses.TEMPLATES)
    docs = spark.createDataFrame(list(enumerate(licenses.TEMPLATES.values())), "doc_id long, text string")
    exact = {(r["doc_id"], r["template"]) for r in licenses.scan_licenses(docs).where("coverage = 1").collect()}
    assert {(i, k) for i, k in enumerate(licenses.TEMPLATES)} <= exact
    assert licenses.scan_licenses(docs, {}).collect() == []


def test_pii_sample_is_not_swamped_by_repeats(spark):
    """Thousands of copies of one number are one vector with a count; each other kind still reaches the sample."""
    docs = [(i, "no 4785380592391139 here") for i in range(3000)] + [(5000 + i, f"mail a{i}@mail.example.org and {10**7 + i * 7919} units") for i in range(60)]
    rows = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 3060 and sum(r["n_email"] for r in rows) == 60


def test_op10_learns_from_every_candidate(spark, monkeypatch):
    """With far more distinct vectors than rows to learn from, each class and shape still weighs what all texts hold."""
    r = np.random.default_rng(21)
    docs = [f"{_drawn(r, 'etaoinshrdlu', int(r.integers(1, 30)))}@{_drawn(r, 'etaoin', int(r.integers(2, 20)))}.example.org" for _ in range(500)]
    docs += [f"sum {_drawn(r, '123456789', int(r.integers(7, 13)))}{_drawn(r, ' ,x-', 1)} of {_drawn(r, 'etaoin', 5)}" for _ in range(900)]
    docs += [f"version {a}.{b}.{c} is out" for a, b, c in r.integers(1, 99, (7, 3))] + [f"call +1 (649) 555-{n} now" for n in r.integers(1000, 9999, 30)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    seen = {}

    class Spy(boosting.Calibrated):
        def __init__(self, x, y, fold, precision, weight=None, group=None):
            seen.update(x=x, y=y, weight=weight)
            super().__init__(x, y, fold, precision, weight, group)

    monkeypatch.setattr(pii, "Calibrated", Spy)
    monkeypatch.setattr(pii, "SAMPLE_CANDIDATES", 60)
    assert pii.learn_redaction(df) is not None
    expected = {}
    for text in docs:
        base = pii.base_spans(text)
        real, cover = {(a, b) for _, a, b in base}, pii.Cover(base)
        for a, b in pii.candidates(text):
            if (a, b) in real or not cover.touches(a, b):
                key = ((a, b) in real, int(pii.shapes(np.array([pii.features(text, a, b)]))[0]))
                expected[key] = expected.get(key, 0) + 1
    got = {}
    for y, shape, n in zip(seen["y"], pii.shapes(seen["x"]), seen["weight"], strict=True):
        got[bool(y), int(shape)] = got.get((bool(y), int(shape)), 0) + n
    assert got == expected and len(seen["x"]) <= 60
