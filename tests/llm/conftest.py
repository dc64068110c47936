"""Odd inputs that every corpus operator must take."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def made_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, white and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, made_text(1, 40_000)), (7, made_text(2, 60)), (7, made_text(2, 60)), (8, made_text(2, 60).upper()),
        (None, made_text(3, 30)), (None, None), (9, "12345 678"), (10, "mail a@b.example.org now"), (11, "password=hunter2hunter2 x"), (12, "été à la plage et l'île"),
    ]
    clash = "root long, key string, part int, block int, h long, n long, score double, b long, label string, lang string, source string, n_chars long, pos int, token string, length long"
    names = [c.split()[0] for c in clash.split(", ")]
    full = [(i, t, *(("en" if k % 2 else "fr") if c == "lang" else None for c in names)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, {clash}").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
