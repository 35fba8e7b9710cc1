from __future__ import annotations

import random

import pytest

ODD = [None, "", " \t\n", "a", "A a", "ü\U0001f600 x", "word " * 3000, "word " * 3000, "z" * 50_000, "1" * 60_000, "a.b" * 20_000 + "@c", "a@b" + ".c" * 30_000]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of texts, or of (id, text) pairs; with further columns whose names clash with internal ones."""

    def build(texts, parts=3, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, None, None if t is None else len(t), "x", 7, b"y", 1) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, bits int, docs binary, chunk int").repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def prose():
    """120 texts of invented words: clean ones, exact copies but for white space, near copies, and shared passages."""
    r = random.Random(5)
    words = ["".join(r.choice(["ta", "re", "mi", "son", "ul", "che"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [line(r.randint(20, 160)) for _ in range(80)]
    shared = line(50)
    texts += [f"{line(30)} {shared} {line(20)}" for _ in range(8)]
    texts += [texts[0].replace(" ", "\n"), texts[0] + " ", texts[1] + "\t\t", texts[1]]
    for k in range(12):
        near = texts[10 + k].split()
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    texts += [shared + " " + shared, "Mail me at a.b@c.de or +49 30 1234567.", texts[2].upper(), "12 34 !!", texts[1]]
    return texts
