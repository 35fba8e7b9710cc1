from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def cut(types):
    n = Counter(types)
    if not all(n[k] for k in (1, 2, 3, 4)):
        return [0, 0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]


def brute(docs):
    """Counts and probabilities by plain dictionaries."""
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    pairs, c = Counter(), Counter()
    for i, text in docs:
        if not held[i]:
            seq = tokens(text)
            c.update(seq)
            pairs.update(zip([END, *seq[:-1]], seq, strict=True))
    follows, met = defaultdict(Counter), Counter(w for _, w in pairs)
    for (v, w), n in pairs.items():
        follows[v][w] = n
    d, e, n_all, v_all = cut(pairs.values()), cut(met.values()), sum(c.values()), len(c)

    def lower(w):
        left = sum(e[min(a, 3)] for a in met.values()) / len(pairs)
        return (met[w] - e[min(met[w], 3)]) / len(pairs) + left / (v_all + 1)

    def p(v, w):
        if v not in follows:
            return lower(w)
        total = sum(follows[v].values())
        return max(follows[v][w] - d[min(follows[v][w], 3)], 0) / total + sum(d[min(n, 3)] for n in follows[v].values()) / total * lower(w)

    out = []
    for i, text in docs:
        seq = tokens(text)
        base = sum(math.log10((c[w] + 1) / (n_all + v_all + 1)) for w in seq)
        score = sum(math.log10(p(v, w)) for v, w in zip([END, *seq[:-1]], seq, strict=True)) if pairs else 0.0
        out.append((i, held[i], len(seq), sum(c[w] > 0 for w in seq), n_all, base, score))
    return out, p, c


def agree(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:7] for g in got], [w[5:7] for w in want], rtol=1e-9, atol=1e-9)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize(("parts", "chunk"), [(1, 12 << 20), (6, 3000)])
def test_scores_equal_brute_force(spark, make, odd, prose, parts, chunk, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    docs = list(enumerate(odd + prose + [None, "Hot HOT hot", "hot"] * 30 + ["Ünï ünï   x y \U0001f600"])) + [(3, "once more"), (None, "hot a b"), (None, None)]
    got = lm.score_corpus(make(docs, parts)).select(*COLUMNS).collect()
    want, p, c = brute(docs)
    agree(got, want)
    assert any(g.held_out for g in got) and not all(g.held_out for g in got)
    for v in [END, *list(c)[:5]]:
        assert abs(sum(p(v, w) for w in c) + p(v, "a word never met") - 1) < 1e-9


def test_nothing_to_learn_from(make):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = [(i, "a b") for i in held] + [(None, "c")]
    agree(lm.score_corpus(make(docs)).select(*COLUMNS).collect(), brute(docs)[0])
    assert lm.score_corpus(make([])).count() == 0


def test_a_model_scores_other_texts(make, prose):
    model = lm.train(make(prose))
    got = {r.doc_id: r for r in lm.score(make([(1, prose[0]), (2, " ".join(reversed(prose[0].split()))), (3, "never met")]), model).collect()}
    assert got[1].score > got[2].score and got[3].n_known == 1 and got[1].perplexity < got[2].perplexity


def test_planes_and_ranges_round_trip():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (lm._values(lm._planes(x), np.uint64) == x).all()
    rows = [np.array(v, np.uint64) for v in ([0, 255], [256, 1], [65536, 2], [1 << 40, 3])]
    got, size = lm._unpacked(lm._packed(*rows) + b"more", 2, 4)
    assert (got == np.stack(rows)).all() and size == 4 + 2 * (1 + 2 + 4 + 8)
    assert lm._unpacked(lm._packed(np.zeros(0, np.uint64)), 0, 1)[0].shape == (1, 0)
    of = lm.shard_of(np.sort(x), 13)
    assert (np.diff(of) >= 0).all() and of.min() >= 0 and of.max() < 13
