from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        asked = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in set(terms(text)) if df[w]}
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def ask(spark, make, docs, items, **how):
    index = lexical.build(make(docs), **how)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, terms string, key long").repartition(2)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(index, table).collect()), key=key)


@pytest.mark.parametrize("how", [{}, {"block_docs": 7}, {"block_bytes": 900}])
def test_ranks_equal_brute_force(spark, make, odd, prose, how):
    texts = odd + prose + ["hot word " * 3] * 40 + ["Ärger ärger ÄRGER x_y-z 3.14 İstanbul \U0001f600\U0001f600 ǅ", "Orre " * 2000]
    docs = list(enumerate(texts)) + [(3, "A a again"), (None, "hot word"), (None, None)]
    r = random.Random(2)
    items = [(i, " ".join(r.sample(prose[i].split(), min(12, len(prose[i].split()))))) for i in range(70)]
    items += [(100, "hot"), (101, None), (102, "nowhere-at-all"), (103, "Hot, HOT word!"), (104, "ÄRGER x y"), (104, "ärger"), (None, "orre \U0001f600\U0001f600"), (105, " ".join(prose[:30]))]
    assert ask(spark, make, docs, items, **how) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark, make):
    assert ask(spark, make, [], [(1, "a")]) == []
    assert ask(spark, make, [(1, None), (2, " .")], [(1, "a")]) == []
    assert ask(spark, make, [(1, "a b")], []) == []
    assert ask(spark, make, [(1, "a b")], [(1, None)]) == []


def test_many_batches_give_the_same(spark, make, prose, monkeypatch):
    docs, items = list(enumerate(prose)), [(i, prose[i]) for i in range(40)]
    monkeypatch.setattr(lexical, "BATCH_TERMS", 100)
    monkeypatch.setattr(lexical, "BROADCAST_BATCHES", 1)
    assert ask(spark, make, docs, items) == sorted(brute(docs, items), key=key)


def test_blocks_are_written_and_read_one_by_one(make, prose, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_BYTES", 1 << 10, raising=False)
    index = lexical.build(make(list(enumerate(prose))).coalesce(1), block_docs=8)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in index.blocks.inputFiles()]
    groups = [f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)]
    assert sum(groups) == index.blocks.count() >= 4 and max(groups) == 1


def test_slices_add_and_select():
    r = np.random.default_rng(0)
    value = r.integers(0, 1 << 33, (3, 100))
    value[1, 20:60] = value[1, 5]
    value[2, 4:] = 0
    total = []
    for part in (value // 3, value // 3, value - 2 * (value // 3), np.zeros_like(value)):
        row, doc = np.nonzero(part >= 0)
        lexical.add(total, lexical._slices(row, doc, part[row, doc], 3, 2))
    got = np.unpackbits(lexical.best(total, 10).view(np.uint8), axis=1, bitorder="little")
    for i in range(3):
        want = [d for d in sorted(range(100), key=lambda d: (-value[i, d], d))[:10] if value[i, d] > 0]
        assert np.flatnonzero(got[i]).tolist() == sorted(want)
    assert (sum(np.unpackbits(t.view(np.uint8), axis=1, bitorder="little")[:, :100].astype(np.int64) << b for b, t in enumerate(total)) == value).all()


def test_long_texts_do_not_overflow():
    got = lexical.impacts(np.array([5, 1]), np.array([10**9, 3]), 10**10, 10**13)
    assert got.tolist() == [5 * 10**9 // (5000 + 8 * (10 + 90 * 10**9 * 10**10 // 10**13)), 10**9 // (1000 + 8 * (10 + 90 * 3 * 10**10 // 10**13))]
