from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, langid, pii, simhash, substring
from sparkloom.llm._xxh64 import xxh64
from sparkloom.llm.components import components, fold_labels

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reach(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- exact ------------------------------------------------------------------------------------------------------------


def exact_brute(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append(i)
    out = {}
    for plain, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(plain.encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_exact_equals_brute_force(make, odd, prose, parts):
    texts = odd + prose + ["hot"] * 60
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decide(make(texts, parts)).collect()}
    assert got == exact_brute(texts)


def test_exact_repeated_rows_and_null_ids(make):
    docs = make([(1, "a b"), (1, "a b"), (None, "ab"), (2, "c"), (None, "c")])
    rows = exact_dedup.decide(docs).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert {r.keep_id for r in rows if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()} == {1}
    kept = exact_dedup.deduplicate(docs).collect()
    assert sorted(r.text for r in kept) == ["a b", "c"]


def test_exact_empty_and_columns(make):
    docs = make(["a"]).where("false")
    assert exact_dedup.decide(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0
    assert exact_dedup.deduplicate(make(["a", "a "])).columns == docs.columns


# --- SimHash ----------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_xxh64_equals_the_library():
    data = bytes(range(256)) * 3
    start = np.arange(0, 400)
    length = np.arange(400) % 101
    want = [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
    assert xxh64(np.frombuffer(data, np.uint8), start, length, 42).tolist() == want


def test_fingerprints_equal_brute_force(odd, prose):
    texts = [t for t in odd if not t or len(t) < 20_000] + prose
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]


def test_trie_pairs_equal_all_pairs():
    r = np.random.default_rng(3)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 300, dtype=np.uint64), (r.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)))]))
    got = {tuple(sorted(map(int, p))) for i, j in simhash.trie_pairs(keys, np.array([0]), np.array([len(keys)]), None, 0, 4) for p in zip(i, j, strict=True)}
    want = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if bin(int(keys[a] ^ keys[b])).count("1") <= 4}
    assert got == want and len(want) > 1000


def test_near_duplicates_equal_brute_force(make, odd, prose, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.pair_tasks.SMALL", 20)
    texts = [t for t in odd if not t or len(t) < 20_000] + prose
    f = [fingerprint(t) for t in texts]
    pairs = [(a, b) for a in range(len(f)) for b in range(a) if bin(f[a] ^ f[b]).count("1") <= 4]
    want = dict(enumerate(reach(len(f), pairs)))
    rows = simhash.near_duplicates(make(texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.bits & (1 << 64) - 1 for r in rows} == dict(enumerate(f))


def test_link_splits_hot_groups_without_losing_links(spark):
    r = np.random.default_rng(0)
    base = int(r.integers(0, 1 << 62))
    keys = sorted({base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(20, 63, (3000, 2))} | set(map(int, r.integers(0, 1 << 62, 3000))))
    edges = simhash.link(spark.createDataFrame([(k,) for k in keys], "bits long"))
    roots = {x.node: x.root for x in components(edges).collect()}
    a = np.array(keys, np.uint64)
    label = np.arange(len(a))
    for i in range(len(a)):
        j = np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1
        label = fold_labels(label, np.full(len(j), i), j)
    groups = defaultdict(set)
    for k, x in zip(keys, label, strict=True):
        groups[x].add(k)
    got = defaultdict(set)
    for k in keys:
        got[roots.get(k, k)].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}


def test_similar_texts_equal_brute_force(make, prose, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.pair_tasks.SMALL", 20)
    hub = " ".join(f"hub{i % 97}x{i}" for i in range(150)).split()
    copies = [" ".join([*hub[:k], "other", *hub[k + 1 :]]) for k in range(0, 150, 3)]  # 0.93 with the hub, less with each other
    texts = [None, "", "a b", *prose, " ".join(hub), *copies, " ".join(hub[:75] + prose[0].split())]
    w = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = reach(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if near(sets[a], sets[b])])
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(make(texts)).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts) - 50
    assert {r.doc_id for r in simhash.deduplicate(make(texts)).collect()} == set(want)


def test_rows_that_repeat_an_id_are_decided_one_by_one(make):
    a, b = "one two three four five six seven", "entirely other words stand in this text here"
    docs = make([(1, a), (1, a + " "), (1, b), (None, b), (None, "x"), (None, "x"), (7, a)])
    for kept in (simhash.deduplicate(docs), exact_dedup.deduplicate(docs)):
        assert sorted(r.text.strip() for r in kept.collect()) == sorted([a, b, "x"]) and kept.columns == docs.columns


CLASH = ["_sha", "_points", "_rank", "_kept", "row_number", "gone_id", "_spans", "spans", "hits_ip", "_hits_ip", "component_id", "node", "root"]


@pytest.mark.parametrize("apply", [exact_dedup.deduplicate, simhash.deduplicate, pii.redact, langid.keep_identified])
def test_stages_keep_columns_whatever_their_names_and_take_empty_tables(spark, apply):
    rows = [(i, t, "en", *range(len(CLASH))) for i, t in enumerate(["a b c d e f", "a b c d e f ", None, "", "mail x@y.zz 1.2.3.4", "m n"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASH))
    out = apply(docs)
    assert out.columns == docs.columns and all(r[3:] == tuple(range(len(CLASH))) for r in out.collect())
    assert apply(docs.where("false")).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), *docs.columns[1:])
    # Ids that are no whole numbers count as none; languages aren't learned from such rows, so that none is known.
    assert (apply(named).count() > 0) == (apply is not langid.keep_identified)


def test_simhash_null_ids_empty_table_and_columns(make):
    docs = make([(None, "a b c d"), (4, "a b c d"), (9, "A b c d")])
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(0, 4), (4, 4), (9, 4)]
    assert sorted((r.doc_id or 0) for r in simhash.deduplicate(docs).collect()) == [4]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 200)] + [(500, 501), (501, 500), (7, 7), (900, 900)], []])
def test_components(spark, edges):
    rows = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(rows) == nodes
    label = reach(1000, edges)
    for a in nodes:
        for b in nodes:
            assert (rows[a] == rows[b]) == (label[a] == label[b])


# --- substrings -------------------------------------------------------------------------------------------------------


def repeats_brute(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("window", "seed"), [(35, 8), (12, 8), (9, 3)])
def test_repeats_equal_brute_force(make, odd, prose, window, seed, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.substring.SHARD_BYTES", 500)
    texts = odd + prose
    rows = substring.remove_repeats(make(texts), window, seed, with_text=True).collect()
    want = repeats_brute(texts, window)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256, r.text) == want[r.doc_id], r.doc_id
    assert len(rows) == len(texts) and sum(x[1] for x in want) > 0


def test_words_are_removed_by_matches_alone(make, prose, monkeypatch):
    from sparkloom.llm._shared import utf8

    texts = [prose[3], f"first {prose[3]} last", prose[4]]
    chunk = substring._Chunk(utf8(pa.array(texts)), 12)
    none = np.zeros(0, np.uint8)
    assert substring._marked(chunk, none).sum() == 2 * len(prose[3].split())
    found = substring._occurrences
    monkeypatch.setattr(substring, "_occurrences", lambda w, patterns, window: found(w, patterns, window)[:0])
    assert substring._marked(chunk, none).sum() == 0


def test_colliding_hashes_change_nothing(prose, monkeypatch):
    from sparkloom.llm._shared import utf8

    keys = substring._Chunk.window_keys

    def weak(self, at):
        out = keys(self, at)
        out["a"] = (out["a"] >> np.uint64(1) & np.uint64(3)) << np.uint64(1)
        return out

    def worst(self, at):
        return np.zeros(len(at), substring._KEY)

    texts = [prose[3], f"first {prose[3]} last", prose[4], prose[5]]
    chunk, sent = substring._Chunk(utf8(pa.array(texts)), 12), np.frombuffer((prose[5] + "\n" + prose[6] + "\n").encode(), np.uint8)
    want = substring._marked(chunk, sent)
    assert want.sum() == 2 * len(prose[3].split()) + len(prose[5].split())
    monkeypatch.setattr(substring._Chunk, "window_keys", weak)
    assert (substring._marked(chunk, sent) == want).all()
    monkeypatch.setattr(substring._Chunk, "window_keys", worst)
    assert not (substring._marked(chunk, sent) & ~want).any()  # nothing is removed that doesn't recur, whatever the hashes


def test_repeats_empty_table(make):
    assert substring.remove_repeats(make(["a"]).where("false")).count() == 0
