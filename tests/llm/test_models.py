from __future__ import annotations

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkloom.llm._shared import tokenizer_path
from sparkloom.llm import itq, kneser_ney, langid, packing, sentencepiece_codec, sharding
from sparkloom.llm.queries import PIECES, VOCABULARY


# --- sharding ---------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_complete(make, odd, prose):
    texts = odd + prose * 8
    rows = sharding.shard(make(texts), 7, 64).collect()
    assert len(rows) == len(texts)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
        load[r.shard] += r.size
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    slots = Counter()
    for r in rows:
        slots[r.virtual_slot] += r.size
    assert max(load.values()) - min(load.get(s, 0) for s in range(7)) <= max(slots.values())


def test_rebalance_moves_little_and_stays_even(spark):
    stats = spark.createDataFrame([(i, 1000 + 7 * i % 300, 3) for i in range(400)], "virtual_slot int, bytes long, rows long")
    first = sharding.build_map(stats, 8).cache()
    second = sharding.rebalance(first, 9, 2).cache()
    assert first.count() == second.count() == 400
    load = [r.b for r in second.groupBy("shard").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "b").collect()]
    assert len(load) == 9 and max(load) - min(load) <= 1400
    moved = first.alias("a").join(second.alias("b"), "virtual_slot").where("a.shard <> b.shard").selectExpr("sum(a.bytes)").first()[0]
    assert moved <= sum(load) / 9 + 9 * 1400
    gone = sharding.rebalance(second, 8, 3)
    assert {r.shard for r in gone.select("shard").distinct().collect()} == set(range(8))


def test_map_versions_are_stored_once(spark, tmp_path):
    stats = spark.createDataFrame([(i, 10, 1) for i in range(20)], "virtual_slot int, bytes long, rows long")
    path = str(tmp_path / "map")
    first = sharding.save_map(sharding.build_map(stats, 2), path, 1)
    sharding.save_map(sharding.rebalance(first, 3, 2), path, 2)
    assert {r.shard for r in sharding.load_map(spark, path).collect()} == {0, 1, 2}
    assert {r.shard for r in sharding.load_map(spark, path, 1).collect()} == {0, 1}
    with pytest.raises(AnalysisException):
        sharding.save_map(first, path, 2)
    assert sharding.load_map(spark, path, 2).count() == 20


def test_shards_are_the_longest_first_fold_of_slots(make, prose):
    rows = sharding.shard(make(prose * 3), 5, 32).collect()
    size, to = Counter(), {}
    for r in rows:
        size[r.virtual_slot] += r.size
        to.setdefault(r.virtual_slot, set()).add(r.shard)
    load, want = [0] * 5, {}
    for b, slot in sorted(((b, s) for s, b in size.items()), reverse=True):
        want[slot] = {load.index(min(load))}
        load[load.index(min(load))] += b
    assert to == want


def test_sharding_null_ids_repeats_and_empty(make):
    assert sharding.shard(make([(None, "a"), (None, None), (1, "x"), (1, "x")]), 3).count() == 4
    assert sharding.shard(make(["a"]).where("false"), 3).count() == 0


# --- Kneser-Ney -------------------------------------------------------------------------------------------------------


def kn_brute(trusted, texts):
    n, cap = kneser_ney.ORDER, (1 << kneser_ney.BITS) - 1

    def grams(t):
        s = [0] * (n - 1) + [min(ord(c) + 2, cap) for c in t] + [1]
        return [tuple(s[i : i + n]) for i in range(len(s) - n + 1)] if t else []

    levels = [Counter(g for t in trusted for g in grams(t or ""))]
    for k in range(n - 1, 0, -1):
        levels.insert(0, Counter(g[-k:] for g in levels[0]))
    for k in range(1, n):
        levels[k - 1] = Counter(g[1:] for g in levels[k])
    model = []
    for c in levels:
        n1, n2, n3, n4 = (max(sum(v == i for v in c.values()), 1) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        total, held = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            held[g[:-1]] += d[min(v, 3) - 1]
        model.append((c, d, total, held))
    out = []
    for t in texts:
        cost, own = 0.0, grams(t or "")
        for g in own:
            p = 1 / (len(levels[0]) + 1)
            for k, (c, d, total, held) in enumerate(model, 1):
                s = g[-k:]
                if s[:-1] in total:
                    v = c.get(s, 0)
                    p = (v - d[min(v, 3) - 1] if v else 0) / total[s[:-1]] + held[s[:-1]] / total[s[:-1]] * p
            cost -= math.log(p)
        out.append(math.exp(cost / len(own)) if own else None)
    return out


def test_perplexities_equal_brute_force(spark, make, odd, prose):
    texts = [t for t in odd if not t or len(t) < 5000] + prose[:30] + ["\x00 odd \U0001f600", prose[0].upper()]
    trusted = list(range(12, 26))
    rows = kneser_ney.score(make(texts), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    want = kn_brute([texts[i] for i in trusted], texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.perplexity is None) == (want[r.doc_id] is None)
        assert r.perplexity is None or r.perplexity == pytest.approx(want[r.doc_id], rel=1e-4), r.doc_id


def test_classifier_equals_brute_force(spark):
    r = np.random.default_rng(3)
    line = lambda parts, n: " ".join("".join(r.choice(parts, 3)) for _ in range(n))
    sound = [line(["sch", "ung", "ei"], 25) if i % 4 == 0 else line(["th", "ing", "ea", "sh"], 25) for i in range(600)]
    texts = [*sound, *[line(["#x", "Q!", "9z"], 25) for _ in range(20)], None, ""]
    langs = [("de" if i % 4 == 0 else "en") if i < 600 else [None, "fr", "en"][i % 3] for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, langs, strict=True)), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(601, 0, 0), (602, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in kneser_ney.classify(docs, labels).collect()}
    held = {x.id for x in spark.range(500).where(kneser_ney.held_out(F.col("id"))).collect()}
    assert 60 < len(held) < 140
    ppl = kn_brute([texts[i] for i in range(500) if i not in held], texts)
    top = lambda ids: (v := sorted(ppl[i] for i in ids))[math.ceil(0.995 * len(v)) - 1]
    of = {k: [i for i in held if langs[i] == k] for k in ("de", "en")}
    pooled = lambda ids: math.exp((len(ids) * math.log(top(ids)) + kneser_ney.FEW * math.log(top(held))) / (len(ids) + kneser_ney.FEW))
    limit = {k: pooled(of[k]) for k in of} | {"fr": top(held), None: top(held)}
    assert limit["de"] != limit["en"]
    for i, x in rows.items():
        assert x.limit == pytest.approx(limit[langs[i]], rel=1e-4)
        assert x.kept == (ppl[i] is not None and ppl[i] <= limit[langs[i]] * (1 + 1e-9)) or abs(ppl[i] / limit[langs[i]] - 1) < 1e-4
    assert sum(rows[i].kept for i in range(600)) >= 570 and not any(rows[i].kept for i in range(600, 622))


def test_classifier_without_enough_trusted_documents_keeps_all_texts(spark, make):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert [x.kept for x in kneser_ney.classify(make(["a", "b", None]), labels).orderBy("doc_id").collect()] == [True, True, False]
    assert all(x.kept for x in kneser_ney.classify(make(["a", "b"]), labels.where("false")).collect())
    assert kneser_ney.classify(make(["a"]).where("false"), labels).count() == 0


def test_letters_beyond_latin_are_told_apart(spark, make):
    texts = ["中文字很好看" * 30, "한국어도좋다" * 30, "中文字很好看"]
    got = {x.doc_id: x.perplexity for x in kneser_ney.score(make(texts), spark.createDataFrame([(0,)], "doc_id long")).collect()}
    assert got[1] > 5 * got[0] and got[1] > got[2]


# --- SentencePiece ----------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "  ", "\n", "a", " a", "a ", "a  b   c", "\n\nx \n y", "tab\tx\r\n", "ünï 中文 \U0001f600\x00", "▁x ▁", "Hello world.\nNext <s> </s> <unk> <0x41>", "x" * 3000, " \n ", None]


def test_codec_has_parity(prose):
    import sentencepiece

    path = tokenizer_path(PIECES)
    own, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in TEXTS + prose[:20]]
    want = [library.encode(t) for t in texts]
    ids = own.encode_batch(texts)
    assert ids == want and all(own.parity(texts, ids))
    assert own.decode_batch(ids) == [library.decode(w) if w else "" for w in want]
    assert own.parity(["a", "b"], [own.encode_batch(["a"])[0], [7]]) == [True, False]


def _field(number, value):
    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_models_with_byte_fallback_have_parity(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]]
    pieces += [(p, -1.0 - math.sqrt(k + 2), 1) for k, p in enumerate("▁ ▁a ▁the ▁he t h e a b ab abc c ▁ab ra ▁bra ca d da o ▁o er ▁th in ing".split())]
    raw = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    raw += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(3, 1) + _field(4, 1) + _field(5, 1))
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    own = sentencepiece_codec.Codec(str(path))
    texts = ["the abracadabra", "thing in the  other", " a ", "b", "ünï 中 😀", "", "zzz", "abc" * 50]
    ids = own.encode_batch(texts)
    assert all(own.parity(texts, ids)) and own.decode_batch(ids)[0] == "the abracadabra"


def test_merges_of_a_bpe_model_come_from_its_scores():
    proto = sentencepiece_codec.ModelProto(["<unk>", "a", "b", "ab", "aba"], [0, 0, 0, -1, -2], [2, 1, 1, 1, 1], sentencepiece_codec.BPE, False, 0, b"", True, False, True)
    assert proto.merges() == [("a", "b"), ("ab", "a")]


def test_unigram_models_are_built():
    proto = sentencepiece_codec.ModelProto(["<unk>", "▁", "▁a", "b", "ab"], [0, -3.0, -1.0, -2.0, -1.5], [2, 1, 1, 1, 1], sentencepiece_codec.UNIGRAM, False, 0, b"", True, True, True)
    built = sentencepiece_codec.Codec._build(proto)
    assert built.encode("a b").tokens == ["▁a", "▁", "b"] and built.decode(built.encode("a b").ids) == "a b"


def test_encode_and_decode_frames(make, prose):
    texts = TEXTS + prose[:10]
    encoded = sentencepiece_codec.encode(make(texts), PIECES)
    rows = encoded.collect()
    assert len(rows) == len(texts) and all(r.parity for r in rows)
    assert all(r.round_trip == ("▁" not in (texts[r.doc_id] or "")) for r in rows)  # the marker itself decodes to a space
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_ids == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, PIECES).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert sentencepiece_codec.encode(make(["a"]).where("false"), PIECES).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 40])
def test_packing_is_an_exact_round_trip(make, odd, prose, parts):
    from tokenizers import Tokenizer

    path = tokenizer_path(VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = [x for x in odd if not x or len(x) < 20_000] + prose + ["Don't can'T İSTANBUL ẞß x́ ́a 3.14 中文 \U0001f600 \x00 x\x1cy \x85z ﬁ Σας", "<|endoftext|>", "ÀÉ×ª"]
    rows = packing.pack(make(texts, parts), path, with_ids=True).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    t.encode_special_tokens = True
    for i, text in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1], text
        assert [r.start for r in own] == [sum(len(x.ids) for x in own[:k]) for k in range(len(own))] and {r.doc_tokens for r in own} == {len(ids)}
    total = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
        total += sum(r.length for r in own)
    assert len(windows) <= -(-total // 2048) + 1


def test_packed_ids_of_queries_are_the_librarys_defaults(spark, tmp_path):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    import corpus_pipeline
    from sparkloom.llm.queries import QUERIES

    texts = ["one <|endoftext|> two", "a<|endoftext|>b <|ENDOFTEXT|> c<|startoftext|>", "É<|endoftext|>中\u2003<|endoftext|><|startoftext|>x", "<|endoftext|", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    for out in (QUERIES["op4_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        got = {r.doc_id: (r.start, r.length, r.doc_tokens, r.ids_crc32) for r in out.where(F.col("length") == F.col("doc_tokens")).collect()}
        assert got == {i: (0, len(x), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_other_tokenizers_encode_whole_texts(make):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t, texts = Tokenizer.from_file(path), ["Two  spaces and\tTabs", "Upper Case, ünï", "", None]
    t.encode_special_tokens = True
    rows = {r.doc_id: list(r.ids) for r in packing.pack(make(texts), "byte_bpe_50k.json", with_ids=True).collect()}
    assert rows == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


def test_packing_keeps_null_ids_and_repeats(make):
    rows = packing.pack(make([(None, "a"), (3, "b"), (3, "b")]), VOCABULARY).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 3, 3] and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(make(["a"]).where("false"), VOCABULARY).count() == 0


# --- ITQ --------------------------------------------------------------------------------------------------------------


def vectors(seed=1, n=600, dims=32):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims))
    for k in range(0, 120, 3):
        v[k + 1] = v[k] + r.normal(size=dims) * 0.35
        v[k + 2] = v[k]
    v[200:260] = v[199] + r.normal(size=(60, dims)) * 0.1
    return v.astype(np.float32)


def test_links_reach_the_recall_and_are_right(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.llm.pair_tasks.SMALL", 20)
    v = vectors()
    table = spark.createDataFrame([(i, x.tolist(), i % 3, "k") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in itq.near_duplicates(table).collect()}
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    links = w @ w.T >= itq.COSINE
    np.fill_diagonal(links, False)
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(v) and all(got[i].n_links <= links[i].sum() for i in got)
    assert found >= 0.95 * links.sum() > 3000
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].component_id == got[199].component_id for i in range(200, 260))


@pytest.mark.parametrize("shift", [0.82, 0.92])
def test_links_of_vectors_with_a_common_direction_are_found(spark, shift):
    r = np.random.default_rng(4)
    side = lambda n: (x := r.normal(size=(n, 31))) / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(1 - shift**2)
    w = np.concatenate((np.full((900, 1), shift), side(900)), axis=1)
    for k in range(0, 600, 2):  # partners at cosines from 0.9
        near, c = np.append(shift, side(1)), r.uniform(0.9, 0.95)
        near -= (near @ w[k]) * w[k]
        w[k + 1] = c * w[k] + math.sqrt(1 - c * c) * near / np.linalg.norm(near)
    links = w @ w.T >= itq.COSINE
    np.fill_diagonal(links, False)
    got = itq.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "vec_id long, embedding array<double>")).collect()
    assert sum(x.n_links for x in got) >= 0.95 * links.sum() > 500 and all(x.n_links <= links[x.vec_id].sum() + 1 for x in got)


def test_odd_vectors_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [2.0, 4.0, 6.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in itq.near_duplicates(table).collect())
    assert got == [(0, 0, None), *[(i, 0, i) for i in range(1, 7)], (7, 2, 7), (8, 2, 7), (8, 2, 7), (9, 1, 9), (10, 1, 9)]
    kept = itq.deduplicate(table).collect()
    assert sorted(r.vec_id for r in kept if r.vec_id) == [1, 2, 3, 4, 5, 6, 7, 9] and sum(r.vec_id is None for r in kept) == 1
    assert itq.deduplicate(table.where("false")).count() == 0
    assert itq.near_duplicates(table.where("false")).count() == 0


# --- language ---------------------------------------------------------------------------------------------------------


def test_gradients_equal_differences():
    model = langid.Model.fresh(["a", "b"], hidden=4, seed=1)
    for name in ("tables", "recurrent"):
        setattr(model, name, [x.astype(np.float64) for x in getattr(model, name)])
    r = np.random.default_rng(0)
    codes, target = r.integers(0, 257, (5, 3, langid.STRIDE)), np.array([0, 1, 1])
    _, grads = langid.gradients(model, codes, target)
    for w, g in zip(model.weights(), grads, strict=True):
        flat, step = w.reshape(-1), 1e-2
        for k in r.choice(np.flatnonzero(np.abs(g.reshape(-1)) > 1e-3), 3):
            at = flat[k]
            flat[k] = at + step
            up = langid.gradients(model, codes, target)[0]
            flat[k] = at - step
            down = langid.gradients(model, codes, target)[0]
            flat[k] = at
            assert g.reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_languages_are_learned_and_odd_texts_are_undetermined(spark, odd):
    r = np.random.default_rng(2)
    make_ = lambda parts: " ".join("".join(r.choice(parts, 3)) for _ in range(60))
    rows = [(i, make_(["sch", "ung", "ei", "ü"]), "de") if i % 2 else (i, make_(["th", "ing", "ea", "sh"]), "en") for i in range(120)]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)] + [(None, "the thing", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(table).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == ("de" if i % 2 else "en") for i in range(120)) and all(0 <= x.score <= 1 for x in got)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert [by[1000 + i].lang_pred == "und" for i, t in enumerate(odd)] == [not (t or "").strip("1 \t\n") for t in odd]
    assert langid.identify(table.where("false")).count() == 0
    assert {x.lang_pred for x in langid.identify(table.where("lang is null")).collect()} == {"und"}


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in both]) > 0.95
