"""Log probabilities of whole texts under an interpolated modified Kneser-Ney model of pairs of words.

Tokens are the words of a text with A-Z lower-cased, then one end; the first word of a text follows an end, too. The model is
sorted arrays of 64-bit hashes, one for each shard of the hash range, with the counts beside them:

1. ``train`` counts the pairs of about ``CHUNK_BYTES`` of text at a time, all of the training documents; each chunk sends every
   shard the pairs that fall to it, words as hashes named once a row. A shard merges what it gets into one sorted array, and
   sums for each word what it knows of it: occurrences, words that it follows, and followers met once, twice and more often.
   These sums are merged by word in the same manner. What is counted, stored and moved grows with the corpus.
2. ``score`` writes the documents once in chunks. Each chunk asks the shards for its distinct pairs and words; a shard's task
   maps its arrays into memory from a file of its own, looks the questions up by bisection as they stream past, and answers
   with counts in the order of the questions. The chunk turns counts into probabilities and sums up each document.

Words and pairs are dealt by hash alone: each chunk names a word or a pair once, so that the commonest weighs as much as the
rarest. Hashes stand for words; two words or pairs that share 64 bits would be counted as one (for a billion different ones
the chance that any two do is 3 %). A question carries 56 bits besides its shard.

Defined cases: a null or empty text is one end; unknown words share the mass left to one more word; where a count of counts is
missing, the discounts are 0.5, 1 and 1.5; a model without training tokens gives every token a probability of 1; repeated
rows are counted and scored one by one; a very long text is a chunk of its own; rows without an id, or with an id that is no
whole number, are scored, have a null id, and are held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import give_back, input_partitions, long_id, released, remove, scratch_path, small_batches, stage, unsigned_crc32, utf8
from ._tokens import gathered, runs
from ._xxh64 import xxh64
from .chunks import ChunkTable

CHUNK_BYTES = 8 << 20
#: Shares of documents by hash of the id: the remainder ``HELD`` of ``SHARES`` is held out.
SHARES, HELD = 7, 2

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: What is known of a word: its occurrences, the different words before it, its followers met once, twice, more often.
FACTS = ("c", "a", "n1", "n2", "n3")


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from training; those without id are."""
    return F.coalesce(unsigned_crc32(id_column.cast("string")) % SHARES == HELD, F.lit(True))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits for each pair of 64-bit hashes, in order."""
    with np.errstate(over="ignore"):
        z = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(32))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hashes, in rising order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def within_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """56 bits that tell the hashes of one shard apart, in the same order; questions need no more."""
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(shards)) >> np.uint64(8)


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes and so on: the high ones are alike and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _values(planes: bytes | pa.Buffer | np.ndarray, kind: type | str) -> np.ndarray:
    flat = np.frombuffer(planes, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).reshape(-1).view(kind)


def _packed(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest of an array needs, named in front of it."""
    out = []
    for a in arrays:
        size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(a) or int(a.max()) < 1 << 8 * s)
        out += [bytes([size]), _planes(a.astype(f"u{size}"))]
    return b"".join(out)


def _unpacked(blob: bytes | pa.Buffer | np.ndarray, n: int, rows: int) -> tuple[np.ndarray, int]:
    """``rows`` arrays of ``n`` numbers at the start of ``blob``, and the bytes that they take."""
    flat, at, out = np.frombuffer(blob, np.uint8), 0, np.empty((rows, n), np.uint64)
    for i in range(rows):
        size = int(flat[at])
        out[i] = _values(flat[at + 1 : at + 1 + n * size], f"u{size}")
        at += 1 + n * size
    return out, at


@dataclass
class _Tokens:
    """``words`` are the hashes of a chunk's distinct tokens; ``v`` and ``w`` index them for each distinct pair.

    ``pair`` is each token's pair, ``bounds`` part the documents' tokens, ``count`` is how often a pair occurs.
    """

    words: np.ndarray
    v: np.ndarray
    w: np.ndarray
    pair: np.ndarray
    count: np.ndarray
    bounds: np.ndarray


def _tokens(column: pa.Array) -> _Tokens:
    text = utf8(column)
    found, doc = runs(text, _WORD)
    coded = found.dictionary_encode()
    spelled = utf8(coded.dictionary)
    words = np.append(xxh64(spelled.data, spelled.offsets[:-1], np.diff(spelled.offsets)), xxh64(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)))
    end = len(words) - 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(text)) + 1)))
    stream = np.full(bounds[-1], end, np.int64)
    stream[np.arange(len(found)) + doc] = coded.indices.to_numpy()
    before = np.append(end, stream[:-1])
    pairs, pair, count = np.unique(before * len(words) + stream, return_inverse=True, return_counts=True)
    return _Tokens(words, pairs // len(words), pairs % len(words), pair, count, bounds)


def _parts(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``of`` and where it stands."""
    order = np.argsort(of, kind="stable")
    values, first = np.unique(of[order], return_index=True)
    yield from zip(values.tolist(), np.split(order, first[1:]) if len(values) else [], strict=True)


def _count(shards: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, CHUNK_BYTES):
            t = _tokens(table["text"].chunk(0))
            rows: list[tuple[int, bytes, bytes, int]] = []
            for shard, at in _parts(shard_of(pair_hash(t.words[t.v], t.words[t.w]), shards)):
                named, code = np.unique(np.concatenate((t.v[at], t.w[at])), return_inverse=True)
                rows.append((shard, t.words[named].tobytes(), _packed(code[: len(at)], code[len(at) :], t.count[at]), len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["shard", "words", "pairs", "n"])
            del t, rows
            give_back()

    return run


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


_MERGED = "kind int, part int, hashes binary, facts binary, total long, types long, k1 long, k2 long, k3 long, k4 long"
_NAMES = [x.split()[0] for x in _MERGED.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(_TYPES)], names=_NAMES)


def _merge_pairs(shards: int):  # noqa: ANN202
    """Of one shard: its sorted array with counts (kind 0), and what it knows of words, by the words' shards (kind 1)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        before, word, count = [], [], []
        for words, pairs, n in zip(*(table[c] for c in ("words", "pairs", "n")), strict=True):
            words = np.frombuffer(words.as_buffer(), np.uint64)
            (v, w, times), _ = _unpacked(pairs.as_buffer(), n.as_py(), 3)
            before.append(words[v.astype(np.int64)])
            word.append(words[w.astype(np.int64)])
            count.append(times)
        before, word, count = np.concatenate(before), np.concatenate(word), np.concatenate(count)
        hashes = pair_hash(before, word)
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        hashes, total = hashes[first], np.add.reduceat(count[order], first)
        first = order[first]
        before, word = before[first], word[first]
        del order, count, first
        rows = [(0, key[0].as_py(), _planes(hashes), _packed(total), int(total.sum()), len(hashes), *_counts_of_counts(total))]
        known, at = np.unique(np.concatenate((before, word)), return_inverse=True)
        v, w = at[: len(before)], at[len(before) :]
        facts = np.zeros((len(FACTS), len(known)), np.uint64)
        facts[0] = np.bincount(w, weights=total, minlength=len(known))
        facts[1] = np.bincount(w, minlength=len(known))
        for i, kind in enumerate((total == 1, total == 2, total > 2)):
            facts[2 + i] = np.bincount(v[kind], minlength=len(known))
        del before, word, v, w, at
        for shard, at in _parts(shard_of(known, shards)):
            rows.append((1, shards + shard, _planes(known[at]), _packed(*facts[:, at]), *[None] * 6))
        del facts, known, total, hashes
        give_back()
        return _table(rows)

    return run


def _merge_words(key: tuple, table: pa.Table) -> pa.Table:
    words = [_values(b.as_buffer(), np.uint64) for b in table["hashes"]]
    facts = [_unpacked(b.as_buffer(), len(w), len(FACTS))[0] for b, w in zip(table["facts"], words, strict=True)]
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    out = np.zeros((len(FACTS), len(known)), np.uint64)
    every = np.concatenate(facts, axis=1)
    for i in range(len(FACTS)):
        np.add.at(out[i], at, every[i])
    return _table([(1, key[0].as_py(), _planes(known), _packed(*out), int(out[0].sum()), len(known), *_counts_of_counts(out[1]))])


def discounts(k1: int, k2: int, k3: int, k4: int) -> np.ndarray:
    """Chen and Goodman's three discounts, from the numbers of types met once to four times; entry 0 is no discount."""
    if not (k1 and k2 and k3 and k4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = k1 / (k1 + 2 * k2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, k1, k2), (2, k2, k3), (3, k3, k4)))])


@dataclass
class Model:
    """``arrays`` is staged: for each shard of pairs (kind 0) and of words (kind 1) its sorted hashes and their counts."""

    arrays: DataFrame
    shards: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    #: Words that follow one, two and more different words.
    spread: tuple[int, int, int]

    def of_words(self, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each word by what it follows, and the share that it passes on to such probabilities as context."""
        c, a, n1, n2, n3 = facts.astype(float)
        if not self.pairs:
            return np.ones(len(c)), np.ones(len(c))
        d = self.word_discounts
        left = (d[1:] * self.spread).sum() / self.pairs
        lower = (a - d[np.minimum(facts[1], 3).astype(np.int64)]) / self.pairs + left / (self.words + 1)
        d = self.pair_discounts
        return lower, np.where(c > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(c, 1), 1.0)

    def of_pairs(self, count: np.ndarray, context: np.ndarray, lower: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of pairs met ``count`` times, the first word ``context`` times."""
        own = np.maximum(count - self.pair_discounts[np.minimum(count, 3).astype(np.int64)], 0.0)
        return own / np.maximum(context, 1) + share * lower


def _pieces(spark: SparkSession) -> int:
    """Shards for each task that reads the input: two for 16 MB, so that a shard stays small where tasks read much."""
    return max(1, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) >> 23)


def train(docs: DataFrame, text_column: str = "text", shards: int | None = None) -> Model:
    """The model of all texts of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(docs[text_column].cast("string").alias("text"))
    shards = shards or input_partitions(texts) * _pieces(spark)
    counted = texts.mapInArrow(_count(shards), "shard int, words binary, pairs binary, n long")
    with released(spark):
        both = scratch_path(spark, "lm-merged")
        counted.groupBy("shard").applyInArrow(_merge_pairs(shards), _MERGED).write.option("compression", "zstd").parquet(both)
        merged = spark.read.schema(_MERGED).parquet(both)
        words = stage(merged.where("kind = 1").groupBy("part").applyInArrow(_merge_words, _MERGED), "lm-words")
        pairs = stage(merged.where("kind = 0"), "lm-pairs")
    remove(spark, both)
    sums = {r["kind"]: r for r in pairs.unionByName(words).groupBy("kind").agg(*(F.sum(c).alias(c) for c in _NAMES[4:])).collect()}
    if not sums:
        return Model(pairs.unionByName(words), shards, 0, 0, 0, discounts(0, 0, 0, 0), discounts(0, 0, 0, 0), (0, 0, 0))
    p, w = sums[0], sums[1]
    more = w["types"] - w["k1"] - w["k2"]
    return Model(pairs.unionByName(words), shards, w["total"], w["types"], p["types"], discounts(*p[-4:]), discounts(*w[-4:]), (w["k1"], w["k2"], more))


def _ask(shards: int):  # noqa: ANN202
    def run(chunk: int, docs: pa.RecordBatch, _: np.ndarray) -> pa.RecordBatch:
        t = _tokens(docs.column(docs.schema.get_field_index("text")))
        parts, blobs = [], []
        for base, hashes in ((0, pair_hash(t.words[t.v], t.words[t.w])), (shards, t.words)):
            hashes = np.sort(hashes)
            for shard, at in _parts(shard_of(hashes, shards)):
                parts.append(base + shard)
                blobs.append(_planes(within_shard(hashes[at], shards)))
        del t
        give_back()
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], ["part", "chunk", "blob"])

    return run


def _mapped(values: np.ndarray) -> np.ndarray:
    """``values`` as an array over a file that has no name any more, and goes with the array."""
    if not values.size:
        return values
    with tempfile.TemporaryFile() as f:
        values.tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)


def _answer(shards: int):  # noqa: ANN202
    return lambda batches: _answers(batches, shards)


def _answers(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows come by part, the part's arrays first. An answer starts with part and length, then the counts of each question."""
    part, hashes, facts = -1, np.zeros(0, np.uint64), np.zeros((1, 0), np.uint64)
    for batch in batches:
        chunks, blobs = [], []
        for i in range(batch.num_rows):
            now, chunk, blob, counts = (batch.column(c)[i] for c in range(4))
            if chunk.as_py() < 0:
                part, hashes = now.as_py(), _mapped(within_shard(_values(blob.as_buffer(), np.uint64), shards))
                facts = _mapped(_unpacked(counts.as_buffer(), len(hashes), 1 if part < shards else len(FACTS))[0])
                give_back()
                continue
            asked = _values(blob.as_buffer(), np.uint64)
            found = np.zeros((facts.shape[0], len(asked)), np.uint64)
            if now.as_py() == part and len(hashes):
                at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
                hit = hashes[at] == asked
                found[:, hit] = facts[:, at[hit]]
            chunks.append(chunk.as_py())
            blobs.append(np.array([now.as_py(), len(asked), len(found)], np.uint64).tobytes() + _packed(*found))
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "blob"])


def _facts(blobs: np.ndarray, base: int, until: int, hashes: np.ndarray, rows: int, shards: int) -> np.ndarray:
    """The answers for ``hashes`` (in any order) among the parts from ``base`` on."""
    order = np.argsort(hashes, kind="stable")
    out = np.zeros((rows, len(hashes)), np.uint64)
    bounds = np.searchsorted(shard_of(hashes[order], shards), np.arange(shards + 1))
    at = 0
    while at < len(blobs):
        part, n, k = np.frombuffer(blobs[at : at + 24].tobytes(), np.uint64).tolist()
        found, size = _unpacked(blobs[at + 24 :], n, k)
        at += 24 + size
        if base <= part < until and k == rows:
            lo = bounds[part - base]
            out[:, order[lo : lo + n]] = found
    return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):  # noqa: ANN202
    plain = {k: getattr(model, k) for k in Model.__dataclass_fields__ if k != "arrays"}

    def run(_: int, docs: pa.RecordBatch, blobs: np.ndarray) -> pa.RecordBatch:
        m = Model(None, **plain)
        t = _tokens(docs.column(docs.schema.get_field_index("text")))
        blobs = np.ascontiguousarray(blobs)
        facts = _facts(blobs, m.shards, 2 * m.shards, t.words, len(FACTS), m.shards)
        count = _facts(blobs, 0, m.shards, pair_hash(t.words[t.v], t.words[t.w]), 1, m.shards)[0].astype(float)
        lower, share = m.of_words(facts)
        seen = facts[0].astype(float)
        log = np.log10(m.of_pairs(count, seen[t.v], lower[t.w], share[t.v])) if m.pairs else np.zeros(len(t.v))
        base = np.log10((seen[t.w] + 1) / (m.tokens + 1 * (m.words + 1)))
        sums = lambda x: np.add.reduceat(x[t.pair], t.bounds[:-1])
        columns = [docs.column(0), docs.column(1), pa.array(np.diff(t.bounds)), pa.array(sums((seen[t.w] > 0).astype(np.int64))), pa.array(np.full(len(docs), m.tokens)), pa.array(sums(base)), pa.array(sums(log))]
        del t, facts, count, log, base
        give_back()
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORED.split(", ")])

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(long_id(docs[id_column]).alias("doc_id"), held_out(long_id(docs[id_column])).alias("held_out"), docs[text_column].cast("string").alias("text"))
    table = ChunkTable.write(rows, CHUNK_BYTES)
    asked = table.finish(_ask(model.shards), "part int, chunk long, blob binary").withColumn("facts", F.lit(None).cast("binary"))
    stored = model.arrays.select("part", F.lit(-1).cast("long").alias("chunk"), F.col("hashes").alias("blob"), "facts")
    met = stored.unionByName(asked).repartition(2 * model.shards, "part").sortWithinPartitions("part", "chunk")
    answers = met.mapInArrow(_answer(model.shards), "chunk long, blob binary")
    with released(spark):
        scored = stage(table.finish(_score(model), _SCORED, answers), "lm-scores")
    table.drop()
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All of ``docs`` under the model of those that are not held out."""
    return score(docs, train(docs.where(~held_out(long_id(docs[id_column]))), text_column), id_column, text_column)
