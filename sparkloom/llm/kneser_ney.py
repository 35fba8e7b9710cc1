"""Quality by perplexity under an interpolated modified Kneser-Ney model trained on trusted text.

The model is of character n-grams of ``ORDER`` symbols. Any code point is a symbol of its own, three bytes in a gram. Its
types are few however long the corpus is, so that counts, adjusted counts and probabilities are small sharded tables:

1. documents are written once in chunks; trusted ids reach the chunks that hold their documents as small rows;
2. each chunk counts the grams of its trusted documents, and the sums are joined order by order into discounts, context
   totals and back-off weights (Chen and Goodman's three discounts for each order);
3. each chunk asks for the distinct grams of all its documents; the distinct questions are answered by joins with the
   count tables, and the answers go back to the chunks that asked, where every document's whole text is scored;
4. a fifth of the trusted documents, by hash of the id, is held out of training. Per language, a quantile of these
   documents' perplexities is the limit that a document must not exceed; one at the limit is kept. A limit is pooled with that
   of all languages, which weighs as much as ``FEW`` documents: the geometric mean of both by numbers of documents. So few
   documents say little and many decide, without a number from which on they count.

Defined cases: a null or empty text has no perplexity and isn't kept; a language without held-out documents, or null, takes
the limit of all held-out documents; where there are none at all, there is no limit and all is kept that has a text; repeated rows are scored one by one; very long texts are scored whole, and are chunks of their own; ids that are
no whole numbers are null, and such rows are never trusted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, long_id, spread, stage
from .chunks import ChunkTable, text_of

ORDER = 4
BITS = 21
#: A gram is handled in two halves, each of which fits a long.
HALF = ORDER // 2
#: Bytes of a symbol in a gram.
BYTES = 3
QUANTILE = 0.995
#: As many documents as the limit of all languages weighs in that of one.
FEW = 20
#: One in so many trusted documents is held out.
HELD_OUT = 5
CHUNK_BYTES = 12 << 20
SLICE_BYTES = 1 << 20
#: Log-probabilities travel as whole numbers of this fraction of a nat.
GRAIN = 1_000_000

_ANSWER = np.dtype([("gram", "u1", ORDER * BYTES), ("cost", ">u4")])
_SHIFTS = np.arange(HALF - 1, -1, -1, dtype=np.uint64) * np.uint64(BITS)


def symbols(docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each led by ORDER - 1 zeros and closed by a one, and the offsets of the texts' symbols."""
    texts = [t or "" for t in docs.column(docs.schema.get_field_index("text")).to_pylist()]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = length + ORDER
    bounds = np.concatenate(([0], np.cumsum(padded)))
    out = np.zeros(int(bounds[-1]), np.uint64)
    out[spread(bounds[:-1] + ORDER - 1, length)] = code + 2
    out[bounds[1:] - 1] = 1
    return out, bounds


def halves(docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last half of a gram for each character and for the end of each text, and the offsets of the texts' grams.

    Empty texts have none.
    """
    symbol, bounds = symbols(docs)
    half = np.zeros(max(len(symbol) - HALF + 1, 0), np.uint64)
    for k in range(HALF):
        half = (half << np.uint64(BITS)) | symbol[k : k + len(half)]
    count = np.diff(bounds) - ORDER + 1
    count[count == 1] = 0
    at = spread(bounds[:-1], count)
    return half[at], half[at + HALF], np.concatenate(([0], np.cumsum(count)))


class Halves:
    """The distinct halves of a chunk's grams; a gram is the ranks of its halves among them, in one long."""

    def __init__(self, docs: pa.RecordBatch):
        self.values = np.zeros(0, np.uint64)
        for _, part in _slices(docs):
            first, last, _ = halves(part)
            self.values = np.union1d(self.values, np.concatenate((first, last)))

    def _keys(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.values, first) << 32 | np.searchsorted(self.values, last)

    def grams(self, docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        first, last, bounds = halves(docs)
        return self._keys(first, last), bounds

    def write(self, keys: np.ndarray) -> pa.Array:
        both = self.values[np.stack((keys >> 32, keys & 0xFFFFFFFF), 1)] if len(keys) else np.zeros((0, 2), np.uint64)
        symbol = ((both[:, :, None] >> _SHIFTS) & np.uint64((1 << BITS) - 1)).astype(">u4")
        raw = np.ascontiguousarray(symbol.view(np.uint8).reshape(len(keys), ORDER, 4)[:, :, 4 - BYTES :])
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * (ORDER * BYTES)
        return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

    def read(self, raw: np.ndarray) -> np.ndarray:
        b = raw.reshape(-1, ORDER, BYTES).astype(np.uint32)
        symbol = (b[:, :, 0] << 16 | b[:, :, 1] << 8 | b[:, :, 2]).reshape(-1, 2, HALF)
        both = np.bitwise_or.reduce(symbol.astype(np.uint64) << _SHIFTS, axis=2)
        return self._keys(both[:, 0], both[:, 1])


def _slices(docs: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of documents of about ``SLICE_BYTES``, and where each begins: what is held as symbols and grams at once."""
    ends = np.cumsum(np.diff(text_of(docs).offsets))
    at = 0
    while at < docs.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(docs.num_rows, int(np.searchsorted(ends, before + SLICE_BYTES)) + 1)
        yield at, docs.slice(at, to - at)
        at = to


def _summed(values: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts, with those of ``more`` added."""
    new, n = np.unique(more, return_counts=True)
    every, at = np.unique(np.concatenate((values, new)), return_inverse=True)
    return every, np.bincount(at, np.concatenate((counts, n)), len(every)).astype(np.int64)


def _count(_: int, docs: pa.RecordBatch, blobs: np.ndarray) -> pa.RecordBatch:
    trusted = np.sort(np.ascontiguousarray(blobs).view(">i8").astype(np.int64))
    ids = docs.column(0).fill_null(-1).to_numpy()
    rows = np.flatnonzero(np.isin(ids, trusted) & docs.column(0).is_valid().to_numpy(zero_copy_only=False))
    values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = docs.take(pa.array(rows))
    known = Halves(docs)
    for _, part in _slices(docs):
        values, counts = _summed(values, counts, known.grams(part)[0])
    return pa.RecordBatch.from_arrays([known.write(values), pa.array(counts, pa.int64())], ["gram", "n"])


def _ask(chunk: int, docs: pa.RecordBatch, _: np.ndarray) -> pa.RecordBatch:
    values = np.zeros(0, np.int64)
    known = Halves(docs)
    for _, part in _slices(docs):
        values = np.union1d(values, known.grams(part)[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), chunk)), known.write(values)], ["chunk", "gram"])


def _score(_: int, docs: pa.RecordBatch, blobs: np.ndarray) -> pa.RecordBatch:
    answers = np.frombuffer(np.ascontiguousarray(blobs), _ANSWER)
    own_halves = Halves(docs)
    known, cost = own_halves.read(answers["gram"]), answers["cost"].astype(np.float64) / GRAIN
    order = np.argsort(known)
    known, cost = known[order], cost[order]
    n, ppl = np.zeros(docs.num_rows, np.int64), np.ones(docs.num_rows)
    for at, part in _slices(docs):
        gram, bounds = own_halves.grams(part)
        sums = np.concatenate(([0.0], np.cumsum(cost[np.searchsorted(known, gram)]))) if len(gram) else np.zeros(1)
        own = slice(at, at + part.num_rows)
        n[own] = np.diff(bounds)
        ppl[own] = np.exp((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n[own], 1))
    return pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(n), pa.array(ppl, pa.float64(), mask=n == 0)], ["doc_id", "lang", "n_symbols", "perplexity"])


def _hex(column: Column, digits: int) -> Column:
    return F.lpad(F.hex(column.cast("long")), digits, "0")


def _members(chunk: int, docs: pa.RecordBatch, _: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(docs.num_rows, chunk)), docs.column(0)], ["chunk", "doc_id"])


def _suffix(gram: Column, order: int) -> Column:
    return F.substring(gram, -BYTES * order, BYTES * order)


def _head(gram: str) -> Column:
    """All symbols but the last."""
    return F.expr(f"substring({gram}, 1, length({gram}) - {BYTES})")


class Model:
    """Count tables by order: ``levels[k - 1]`` is (gram, n), ``contexts[k - 1]`` is (context, total, gamma)."""

    def __init__(self, counts: DataFrame):
        by_order = [stage(counts, f"grams-{ORDER}")]
        for k in range(ORDER - 1, 0, -1):
            shorter = by_order[0].select(_suffix(F.col("gram"), k).alias("gram"))
            by_order.insert(0, stage(shorter.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"grams-{k}"))
        self.levels = by_order
        self.discounts = [self._discount(level) for level in by_order]
        self.contexts = [self._context(level, d) for level, d in zip(by_order, self.discounts, strict=True)]
        self.types = by_order[0].count() + 1  # one for symbols never seen

    @staticmethod
    def _discount(level: DataFrame) -> tuple[float, float, float]:
        """Three discounts from four counts of counts."""
        n = level.agg(*[F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in range(1, 5)]).first()
        n1, n2, n3, n4 = (max(x, 1) for x in n)
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))

    @staticmethod
    def _context(level: DataFrame, d: tuple[float, float, float]) -> DataFrame:
        n = F.col("n")
        grouped = level.groupBy(_head("gram").alias("context")).agg(
            F.sum("n").alias("total"), F.sum(F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])).alias("held")
        )
        return stage(grouped.select("context", "total", (F.col("held") / F.col("total")).alias("gamma")), "contexts")

    def costs(self, asked: DataFrame) -> DataFrame:
        """(gram, cost): minus the log-probability of each asked gram's last symbol after the others."""
        p = F.lit(1.0 / self.types)
        out = asked.select("gram", p.alias("p"))
        for k, (level, context, d) in enumerate(zip(self.levels, self.contexts, self.discounts, strict=True), 1):
            own = level.select(F.col("gram").alias("_g"), "n")
            ctx = context.select(F.col("context").alias("_c"), "total", "gamma")
            suffix = out.withColumn("_g", _suffix(F.col("gram"), k))
            suffix = suffix.withColumn("_c", _head("_g")).join(own, "_g", "left").join(ctx, "_c", "left")
            n = F.coalesce("n", F.lit(0))
            kept = F.greatest(n - F.when(n == 1, d[0]).when(n == 2, d[1]).when(n > 2, d[2]).otherwise(0.0), F.lit(0.0))
            p = F.when(F.col("total").isNull(), F.col("p")).otherwise(kept / F.col("total") + F.col("gamma") * F.col("p"))
            out = suffix.select("gram", p.alias("p"))
        return out.select("gram", (-F.log("p")).alias("cost"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good and not toxic."""
    return labels.where((labels["quality"] == 1) & (labels["toxic"] == 0)).select(long_id(labels["doc_id"]).alias("doc_id")).where("doc_id is not null").distinct()


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity of every row of ``docs``; ``trusted`` has the ids to train on."""
    table = ChunkTable.write(docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text")), CHUNK_BYTES)
    where = table.finish(_members, "chunk long, doc_id long")
    told = where.join(trusted, "doc_id", "left_semi").select("chunk", F.unhex(_hex(F.col("doc_id"), 16)).alias("blob"))
    counted = table.finish(_count, "gram binary, n long", told).groupBy("gram").agg(F.sum("n").alias("n"))
    model = Model(counted)
    asked = stage(table.finish(_ask, "chunk long, gram binary"), "asked")
    cost = F.least(F.round(F.col("cost") * GRAIN), F.lit(4_000_000_000.0))
    known = stage(model.costs(asked.select("gram").distinct()).select("gram", F.concat(F.col("gram"), F.unhex(_hex(cost, 8))).alias("blob")), "costs")
    answers = asked.join(known, "gram").select("chunk", "blob")
    out = stage(table.finish(_score, "doc_id long, lang string, n_symbols long, perplexity double", answers), "perplexities")
    table.drop()
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), doc_id), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, limit, kept for every row of ``docs``."""
    trusted = stage(trusted_ids(labels).withColumn("held", held_out(F.col("doc_id"))), "trusted")
    scored = score(docs, trusted.where("not held").select("doc_id"))
    judged = scored.join(trusted.where("held"), "doc_id", "left_semi").where("perplexity is not null")
    n, at = F.count(F.lit(1)), F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    limits = stage(judged.where("lang is not null").groupBy("lang").agg(n.alias("n"), at.alias("own")), "limits")
    overall = judged.agg(at.alias("overall"))
    few = limits.count() <= BROADCAST_IDS  # one row a language
    out = scored.join(F.broadcast(limits) if few else limits, "lang", "left").crossJoin(F.broadcast(overall))
    pooled = F.exp((F.col("n") * F.log("own") + FEW * F.log("overall")) / (F.col("n") + FEW))
    limit = F.coalesce(pooled, "overall")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", limit.alias("limit"), kept.alias("kept"))
