"""Ranked lexical search over a bit-sliced impact index, partitioned by documents.

``build`` writes one row for each block of documents (at most ``BLOCK_DOCS`` of them, or ``BLOCK_BYTES`` of text): the ids in
rising order, the number of terms of each, and for each distinct term its documents and frequencies. All terms of all
documents are in it; no posting leaves its block. ``search`` counts the document frequencies of the terms that are asked for
in one small shuffle, and then visits every block once:

1. the postings of an asked term get their impact, weight times saturated frequency, and become bitmaps: bit k of document
   d's impact is bit d of the term's slice k;
2. the slices of an item's terms are added by ripple-carry arithmetic on whole machine words, all items of a batch side by side;
3. the best documents are found from the most significant slice down: documents with the bit set go first while they are few
   enough, the rest are narrowed to those that share it. Ties at the end go to the smallest ids.

Each block sends at most ``k`` rows an item, and Spark ranks these. Blocks are independent, so a hot term, source or group of
copies is spread like all rows. Items come in batches of about ``BATCH_TERMS`` terms, which meet every block in turn.

Defined cases: a null or empty text has no terms, counts in no statistic and is never found; an item without terms, or whose
terms occur nowhere, has no rows; items with one id are answered each for itself; repeated documents are ranked row by row;
documents without an id, or with one that is no whole number, come last among equal scores and have a null id; a very long
text is a block of its own; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import long_id, small_batches, spread, stage, utf8
from ._tokens import gathered, runs

BLOCK_DOCS, BLOCK_BYTES = 1 << 14, 8 << 20
#: Bytes of the index that a task has at once in Spark's memory: blocks are written in row groups of about this size.
GROUP_BYTES = 8 << 20
#: Terms of the items that a task has at once, and items whose slices are summed side by side.
BATCH_TERMS, SIDE_BY_SIDE = 200_000, 64
#: Batches that are sent to every task together; more meet the blocks by shuffle.
BROADCAST_BATCHES = 16
TOP = 10

# Everything in ASCII but digits and letters parts terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_INSIDE = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _INSIDE[_lo : _hi + 1] = False
_BLOCK = "ids array<long>, n binary, terms array<string>, df array<int>, doc binary, tf binary, n_docs long, n_terms long"


def terms_of(column: Column) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _block(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, text = ids.take(order), utf8(pc.cast(text, pa.large_string()).take(order))
    found, doc = runs(text, _INSIDE)
    coded = found.dictionary_encode()
    n = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + doc, return_counts=True)
    df = np.bincount(pairs // len(ids), minlength=len(coded.dictionary)) if len(pairs) else np.zeros(0, np.int64)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    row = [
        one(ids), pa.array([n.tobytes()], pa.binary()), one(coded.dictionary.cast(pa.string())), one(pa.array(df.astype(np.int32))),
        pa.array([(pairs % len(ids)).astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
    ]
    return pa.RecordBatch.from_arrays(row, ["ids", "n", "terms", "df", "doc", "tf", "n_docs", "n_terms"])


def _blocks(most_docs: int, most_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, most_bytes, most_docs):
            yield _block(table["id"].chunk(0), table["text"].chunk(0))

    return run


@dataclass
class Index:
    """``blocks`` is staged; ``n_docs`` documents have a term, ``n_terms`` terms are in them."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> Index:
    small_batches(docs.sparkSession)
    rows = docs.select(long_id(docs[id_column]).alias("id"), docs[text_column].cast("string").alias("text"))
    blocks = stage(rows.mapInArrow(_blocks(block_docs, block_bytes), _BLOCK), "lexical-blocks", GROUP_BYTES)
    n, terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(blocks, n or 0, terms or 0)


def _weighted(index: Index, items: DataFrame) -> DataFrame:
    """key, item_id, terms and w of each item: its distinct terms that some document holds, with their weights."""
    asked = items.select("key", "item_id", F.explode(F.array_distinct("terms")).alias("term"))
    held = index.blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    counts = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((F.lit(2 * index.n_docs + 2).cast("double")) / (2 * F.col("df") + 1)))
    pairs = asked.join(counts, "term").select("key", "item_id", F.struct("term", weight.alias("w")).alias("t"))
    return pairs.groupBy("key", "item_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("key", "item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("w"))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated frequencies in millionths, ``n`` the length of the posting's document."""
    if len(n) and int(n.max()) > (2**63 - 1) // (90 * max(1, n_docs)):
        m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def add(total: list[np.ndarray], other: list[np.ndarray]) -> None:
    """Adds the numbers that ``other`` holds in slices to those of ``total``, in place; slice k holds bit k of each number."""
    carry = None
    for k in range(max(len(total), len(other))):
        if k >= len(other) and (carry is None or not carry.any()):
            return
        if k == len(total):
            total.append(np.zeros_like(total[0] if total else other[0]))
        a, b = total[k], other[k] if k < len(other) else None
        if b is None:
            total[k], carry = a ^ carry, a & carry
        elif carry is None:
            total[k], carry = a ^ b, a & b
        else:
            half = a ^ b
            total[k], carry = half ^ carry, (a & b) | (carry & half)
    if carry is not None and carry.any():
        total.append(carry)


def best(slices: list[np.ndarray], k: int) -> np.ndarray:
    """Which numbers are a row's ``k`` largest above 0, as bitmaps; among equals at the end the first places win."""
    sure = np.zeros_like(slices[0])
    maybe = np.bitwise_or.reduce(slices)
    size = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None]
    for bits in reversed(slices):
        having = maybe & bits
        n = size(sure | having)
        maybe = np.where(n > k, having, np.where(n < k, maybe & ~bits, 0).astype(np.uint64))
        sure = np.where(n > k, sure, sure | having)
    flat = np.unpackbits(maybe.view(np.uint8), axis=1, bitorder="little").astype(bool)
    first = flat & (np.cumsum(flat, axis=1) <= k - size(sure))
    return sure | np.packbits(first, axis=1, bitorder="little").view(np.uint64)


def _slices(rows: np.ndarray, doc: np.ndarray, value: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Bitmaps of the bits of ``value``, one number for each (row, doc), given in rising order."""
    place = rows * (64 * width) + doc
    word, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = []
    for k in range(int(value.max()).bit_length()):
        flat = np.zeros(n_rows * width, np.uint64)
        flat[word[starts]] = np.bitwise_or.reduceat(np.where((value >> k) & 1, bit, np.uint64(0)), starts)
        out.append(flat.reshape(n_rows, width))
    return out


def _search_block(block: dict, items: pa.StructArray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    n = np.frombuffer(block["n"], np.int64)
    doc, tf = np.frombuffer(block["doc"], np.int32).astype(np.int64), np.frombuffer(block["tf"], np.int32).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(block["df"].to_numpy(zero_copy_only=False)))).astype(np.int64)
    impact = impacts(tf, n[doc], n_docs, n_terms)
    width = -(-len(n) // 64)
    asked, weight = items.field("terms"), items.field("w").flatten().to_numpy(zero_copy_only=False)
    own = pc.index_in(asked.flatten().cast(pa.string()), value_set=block["terms"].cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    item = np.repeat(np.arange(len(items)), np.diff(asked.offsets.to_numpy()))
    here = np.flatnonzero((own >= 0) & (weight > 0))
    bounds = np.searchsorted(item[here], np.arange(0, len(items) + SIDE_BY_SIDE, SIDE_BY_SIDE))
    for base, lo, hi in zip(range(0, len(items), SIDE_BY_SIDE), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = here[lo:hi]
        if not len(mine):
            continue
        turn = np.arange(len(mine)) - np.searchsorted(item[mine], item[mine])
        total: list[np.ndarray] = []
        for t in range(int(turn.max()) + 1):
            now = mine[turn == t]
            held = first[own[now] + 1] - first[own[now]]
            at = spread(first[own[now]], held)
            add(total, _slices(np.repeat(item[now] - base, held), doc[at], np.repeat(weight[now], held) * impact[at], SIDE_BY_SIDE, width))
        if not total:
            continue
        row, place = np.nonzero(np.unpackbits(best(total, k).view(np.uint8), axis=1, bitorder="little"))
        score = np.zeros(len(row), np.int64)
        for b, bits in enumerate(total):
            score |= ((bits[row, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
        of = pa.array(row + base)
        yield pa.RecordBatch.from_arrays([items.field("key").take(of), items.field("item_id").take(of), block["ids"].take(pa.array(place)), pa.array(score)], ["key", "item_id", "doc_id", "score"])


def _visit(n_docs: int, n_terms: int, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                block = {name: row[name].values for name in ("ids", "terms", "df")} | {name: row[name].as_buffer() for name in ("n", "doc", "tf")}
                yield from _search_block(block, row["items"].values, n_docs, n_terms, k)

    return run


def search(index: Index, queries: DataFrame, k: int = TOP, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each row of ``queries``."""
    spark = queries.sparkSession
    if not index.n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    small_batches(spark)
    items = queries.select(F.monotonically_increasing_id().alias("key"), long_id(queries[id_column]).alias("item_id"), terms_of(queries[text_column].cast("string")).alias("terms"))
    weighted = stage(_weighted(index, stage(items, "items")), "weighted-items")
    n_batches = -(-(weighted.agg(F.sum(F.size("terms"))).first()[0] or 0) // BATCH_TERMS)
    dealt = weighted.groupBy(F.pmod(F.xxhash64("key"), F.lit(max(1, n_batches))).alias("batch")).agg(F.collect_list(F.struct("key", "item_id", "terms", "w")).alias("items"))
    dealt = dealt.select("items")
    met = index.blocks.select("ids", "n", "terms", "df", "doc", "tf").crossJoin(F.broadcast(dealt) if n_batches <= BROADCAST_BATCHES else dealt)
    found = met.mapInArrow(_visit(index.n_docs, index.n_terms, k), "key long, item_id long, doc_id long, score long")
    place = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
