"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit set where over half of the document's shingles have it set in their hashes. Distinct fingerprints
are joined with themselves in binary tries: node pairs are walked down together, differing bits add up, and a pair of
nodes is given up as soon as they exceed the budget. So that no trie holds the corpus, a forest is walked with one trie for
each value of some leading bits, in several orders of the bits. Hot tries are split into chunk pairs (pair_tasks); within a
task, rows that are linked to a common one already aren't compared again. What leaves a task is a spanning forest of the
pairs found, never the pairs; components are then found by hooking and contraction.

Two ways to call it:

* ``near_duplicates``: 64 bits of the shingles' XXH64, repeats included; links are pairs within ``budget`` bits, and none is
  missed: two fingerprints within the budget agree in one of ``budget + 1`` blocks, and each block leads one order.
* ``similar_texts``: links are pairs of a Jaccard similarity of at least ``similarity`` over distinct shingles (0.8 of five
  words) whose fingerprints of 128 bits lie within ``wide_budget`` bits, which all but about one in two thousand pairs at
  that similarity do. The orders of the bits are random and as many as meet ``RECALL`` of such pairs (``orders_for``); pairs
  found are checked exactly on their shingles, by the same dealing of hot groups. ``deduplicate`` keeps one row a component.

Defined cases: a text without words (also a null one) has fingerprint zero and links like any other, texts without words
being copies of each other; fewer words than a shingle give one shingle of all of them; null ids, and ids that are no whole
numbers, never become a component's id; equal rows get equal results; an empty table gives an empty result; other columns
are ignored, or kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, long_id, slices, small_batches, spread, stage, utf8, without, words
from ._xxh64 import xxh64
from .components import components, fold_labels
from .pair_tasks import deal, whole_tasks

BUDGET = 4
SHINGLE = 4
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint64(0x0101010101010101)
#: Pairs compared at once, and node pairs of the walk kept at once.
_AT_ONCE = 1 << 20
#: A pair of nodes with at most so many fingerprint pairs is compared directly.
_LEAF = 32
#: Tries of at least so many rows are first compared with some of their own rows, as leaders.
_LED = 64
_LEADERS = 4

# What ``deduplicate`` links, and how much of it the orders of the bits are to meet.
WORDS = 5
SIMILARITY = 0.8
RECALL = 0.985
WIDE = 128
#: Bytes of shingles that a task gathers before it compares; a single group may hold more.
SET_BYTES = 8 << 20


def shingles_of(text: pa.Array, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles in turn, and how many each text has. A-Z are lower-cased, other letters are left alone."""
    raw = utf8(text)
    raw.data = _LOWER[raw.data]
    w = words(raw)
    count = np.diff(w.bounds)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = spread(w.bounds[:-1], shingles)
    last = first + np.repeat(np.minimum(count, size), shingles) - 1
    h = xxh64(w.joined, w.start[first], w.end[last] - w.start[first], seed) if len(first) else np.zeros(0, np.uint64)
    return h, shingles


def fingerprints_of(text: pa.Array, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text as uint64. Whole texts."""
    return _majority(*shingles_of(text, size, seed))


def _majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Of each run of ``per[i]`` hashes, the bits set in over half. Eight one-byte counters a word, in runs of up to 255."""
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per)
    if not len(full):
        return out
    pieces = -(-per[full] // 255)
    starts = np.concatenate(([0], np.cumsum(per[full])[:-1]))
    cut = spread(np.zeros(len(full), np.int64), pieces) * 255 + np.repeat(starts, pieces)
    runs = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    half = per[full]
    bits = np.zeros(len(full), np.uint64)
    for b in range(8):
        eight = np.add.reduceat((h >> np.uint64(b)) & _ONES, cut)
        each = np.add.reduceat(eight.view(np.uint8).reshape(-1, 8).astype(np.int64), runs, axis=0)
        for byte in range(8):
            bits |= (2 * each[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + b)
    out[full] = bits
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            bits = fingerprints_of(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    return docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, bits long")


def block_edges(budget: int) -> list[int]:
    """Where the ``budget + 1`` blocks begin, and 64."""
    return [round(64 * i / (budget + 1)) for i in range(budget + 2)]


def trie_pairs(
    keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, chunk: np.ndarray | None, skip: int, budget: int, todo: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits, of tries that are ranges [lo, hi) of ``keys`` sorted within each range.

    ``keys`` has one or more words of 64 bits for each row. The first ``skip`` bits are equal in a range. ``chunk``: where a
    range has rows of two chunks, only pairs across. ``todo``: only pairs with at least one such row.
    """
    keys = keys.reshape(len(keys), -1)
    zeros: dict[int, np.ndarray] = {}
    waiting = np.concatenate(([0], np.cumsum(todo))) if todo is not None else None

    def split(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if depth not in zeros:
            bit = (keys[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0)))
        return a + zeros[depth][b] - zeros[depth][a]

    work = [(skip, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while work:
        depth, a0, a1, b0, b1, differ = work.pop()
        if len(a0) > _AT_ONCE:  # bounded memory: the rest waits
            half = len(a0) // 2
            work += [(depth, *(x[s] for x in (a0, a1, b0, b1, differ))) for s in (slice(half, None), slice(0, half))]
            continue
        own = (a0 == b0) & (a1 == b1)
        pairs = np.where(own, (a1 - a0) * (a1 - a0 - 1) // 2, (a1 - a0) * (b1 - b0))
        leaf = (pairs <= _LEAF) | (depth >= 64 * keys.shape[1])
        take = leaf & (pairs > 0)
        yield from _compare(keys, a0[take], a1[take], b0[take], b1[take], chunk, budget, todo)
        go = ~leaf
        if not go.any():
            continue
        a0, a1, b0, b1, differ, own = (x[go] for x in (a0, a1, b0, b1, differ, own))
        am, bm = split(depth, a0, a1), split(depth, b0, b1)
        parts = [(a0, am, b0, bm, differ), (am, a1, bm, b1, differ), (a0, am, bm, b1, differ + 1)]
        other = ~own
        parts.append((am[other], a1[other], b0[other], bm[other], differ[other] + 1))
        a0, a1, b0, b1, differ = (np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (differ <= budget) & (a1 > a0) & (b1 > b0)
        if waiting is not None:
            alive &= (waiting[a1] > waiting[a0]) | (waiting[b1] > waiting[b0])
        work.append((depth + 1, a0[alive], a1[alive], b0[alive], b1[alive], differ[alive]))


def _apart(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the rows differ."""
    return np.bitwise_count(keys[i] ^ keys[j]).sum(1, dtype=np.int64)


def _compare(
    keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, chunk: np.ndarray | None, budget: int, todo: np.ndarray | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = a1 - a0
    wide = np.repeat(b1 - b0, rows)
    left, b_from = spread(a0, rows), np.repeat(b0, rows)
    at = 0
    ends = np.cumsum(wide)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE)))
        i = np.repeat(left[at:to], wide[at:to])
        j = spread(b_from[at:to], wide[at:to])
        at = to
        asked = i != j
        if chunk is not None:
            asked &= chunk[i] != chunk[j]
        if todo is not None:
            asked &= todo[i] | todo[j]
        i, j = i[asked], j[asked]
        near = _apart(keys, i, j) <= budget
        yield i[near], j[near]


def _led(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, labels: np.ndarray, rows: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links each large range to leaders of its own. Returns the labels and which rows have pairs left to compare.

    Rows of a range's largest set so far are linked already: their pairs with each other add nothing.
    """
    todo = np.ones(len(keys), bool)
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a < _LED:
            continue
        own = rows[a:b]
        for _ in range(_LEADERS):
            leader = a + int(np.argmax(todo[a:b]))
            near = np.flatnonzero(_apart(keys, np.full(b - a, leader), np.arange(a, b)) <= budget)
            labels = fold_labels(labels, np.full(len(near), rows[leader]), own[near])
            values, at, counts = np.unique(labels[own], return_inverse=True, return_counts=True)
            todo[a:b] = at != counts.argmax()
            if not todo[a:b].any():
                break
    return labels, todo


def _walk(words_: list[str], skip: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tasks(batches, ["tab", "key", "task_i", "task_j"]):
            node, chunks = table["node"].to_numpy(), table["chunk"].to_numpy()
            every = np.stack([table[w].to_numpy() for w in words_], 1).view(np.uint64)
            ends = np.append(starts[1:], table.num_rows)
            split = table["task_i"].to_numpy() != table["task_j"].to_numpy()
            task = np.repeat(np.arange(len(starts)), ends - starts)
            labels = np.arange(len(node))
            for crossed in (False, True):
                rows = np.flatnonzero(split == crossed)
                if not len(rows):
                    continue
                rows = rows[np.lexsort((*(every[rows, k] for k in range(len(words_) - 1, -1, -1)), task[rows]))]
                keys = every[rows]
                lo = np.flatnonzero(np.append(True, np.diff(task[rows]) != 0))
                hi = np.append(lo[1:], len(rows))
                labels, todo = _led(keys, lo, hi, labels, rows, budget)
                for i, j in trie_pairs(keys, lo, hi, chunks[rows] if crossed else None, skip, budget, todo):
                    labels = fold_labels(labels, rows[i], rows[j])
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], ["a", "b"])

    return run


def _walked(rows: DataFrame, words_: list[str], skip: int, budget: int) -> DataFrame:
    """Edges (a, b) over the nodes of ``rows``: tab, key, node, words_; the tries are the rows of one tab and key."""
    dealt = deal(rows, ["tab", "key"], "node").select("tab", "key", "task_i", "task_j", "chunk", "node", *words_)
    return dealt.mapInArrow(_walk(words_, skip, budget), "a long, b long")


def link(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of all pairs within ``budget`` bits."""
    edges = block_edges(budget)
    blocks = [
        F.struct(
            F.lit(k).alias("tab"), F.expr(f"shiftrightunsigned(bits, {64 - hi}) & {(1 << (hi - lo)) - 1}L").alias("key"),
            (F.expr(f"shiftleft(bits, {lo}) | shiftrightunsigned(bits, {64 - lo})") if lo else F.col("bits")).alias("w0"),
        )
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    small_batches(distinct.sparkSession)
    rows = distinct.select(F.col("bits").alias("node"), F.inline(F.array(*blocks)))
    return _walked(rows, ["w0"], min(b - a for a, b in zip(edges, edges[1:], strict=False)), budget)


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, bits, component_id for every row of ``docs``; component_id is the smallest id reachable over links."""
    own = stage(fingerprints(docs), "fingerprints")
    least = stage(own.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(link(least.select("bits"), budget)).select(F.col("node").alias("bits"), "root")
    rooted = least.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("bits", "component_id")
    return own.join(named, "bits").select("doc_id", "bits", "component_id")


# --- by Jaccard similarity --------------------------------------------------------------------------------------------


def bit_difference(similarity: float) -> float:
    """The chance that a bit parts two sets of equal size at this Jaccard similarity: their angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_budget(similarity: float = SIMILARITY) -> int:
    """Bits of the wide fingerprint in which pairs at ``similarity`` differ, and three and a half deviations more."""
    q = bit_difference(similarity)
    return math.ceil(WIDE * q + 3.5 * math.sqrt(WIDE * q * (1 - q)))


def orders_for(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """For n fingerprints, the leading bits of a trie (tries of some 32 rows), and how many orders of the bits are walked."""
    width = max(8, min(24, round(math.log2(max(n, 2))) - 5))
    hit = (1 - bit_difference(similarity)) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def sets_of(text: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, sorted, one text after the other, and how many each has."""
    h, count = shingles_of(text, size)
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(count))


def wide_of(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(n, 2) words of fingerprints of sets of hashes."""
    other = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack((_majority(h, count), _majority(other ^ (other >> np.uint64(29)), count)), 1)


def _wide_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                w = wide_of(*sets_of(part.column(1), size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w[:, 0]), pa.array(w[:, 1])], ["doc_id", "w0", "w1"])

    return run


def _ordered(width: int, orders: int, seed: int = 11):
    """A row for each fingerprint and order of the bits: the leading bits as key, and the words in that order."""
    r = np.random.default_rng(seed)
    turns = [r.permutation(WIDE) for _ in range(orders)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.stack([batch.column(k).to_numpy() for k in (1, 2)], 1).astype(">i8").view(np.uint8)
            bits = np.unpackbits(raw, axis=1)
            for k, turn in enumerate(turns):
                w = np.ascontiguousarray(np.packbits(bits[:, turn], axis=1)).view(">u8").astype(np.uint64)
                key = (w[:, 0] >> np.uint64(64 - width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(w), k, np.int32)), pa.array(key), batch.column(0), *(pa.array(w[:, i].view(np.int64)) for i in range(2))], ["tab", "key", "node", "w0", "w1"]
                )

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                h, count = sets_of(part.column(2), size)
                w = wide_of(h, count).view(np.int64)
                raw, ends = h.tobytes(), np.concatenate(([0], np.cumsum(count))) * 8
                own = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(own, pa.binary())], ["root", "node", "w0", "w1", "shingles"])

    return run


def jaccard_links(sets: list[np.ndarray], keys: np.ndarray, similarity: float, budget: int) -> np.ndarray:
    """Labels of the sets that links join: a similarity of at least ``similarity``, fingerprints within ``budget`` bits."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    labels = np.arange(n)
    for r in range(n - 1):
        later = np.arange(r + 1, n)
        later = later[labels[later] != labels[r]]
        least, most = np.minimum(size[later], size[r]), np.maximum(size[later], size[r])
        later = later[least >= similarity * most - 1e-9]
        later = later[_apart(keys, np.full(len(later), r), later) <= budget]
        if not len(later):
            continue
        if size[r]:
            held = flat[spread(first[later], size[later])]
            at = np.minimum(np.searchsorted(sets[r], held), size[r] - 1)
            hit = np.concatenate(([0], np.cumsum(sets[r][at] == held)))
            ends = np.cumsum(size[later])
            shared = hit[ends] - hit[ends - size[later]]
        else:
            shared = np.zeros(len(later), np.int64)
        near = later[shared >= similarity * (size[later] + size[r] - shared) - 1e-9]
        labels = fold_labels(labels, np.full(len(near), r), near)
    return labels


def _verify(similarity: float, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tasks(batches, ["root", "task_i", "task_j"], at_least_bytes=SET_BYTES):
            node = table["node"].to_numpy()
            keys = np.stack([table[w].to_numpy() for w in ("w0", "w1")], 1).view(np.uint64)
            column = table["shingles"].combine_chunks()
            a, b = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                if hi - lo > 1:
                    labels = jaccard_links([np.frombuffer(column[i].as_buffer(), np.uint64) for i in range(lo, hi)], keys[lo:hi], similarity, budget)
                    linked = np.flatnonzero(labels != np.arange(hi - lo))
                    a.append(node[lo + linked])
                    b.append(node[lo + labels[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

    return run


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """doc_id, component_id (the smallest id reachable over links) for every row of ``docs``, whose ids differ and aren't null."""
    small_batches(docs.sparkSession)
    budget = wide_budget(similarity)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    own = stage(rows.mapInArrow(_wide_batches(size), "doc_id long, w0 long, w1 long"), "wide-fingerprints")
    classes = stage(own.groupBy("w0", "w1").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", "w0", "w1", "n"), "wide-classes")
    width, orders = orders_for(classes.count(), similarity)
    ordered = classes.select("node", "w0", "w1").mapInArrow(_ordered(width, orders), "tab int, key long, node long, w0 long, w1 long")
    roots = components(_walked(ordered, ["w0", "w1"], width, budget))
    named = classes.join(roots, "node", "left").select("w0", "w1", "n", F.coalesce("root", "node").alias("root"))
    shared = named.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root")
    members = stage(own.join(named.join(shared, "root").select("w0", "w1", "root"), ["w0", "w1"]).select("root", F.col("doc_id").alias("node")), "near-candidates")
    asked = rows.join(members, rows["doc_id"] == members["node"]).select("root", "node", "text")
    sets = asked.mapInArrow(_set_batches(size), "root long, node long, w0 long, w1 long, shingles binary")
    dealt = deal(sets, ["root"], "node", members).select("root", "task_i", "task_j", "node", "w0", "w1", "shingles")
    links = components(dealt.mapInArrow(_verify(similarity, budget), "a long, b long"))
    links = stage(links, "near-links")
    least = links.groupBy("root").agg(F.least(F.min("node"), F.first("root")).alias("component_id"))
    linked = links.join(least, "root").select(F.col("node").alias("doc_id"), "component_id")
    return own.select("doc_id").join(linked, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the row with the smallest id.

    It is decided by row. Rows without id come after those with one; of rows that share an id, and of rows without, any one
    stays for its component. Where ids repeat or are null, the rows are written once with numbers of their own.
    """
    ids = docs.select(long_id(docs["doc_id"]).alias("doc_id"))
    odd = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        found = similar_texts(docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["text"]), similarity, size)
        return without(docs, "doc_id", stage(found.where("doc_id <> component_id").select("doc_id"), "near-copies"))
    row = fresh(docs, "row_number")
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = similar_texts(held.select(held[row].alias("doc_id"), held["text"]), similarity, size)
    found = found.join(held.select(held[row].alias("doc_id"), long_id(held["doc_id"]).alias("own")), "doc_id")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("doc_id"))
    gone = found.join(first, "doc_id", "left_anti").select("doc_id")
    return without(held, row, stage(gone, "near-copies")).select(*[held[c] for c in docs.columns])
