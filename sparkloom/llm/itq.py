"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (``SAMPLE`` vectors of a length with the least hashes of their ids): principal
directions, then alternating sign codes and orthogonal Procrustes steps, so that the code's bits are balanced and lie close
to the data. Every vector is indexed: its code is cut into substrings, each the key of one table. Vectors that share a
substring are compared by the Hamming distance of their whole codes; what lies within the radius that pairs at the threshold
keep (``fit``) is reranked by cosine in double precision over the original components. Codes alone travel once a table;
vectors follow only for rows that have a pair left.

Width and number of tables begin with what the number of vectors and the wanted recall at the threshold ask for where vectors
have no common direction (``tables_for``). Tables are then added until pairs at the threshold are met often enough (``fit``:
pairs made of the sample's vectors, and its own ones), and again until the links of ``QUERIES`` vectors with all rows, found
by brute force, are (``recall_of``). Where that takes more than ``MOST`` times the tables, or the buckets hold half of all
pairs anyway, all pairs are compared (``all_pairs``), as they are for lengths of at most ``FEW`` vectors. All buckets are
searched whole, and hot ones are split into chunk pairs (pair_tasks).

Equal vectors are indexed once and weigh as many as they are. A pair that shares several substrings counts in the first
table that has it. A task emits a count for each vector and a spanning forest of its links, never the pairs.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing and is its own
component; vectors of different lengths link with nothing of another length; null ids, and ids that are no whole numbers,
take part in no link and have a null component; repeated rows link with each other; an empty table gives an empty result;
other columns are ignored, or kept by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, long_id, small_batches, stage, without
from .components import components, fold_labels
from .pair_tasks import deal, whole_tasks

COSINE = 0.9
SAMPLE = 4096
ROUNDS = 30
RECALL = 0.97
#: Recall that is measured must come to this.
LEAST = 0.95
#: Vectors whose links with all rows are found by brute force.
QUERIES = 256
#: Tables are added up to so many times what ``tables_for`` asks for; beyond that, all pairs are compared.
MOST = 4
#: Lengths with at most so many different vectors are compared whole.
FEW = 256
#: Of pairs at the threshold, the part that the radius keeps.
WITHIN = 0.999


@dataclass(frozen=True)
class Quantiser:
    """``rotations[r]`` maps a centred vector to the values whose signs are the r-th code."""

    mean: np.ndarray
    rotations: np.ndarray
    width: int
    tables: int
    radius: int = 1 << 30

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        bits = ((vectors - self.mean) @ np.concatenate(list(self.rotations), axis=1)) >= 0
        return bits[:, : self.width * self.tables]

    def keys_of(self, bits: np.ndarray) -> np.ndarray:
        """(n, tables) substrings of the codes as integers."""
        return bits.reshape(len(bits), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        return self.keys_of(self.bits(vectors))

    def code_of(self, bits: np.ndarray) -> np.ndarray:
        """(n, words) codes in words of 64 bits, the last one filled with zeros."""
        words = max(1, -(-bits.shape[1] // 64))
        padded = np.zeros((len(bits), 64 * words), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1).view(np.uint64)

    def met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of vectors a[i], b[i] the tables and the radius let through."""
        a, b = self.bits(a), self.bits(b)
        return (self.keys_of(a) == self.keys_of(b)).any(1) & ((a != b).sum(1) <= self.radius)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Substring width and number of tables for n vectors: buckets of some 64, and the recall wanted at the threshold.

    A bit of a balanced code parts two vectors at angle t with a chance of about t / pi.
    """
    width = max(8, min(24, round(math.log2(max(n, 2))) - 6))
    hit = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def learn(sample: np.ndarray, width: int, tables: int, rounds: int = ROUNDS, seed: int = 7) -> Quantiser:
    """Iterative quantisation, begun from as many random rotations as the tables need bits."""
    r = np.random.default_rng(seed)
    mean = sample.mean(0)
    x = sample - mean
    dims = x.shape[1]
    _, directions = np.linalg.eigh(x.T @ x)
    directions = directions[:, ::-1]
    v = x @ directions
    rotations = []
    for _ in range(-(-width * tables // dims)):
        turn, _ = np.linalg.qr(r.normal(size=(dims, dims)))
        for _ in range(rounds):
            code = np.where(v @ turn >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(v.T @ code)
            turn = a @ b
        rotations.append(directions @ turn)
    return Quantiser(mean, np.array(rotations), width, tables)


def all_pairs(dims: int) -> Quantiser:
    """One table in which all vectors have the same key."""
    return Quantiser(np.zeros(dims), np.eye(dims)[None], 0, 1)


def _at_threshold(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the threshold: each vector with one turned from it towards another, as the data lie."""
    other = np.roll(unit, 1, axis=0)
    away = other - (other * unit).sum(1, keepdims=True) * unit
    size = np.sqrt((away * away).sum(1))
    some = size > 1e-6
    unit, away = unit[some], away[some] / size[some, None]
    return unit, cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * away


def _own_pairs(unit: np.ndarray, cosine: float, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sample within the threshold."""
    found, total = [], 0
    for at in range(0, len(unit), 512):
        i, j = np.nonzero(unit[at : at + 512] @ unit.T >= cosine)
        apart = i + at < j
        found.append((i[apart] + at, j[apart]))
        total += int(apart.sum())
        if total > most:  # enough to judge by
            break
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def fit(sample: np.ndarray, n: int, cosine: float = COSINE, tables: int = 0) -> Quantiser:
    """A quantiser for n vectors, of ``tables`` tables at least, by whose tables the pairs of the sample are met."""
    width, first = tables_for(n, cosine)
    tables = max(tables, first)
    left, right = _at_threshold(sample, cosine)
    i, j = _own_pairs(sample, cosine)
    while tables <= MOST * first:
        model = learn(sample, width, tables)
        keys = model.keys(sample)
        if (keys == np.roll(keys, 1, axis=0)).mean(0).sum() >= 0.5 and len(sample) > 256:  # as random pairs go
            break
        apart = np.concatenate([(model.bits(x) != model.bits(y)).sum(1) for x, y in ((left, right), (sample[i], sample[j]))])
        model = replace(model, radius=int(np.quantile(apart, WITHIN)) + 1 if len(apart) else 1 << 30)
        recall = [float(model.met(left, right).mean())] if len(left) else []
        recall += [float(model.met(sample[i], sample[j]).mean())] if len(i) >= 100 else []
        if all(x >= LEAST for x in recall):
            return model
        tables += -(-tables // 2)
    return all_pairs(sample.shape[1])


def _meet(model: Quantiser, rep: np.ndarray, asked: np.ndarray, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = met = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1)))
            i, j = np.nonzero((v @ asked.T >= cosine) & (batch.column(0).to_numpy()[:, None] != rep))
            links += len(i)
            for lo in range(0, len(i), 65_536):
                met += int(model.met(v[i[lo : lo + 65_536]], asked[j[lo : lo + 65_536]]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links], pa.int64()), pa.array([met], pa.int64())], ["links", "met"])

    return run


def recall_of(model: Quantiser, classes: DataFrame, cosine: float, queries: int = QUERIES) -> float:
    """Of the links of ``queries`` vectors with all others, by brute force, the part that the tables meet. 1 if there are none."""
    asked = classes.select("rep", "v").orderBy(F.xxhash64(F.lit(5), F.col("rep")), "rep").limit(queries).toArrow()
    run = _meet(model, asked["rep"].to_numpy(), _unit(_matrix(asked["v"])), cosine)
    links, met = classes.select("rep", "v").mapInArrow(run, "links long, met long").agg(F.sum("links"), F.sum("met")).first()
    return met / links if links else 1.0


def _usable() -> Column:
    """Whether the row's id and vector ``v`` can link with anything."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _index(model: Quantiser):
    """A row for each vector and table: its key there and its whole code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = model.bits(_unit(_matrix(batch.column(1))))
            keys, code = model.keys_of(bits), pa.array([c.tobytes() for c in model.code_of(bits)], pa.binary())
            for k in range(model.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys[:, k]), batch.column(0), code], ["tab", "key", "rep", "code"])

    return run


def _blocks(left: np.ndarray, right: np.ndarray, across: bool, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(left), at_once):
        for b in range(0 if across else a, len(right), at_once):
            yield left[a : a + at_once], right[b : b + at_once]


def _once(keys: np.ndarray, tab: int, i: np.ndarray, j: np.ndarray, across: bool) -> np.ndarray:
    """Which pairs count here: each once, and only in the first table that has it."""
    once = np.ones(len(i), bool) if across else i < j
    return once & ~(keys[i, :tab] == keys[j, :tab]).any(1) if tab else once


_TASK = ["tab", "key", "task_i", "task_j"]


def _sides(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Of each task its table, its first row, and the rows to be met with each other, and whether they are of two chunks."""
    tab, ti, tj, chunk = (table[c].to_numpy() for c in ("tab", "task_i", "task_j", "chunk"))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
        if hi - lo > 1:
            yield int(tab[lo]), lo, lo + np.flatnonzero(chunk[lo:hi] == ti[lo]), lo + np.flatnonzero(chunk[lo:hi] == tj[lo]), bool(ti[lo] != tj[lo])


def _within(model: Quantiser, at_once: int = 512):
    """The rows that have a pair within the radius, with their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tasks(batches, _TASK):
            column = table["code"].combine_chunks()
            code = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
            keys = model.keys_of(np.unpackbits(code.view(np.uint8), axis=1)[:, : model.width * model.tables].astype(bool))
            some = np.zeros(len(code), bool)
            for tab, _, left, right, across in _sides(table, starts):
                for i, j in _blocks(left, right, across, at_once):
                    x, y = np.nonzero(_distance(code[i][:, None], code[j][None]) <= model.radius)
                    i, j = i[x], j[y]
                    once = _once(keys, tab, i, j, across)
                    some[i[once]] = some[j[once]] = True
            yield from table.select([*_TASK, "chunk", "rep"]).filter(pa.array(some)).combine_chunks().to_batches()

    return run


def _compare(model: Quantiser | None, cosine: float, at_once: int = 1024):
    """Links of the rows of each task, counted, and a spanning forest of them. Without a model, all pairs of a task count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tasks(batches, _TASK, at_least_bytes=8 << 20):
            rep, mult = table["rep"].to_numpy(), table["mult"].to_numpy()
            links, labels = np.zeros(len(rep), np.int64), np.arange(len(rep))
            column = table["v"].combine_chunks()
            first = column.offsets.to_numpy()
            for tab, lo, left, right, across in _sides(table, starts):
                hi = 1 + max(left.max(initial=lo), right.max(initial=lo))
                v = _unit(column.values[first[lo] : first[hi]].to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1))
                if model:
                    bits = model.bits(v)
                    keys, code = model.keys_of(bits), model.code_of(bits)
                for i, j in _blocks(left - lo, right - lo, across, at_once):
                    x, y = np.nonzero(v[i] @ v[j].T >= cosine)
                    i, j = i[x], j[y]
                    if model:
                        once = _once(keys, tab, i, j, across) & (_distance(code[i], code[j]) <= model.radius)
                    else:
                        once = np.ones(len(i), bool) if across else i < j
                    i, j = i[once] + lo, j[once] + lo
                    np.add.at(links, i, mult[j])
                    np.add.at(links, j, mult[i])
                    labels = fold_labels(labels, i, j)
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[labels[some]])], ["rep", "links", "other"])

    return run


_LINKS = "rep long, links long, other long"


def _linked(tasks: DataFrame, model: Quantiser | None, cosine: float) -> DataFrame:
    return tasks.select(*_TASK, "chunk", "rep", "mult", "v").mapInArrow(_compare(model, cosine), _LINKS)


def _search(classes: DataFrame, n: int, cosine: float, sample: int) -> DataFrame:
    """Links among vectors of one length, by tables of codes."""
    picked = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()
    fitted = _unit(_matrix(picked["v"]))
    model = fit(fitted, n, cosine)
    while model.width and recall_of(model, classes, cosine) < LEAST:
        model = fit(fitted, n, cosine, model.tables + -(-model.tables // 2))
    if not model.width:
        return _linked(deal(classes.select(F.lit(0).alias("tab"), F.lit(0).cast("long").alias("key"), "rep", "mult", "v"), ["tab", "key"], "rep"), None, cosine)
    indexed = classes.select("rep", "v").mapInArrow(_index(model), "tab int, key long, rep long, code binary")
    near = deal(indexed, ["tab", "key"], "rep").select(*_TASK, "chunk", "rep", "code").mapInArrow(_within(model), "tab int, key long, task_i int, task_j int, chunk int, rep long")
    asked = stage(near, "within-radius").join(classes.select("rep", "mult", "v"), "rep")
    return _linked(asked.repartition(*_TASK).sortWithinPartitions(*_TASK), model, cosine)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(long_id(vectors[id_column]).alias("vec_id"), vectors[vector_column].alias("v"))
    # Equal vectors by 128 bits of hash; those of one key but other components would be taken for equal.
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v")).alias("k2")]
    classes = rows.where(_usable()).groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.min_by("v", "vec_id").alias("v"))
    classes = stage(classes.select("k1", "k2", "rep", "mult", F.size("v").alias("dims"), "v"), "vector-classes")
    many = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).orderBy(F.desc("n"), "dims").collect()
    parts = [_search(classes.where(F.col("dims") == r["dims"]), r["n"], cosine, sample) for r in many]
    rest = classes.where(~F.col("dims").isin([r["dims"] for r in many])) if many else classes
    rest = rest.select(F.lit(0).alias("tab"), F.col("dims").cast("long").alias("key"), "rep", "mult", "v")
    found = stage(_linked(deal(rest, ["tab", "key"], "rep"), None, cosine), "vector-links")
    for part in parts:
        found = found.unionByName(stage(part, "vector-links"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), "root")
    named = classes.select("k1", "k2", "rep", "mult").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    keyed = rows.select("vec_id", _usable().alias("ok"), *key)
    out = keyed.select("vec_id", F.when(F.col("ok"), F.col("k1")).alias("k1"), F.when(F.col("ok"), F.col("k2")).alias("k2")).join(named, ["k1", "k2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """The rows of ``vectors`` that stay: of each component the row with the smallest id; of rows that share it, one.

    Rows without id, and rows whose vector links with nothing, stay.
    """
    row = fresh(vectors, "row_number")
    held = stage(vectors.withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = held.select(held[row].alias("number"), long_id(held[id_column]).alias("own"), held[vector_column].alias("v"))
    found = near_duplicates(own.where("own is not null").select("number", "v"), "number", "v", cosine).select(F.col("vec_id").alias("number"), "component_id")
    first = found.join(own.select("number", "own"), "number").groupBy("component_id").agg(F.min(F.struct("own", "number"))["number"].alias("number"))
    gone = stage(found.join(first, "number", "left_anti").select("number"), "near-vectors")
    return without(held, row, gone).select(*[held[c] for c in vectors.columns])
