"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network advances ``STRIDE`` bytes a step in either direction: their embeddings, already multiplied by the input weights,
are rows of four tables and simply add up. From each step's two states every byte that it covers gets a label distribution of
its own (weights by its place in the step); a document's probabilities are the mean of its bytes' log-probabilities, taken
to probabilities again. Long texts are cut into windows of up to ``WINDOW`` steps that run side by side. Each begins
``MARGIN`` steps earlier and ends as many later, so that states don't start anew at its edges and no byte is labelled without
its surroundings; whole texts are read in bounded memory.

Training is backpropagation through time with Adam, on a documented, bounded sample: of the ``LABELS`` most frequent
languages up to ``PER_LANG`` labelled documents each, those with the least hashes of their ids among the ones not held out,
and of each ``EXCERPTS`` excerpts of ``EXCERPT`` characters from places all over its text, chosen by hash. Prediction reads
whole texts. Weights are some 20 kB, whatever the corpus, and go to executors with the task.

Defined cases: a null text or one without any letter is ``und`` with score 0; without labelled rows all are ``und``; of equal
scores the label that comes first in order is taken; ids that are no whole numbers are null, and null ids are never trained
on; equal texts get equal results; other columns are ignored, or kept by ``keep_identified`` whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Utf8, long_id, slices, small_batches, spread, utf8

STRIDE = 4
WINDOW, TRAINED = 256, 32
MARGIN = 16
HIDDEN = 16
LABELS = 256
PER_LANG = 192
EXCERPTS, EXCERPT = 4, 256
#: Rows of a language that may come to be sorted for the sample, in times ``PER_LANG``.
SPARE = 16
STEPS = 220
BATCH = 96
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """Of each direction: tables (STRIDE, 257, 3 * hidden) and recurrent weights (hidden, 3 * hidden); then the output.

    The output is (labels, 2 * hidden, STRIDE): for each label a column for each byte of a step.
    """

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    hidden: int = HIDDEN
    parameters: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        tables = [r.normal(0, 0.3, (STRIDE, 257, 3 * hidden)).astype(np.float32) for _ in range(2)]
        recurrent = [r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32) for _ in range(2)]
        return cls(labels, tables, recurrent, r.normal(0, 0.3, (len(labels), 2 * hidden, STRIDE)).astype(np.float32), np.zeros((len(labels), STRIDE), np.float32), hidden)

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]


def _run(x: np.ndarray, u: np.ndarray, hidden: int, trace: list | None = None) -> np.ndarray:
    """States of one direction over x (steps, batch, 3 * hidden), which holds each step's input part."""
    steps, batch, _ = x.shape
    states = np.empty((steps, batch, hidden), np.float32)
    h = np.zeros((batch, hidden), np.float32)
    for t in range(steps):
        own = h @ u
        gates = _sigmoid(x[t, :, : 2 * hidden] + own[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        n = np.tanh(x[t, :, 2 * hidden :] + r * own[:, 2 * hidden :])
        if trace is not None:
            trace.append((h, z, r, n, own[:, 2 * hidden :]))
        h = n + z * (h - n)
        states[t] = h
    return states


def _inputs(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """codes (steps, batch, STRIDE) -> the sum of their rows of the tables."""
    x = tables[0][codes[..., 0]]
    for k in range(1, STRIDE):
        x += tables[k][codes[..., k]]
    return x


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, the labels."""
    x = x - x.max(0)
    return x - np.log(np.exp(x).sum(0))


def _forward(model: Model, codes: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both states of each step, and the log-probabilities (labels, steps, batch, STRIDE) of each byte."""
    ahead = _run(_inputs(codes, model.tables[0]), model.recurrent[0], model.hidden, traces and traces[0])
    back = _run(_inputs(codes[::-1], model.tables[1]), model.recurrent[1], model.hidden, traces and traces[1])[::-1]
    both = np.concatenate((ahead, back), -1)
    return both, _log_softmax(np.stack([both @ w + b for w, b in zip(model.out, model.bias, strict=True)]))


def _backward(u: np.ndarray, trace: list, d_states: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: the gradients of the inputs and of the recurrent weights."""
    d_x = np.empty((*d_states.shape[:2], 3 * hidden), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, n, own_n = trace[t]
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h - n) * z * (1 - z)
        d_r = d_n * own_n * r * (1 - r)
        d_x[t, :, :hidden], d_x[t, :, hidden : 2 * hidden], d_x[t, :, 2 * hidden :] = d_z, d_r, d_n
        d_own = np.concatenate((d_z, d_r, d_n * r), -1)
        d_u += h.T @ d_own
        d_h = d_h * z + d_own @ u.T
    return d_x, d_u


def gradients(model: Model, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes and its gradients, in the order of ``Model.weights``."""
    traces: tuple[list, list] = ([], [])
    both, logp = _forward(model, codes, traces)
    batch = codes.shape[1]
    real = codes != 256
    n = max(int(real.sum()), 1)
    loss = -(logp[target, :, np.arange(batch)].transpose(1, 0, 2) * real).sum() / n
    d = np.exp(logp)
    d[target, :, np.arange(batch)] -= 1
    d = (d * (real / n)).astype(both.dtype)
    flat = both.reshape(-1, both.shape[-1])
    d_out, d_bias = np.stack([flat.T @ x.reshape(-1, STRIDE) for x in d]), d.sum((1, 2))
    d_both = sum(x @ w.T for x, w in zip(d, model.out, strict=True))
    d_tables, d_recurrent = [], []
    for k, seen in ((0, codes), (1, codes[::-1])):
        half = d_both[..., k * model.hidden : (k + 1) * model.hidden]
        d_x, d_u = _backward(model.recurrent[k], traces[k], half if k == 0 else half[::-1], model.hidden)
        d_t = np.zeros_like(model.tables[k])
        rows = d_x.reshape(-1, d_x.shape[-1])
        for s in range(STRIDE):
            code = np.ascontiguousarray(seen[..., s]).ravel()
            order = np.argsort(code, kind="stable")
            values, first = np.unique(code[order], return_index=True)
            d_t[s][values] = np.add.reduceat(rows[order], first, axis=0)
        d_tables.append(d_t)
        d_recurrent.append(d_u)
    return float(loss), [*d_tables, *d_recurrent, d_out, d_bias]


def _windows(text: Utf8, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of ``steps`` steps over each text begin, their bytes, and their documents."""
    span = steps * STRIDE
    per = -(-np.diff(text.offsets) // span)
    doc = np.repeat(np.arange(len(text)), per)
    begin = spread(np.zeros(len(per), np.int64), per) * span + text.offsets[:-1][doc]
    return begin, np.minimum(span, text.offsets[1:][doc] - begin), doc


def _codes(text: Utf8, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, steps: int, margin: int) -> np.ndarray:
    """(windows, steps + 2 * margin, STRIDE), with 256 beyond a text's ends; the window proper follows the margin."""
    edge = margin * STRIDE
    codes = np.full((len(doc), steps * STRIDE + 2 * edge), 256, np.int16)
    first = np.maximum(begin - edge, text.offsets[:-1][doc])
    count = np.minimum(begin + size + edge, text.offsets[1:][doc]) - first
    codes[np.repeat(np.arange(len(doc)), count), spread(first - begin + edge, count)] = text.data[spread(first, count)]
    return codes.reshape(len(doc), -1, STRIDE)


def fit(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Model | None:
    """Trains on windows of ``TRAINED`` steps of the given texts, which are excerpts, with margins as in prediction."""
    labels = sorted(set(langs))
    if not labels:
        return None
    model = Model.fresh(labels)
    raw = utf8(pa.array(texts, pa.large_string()))
    begin, size, doc = _windows(raw, TRAINED)
    codes = _codes(raw, begin, size, doc, TRAINED, MARGIN)
    target = np.array([labels.index(x) for x in langs])[doc]
    if len(labels) == 1 or not len(codes):
        return model
    r = np.random.default_rng(seed)
    weights = model.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = 1 / np.bincount(target, minlength=len(labels))[target]
    for step in range(1, steps + 1):
        pick = r.choice(len(codes), min(BATCH, len(codes)), p=share / share.sum())
        _, grads = gradients(model, np.ascontiguousarray(codes[pick].transpose(1, 0, 2)), target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, 2 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g * min(1, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def predict(model: Model | None, column: pa.Array, at_once: int = 256) -> tuple[list[str], np.ndarray]:
    """Label and score of each text; whole texts, ``at_once`` windows at a time."""
    text = utf8(column)
    letters = pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, bool)
    if model is None:
        return [UNDETERMINED] * len(text), np.zeros(len(text))
    begin, size, doc = _windows(text, WINDOW)
    order = np.argsort(size, kind="stable")  # windows of about one length run together
    total, seen = np.zeros((len(text), len(model.labels))), np.zeros(len(text))
    for lo in range(0, len(order), at_once):
        own = order[lo : lo + at_once]
        steps = -(-int(size[own[-1]]) // STRIDE)
        part = np.ascontiguousarray(_codes(text, begin[own], size[own], doc[own], steps, MARGIN).transpose(1, 0, 2))
        _, logp = _forward(model, part)
        inner = slice(MARGIN, MARGIN + steps)
        covered = np.arange(steps * STRIDE).reshape(steps, 1, STRIDE) < size[own][None, :, None]
        np.add.at(total, doc[own], np.stack([(x[inner] * covered).sum((0, 2)) for x in logp], 1))
        np.add.at(seen, doc[own], size[own])
    p = np.exp(_log_softmax((total / np.maximum(seen, 1)[:, None]).T)).T
    best = p.argmax(1)
    found = letters & (seen > 0)
    labels = [model.labels[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), found.tolist(), strict=True)]
    return labels, np.where(found, p.max(1), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The bounded sample: lang, text (an excerpt) and a place in the order of training.

    Hashes above what ``SPARE * per_lang`` rows of a language are expected to stay under are left out before anything is
    sorted, so that the rows that meet in a language's task don't grow with the table.
    """
    rows = docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang")).withColumn("h", F.xxhash64("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS).collect()
    if not counts:
        return rows.select("lang", "text", "h").where("false")
    most = [(r["lang"], min(SPARE * per_lang * 2**63 // r["n"], 2**63 - 1)) for r in counts]
    bounds = docs.sparkSession.createDataFrame(most, "lang string, most long")
    near = rows.join(F.broadcast(bounds), "lang").where((F.shiftrightunsigned("h", 1) <= F.col("most")) & F.col("text").isNotNull())
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "doc_id", F.xxhash64("text")))
    room = F.greatest(F.char_length("text") - EXCERPT, F.lit(0)) + 1
    cuts = [F.struct(F.xxhash64("h", F.lit(k)).alias("h"), F.substr("text", (F.pmod(F.xxhash64("h", F.lit(k), F.lit(1)), room) + 1).cast("int"), F.lit(EXCERPT)).alias("text")) for k in range(EXCERPTS)]
    near = near.select("lang", "h", "doc_id", F.array(*cuts).alias("cuts"), F.col("text"))
    chosen = near.withColumn("rank", first).where(F.col("rank") <= per_lang)
    return chosen.select("lang", F.inline("cuts")).select("lang", "text", "h")


def fit_on(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    sample = training_rows(docs, per_lang).orderBy("h", "text").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. Without a model, one is trained on ``docs``."""
    small_batches(docs.sparkSession)
    model = model or fit_on(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                labels, score = predict(model, part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(labels, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(long_id(docs["doc_id"]).alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``min_score``; all their columns, and no shuffle."""
    small_batches(docs.sparkSession)
    model, at = fit_on(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                labels, score = predict(model, part.column(at))
                known = np.array([x != UNDETERMINED for x in labels], bool)
                yield part.filter(pa.array(known & (score >= min_score), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
