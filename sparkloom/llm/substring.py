"""Substring deduplication by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of a document. Words are removed that lie in a window whose word sequence also
starts anywhere else. Five passes over chunks of documents (``chunks``), none of which moves a document:

1. seeds: of every window the ``SEED``-word phrase with the least hash; windows with equal words have equal seeds, so only
   windows whose seed recurs can recur. One word in fourteen is a seed.
2. candidates: 95 bits of hash of all windows with a recurring seed. A window that other chunks hold, too, and that its own
   chunk holds once, is asked of the chunk before it among its holders (the first asks the second), so that a passage that
   all chunks share costs each of them one passage out and one in.
3. passages: the chunks asked send the words of those windows, runs of them as one passage.
4. automata: each candidate window now has another occurrence's words beside it, of its own chunk or sent. Where these stop
   following one another a pattern begins: the other occurrence's window. Aho-Corasick automata of the distinct patterns, in
   shards of bounded size, are compiled, and
5. all documents are streamed through them. Only what they locate is marked: from there a passage extends as long as the
   words of both occurrences are equal, byte by byte.

So hashes only propose; no word is removed that doesn't stand elsewhere in the same sequence. Automata and the passages sent
to a chunk are bounded by what the chunk itself holds, not by the corpus.

Defined cases: a null text has no words; fewer words than a window are never removed; very long texts are chunks of their
own; repeated rows are documents of their own, so that each makes the other's windows recur; ids that are no whole numbers
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import Utf8, Words, long_id, spread, stage, words
from ._xxh64 import xxh64
from .chunks import ChunkTable, among, flagged, joined_keys, recurring, text_of

WINDOW = 35
SEED = 8
#: Bytes of passages that one automaton holds.
SHARD_BYTES = 1 << 20

# Fixed odd multipliers, for hashes of runs of words.
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

#: A window's key: 63 bits of hash with a flag for windows that their chunk holds more than once, and 32 bits of another.
_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])
#: A window that a chunk is asked for, and who asks.
_ASKED = np.dtype([("a", "<u8"), ("b", "<u4"), ("to", "<i8")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(word_hash: np.ndarray, length: int, at: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Of the runs of ``length`` words that start at the words ``at``, a hash of their words in turn."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word_hash * _powers(base, len(word_hash)), dtype=np.uint64)))
    return _mix((sums[at + length] - sums[at]) * _powers(pow(base, -1, 1 << 64), len(word_hash) + 1)[at])


def starts_of(w: Words, length: int) -> np.ndarray:
    """The words at which a run of ``length`` words of one document starts."""
    return spread(w.bounds[:-1], np.maximum(np.diff(w.bounds) - length + 1, 0))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i:i + width] for each i that has as many."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class _Chunk:
    """Words of texts and hashes of runs of them."""

    def __init__(self, text: Utf8, window: int):
        self.words = words(text)
        self.window = window
        w = self.words
        self.starts = starts_of(w, window)
        self.hash = xxh64(w.joined, w.start, w.end - w.start) if len(self.starts) else np.zeros(0, np.uint64)

    def seeds(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every window its seed's hash, and the hashes of all phrases chosen as seeds, once for each place."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        phrase = np.full(len(self.hash), np.iinfo(np.uint64).max, np.uint64)
        at = starts_of(self.words, size)
        phrase[at] = run_hashes(self.hash, size, at)
        span = self.window - size + 1
        least = _sliding(phrase, span, np.minimum)[self.starts]
        by_start = np.zeros(len(phrase) + span - 1, np.uint64)
        by_start[self.starts + span - 1] = least
        most = _sliding(by_start, span, np.maximum)  # over the windows that contain a phrase, the largest of their seeds
        return least, phrase[(most == phrase) & (most > 0)]

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        """Keys of the windows that start at ``at``, the flag being zero."""
        out = np.zeros(len(at), _KEY)
        if len(at):
            out["a"] = run_hashes(self.hash, self.window, at) << np.uint64(1)
            out["b"] = run_hashes(self.hash ^ (self.hash >> np.uint64(29)), self.window, at, _OTHER) >> np.uint64(32)
        return out


def _codes(keys: np.ndarray) -> np.ndarray:
    """One number for both parts of each key, by which windows of a chunk are looked up."""
    return _mix((keys["a"] & ~np.uint64(1)) ^ _mix(keys["b"].astype(np.uint64) * np.uint64(_OTHER)))


def _seed_keys(window: int, seed: int):
    def run(docs: pa.RecordBatch, _: np.ndarray) -> np.ndarray:
        return flagged(_Chunk(text_of(docs), window).seeds(seed)[1])

    return run


def _window_keys(window: int, seed: int):
    def run(docs: pa.RecordBatch, blobs: np.ndarray) -> np.ndarray:
        if not len(blobs):
            return np.zeros(0, _KEY)
        chunk = _Chunk(text_of(docs), window)
        own = among(chunk.seeds(seed)[0] << np.uint64(1), joined_keys(blobs))
        keys = chunk.window_keys(chunk.starts[own])
        keys = keys[np.lexsort((keys["b"], keys["a"]))]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        keys, count = keys[first], np.diff(np.append(first, len(keys)))
        keys["a"] |= (count > 1).astype(np.uint64)
        return keys

    return run


def requests(keys: DataFrame) -> DataFrame:
    """(chunk, blob): the windows that other chunks ask of a chunk. A chunk that holds a window twice needs no other's."""

    def run(_: tuple, table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b.as_buffer(), _KEY) for b in table["blob"]]
        every = np.concatenate(blobs)
        chunk = np.repeat(np.array(table["chunk"].to_pylist(), np.int64), [len(b) for b in blobs])
        a, b = every["a"] >> np.uint64(1), every["b"]
        order = np.lexsort((chunk, b, a))
        a, b, chunk, twice = a[order], b[order], chunk[order], (every["a"][order] & np.uint64(1)) == 1
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        after, before = np.append(False, same), np.append(same, False)  # has a holder before it; after it
        asks = ~twice & (after | before)
        source = np.where(after, np.roll(chunk, 1), np.roll(chunk, -1))[asks]
        out = np.zeros(int(asks.sum()), _ASKED)
        out["a"], out["b"], out["to"] = a[asks] << np.uint64(1), b[asks], chunk[asks]
        order = np.lexsort((out["to"], source))
        sources, first = np.unique(source[order], return_index=True)
        parts = np.split(out[order], first[1:]) if len(sources) else []
        return pa.table([pa.array(sources, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "blob"])

    return keys.groupBy("bucket").applyInArrow(run, "chunk long, blob binary")


def _send(window: int):
    """Passages asked of a chunk, for each chunk that asks: words parted by spaces, passages ended by line feeds."""

    def run(_: int, docs: pa.RecordBatch, blobs: np.ndarray) -> pa.RecordBatch:
        asked = np.frombuffer(np.ascontiguousarray(blobs), _ASKED)
        to, texts = [], []
        if len(asked):
            chunk = _Chunk(text_of(docs), window)
            w, codes = chunk.words, _codes(chunk.window_keys(chunk.starts))
            order = np.argsort(codes, kind="stable")
            place = chunk.starts[order[np.searchsorted(codes[order], _codes(asked))]]
            order = np.lexsort((place, asked["to"]))
            place, who = place[order], asked["to"][order]
            opens = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (who[1:] != who[:-1])))
            joined, parts = w.joined.tobytes(), {}
            for lo, hi in zip(opens.tolist(), [*opens[1:].tolist(), len(place)], strict=True):
                parts.setdefault(int(who[lo]), []).append(joined[w.start[place[lo]] : w.end[place[hi - 1] + window - 1]] + b"\n")
            to, texts = list(parts), [b"".join(p) for p in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(texts, pa.binary())], ["chunk", "blob"])

    return run


def _passages(blobs: np.ndarray) -> Utf8:
    """The passages sent to a chunk, each a text of its own."""
    ends = np.flatnonzero(blobs == 0x0A) + 1
    return Utf8(blobs, np.concatenate((np.zeros(1, np.int64), ends)), np.ones(len(ends), bool))


def _occurrences(w: Words, patterns: list[bytes], window: int) -> np.ndarray:
    """The words at which one of ``patterns``, each of ``window`` words parted by spaces, occurs, by Aho-Corasick automata."""
    import ahocorasick

    joined = w.joined.tobytes().decode("latin-1")
    patterns = list(dict.fromkeys(patterns))
    found: list[int] = []
    lo = 0
    while lo < len(patterns):
        automaton, size = ahocorasick.Automaton(), 0
        while lo < len(patterns) and (not size or size + len(patterns[lo]) <= SHARD_BYTES):
            automaton.add_word(f" {patterns[lo].decode('latin-1')} ", len(patterns[lo]) + 2)
            size += len(patterns[lo])
            lo += 1
        automaton.make_automaton()
        for d in np.flatnonzero(np.diff(w.bounds) >= window).tolist():
            a = int(w.start[w.bounds[d]])
            text = f" {joined[a : int(w.end[w.bounds[d + 1] - 1])]} "
            found += [a + end - size_ + 1 for end, size_ in automaton.iter(text)]
    return np.searchsorted(w.start, np.array(sorted(found), np.int64))


def _others(own: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """For each of the codes ``own``, another place with that code: another of ``own``, else len(own) + one of ``sent``, else -1."""
    n = len(own)
    other = np.full(n, -1, np.int64)
    if len(sent):
        order = np.argsort(sent, kind="stable")
        at = order[np.minimum(np.searchsorted(sent[order], own), len(sent) - 1)]
        other = np.where(sent[at] == own, n + at, -1)
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    after, before = np.append(False, same), np.append(same, False)
    other[order[before]] = np.roll(order, -1)[before]
    other[order[after]] = np.roll(order, 1)[after]
    return other


def _equal_windows(a: bytes, b: bytes, window: int) -> np.ndarray:
    """Of two runs of as many words, the windows whose words are equal."""
    if a == b:
        return np.ones(a.count(b" ") + 2 - window, bool)
    same = np.array([x == y for x, y in zip(a.split(b" "), b.split(b" "), strict=True)])
    return np.convolve(same, np.ones(window, np.int64), "valid") == window


def _marked(chunk: _Chunk, blobs: np.ndarray) -> np.ndarray:
    """Which words lie in a window that stands elsewhere, too."""
    w, window, starts = chunk.words, chunk.window, chunk.starts
    covered = np.zeros(len(w.start) + 1, np.int64)
    if not len(starts):
        return covered[:-1] > 0
    sent = _Chunk(_passages(blobs), window)
    other = _others(_codes(chunk.window_keys(starts)), _codes(sent.window_keys(sent.starts)))
    rows = np.flatnonzero(other >= 0)
    if not len(rows):
        return covered[:-1] > 0
    at, n = starts[rows], len(w.start)
    there = np.concatenate((starts, sent.starts + n + 1))[other[rows]]  # words of both, one after the other, with a gap
    opens = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (there[1:] != there[:-1] + 1)))
    joined = (w.joined.tobytes(), sent.words.joined.tobytes())
    sides = ((w.start, w.end), (sent.words.start, sent.words.end))

    def run_of(place: int, length: int) -> bytes:
        side = int(place > n)
        begin, end = sides[side]
        place -= side * (n + 1)
        return joined[side][begin[place] : end[place + length - 1]]

    runs = list(zip(opens.tolist(), [*opens[1:].tolist(), len(at)], strict=True))
    while runs:
        located = np.zeros(n, bool)
        located[_occurrences(w, [run_of(int(there[lo]), window) for lo, _ in runs], window)] = True
        for lo, hi in runs:
            if located[at[lo]]:
                length = hi - lo + window - 1
                same = _equal_windows(run_of(int(at[lo]), length), run_of(int(there[lo]), length), window)
                here = at[lo:hi][same]
                np.add.at(covered, here, 1)
                np.add.at(covered, here + window, -1)
        # A run whose first window isn't there after all (two texts of one hash) begins anew at its next window.
        runs = [(lo + 1, hi) for lo, hi in runs if not located[at[lo]] and lo + 1 < hi]
    return np.cumsum(covered)[:-1] > 0


def _clean(window: int, with_text: bool):
    def run(_: int, docs: pa.RecordBatch, blobs: np.ndarray) -> pa.RecordBatch:
        chunk = _Chunk(text_of(docs), window)
        w, gone = chunk.words, _marked(chunk, blobs)
        kept = ~gone
        removed = np.concatenate(([0], np.cumsum(gone)))
        bytes_ = w.joined.tobytes()
        shas, texts = [], []
        for d in range(docs.num_rows):
            lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
            mine = kept[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0])))) + lo
            text = b" ".join(bytes_[w.start[a] : w.end[b - 1]] for a, b in edge.reshape(-1, 2).tolist())
            shas.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode())
        n = np.diff(w.bounds)
        columns = [docs.column(0), pa.array(n, pa.int64()), pa.array(removed[w.bounds[1:]] - removed[w.bounds[:-1]], pa.int64()), pa.array(shas)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(texts, pa.string())] * with_text], [*names, *["text"] * with_text])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words as ``text`` if asked for."""
    table = ChunkTable.write(docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text")))
    seeds = stage(recurring(table.keys(_seed_keys(window, seed))), "seeds")
    asked = stage(requests(table.keys(_window_keys(window, seed), seeds)), "asked")
    sent = stage(table.finish(_send(window), "chunk long, blob binary", asked), "passages")
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    out = stage(table.finish(_clean(window, with_text), ddl, sent), "kept")
    table.drop()
    return out
