"""Token ids of whole texts, with each distinct unit of text (such as a word) encoded once for each Python worker."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import repeat
from pathlib import Path

import numpy as np

from ._shared import Utf8, spread, tokenizer_path, words

#: Bytes of distinct units, their ids and their places that a table keeps at most; a full one keeps the units that it met
#: more than once. Half as many bytes go to distinct parts of words.
KEEP = 64 << 20
#: What a unit takes besides its bytes and ids: an object, a place in a dictionary and four numbers.
_EACH = 160

# Words of printable ASCII and precomposed Latin-1 letters: no normal form changes them but lower case.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
# How the tokenizer parts such words, after lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class IdTable:
    """Ids of units, looked up by their bytes; ``encode`` is asked for those that aren't known yet, as 32-bit numbers in a row."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], keep: int = KEEP):
        self._encode, self._keep = encode, keep
        self._forget()

    def _forget(self) -> None:
        self._row: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._start = np.zeros(1 << 16, np.int64)
        self._count = np.zeros(1 << 16, np.int64)
        self._hits = np.zeros(0, np.int64)
        self._used = 0
        self._bytes = 0

    def _shrink(self) -> None:
        """Keeps units met more than once, the most frequent ones of half the table's bytes at most."""
        known, hits, ids, start, count = list(self._row), self._hits, self._ids, self._start, self._count
        rows = np.flatnonzero(hits > 1)
        rows = rows[np.argsort(-hits[rows], kind="stable")]
        each = np.fromiter((len(known[r]) for r in rows.tolist()), np.int64, len(rows)) + 4 * count[rows] + _EACH
        rows = np.sort(rows[np.cumsum(each) <= self._keep // 2])
        self._forget()
        self._bytes = int(sum(len(known[r]) for r in rows.tolist()) + 4 * count[rows].sum() + _EACH * len(rows))
        self._row = {known[r]: i for i, r in enumerate(rows.tolist())}
        n = len(rows)
        self._ids = ids[spread(start[rows], count[rows])]
        self._used = len(self._ids)
        self._count, self._start = count[rows], np.cumsum(count[rows]) - count[rows]
        self._hits = hits[rows] // 2
        if not n:
            self._forget()

    def _learn(self, new: list[bytes]) -> None:
        at = len(self._row)
        ids = self._encode(new)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(count.sum())
        if self._used + total > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros(self._used + total, np.uint32)))
        if at + len(new) > len(self._start):
            self._start, self._count = (np.concatenate((x, np.zeros(at + len(new), np.int64))) for x in (self._start, self._count))
        self._hits = np.concatenate((self._hits, np.zeros(len(new), np.int64)))
        self._ids[self._used : self._used + total] = np.frombuffer(b"".join(ids), np.uint32)
        self._start[at : at + len(new)] = self._used + np.cumsum(count) - count
        self._count[at : at + len(new)] = count
        self._used += total
        self._bytes += sum(map(len, new)) + 4 * total + _EACH * len(new)
        self._row.update(zip(new, range(at, at + len(new)), strict=True))

    def ids(self, units: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in turn; of the texts that begin at the units ``bounds``, where their ids begin."""
        rows = np.fromiter(map(self._row.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = list(dict.fromkeys(units[i] for i in missing.tolist()))
            if self._bytes > self._keep and self._row:
                self._shrink()
                rows = np.fromiter(map(self._row.get, units, repeat(-1)), np.int64, len(units))
                missing = np.flatnonzero(rows < 0)
                new = list(dict.fromkeys(units[i] for i in missing.tolist()))
            self._learn(new)
            rows[missing] = [self._row[units[i]] for i in missing.tolist()]
        self._hits += np.bincount(rows, minlength=len(self._hits))
        count = self._count[rows]
        ends = np.concatenate(([0], np.cumsum(count)))
        return self._ids[spread(self._start[rows], count)], ends[bounds]


# The settings of tokenizers of the word_bpe kind, for which words can be encoded one by one.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def parts_words(settings: dict) -> bool:
    """Whether a tokenizer's file, as JSON, is of the kind whose words can be encoded one by one."""
    pre = settings.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    drops = steps[0] == {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    return settings.get("normalizer") == _NORMALIZER and drops and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and settings["model"]["type"] == "BPE"


class WordIds:
    """For tokenizers of the word_bpe kind: NFC, lower case, and pre-tokens that never span white space.

    A text's ids are then those of its words in turn, and a plain word's those of its pre-tokens in turn. ``special``: added
    tokens' literals in the text give their own ids, as is the library's default; no literal may hold white space then.
    Whether a tokenizer is of that kind is read off its file (``parts_words``); with any other, whole texts are encoded.
    """

    def __init__(self, path: str, keep: int = KEEP, special: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self._parts: dict[str, bytes] = {}
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # Whatever case: tokens may be sought in normalised text, and a word too many here only takes the longer way.
        self._added = re.compile("|".join(map(re.escape, added)) if special and added else "(?!)", re.IGNORECASE)
        self._model = self._tokenizer.model
        self.by_words = parts_words(json.loads(Path(path).read_text())) and not any(re.search(r"\s", t) for t in added)
        self._keep, self._part_bytes = keep, 0
        self._table = IdTable(self._encode_words, keep)

    def _encode_words(self, new: list[bytes]) -> list[bytes]:
        """Plain words by the library's model, a distinct part at a time; others, and added tokens', by its whole chain."""
        out = [b""] * len(new)
        parts, known = self._parts, self._parts.get
        if self._part_bytes > self._keep // 2:
            parts.clear()
            self._part_bytes = 0
        other = []
        for i, raw in enumerate(new):
            word = raw.decode()
            if not _PLAIN.fullmatch(word) or self._added.search(word):
                other.append((i, word))
                continue
            ids = []
            for part in _PARTS.findall(word.lower()):
                own = known(part)
                if own is None:
                    mapped = part if part.isascii() else self._bytes.pre_tokenize_str(part)[0][0]
                    own = parts[part] = np.array([t.id for t in self._model.tokenize(mapped)], np.uint32).tobytes()
                    self._part_bytes += len(part) + len(own) + _EACH
                ids.append(own)
            out[i] = b"".join(ids)
        for (i, _), e in zip(other, self._tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def encode(self, text: Utf8) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offsets at which each text's ids begin."""
        if not self.by_words:
            raw = text.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(text.offsets.tolist(), text.offsets[1:].tolist(), strict=False)]
            whole = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in whole for i in x], np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in whole]))).astype(np.int64)
        w = words(text)
        return self._table.ids(w.joined.tobytes().split(b" ") if len(w.start) else [], w.bounds)


_loaded: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, special: bool = False) -> WordIds:
    """The table of this Python worker."""
    if (path, special) not in _loaded:
        _loaded[path, special] = WordIds(tokenizer_path(path), special=special)
    return _loaded[path, special]
