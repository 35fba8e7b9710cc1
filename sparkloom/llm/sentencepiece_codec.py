"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces, scores and types, trainer and normaliser settings) and rebuilt as a tokenizer:
normaliser (character map, extra white space), metaspace marker, unigram scores or, for BPE models, the merges that the
scores imply, byte fallback, and the decoder. Whole texts are encoded in batches of about 1 MB on ``THREADS`` threads of the
library, and decoded again by the rebuilt decoder.

The ids returned are always the rebuilt tokenizer's. Parity is a verdict on them: whole texts are encoded by the
sentencepiece library, too, and the row says whether it gives the same ids.

Defined cases: a null or empty text has no ids; equal rows get equal ids; very long texts are encoded whole; ids that are no
whole numbers are null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import long_id, slices, small_batches, tokenizer_path, utf8

MARK = "▁"
#: Threads of the library in each Python worker.
THREADS = 2

# Piece types and model types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


@dataclass(frozen=True)
class ModelProto:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    @classmethod
    def parse(cls, raw: bytes) -> ModelProto:
        pieces, scores, types, trainer, normaliser = [], [], [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        return cls(
            pieces, scores, types, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), normaliser.get(2, b""),
            bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
        )

    def merges(self) -> list[tuple[str, str]]:
        """Of a BPE model, every pair of pieces that makes a piece, by that piece's score and then by the pair's ids."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        found = [
            (-self.scores[i], i, ids[p[:cut]], ids[p[cut:]], p[:cut], p[cut:])
            for p, i in ids.items() for cut in range(1, len(p)) if p[:cut] in ids and p[cut:] in ids
        ]
        return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    """Encodes and decodes like the sentencepiece library does with the model at ``path``."""

    def __init__(self, path: str, check: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        raw = Path(path).read_bytes()
        self.proto = ModelProto.parse(raw)
        self.tokenizer = self._build(self.proto)
        self._reference = None
        if check:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_proto=raw)

    @staticmethod
    def _build(proto: ModelProto):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if proto.kind == UNIGRAM:
            model = models.Unigram(list(zip(proto.pieces, proto.scores, strict=True)), proto.unk_id, proto.byte_fallback)
        elif proto.kind == BPE:
            vocab = {p: i for i, p in enumerate(proto.pieces)}
            model = models.BPE(vocab, proto.merges(), unk_token=proto.pieces[proto.unk_id], fuse_unk=True, byte_fallback=proto.byte_fallback)
        else:
            raise ValueError(f"model type {proto.kind} is neither unigram nor BPE")
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
        if proto.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * proto.dummy_prefix + [normalizers.Replace(" ", MARK)] * proto.escape
        tokenizer.normalizer = normalizers.Sequence(steps)
        tokenizer.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * proto.dummy_prefix])
        return tokenizer

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Whole texts, on the library's threads. An empty text has no ids."""
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [ids if t else [] for ids, t in zip(out, texts, strict=True)]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """By the rebuilt decoder."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def parity(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each text."""
        return [a == b for a, b in zip(ids, self._reference.encode(texts, num_threads=1), strict=True)]


def _little_endian(ids: list[int]) -> array:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


_loaded: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The codec of this Python worker. ``model`` is a path, or the name of a public tokenizer's file."""
    if model not in _loaded:
        _loaded[model] = Codec(tokenizer_path(model))
    return _loaded[model]


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, parity (both libraries agree), round_trip (the ids decode to the text), and ids if asked."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, 1):
                raw, bounds = (text := utf8(part.column(1))).data.tobytes(), text.offsets.tolist()
                texts = [raw[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]
                ids = own.encode_batch(texts)
                same = [x == t for x, t in zip(own.decode_batch(ids), texts, strict=True)]
                crc = [zlib.crc32(_little_endian(x)) for x in ids]
                columns = [part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array(own.parity(texts, ids), pa.bool_()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ddl = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(long_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, ddl)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids. Null ids decode to an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = own.decode_batch([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(long_id(encoded["doc_id"]).alias("doc_id"), encoded["ids"].alias("ids")).mapInArrow(run, "doc_id long, text string")
