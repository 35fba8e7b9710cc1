"""XXH64 of many byte ranges of one buffer at once, after the published description of the algorithm."""

from __future__ import annotations

import numpy as np

# The five primes of XXH64.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hashes ``data[start[i]:start[i] + length[i]]``; ranges of equal length are hashed together."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at8 = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    at4 = np.ndarray((len(data) + 1,), "<u4", padded.data, strides=(1,))
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, lo, hi in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            rows = order[lo:hi]
            out[rows] = _same_size(padded, at8, at4, start[rows], size, np.uint64(seed))
    return out


def _same_size(data: np.ndarray, at8: np.ndarray, at4: np.ndarray, p: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    done = 0
    if size >= 32:
        lanes = [np.full(len(p), v, np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while size - done >= 32:
            for i in range(4):
                lanes[i] = _round(lanes[i], at8[p + (done + 8 * i)])
            done += 32
        h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            h = (h ^ _round(np.uint64(0), lane)) * _P1 + _P4
    else:
        h = np.full(len(p), seed + _P5, np.uint64)
    h = h + np.uint64(size)
    while size - done >= 8:
        h = _rotl(h ^ _round(np.uint64(0), at8[p + done]), 27) * _P1 + _P4
        done += 8
    if size - done >= 4:
        h = _rotl(h ^ (at4[p + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
        done += 4
    for i in range(done, size):
        h = _rotl(h ^ (data[p + i].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))
