"""XXH64 of many byte ranges at once, by the public specification."""

from __future__ import annotations

import numpy as np
import xxhash

# The primes of XXH64.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5

#: Longer ranges (giant words) are hashed one by one.
LONG = 512

_p1, _p2, _p3, _p4, _p5 = (np.uint64(p) for p in (P1, P2, P3, P4, P5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _p2, 31) * _p1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned hashes of ``buf[starts[i]:starts[i] + lens[i]]``."""
    out = np.empty(len(starts), np.uint64)
    giant = lens > LONG
    for i in np.flatnonzero(giant):
        out[i] = xxhash.xxh64_intdigest(buf[starts[i]:starts[i] + lens[i]].tobytes(), seed)
    rest = np.flatnonzero(~giant)
    if len(rest):
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        out[rest] = _short(padded, starts[rest], lens[rest], seed)
    return out


def _short(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    u64 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    u32 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    h = np.full(len(starts), (seed + P5) & (1 << 64) - 1, np.uint64)
    stripes = lens >> 5
    big = np.flatnonzero(stripes)
    if len(big):
        at, left = starts[big].copy(), stripes[big]
        v = [np.full(len(big), x & (1 << 64) - 1, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for t in range(int(left.max())):
            on = np.flatnonzero(left > t)
            for k in range(4):
                v[k][on] = _round(v[k][on], u64[at[on] + (32 * t + 8 * k)])
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.uint64(0), x)) * _p1 + _p4
        h[big] = acc
    h += lens.astype(np.uint64)
    at, left = starts + (stripes << 5), lens & 31
    for k in range(3):
        on = np.flatnonzero(left >= 8 * (k + 1))
        h[on] = _rotl(h[on] ^ _round(np.uint64(0), u64[at[on] + 8 * k]), 27) * _p1 + _p4
    at, left = at + (left & ~7), left & 7
    on = np.flatnonzero(left >= 4)
    h[on] = _rotl(h[on] ^ (u32[at[on]].astype(np.uint64) * _p1), 23) * _p2 + _p3
    at, left = at + (left & 4), left & 3
    for k in range(3):
        on = np.flatnonzero(left > k)
        h[on] = _rotl(h[on] ^ (buf[at[on] + k].astype(np.uint64) * _p5), 11) * _p1
    h ^= h >> np.uint64(33)
    h *= _p2
    h ^= h >> np.uint64(29)
    h *= _p3
    h ^= h >> np.uint64(32)
    return h
