"""Vectorised word splitting and hashing over the bytes of an Arrow string
array: the helper of the operators that work on words inside Arrow batches.

Nothing here loops over words: a batch's UTF-8 bytes are classified with a
256-entry table, word limits are where the class changes, and all words are
hashed together. Texts are never cut or decoded.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prepforge.llm.xxh import xxh64


def space_table() -> tuple[np.ndarray, np.ndarray]:
    """Words are ``[^\\x20\\x09-\\x0D]+``, bytes unchanged."""
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return word, np.arange(256, dtype=np.uint8)


def alnum_table() -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    return word, low


def space_lower_table() -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``."""
    return space_table()[0], alnum_table()[1]


class Words(NamedTuple):
    """Words of consecutive rows: ``low`` the mapped bytes, ``starts``/``ends``
    byte limits per word, ``first`` the first word of each row (rows + 1)."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def row_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes and their limits (rows + 1); NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n, at = len(texts), texts.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    limits = np.frombuffer(offs, np.int64, n + 1, at * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[limits[0]:limits[-1]], limits - limits[0]


def row_slices(texts: pa.Array, limit: int = 4 << 20):
    """Row ranges (lo, hi) of at most ``limit`` bytes, one row at least."""
    _, offs = row_bytes(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def split_words(texts: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> Words:
    body, offs = row_bytes(texts)
    word, lower = table
    m = word[body]
    st, en = m.copy(), m.copy()
    st[1:] &= ~m[:-1]
    en[:-1] &= ~m[1:]
    heads = offs[:-1][offs[:-1] < len(body)]
    st[heads] = m[heads]
    tails = offs[1:][offs[1:] > 0] - 1
    en[tails] = m[tails]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return Words(lower[body], starts, ends, np.searchsorted(starts, offs))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that close sums spread."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """XXH64 of every word's bytes; hashes of two seeds are independent."""
    return xxh64(w.low, w.starts, w.ends - w.starts, seed)


def window_hashes(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every ``k`` consecutive entries (``len - k + 1`` of them), built
    by doubling; it runs over row limits, which the caller masks."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    size, block, done, out = 1, h, 0, None
    while True:
        if k & size:
            m = np.uint64(pow(base, done, 1 << 64))
            part = block[done:done + len(h) - k + 1] * m
            out = part if out is None else out + part
            done += size
        if done == k:
            return mix(out)
        block = block[:-size] + block[size:] * np.uint64(pow(base, size, 1 << 64))
        size *= 2


def in_one_row(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of ``k`` words lie within one row."""
    total = int(first[-1])
    ok = np.ones(max(total - k + 1, 0), bool)
    if k > 1 and len(ok):
        edges = np.unique(first[1:-1])
        for d in range(1, k):
            x = edges - d
            x = x[(x >= 0) & (x < len(ok))]
            ok[x] = False
    return ok


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(lo[i], lo[i] + n[i])``."""
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = n > 0
    lo, n = lo[keep], n[keep]
    out[0] = lo[0]
    at = np.cumsum(n)[:-1]
    out[at] = lo[1:] - lo[:-1] - n[:-1] + 1
    return np.cumsum(out)
