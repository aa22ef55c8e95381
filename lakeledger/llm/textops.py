"""Vectorised word splitting and hashing over UTF-8 buffers.

Every function works on a *slice*: the concatenated UTF-8 bytes of some rows
(``buf``) and their boundaries (``offs``).  Slices hold about ``SLICE`` bytes,
or one row where a single text is longer, so memory stays bounded by the
longest text and never by the Arrow batch.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240611))
_BASES = [int(x) | 1 for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_TABLES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in _BASES]
_MULT = [_rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1) for _ in _BASES]
_POW: dict = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: bytes of words ``[^\x20\x09-\x0D]+``
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(which: int, n: int):
    have = _POW.get(which)
    if have is None or len(have[0]) <= n:
        size = max(SLICE, n) + 1
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POW[which] = tuple(out)
    return have


def slices(column: pa.Array, budget: int = SLICE):
    """(first row, last row + 1, bytes, offsets) runs over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + budget, "right")) - 1)
        yield a, b, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def split_words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Word starts, ends, and for each row the index of its first word (n + 1 entries)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = table[buf]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    some = offs[1:] > offs[:-1]
    at = offs[:-1][some]
    first[at] = m[at]
    at = offs[1:][some] - 1
    last[at] = m[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(buf, starts, ends, lower: bool, which: int = 0) -> np.ndarray:
    """64-bit hash of each word; two independent families (``which``).

    Words longer than 32 bytes are hashed with blake2b, as the modular
    polynomial is weak on long crafted strings.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(which, len(buf))
    table = _TABLES[which][LOWER] if lower else _TABLES[which]
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * power[: len(buf)], out=run[1:])
    size = (ends - starts).astype(np.uint64)
    h = mix((run[ends] - run[starts]) * inverse[starts] + size * U64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > 32):
        word = buf[starts[i]:ends[i]]
        word = (LOWER[word] if lower else word).tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def windows(words: np.ndarray, first: np.ndarray, k: int, which: int = 0):
    """Hash of every run of ``k`` words inside one row, its first word's index, and per row the index of its first window."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    edge = np.concatenate(([0], np.cumsum(counts)))
    total = int(edge[-1])
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), edge
    n = len(words) - k + 1
    h = words[:n] * _MULT[which][0]
    for j in range(1, k):
        h += words[j: j + n] * _MULT[which][j]
    at = np.arange(total) + np.repeat(first[:-1] - edge[:-1], counts)
    return mix(h[at]), at, edge


def cover(n_words: int, at: np.ndarray, k: int) -> np.ndarray:
    """Words covered by windows of ``k`` words that start at ``at``."""
    d = np.zeros(n_words + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + k, n_words), -1)
    return np.cumsum(d[:-1]) > 0


def int_column(batch, name: str):
    """A long column as numpy, with null as the largest value, and the mask of nulls."""
    c = batch.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    c = c.cast(pa.int64())
    null = np.asarray(c.is_null())
    return pc.fill_null(c, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), null
