"""Vectorised word and shingle hashes over Arrow text buffers (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
_M64 = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Further separators for tokens: ASCII but letters and digits; bytes of other characters are parts of tokens.
TOKEN_ENDS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MUL = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end where a text ends or, in a long text, at white space."""
    at, end = 0, len(data)
    while at < end:
        to = at + PIECE
        if to >= end:
            yield at, end
            return
        k = int(np.searchsorted(offsets, to, "right")) - 1
        if offsets[k] > at:
            to = int(offsets[k])
        else:  # inside one text
            stop = int(offsets[k + 1])
            while to < stop:
                gap = np.flatnonzero(_SPACE[data[to : min(stop, to + 65536)]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(stop, to + 65536)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, ends: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and, per text, where its words begin (n + 1 entries).

    A word is a longest run of bytes other than \\x20 and \\x09 to \\x0D; `lower` folds A-Z; `ends`: other bytes
    that part words, white space among them. Words don't reach over texts.
    """
    table = _BYTE_LOWER if lower else _BYTE
    hashes, starts, stops = [], [], []
    for a, b in _cuts(data, offsets):
        piece = data[a:b]
        full = ~ends[piece]
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        first = full.copy()
        first[1:] &= ~full[:-1]
        inner = inner[(inner > 0) & (inner < b - a)]
        first[inner] = full[inner]
        last = full.copy()
        last[:-1] &= ~full[1:]
        last[inner - 1] = full[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if not len(s):
            continue
        up, down = powers(b - a)
        total = table[piece]
        total *= up[: b - a]
        np.cumsum(total, out=total)
        h = total[e]
        h[1:] -= total[s[1:] - 1]
        if s[0]:
            h[:1] -= total[s[0] - 1]
        h *= down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + a)
        stops.append(e + a + 1)
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(stops), np.searchsorted(start, offsets, "left")


def prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, ascending, the hashes of the first so many bytes of the longer words, and which words these are."""
    power, done = np.uint64(1), 0
    which = np.arange(len(start))
    h = np.zeros(len(start), np.uint64)
    for n in lengths:
        longer = end[which] - start[which] > n
        which, h = which[longer], h[longer]
        for i in range(done, n):
            h = h + _BYTE_LOWER[data[start[which] + i]] * power
            power = np.uint64(int(power) * _P & _M64)
        done = n
        yield mix(h ^ np.uint64(n)), which


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words, over the limits of texts too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _MUL[0]
    for i in range(1, k):
        out += hashes[i : i + n] * _MUL[i]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """The hash of a sequence shorter than a shingle; equal to no shingle's but by chance."""
    n = len(hashes)
    return mix((hashes * _MUL[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(0xD1B54A32D192ED03) * np.uint64(n))[0]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles (fewer words: the sequence; none: empty)."""
    data, offsets = text_buffers(column)
    h, _, _, at = words(data, offsets)
    grams = ngrams(h, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield np.array([whole(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
