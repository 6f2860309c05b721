"""Vectorised words and rolling hashes over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 never uses these bytes inside a longer
character, so words of bytes are the words of the text.

Hashes are polynomials modulo 2**64 (numpy's uint64 wraps). Such a polynomial takes some different sequences of 1024
and more terms as equal whatever its base (Thue-Morse sequences), so only words of up to SHORT bytes and windows of up to
SHORT words are hashed by one; longer words get XXH3, longer windows fold the mixed hashes of their parts. A second seed
gives an independent hash of everything, for comparisons that must not rest on 64 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bases of the polynomials over bytes and over words, by seed.
BYTE_BASES, WORD_BASES = (0x9E3779B97F4A7C15, 0xA24BAED4963EE407), (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Bytes of a word, and words of a window, up to which a polynomial hashes them.
SHORT = 32
#: Bytes hashed in one go; bounds the temporary arrays (8 bytes each) whatever the text.
SPAN = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLES = [mix(np.arange(1, 257, dtype=U) * U(m)) for m in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7)]
_LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER = [t[np.frombuffer(_LOWERED, np.uint8)] for t in _TABLES]


@functools.lru_cache(16)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j for j < size."""
    up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(SPAN + 1, 1 << max(0, size - 1).bit_length()))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its values; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    word = ~SEPARATORS[data]
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin = offsets[offsets < len(data)]
    first[begin] = word[begin]
    final = offsets[offsets > 0] - 1
    last[final] = word[final]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with lower, A-Z count as a-z."""
    table, out = (_LOWER if lower else _TABLES)[seed], np.empty(len(starts), U)
    long = ends - starts > SHORT
    few = np.flatnonzero(long)
    if len(few):
        raw = memoryview(np.ascontiguousarray(data))
        for i, s, e in zip(few.tolist(), starts[few].tolist(), ends[few].tolist(), strict=True):
            out[i] = xxhash.xxh3_64_intdigest(raw[s:e].tobytes().translate(_LOWERED) if lower else raw[s:e], seed)
    rest = np.flatnonzero(~long) if len(few) else slice(None)
    starts, ends = starts[rest], ends[rest]
    found = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        up, down = powers(BYTE_BASES[seed], to - at + 1)
        total = np.zeros(to - at + 1, U)
        np.cumsum(table[data[at:to]] * up[: to - at], dtype=U, out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        found[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(WORD_BASES[seed]))
        i = j
    out[rest] = found
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp: the hash of words[i:i + size] for each i, all from one running sum."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    if size > SHORT:  # parts of SHORT words, the last one where the window ends
        part = window_hashes(words, SHORT, seed)
        out = np.full(n, U(size))
        for at in [*range(0, size - SHORT, SHORT), size - SHORT]:
            out = mix(out * U(WORD_BASES[seed]) + part[at : at + n])
        return out
    out = np.empty(n, U)
    for at in range(0, n, SPAN):
        to = min(n, at + SPAN)
        part = words[at : to + size - 1]
        up, down = powers(WORD_BASES[seed], len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], dtype=U, out=total[1:])
        out[at:to] = mix((total[size:] - total[:-size]) * down[: to - at] + U(size))
    return out


def windows_inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """True for each i whose window of size words stays within its text; bounds as word_spans gives them."""
    n = int(bounds[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    inside = np.ones(n, bool)
    for back in range(1, size):
        cut = bounds[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return inside


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
