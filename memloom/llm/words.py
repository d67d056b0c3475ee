"""Vectorised words, shingles and hashes of whole texts in an Arrow column.

Words are maximal runs of bytes other than space and tab to carriage return,
the same on UTF-8 bytes as on code points.  Within a block of texts words are
told apart by their bytes: each gets a code from Arrow's dictionary, and runs
of words get codes from pairs of codes, so counts and comparisons rest on no
hash.  Where texts of different tasks meet, a word stands for itself by a
keyed SipHash of its bytes, made once for each distinct word of a block, under
a key that never changes, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BASE = 6364136223846793005
#: Keys of the two hashes of a word, sixteen bytes each.
_KEYS = ("memloom-word-one", "memloom-word-two")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each block; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK_BYTES, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_bounds(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of its first word (one more entry at the end).
    ``between`` tells for each byte value whether it parts words."""
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[:-1] += inside
    edge[1:] -= inside
    starts, ends = edge == 1, edge == -1
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts  # words that meet where texts meet
    starts[both] = True
    ends[both] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offs)


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, the same for equal bytes only, and the distinct words that the numbers stand for.
    With ``lower``, A-Z count as a-z."""
    size = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    body = data[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])]
    if lower:
        body = _LOWER[body]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(body))])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def strong(words: pa.Array, key: int = 0) -> np.ndarray:
    """SipHash of each word's bytes."""
    if not len(words):
        return np.zeros(0, _U)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), hash_key=_KEYS[key], categorize=False)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, for use across tasks."""
    code, words = codes(data, starts, ends, lower)
    return strong(words)[code]


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a, b) of numbers from 0, the same for equal pairs only."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def runs(code: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words, by the word it starts with, the same for equal runs only."""
    now, k = code, 1
    while 2 * k <= width:
        now, k = paired(now[: len(now) - k], now[k:]) if len(now) > k else now[:0], 2 * k
    if k < width:
        gap = width - k
        now = paired(now[: len(now) - gap], now[gap:]) if len(now) > gap else now[:0]
    return now


def sets(code: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text where its distinct runs of ``width`` words start (one place each);
    with fewer words, where all its words do; without words, nowhere."""
    run = runs(code, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield a + np.unique(run[a : b - width + 1], return_index=True)[1]
        else:
            yield np.arange(a, min(b, a + 1))


def run_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """By the word it starts with, the hash of each run of ``width`` words; at a text of fewer words that of them all."""
    n = len(hashes)
    out = np.zeros(n, _U)
    k = max(0, n - width + 1)
    for j in range(width if k else 0):
        out[:k] += hashes[j : j + k] * _U((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64) | 1)
    out = mix(out)
    short = np.flatnonzero((np.diff(first) < width) & (np.diff(first) > 0))
    for t in short.tolist():
        a, b = int(first[t]), int(first[t + 1])
        h = 0x243F6A8885A308D3 ^ (b - a)
        for x in hashes[a:b].tolist():
            h = (h * _BASE + x) % (1 << 64)
        out[a] = mix(np.array([h], _U))[0]
    return out
