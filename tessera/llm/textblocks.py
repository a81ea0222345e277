"""Vectorised views of UTF-8 text columns, shared by the operators that run inside Arrow tasks.

A task gets Arrow batches; `blocks` cuts them into runs of rows of about a megabyte (a longer text
is a block of its own), so that the numpy passes below stay inside the CPU caches and memory does
not depend on the batch size. All hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_MASK = (1 << 64) - 1


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, _MASK, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _odd(11, 256)
_STEP = _odd(12, 64)
_BASE = int(_odd(13, 1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest run so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > 64 * BLOCK_BYTES:
            return have[:n]
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Block:
    """Some rows of a text column: `data` are their bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.rows = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty. `Block.first` is the row of the column at which the block starts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, bytes of longer characters as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a block: byte ranges [starts, ends), `counts` of each row, and the row of each word."""

    def __init__(self, block: Block, inside: np.ndarray):
        word = np.zeros(len(block.data) + 2, bool)
        np.take(inside, block.data, out=word[1:-1])
        new = np.zeros(len(block.data) + 1, bool)  # a row starts here
        new[block.offsets] = True
        here, before = word[1:], word[:-1]
        self.starts = np.flatnonzero(here & (~before | new))
        self.ends = np.flatnonzero(before & (~here | new))
        self.bounds = np.searchsorted(self.starts, block.offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(block.rows), self.counts)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c such that (c[e] - c[s]) * inverse ** s identifies data[s:e]."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], powers(_BASE, len(data)), out=c[1:])
    np.cumsum(c[1:], out=c[1:])
    return c


def range_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((c[ends] - c[starts]) * powers(_INVERSE, len(c))[starts])


def next_hashes(c: np.ndarray, n: int, size: int) -> np.ndarray:
    """`range_hashes` of the `size` bytes from each of the first n places on."""
    return mix((c[size : size + n] - c[:n]) * powers(_INVERSE, len(c))[:n])


#: Longer words are hashed with BLAKE2b: sums of powers modulo 2 ** 64 can be made equal on purpose where a text is long (Thue-Morse words of 1024 letters).
POLYNOMIAL = 64


def word_hashes(block: Block, words: Words, lower: bool = False) -> np.ndarray:
    data = LOWER[block.data] if lower else block.data
    out = range_hashes(prefix_hashes(data), words.starts, words.ends)
    for i in np.flatnonzero(words.ends - words.starts > POLYNOMIAL).tolist():
        out[i] = int.from_bytes(blake2b(data[words.starts[i] : words.ends[i]], digest_size=8).digest(), "little")
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries of h, in order; shorter by n - 1 than h (empty if h is shorter than n)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _STEP[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * (_STEP[j] if j < 64 else np.uint64(pow(int(_STEP[1]), j, 1 << 64)))
    return mix(out)


def sliding(fold, h: np.ndarray, w: int) -> np.ndarray:
    """fold (np.minimum or np.maximum) of each w consecutive entries, in about log2(w) passes."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = fold(out[: len(out) - step], out[step:])
        have += step
    return out
