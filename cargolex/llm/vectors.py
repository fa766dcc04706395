"""Tokenising and hashing of whole Arrow batches with numpy: no Python object per word.

Texts are taken as UTF-8 bytes. A class of word bytes is a table of 256 flags; as every byte of a
non-ASCII character is 0x80 or more, classes that hold all non-ASCII characters or none are exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; arrays of 8 bytes for each still fit a core's cache.
PIECE = 1 << 19

_random = np.random.Generator(np.random.PCG64(20240613))
BYTE = _random.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
BASE = int(_random.integers(1 << 61, 1 << 62)) * 2 + 1
STEP = int(_random.integers(1 << 61, 1 << 62)) * 2 + 1

#: Bytes of words between white space; those of words of letters, digits and non-ASCII characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_LOWER = BYTE[LOWER]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. modulo 2^64, n or more of them."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = U(1)
        have = _powers[base] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all bits, one to one."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about `size` bytes of text (one row at least), the bytes and the rows' bounds in them."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()), b"")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, byte: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: first byte, end, row and 64-bit hash. Words do not cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    w = np.zeros(n + 2, bool)
    w[1:-1] = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    inside = w[1:-1]
    starts = np.flatnonzero(inside & (~w[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (~w[2:] | edge[1:])) + 1
    up, down = powers(BASE, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(byte[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1, hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words on; whether they lie in one row is for the caller to see to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, c = hashes[:n].copy(), 1
    for j in range(1, k):
        c = c * STEP % (1 << 64)
        out += hashes[j : j + n] * U(c)
    return mix(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of values, as many as counts say, as one list each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
