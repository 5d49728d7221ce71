"""Vectorised work on the UTF-8 bytes of a text column, a bounded block of rows at a time.

Every function sees whole texts; a block holds at most ``limit`` bytes, or one text if that is longer.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
RADIX = 0x9E3779B97F4A7C15 | 3  # odd, so that its powers can be inverted
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a NULL is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold at most ``limit`` bytes together."""
    data, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX ** i and its inverse for i below ``n``, modulo 2 ** 64."""
    if len(_powers.get(0, ([],))[0]) < n:
        size = max(n, BLOCK + 2)
        up = np.full(size, RADIX, dtype=np.uint64)
        up[0] = 1
        down = np.full(size, pow(RADIX, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _powers[0]
    return up[:n], down[:n]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lowered: (64-bit hash, row, start, end) of each; rows never share a word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = np.concatenate(([False], ~SPACE[data], [False]))
    turn = solid[1:] != solid[:-1]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    glued = np.unique(inner[solid[inner] & solid[inner + 1]])  # a row ends in a word and the next one begins with one
    edges = np.flatnonzero(turn)
    if len(glued):
        edges = np.sort(np.concatenate((edges, glued, glued)))
    start, end = edges[0::2], edges[1::2]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[LOWER[data]] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    row = np.searchsorted(at, start, "right") - 1
    return hashed, row, start, end
