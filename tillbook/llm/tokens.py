"""Words and word hashes of Arrow text columns, vectorised over whole batches of documents.

The words are read straight from the Arrow buffers: separators are looked up byte by byte, a word's hash
is a difference of prefix sums, and so is the hash of k consecutive words. Nothing here loops over words
in Python, and a batch is worked on in pieces of a few megabytes so memory stays bounded; one text is
never cut, so the longest text bounds a piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Separators of the word rule ``[^\\x20\\x09-\\x0D]+``.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
PIECE_BYTES, PIECE_ROWS = 1 << 20, 8192

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MULT2 = 0xD6E8FEB86659FD93


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown when a longer piece needs them."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(size, self.base), _powers(size, self.inverse)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_MULT), _Powers(_MULT2)
#: One fixed random value per byte, so that short words differ in all bits.
_BYTE_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on every bit of x."""
    x = x ^ _U(salt)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def text_buffers(column: pa.Array):
    """(bytes as uint8, offsets as int64 with one more entry than rows); a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    width = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], width, n + 1, column.offset * width().itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    if column.null_count:
        null = np.asarray(column.is_null())
        length = np.diff(offsets)
        if length[null].any():
            return text_buffers(column.fill_null(""))
    return data, offsets


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES):
    """Row ranges [a, b) of at most ``size`` bytes and PIECE_ROWS rows each, or of one row if that row is longer."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), a + PIECE_ROWS, n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Start and end byte of each word of consecutive rows (offsets relative to data), and its row.

    ``table`` tells for each byte whether it belongs to a word.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    inside = np.zeros(end - begin + 2, dtype=np.int8)
    inside[1:-1] = table[data[begin:end]]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1] - begin
    if len(cuts):  # a word that runs over the end of a row is two words
        cuts = np.unique(cuts)
        cuts = cuts[(cuts > 0) & (cuts < end - begin)]
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets - begin, starts, side="right") - 1
    return starts + begin, ends + begin, rows


def byte_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=np.int8)
    table[list(separators)] = 0
    return table


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower`` A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    begin, end = int(starts[0]), int(ends[-1])
    values = _BYTE_VALUES
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    up, down = _BYTE_POWERS.get(end - begin + 1)
    sums = np.zeros(end - begin + 1, dtype=_U)
    np.cumsum(values[data[begin:end]] * up[:end - begin], dtype=_U, out=sums[1:])
    s, e = starts - begin, ends - begin
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i from 0 to len(words)-k; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = _WORD_POWERS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * up[:len(words)], dtype=_U, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n], k)
