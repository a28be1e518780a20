"""Columns of numbers packed into one binary value, and small Arrow helpers for Python tasks.

Rows that belong to one bucket of one batch travel through a shuffle as one blob: a count and the columns
one after another, which compresses far better than a row per entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length; the reader must know their types."""
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob, types: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += out[-1].nbytes
    return out


def unpack_all(blobs, types: list) -> list[np.ndarray]:
    """The columns of many blobs, one after another."""
    parts = [unpack(b, types) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]):
    """(bucket, blob) for each bucket that occurs; entries keep their order inside a bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.r_[0, np.flatnonzero(sorted_bucket[1:] != sorted_bucket[:-1]) + 1, len(order)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(sorted_bucket[a]), pack([c[a:b] for c in columns])


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def spread(starts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """One value per group repeated for each row of the group."""
    return np.repeat(values, np.diff(np.r_[starts, n]))


def lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] numbers, then the same for the next range."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every full window, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:len(out) - step], out[step:])
        done += step
    return out
