"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes runs over the text. A chunk ends where the hash has enough leading zeros:
many below the normal chunk size, fewer above it (normalised chunking), at the latest at the largest
size. Boundaries depend on nearby bytes only, so an edit changes the chunks it touches and no others. A
fingerprint is the sorted set of chunk digests (48 bits) with chunk lengths (16 bits), as base64; the likeness of a
fingerprint to another is the share of its bytes whose chunks the other one has too (containment).

Chunking is numpy over batches of texts inside tasks: all texts of a piece advance one chunk per step.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, which is like itself (1) and
like no other (0), and nothing but itself; null ids come last in descending order; rows of equal id follow each other by
text hash, repeated rows by chance (they are equal); an empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import group_starts
from .tokens import pieces, text_buffers, word_hashes

LEAST, NORMAL, MOST = 32, 64, 256
#: Leading zero bits that end a chunk below and above the normal size.
HARD_BITS, EASY_BITS = 7, 5
SLICES = 65536
PART_BYTES = 4 << 20
_PIECE = 4 << 20
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' values, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunks(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row) of the chunks of each row, ordered by position."""
    begin = int(offsets[0])
    h = gear(data[begin:int(offsets[-1])])
    hard = np.append(np.flatnonzero(h < np.uint32(1 << (32 - HARD_BITS))), 1 << 62)
    easy = np.append(np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS))), 1 << 62)
    at, stop = offsets[:-1] - begin, offsets[1:] - begin
    row = np.flatnonzero(at < stop)
    at, stop = at[row], stop[row]
    found = []
    while len(row):
        last = np.minimum(at + MOST, stop)
        first = hard[np.searchsorted(hard, at + LEAST - 1)] + 1
        later = easy[np.searchsorted(easy, at + NORMAL - 1)] + 1
        end = np.minimum(np.where(first < at + NORMAL, first, later), last)
        found.append((at, end, row))
        more = end < stop
        at, stop, row = end[more], stop[more], row[more]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, row = (np.concatenate(c) for c in zip(*found))
    by = np.argsort(start)
    return start[by] + begin, end[by] + begin, row[by]


def digest_sets(data: np.ndarray, offsets: np.ndarray):
    """Sorted distinct entries (digest << 16 | length) of all rows, and where each row's entries start."""
    entries, sizes = [], []
    for a, b in pieces(offsets, _PIECE):
        start, end, row = chunks(data, offsets[a:b + 1])
        value = (word_hashes(data, start, end) & ~np.uint64(0xFFFF)) | (end - start).astype(np.uint64)
        by = np.lexsort((value, row))
        value, row = value[by], row[by]
        first = group_starts(row, value)
        entries.append(value[first])
        sizes.append(np.bincount(row[first], minlength=b - a))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(entries) if entries else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes)]


def encode(entries: np.ndarray, starts: np.ndarray) -> list[str]:
    raw = entries.astype(">u8").tobytes()
    return [base64.b64encode(raw[a * 8:b * 8]).decode() for a, b in zip(starts[:-1], starts[1:])]


def _weights(entries: np.ndarray) -> np.ndarray:
    return (entries & np.uint64(0xFFFF)).astype(np.float64)


def contained(a, a_starts, b, b_starts) -> np.ndarray:
    """For each row the share of a's bytes in chunks that b has too; 1 and 0 for an empty a, as b is empty or not."""
    n = len(a_starts) - 1
    row_a, row_b = (np.repeat(np.arange(n), np.diff(s)) for s in (a_starts, b_starts))
    values, rows = np.concatenate([a, b]), np.concatenate([row_a, row_b])
    by = np.lexsort((values, rows))
    values, rows = values[by], rows[by]
    twice = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
    both = np.bincount(rows[1:][twice], _weights(values[1:][twice]), minlength=n)
    own = np.bincount(row_a, _weights(a), minlength=n)
    return np.where(own > 0, both / np.maximum(own, 1), np.diff(b_starts) == 0)


def likeness(fingerprint: str, other: str) -> float:
    """Containment of one encoded fingerprint in another."""
    a, b = (np.frombuffer(base64.b64decode(x), ">u8").astype(np.uint64) for x in (fingerprint, other))
    return float(contained(a, np.array([0, len(a)]), b, np.array([0, len(b)]))[0])


def _fingerprint_map(batches):
    for batch in batches:
        entries, starts = digest_sets(*text_buffers(batch.column("text")))
        weight = np.add.reduceat(np.append(_weights(entries), 0), starts[:-1]) * (np.diff(starts) > 0) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode(entries, starts), pa.string()),
                                          pa.array(np.diff(starts)), pa.array(weight.astype(np.int64))],
                                         ["doc_id", "fingerprint", "n_chunks", "n_bytes"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_chunks, n_bytes): distinct chunks and the bytes they stand for. No shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _fingerprint_map, "doc_id long, fingerprint string, n_chunks long, n_bytes long")


def beside_next(docs: DataFrame, part_bytes: int = PART_BYTES, slices: int = SLICES) -> DataFrame:
    """(part, follows, doc_id, text): rows laid out so that each is followed by the next in descending id order.

    Ids are cut into slices of equal width; neighbouring slices form parts of about ``part_bytes`` (one slice at least, so
    ids crowded into one slice share a part). Each part is one sorted run, closed by a copy (``follows``) of the
    first row of the next part; the first row of all closes the last one. Texts are shuffled once.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    low, high = docs.select(F.col("doc_id").cast("long").alias("i")).agg(F.min("i"), F.max("i")).first()
    width = max((float(high) - float(low)) / slices, 1e-9) if low is not None else 1.0
    place = F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(width))
    slice_of = F.when(F.col("doc_id").isNotNull(), F.least(place, F.lit(slices)).cast("int")).otherwise(-1)
    rows = rows.withColumn("slice", slice_of)
    table = rows.groupBy("slice").agg(F.sum(F.octet_length("text") + F.lit(16)).alias("bytes"), F.max(F.struct("doc_id", "th")).alias("head"))
    # at most `slices` + 2 rows from here on, whatever the input
    down = Window.orderBy(F.desc("slice"))
    table = table.withColumn("raw", F.floor(F.coalesce(F.sum("bytes").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / part_bytes))
    table = table.withColumn("part", F.dense_rank().over(Window.orderBy("raw")) - 1)
    table = table.withColumn("opens", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("slice"))) == 1)
    table = table.withColumn("parts", F.max("part").over(Window.partitionBy()) + 1)
    here, before = F.struct(F.col("part"), F.lit(0).alias("follows")), F.struct(
        F.pmod(F.col("part") - 1, F.col("parts")).cast("int").alias("part"), F.lit(1).alias("follows"))
    is_head = F.col("opens") & F.struct("doc_id", "th").eqNullSafe(F.col("head"))
    placed = rows.join(F.broadcast(table.select("slice", "part", "opens", "parts", "head")), "slice").select(
        "doc_id", "text", "th", F.explode(F.when(is_head, F.array(here, before)).otherwise(F.array(here))).alias("at"))
    return (placed.select("at.part", "at.follows", "doc_id", "text", "th").repartition("part")
            .sortWithinPartitions("part", "follows", F.desc_nulls_last("doc_id"), F.desc("th")).select("part", "follows", "doc_id", "text"))


def _compare(ids, own, following):
    """Fingerprints of texts, of their edited texts and of the next ones."""
    n = len(own)
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(own, following)]
    # the next text of a row mostly is the next row's own
    ahead = np.arange(1, n + 1)
    extra = [i for i in range(n) if i + 1 == n or following[i] is not own[i + 1]]
    ahead[extra] = n + np.arange(len(extra))
    entries, starts = digest_sets(*text_buffers(pa.array(own + [following[i] for i in extra], pa.large_string())))
    e_entries, e_starts = digest_sets(*text_buffers(pa.array(edited, pa.large_string())))
    size = np.diff(starts)
    mine, mine_starts = entries[:starts[n]], starts[:n + 1]
    next_starts = np.r_[0, np.cumsum(size[ahead])]
    take = np.arange(next_starts[-1]) - np.repeat(next_starts[:-1] - starts[ahead], size[ahead])
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(encode(mine, mine_starts), pa.string()), pa.array(encode(e_entries, e_starts), pa.string()),
        pa.array(contained(mine, mine_starts, e_entries, e_starts)), pa.array(contained(mine, mine_starts, entries[take], next_starts))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _edited_map(batches):
    ids, own, following, size = [], [], [], 0
    waiting = None
    for batch in batches:
        for doc_id, follows, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "follows", "text"))):
            if waiting is not None:
                ids.append(waiting[0])
                own.append(waiting[1])
                following.append(text)
                size += len(text)
            waiting = None if follows else (doc_id, text)
            if size > _PIECE:
                yield _compare(ids, own, following)
                ids, own, following, size = [], [], [], 0
    if ids:
        yield _compare(ids, own, following)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text (its second half replaced by the next document's first code points)."""
    return beside_next(docs).mapInArrow(_edited_map, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                     "edited_fingerprint string, near_edited double, near_next double")
