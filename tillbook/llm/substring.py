"""Substring dedup with difference-cover anchors.

A window of ``window`` words is a repeat if the same words also start in a document with a smaller id; every
word that a repeat covers is removed. Positions of a document are sampled by a difference cover modulo
``period``: for any two positions there is a shift below the period that moves both into the cover. So any
match of window words contains, at one of the first ``period`` shifts, an anchor of window - period + 1 words that is
sampled in both documents.

1. Anchors: hashes of the sampled positions meet in hash buckets; anchors found in two documents are kept.
2. Extension: only windows that contain such an anchor are hashed whole (64 bits of the window and 64 bits of its smallest
   anchor hash); the windows meet again in buckets, and all but those of the smallest id are repeats.
3. The covered words are cut from the texts.

Steps 1 and 2 combine equal hashes of a batch of rows before the shuffle: a passage in a third of all documents sends one
entry per batch, the other documents are answered on the spot; these answers go to buckets by id and text, and rows of equal
id and text are sent once per batch, so copies of one text spread over all buckets. Buckets hold about ``bucket_bytes`` of text. A window's
bucket follows its smallest anchor, so neighbouring windows stay together and travel as runs.

Defined cases: null and empty texts have no words and keep an empty text; a null id ranks above every other
id; rows of equal id never remove each other's words; repeated rows get equal results; an empty table gives no
rows. Only the id and the text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import by_bucket, group_starts, lists, pack, ranges, sliding_min, spread, unpack_all
from .tokens import SPACES, byte_table, mix, pieces, text_buffers, window_hashes, word_hashes, word_spans

WINDOW = 50
#: A perfect difference set: each difference modulo 31 but 0 occurs exactly once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
BUCKET_BYTES = 32 << 20

_WORD_BYTES = byte_table(SPACES)
_NO_ID = (1 << 63) - 1
_ANCHOR = [np.uint64, np.int64, np.int64, np.int32]
_KNOWN = [np.int64, np.int64, np.int32]
_RUN = [np.uint64, np.int64, np.int64, np.int32, np.int32]


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _words(data, offsets, a, b):
    """Per piece of rows: word hashes, row of each word (from a), number of each word in its row, words per row."""
    starts, ends, rows = word_spans(data, offsets[a:b + 1], _WORD_BYTES)
    count = np.bincount(rows, minlength=b - a)
    first = np.cumsum(count) - count
    return starts, ends, rows, np.arange(len(rows)) - first[rows], count, first


def _anchor_map(window: int, period: int, cover: tuple[int, ...], buckets: int):
    k = window - period + 1
    covered = np.isin(np.arange(period), cover)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            order, key = (np.asarray(batch.column(c)) for c in ("o", "th"))
            once, found = _once(order, key), []
            for a, b in pieces(offsets):
                starts, ends, rows, at, count, _ = _words(data, offsets, a, b)
                h = window_hashes(word_hashes(data, starts, ends), k)
                if not len(h):
                    continue
                rows, at = rows[:len(h)], at[:len(h)]
                use = np.flatnonzero(covered[at % period] & (at + k <= count[rows]) & (count[rows] >= window) & once[rows + a])
                found.append((h[use], rows[use] + a, at[use].astype(np.int32)))
            if not found:
                continue
            h, rows, at = (np.concatenate(c) for c in zip(*found))
            o, th = order[rows], key[rows]
            by = np.lexsort((o, h))
            first = group_starts(h[by])
            last = np.r_[first[1:], len(by)] - 1
            shared = o[by][first] < o[by][last]
            known = by[spread(first, shared, len(by))]
            send = np.sort(np.r_[by[~spread(first, shared, len(by))], by[first[shared]]])
            out = [(x, 0, blob) for x, blob in by_bucket((h[send] % np.uint64(buckets)).astype(np.int64), [h[send], o[send], th[send], at[send]])]
            known = np.sort(known)
            out += [(x, 1, blob) for x, blob in by_bucket(anywhere(buckets, o[known], th[known]), [o[known], th[known], at[known]])]
            if out:
                yield _blobs(out)
    return run


def anywhere(buckets: int, *columns: np.ndarray) -> np.ndarray:
    """A bucket for each of some entries that need no grouping, by the given columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h + c.astype(np.int64).view(np.uint64), 9)
    return (h % np.uint64(buckets)).astype(np.int64)


def _once(o: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its id and text in this batch; the others get its result."""
    by = np.lexsort((th, o))
    first = np.zeros(len(o), bool)
    first[by[group_starts(o[by], th[by])]] = True
    return first


def _blobs(rows) -> pa.RecordBatch:
    bucket, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
                                      ["bucket", "kind", "blob"])


def _of_kind(table: pa.Table, kind: int):
    kinds = table.column("kind").to_pylist()
    return [b.as_py() for b, k in zip(table.column("blob"), kinds) if k == kind]


def _anchor_reduce(table: pa.Table) -> pa.Table:
    h, o, th, at = unpack_all(_of_kind(table, 0), _ANCHOR)
    by = np.lexsort((o, h))
    first = group_starts(h[by])
    last = np.r_[first[1:], len(by)] - 1 if len(by) else first
    hit = by[spread(first, o[by][first] < o[by][last], len(by))]
    ko, kth, kat = unpack_all(_of_kind(table, 1), _KNOWN)
    return pa.table({"o": np.r_[o[hit], ko], "th": np.r_[th[hit], kth], "at": np.r_[at[hit], kat].astype(np.int32)})


def _runs(o, th, start):
    """Windows sorted by (o, th, start) as runs of consecutive starts: index of the first, length."""
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(o)])


def _window_map(window: int, period: int, buckets: int):
    k = window - period + 1

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            order, key = (np.asarray(batch.column(c)) for c in ("o", "th"))
            anchors = batch.column("at")
            marks, mark_at = np.asarray(anchors.offsets).astype(np.int64), np.asarray(anchors.values)
            once, found = _once(order, key), []
            for a, b in pieces(offsets):
                starts, ends, rows, at, count, first = _words(data, offsets, a, b)
                h = word_hashes(data, starts, ends)
                if len(h) < window:
                    continue
                row_of = np.repeat(np.arange(b - a), np.diff(marks[a:b + 1]))
                p = mark_at[marks[a]:marks[b]].astype(np.int64)
                low, high = np.maximum(p - (window - k), 0), np.minimum(p, count[row_of] - window)
                ok = high >= low
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, first[row_of[ok]] + low[ok], 1)
                np.add.at(edge, first[row_of[ok]] + high[ok] + 1, -1)
                use = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & once[rows + a])
                small = sliding_min(window_hashes(h, k), period)
                found.append((window_hashes(h, window)[use], small[use], rows[use] + a, at[use].astype(np.int32)))
            if not found:
                continue
            h, m, rows, at = (np.concatenate(c) for c in zip(*found))
            o, th = order[rows], key[rows]
            by = np.lexsort((o, m, h))
            first = group_starts(h[by], m[by])
            least = spread(first, o[by][first], len(by))
            gone = np.sort(by[o[by] > least])
            send = np.ones(len(h), bool)
            send[gone] = False
            send = np.flatnonzero(send)
            out = []
            if len(send):
                h, m, so, sth, sat = h[send], m[send], o[send], th[send], at[send]
                new = np.ones(len(send), bool)
                new[1:] = (so[1:] != so[:-1]) | (sth[1:] != sth[:-1]) | (sat[1:] != sat[:-1] + 1) | (m[1:] != m[:-1])
                s = np.flatnonzero(new)
                n = np.diff(np.r_[s, len(send)])
                bucket = (mix(m[s], 3) % np.uint64(buckets)).astype(np.int64)
                for x in np.unique(bucket):
                    i = np.flatnonzero(bucket == x)
                    head = pack([m[s[i]], so[s[i]], sth[s[i]], sat[s[i]], n[i].astype(np.int32)])
                    out.append((int(x), 0, head + h[ranges(s[i], n[i])].tobytes()))
            first, n = _runs(o[gone], th[gone], at[gone])
            if len(first):
                g = gone[first]
                out += [(x, 1, blob) for x, blob in by_bucket(anywhere(buckets, o[g], th[g]), [o[g], th[g], (at[g].astype(np.int64) << 32) | n])]
            if out:
                yield _blobs(out)
    return run


def _window_reduce(table: pa.Table) -> pa.Table:
    heads, hashes = [], []
    for blob in _of_kind(table, 0):
        count = int(np.frombuffer(blob, np.int64, 1)[0])
        size = 8 + count * sum(np.dtype(t).itemsize for t in _RUN)
        heads.append(blob[:size])
        hashes.append(np.frombuffer(blob, np.uint64, offset=size))
    m, o, th, start, n = unpack_all(heads, _RUN)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    run = np.repeat(np.arange(len(n)), n)
    at = ranges(start.astype(np.int64), n.astype(np.int64))
    by = np.lexsort((o[run], m[run], h))
    first = group_starts(h[by], m[run][by])
    gone = by[o[run][by] > spread(first, o[run][by][first], len(by))]
    gone = gone[np.lexsort((at[gone], th[run[gone]], o[run[gone]]))]
    r, a = run[gone], at[gone]
    first, length = _runs(o[r], th[r], a)
    ko, kth, kruns = unpack_all(_of_kind(table, 1), [np.int64, np.int64, np.int64])
    return pa.table({"o": np.r_[o[r][first], ko], "th": np.r_[th[r][first], kth], "run": np.r_[(a[first] << 32) | length, kruns].astype(np.int64)})


def _cut_map(window: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            column = batch.column("runs")
            marks, runs = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values).astype(np.int64)
            words, removed, kept, span_rows, spans = [], [], [], [], []
            for a, b in pieces(offsets):
                starts, ends, rows, _, count, first = _words(data, offsets, a, b)
                row_of = np.repeat(np.arange(b - a), np.diff(marks[a:b + 1]))
                part = runs[marks[a]:marks[b]]
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[row_of] + (part >> 32), 1)
                np.add.at(edge, np.minimum(first[row_of] + (part >> 32) + (part & 0xFFFFFFFF) - 1 + window, len(starts)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                words.append(count)
                removed.append(np.bincount(rows[gone], minlength=b - a))
                kept += _joined(data, starts[~gone], ends[~gone], rows[~gone], b - a)
                at = np.arange(len(starts)) - first[rows]
                s, n = _runs(rows[gone], rows[gone], at[gone])
                span_rows.append(np.bincount(rows[gone][s], minlength=b - a))
                spans.append(np.stack([at[gone][s], at[gone][s] + n], 1))
            span_count = np.concatenate(span_rows) if span_rows else np.zeros(0, np.int64)
            spans = np.concatenate(spans).astype(np.int32) if spans else np.zeros((0, 2), np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "stop"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.concatenate(words or [np.zeros(0)]).astype(np.int64)),
                pa.array(np.concatenate(removed or [np.zeros(0)]).astype(np.int64)),
                lists((np.cumsum(span_count) - span_count), pairs), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"])
    return run


def _joined(data, starts, ends, rows, n) -> list[str]:
    """The words of each row joined by one space; the byte after a word that is not the row's last is a separator."""
    if not len(rows):
        return [""] * n
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    length = ends - starts + ~last
    taken = data[np.minimum(ranges(starts, length), len(data) - 1)]
    done = np.cumsum(length)
    taken[done[~last] - 1] = 0x20
    size = np.zeros(n, np.int64)
    np.add.at(size, rows, length)
    cuts, raw = np.r_[0, np.cumsum(size)], taken.tobytes()
    return [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): removed word ranges and the words that stay, joined by one space."""
    if not is_cover(period, cover) or period >= window:
        raise ValueError("cover must be a difference cover of a period below the window")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(doc_id, F.lit(_NO_ID)).alias("o"), F.xxhash64(text).alias("th"), doc_id.alias("doc_id"), text.alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    blob = "bucket long, kind int, blob binary"
    anchors = (texts.select("o", "th", "text").mapInArrow(_anchor_map(window, period, cover, buckets), blob)
               .groupBy("bucket").applyInArrow(_anchor_reduce, "o long, th long, at int")
               .groupBy("o", "th").agg(F.collect_list("at").alias("at")))
    # the same columns as in the last join, so that Spark shuffles the texts once for both
    repeats = (texts.join(anchors, ["o", "th"]).select("o", "th", "doc_id", "text", "at")
               .mapInArrow(_window_map(window, period, buckets), blob)
               .groupBy("bucket").applyInArrow(_window_reduce, "o long, th long, run long")
               .groupBy("o", "th").agg(F.collect_list("run").alias("runs")))
    return (texts.join(repeats, ["o", "th"], "left")
            .select("doc_id", "text", F.coalesce("runs", F.array().cast("array<long>")).alias("runs"))
            .mapInArrow(_cut_map(window), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"))
