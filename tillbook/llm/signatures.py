"""Ranked lexical search by bit-sliced Bloom signatures with exact rescoring.

Index: documents are taken in blocks of similar length. A document's Bloom signature holds, for each of its terms, one key per
level of its frequency (once, twice, 3, 5, 9, 17, 33 times or more); the signatures of a block are stored by slices, one
bitmap of documents for each signature bit. A block of longer documents has wider signatures, so about one key in
a hundred is a false hit at any length. Beside its blocks every piece of the corpus stores its dictionary, the terms with
the number of its documents that hold them, so document frequencies are sums over pieces and never estimated.

Search: for each query term the slices of its key are ANDed to the bitmap of documents that may hold it so often. Signatures
have no false misses, so the weighted sum of these bitmaps, with each level counted at the highest score that a frequency
below the next level can give, is never below the true score. The texts of the best bounds are scored
exactly first; the tenth best exact score of an item is its threshold. Every document whose bound reaches it
is then scored exactly from its text, so no document that belongs to the result can be missing, whatever the false hits.

Plan: one pass over the texts writes the index (a fraction of the input); two passes over the index give bounds; texts are
picked by a join on (id, text key), which shuffles no text unless more than ``common.BROADCAST_ROWS`` texts reach a threshold.
A text's score is computed once for an item: of its copies only the ``top`` smallest ids of a block travel, with the
text's key. Items are collected in blocks of about ``ITEM_BYTES`` (one longer item makes a block of its own
length) and each block runs against all documents; tasks keep ``SEEDS`` rows an item.

Terms and texts are told apart by 64-bit and 128-bit hashes. Defined cases: null texts and texts without terms are never
found and count in neither N nor L; null document ids come last among equal scores; repeated rows are ranked each; equal item rows
count once, and an item without terms has no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.core import cut_lineage
from .common import small_or_joined
from .packing import group_starts, ranges
from .tokens import byte_table, mix, pieces, text_buffers, word_hashes, word_spans

#: Bytes that belong to no term ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` (fixed by the contract).
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LEVELS = np.array([1, 2, 3, 5, 9, 17, 33])
BITS, HASHES = 12, 6
SEGMENT_BYTES, ITEM_BYTES, SEEDS, COLUMNS_AT_ONCE = 1 << 22, 1 << 21, 32, 256
#: Signature widths in bits: 64, 96, 128, 192, ...
WIDTHS = np.array([64 * m << k for k in range(34) for m in (2, 3)]) // 2

INDEX_SCHEMA = ("width int, n_docs long, n_terms long, lens binary, ids binary, no_id binary, key1 binary, key2 binary, slices binary, "
                "terms binary, dfs binary")
_INDEX = pa.schema([("width", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64())] + [
    (c, pa.binary()) for c in ("lens", "ids", "no_id", "key1", "key2", "slices", "terms", "dfs")])


def _counts(rows: np.ndarray, hashes: np.ndarray):
    """(row, term, frequency) of each distinct term of each row; ``rows`` ascend."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    at = group_starts(r, h)
    return r[at], h[at], np.diff(np.r_[at, len(r)])


def _positions(keys: np.ndarray, width: int) -> np.ndarray:
    """The signature bits of each key, one row a key."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


def _level_keys(terms: np.ndarray, level: int) -> np.ndarray:
    return mix(terms, 0x5851F42D4C957F2D * (level + 1) & (1 << 63) - 1)


def _blocks(rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_rows: int):
    """(width, rows of the block, bitmaps) for rows of like signature width."""
    found = [(level, tf >= least) for level, least in enumerate(LEVELS)]
    n_keys = sum(np.bincount(rows[hit], minlength=n_rows) for _, hit in found)
    kind = np.searchsorted(WIDTHS, BITS * n_keys)
    column = np.zeros(n_rows, np.int64)
    for k in np.unique(kind[n_keys > 0]):
        members = np.flatnonzero((kind == k) & (n_keys > 0))
        width = int(WIDTHS[k])
        column[members] = np.arange(len(members))
        bits = np.zeros((width, len(members)), np.uint8)
        for level, hit in found:
            own = hit & (kind[rows] == k)
            at = _positions(_level_keys(terms[own], level), width)
            bits[at, column[rows[own]][:, None]] = 1
        yield width, members, np.packbits(bits, axis=1)


def _index_batches(batches):
    table = byte_table(SEPARATORS)
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        ids, no_id = batch.column("id"), np.asarray(batch.column("id").is_null())
        ids = np.asarray(ids.fill_null(0))
        keys = [np.asarray(batch.column(c)) for c in ("key1", "key2")]
        for a, b in pieces(offsets, SEGMENT_BYTES):
            starts, ends, rows = word_spans(data, offsets[a:b + 1], table)
            if not len(starts):
                continue
            lens = np.bincount(rows, minlength=b - a)
            rows, terms, tf = _counts(rows, word_hashes(data, starts, ends, lower=True))
            out = []
            for width, members, bitmaps in _blocks(rows, terms, tf, b - a):
                at = a + members
                out.append([width, len(members), int(lens[members].sum()), lens[members].tobytes(), ids[at].tobytes(),
                            no_id[at].tobytes(), keys[0][at].tobytes(), keys[1][at].tobytes(), bitmaps.tobytes(), None, None])
            known, dfs = np.unique(terms, return_counts=True)
            out.append([None, 0, 0] + [None] * 6 + [known.tobytes(), dfs.astype(np.int64).tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _INDEX.types)], schema=_INDEX)


def _named(docs: DataFrame) -> DataFrame:
    """(id, text, key1, key2) of all documents; the keys are two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), F.xxhash64(text).alias("key1"),
                       F.xxhash64(F.lit(7), text).alias("key2"))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder: one row a block and one a dictionary."""
    return cut_lineage(_named(docs).mapInArrow(_index_batches, INDEX_SCHEMA), "signatures")


class _Items:
    """One block of items: their terms, weights and thresholds as arrays that travel to the tasks."""

    def __init__(self, texts: list[str], index: DataFrame):
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        starts, ends, rows = word_spans(data, offsets, byte_table(SEPARATORS))
        item, term, repeats = _counts(rows, word_hashes(data, starts, ends, lower=True))
        self.terms = np.unique(term)
        known = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        self.n_docs, self.n_terms = known[0] or 0, known[1] or 0
        dfs = np.zeros(len(self.terms), np.int64)
        if len(self.terms):
            found = (index.where("terms is not null").select("terms", "dfs")
                     .mapInArrow(_count_terms(self.terms), "term long, df long").groupBy("term").agg(F.sum("df")))
            for at, df in found.collect():  # at most a row for each term of the block
                dfs[at] = df
        weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * d + 1))) if d else 0 for d in dfs.tolist()], np.int64)
        at = np.searchsorted(self.terms, term)
        useful = weight[at] > 0
        self.item, self.at, self.weight = item[useful], at[useful], (weight[at] * repeats)[useful]
        used = np.unique(self.at)
        self.terms, self.at = self.terms[used], np.searchsorted(used, self.at)
        self.n, self.least = len(texts), np.ones(len(texts), np.int64)

    def m(self, lens: np.ndarray) -> np.ndarray:
        return 25 + 75 * lens * self.n_docs // self.n_terms

    def bounds(self, width: int, lens: np.ndarray, bitmaps: np.ndarray):
        """(first column, upper bounds as items x documents) for groups of columns of a block."""
        n, firsts = len(lens), group_starts(self.item)
        m, at = self.m(lens), [_positions(_level_keys(self.terms, level), width) for level in range(len(LEVELS))]
        for a in range(0, n, COLUMNS_AT_ONCE):
            b = min(a + COLUMNS_AT_ONCE, n)
            total, before, present = np.zeros((len(firsts), b - a), np.int64), np.zeros(b - a, np.int64), None
            for level in range(len(LEVELS)):
                some = np.bitwise_and.reduce(bitmaps[:, a // 8:-(-b // 8)][at[level]], axis=1)
                present = some if present is None else present & some
                hits = np.unpackbits(present, axis=1, count=b - a)
                if not hits.any():
                    break
                most = np.minimum(LEVELS[level + 1] - 1, lens[a:b]) if level + 1 < len(LEVELS) else lens[a:b]
                worth = 1_000_000_000 * most // (1000 * most + 8 * m[a:b])
                sums = np.add.reduceat(hits[self.at] * self.weight[:, None], firsts, axis=0)
                total += sums * np.maximum(worth - before, 0)
                before = np.maximum(worth, before)
            yield a, self.item[firsts], total


def _count_terms(terms: np.ndarray):
    def count(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for known, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist()):
                known, dfs = np.frombuffer(known, np.uint64), np.frombuffer(dfs, np.int64)
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                total += np.where(known[at] == terms, dfs[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])
    return count


FOUND = "item int, id long, key1 long, key2 long, bound long"


def _few_copies(found: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Rows (item, no_id, id, key1, key2, bound) with the ``top`` smallest ids of each item and text."""
    item, no_id, ids, key1, key2, bound = found
    order = np.lexsort((ids, no_id, key2, key1, item))
    found = [c[order] for c in found]
    starts = group_starts(found[0], found[3], found[4])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return [c[place < top] for c in found]


def _search(items: _Items, top: int, seeds: int | None):
    """Rows of FOUND for documents whose bound reaches the item's threshold; with ``seeds`` only a task's best of an item."""
    def batch_of(found):
        item, no_id, ids, key1, key2, bound = found
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=no_id), pa.array(key1), pa.array(key2),
                                           pa.array(bound)], ["item", "id", "key1", "key2", "bound"])

    def best(found, least):
        """The best ``seeds`` of each item; ``least`` rises to the lowest of a full set."""
        order = np.lexsort((-found[5], found[0]))
        found = [c[order] for c in found]
        starts = group_starts(found[0])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        last = place == seeds - 1
        least[found[0][last]] = np.maximum(least[found[0][last]], found[5][last] + 1)
        return [c[place < seeds] for c in found]

    def search(batches):
        kept, pending, least = [], 0, items.least.copy()
        for batch in batches:
            for row in batch.to_pylist():
                lens, ids, key1, key2 = (np.frombuffer(row[c], np.int64) for c in ("lens", "ids", "key1", "key2"))
                no_id = np.frombuffer(row["no_id"], bool)
                bitmaps = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
                parts = []
                for a, item, bound in items.bounds(row["width"], lens, bitmaps):
                    i, j = np.nonzero(bound >= least[item][:, None])
                    d = a + j
                    parts.append([item[i], no_id[d], ids[d], key1[d], key2[d], bound[i, j]])
                found = _few_copies([np.concatenate(c) for c in zip(*parts)], top)
                if seeds is None:
                    yield batch_of(found)
                    continue
                kept.append(found)
                pending += len(found[0])
                if pending > 100 * seeds * items.n:
                    kept = [best(_few_copies([np.concatenate(c) for c in zip(*kept)], top), least)]
                    pending = len(kept[0][0])
        if kept:
            yield batch_of(best(_few_copies([np.concatenate(c) for c in zip(*kept)], top), least))
    return search


def _score(items: _Items):
    """Exact scores of texts for the items that ask for them."""
    table, firsts = byte_table(SEPARATORS), np.searchsorted(items.item, np.arange(items.n + 1))

    def score(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            asked = batch.column("items").to_pylist()
            out = []
            for a, b in pieces(offsets, SEGMENT_BYTES):
                starts, ends, rows = word_spans(data, offsets[a:b + 1], table)
                lens = np.bincount(rows, minlength=b - a)
                rows, terms, tf = _counts(rows, word_hashes(data, starts, ends, lower=True))
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                for r in range(b - a):
                    own = slice(cuts[r], cuts[r + 1])
                    freq = np.zeros(len(items.terms), np.int64)
                    at = np.minimum(np.searchsorted(items.terms, terms[own]), len(items.terms) - 1)
                    hit = items.terms[at] == terms[own]
                    freq[at[hit]] = tf[own][hit]
                    worth = 1_000_000_000 * freq // (1000 * freq + 8 * items.m(lens[r:r + 1]))
                    want = np.array(asked[a + r])
                    pick = ranges(firsts[want], firsts[want + 1] - firsts[want])
                    owner = np.repeat(np.arange(len(want)), firsts[want + 1] - firsts[want])
                    sums = np.zeros(len(want), np.int64)
                    np.add.at(sums, owner, items.weight[pick] * worth[items.at[pick]])
                    out += zip(want.tolist(), [a + r] * len(want), sums.tolist())
            item, row, sums = zip(*out) if out else ((), (), ())
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("key1").take(row), batch.column("key2").take(row),
                                              pa.array(sums, pa.int64())], ["item", "key1", "key2", "score"])
    return score


def _rescored(docs: DataFrame, found: DataFrame, items: _Items) -> DataFrame:
    """``found`` with the exact score of each row; each text is read once, at its smallest id."""
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("one")
    wanted = cut_lineage(found.groupBy("key1", "key2").agg(one, F.collect_set("item").alias("items"))
                         .select("key1", "key2", F.col("one.id").alias("id"), "items"), "wanted-texts")
    w, d = small_or_joined(wanted, wanted.count()).alias("w"), _named(docs).alias("d")
    texts = d.join(w, (F.col("d.key1") == F.col("w.key1")) & (F.col("d.key2") == F.col("w.key2")) & F.col("d.id").eqNullSafe(F.col("w.id")))
    scores = (texts.select("d.key1", "d.key2", "d.text", "w.items")
              .mapInArrow(_score(items), "item int, key1 long, key2 long, score long").distinct())
    return found.join(scores, ["item", "key1", "key2"])


def _ranked(rows: DataFrame, top: int, order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search_block(docs: DataFrame, index: DataFrame, texts: list[str], top: int) -> DataFrame:
    """item (place in ``texts``), rank, id, score: the ``top`` best documents of one block of items."""
    items = _Items(texts, index)
    blocks = index.where("width is not null").drop("terms", "dfs", "n_docs", "n_terms")
    if not len(items.at):
        return docs.sparkSession.createDataFrame([], "item int, rank int, id long, score long")
    by_score = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    seeds = _ranked(blocks.mapInArrow(_search(items, top, SEEDS), FOUND), SEEDS, [F.col("bound").desc(), F.col("id").asc_nulls_last()])
    known = _rescored(docs, cut_lineage(seeds.drop("rank"), "seeds"), items)
    for item, least in _ranked(known, top, by_score).where(F.col("rank") == top).select("item", "score").collect():
        items.least[item] = max(least, 1)  # a number for each item of the block
    found = cut_lineage(blocks.mapInArrow(_search(items, top, None), FOUND), "candidates")
    return _ranked(_rescored(docs, found, items).where("score > 0"), top, by_score).select("item", "rank", "id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = 10, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each row of ``queries`` (item_id, text)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    index = build_index(docs) if index is None else index
    queries = queries.select("item_id", "text").where("text is not null").distinct()
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, out = -(-total // ITEM_BYTES), []
    for k in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = sorted(block.collect(), key=lambda r: (r.item_id is None, str(r.item_id), r.text))
        if not rows:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)],
                                      f"item int, item_id {queries.schema['item_id'].dataType.simpleString()}")
        found = search_block(docs, index, [r.text for r in rows], top)
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not out:
        item_type = queries.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
