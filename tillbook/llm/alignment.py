"""Cross-tokenizer alignment by products of token-byte incidence matrices.

A text is encoded by two tokenizers whose tokens cover the same bytes. For a piece of texts, the incidence matrices of tokens
and bytes are built by hand in CSR form. Row products (Gustavson) of A with the transpose of B give the overlap links, each
with its number of shared bytes; a group ends where the last B token that a row of the product reaches is not the first one that the
next row reaches, which is where tokens of both sides end at one byte. The second product, of the group incidence of A's ids with
that of B's ids, gives the links that share a group, counted by id pair.

Groups repeat (a group is mostly one word), so each segment of some ``SEGMENT_BYTES`` keeps a dictionary of its kinds of
groups, and the second product runs once for a kind: a sparse matrix of kinds and id pairs, beside one of documents
and kinds. The corpus-wide count of an id pair is the sum, over segments, of the documents that hold it.

Plan: one pass tokenises each text once and writes the segments; (segment, id pair) rows are summed to the counts, joined back to
their segments, and each segment multiplies its two matrices with the counts, one group of a cogroup at a time. Rows travel
once per segment and distinct id pair, not per link or document; a pair that every document holds has one row a segment.
No text is shuffled, nothing is collected.

The kinds of a segment are told apart by 64-bit hashes of their ids. A single text is never cut, so the longest text bounds a piece.
Defined cases: texts that are null or empty, or that one of the tokenizers does not give back byte by byte, have no
tokens: zeros and an empty digest; they hold no link. Special-token strings in a text are plain text. Null ids are kept;
repeated rows count as documents each; an empty table gives no rows; other columns are ignored.
``folder`` names the vocabulary files and must exist on every worker.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.core import cut_lineage
from .packing import group_starts, ranges
from .tokens import mix, pieces, text_buffers

FOLDER = "/opt/tokenizers"
#: Vocabulary files of the two sides (fixed by the contract).
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: How side A splits a text before merging bytes (fixed by its vocabulary file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that the quicker encoder of side A leaves to the other one: letters whose class depends on the Unicode version, long runs.
UNUSUAL = re.compile(r"[^\x00-\u024F]|\S{400}|\s{400}")
PIECE_BYTES, SEGMENT_BYTES = 1 << 19, 1 << 23


class _Vocabulary:
    """The bytes of each id, one after another, and an encoder of many texts."""

    def __init__(self, entries: list[bytes], encode):
        self.lens = np.array([len(e) for e in entries], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lens)]
        self.data, self.encode = np.frombuffer(b"".join(entries), np.uint8), encode

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[ids], self.lens[ids])]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_encoder(file: str, slow):
    """Side A's encoder of many texts. Byte pairs merge in the order of their ids, so a quicker encoder of such ranks gives
    the same tokens; where the file's merges are ordered otherwise, and for UNUSUAL texts, ``slow`` is used.
    """
    import tiktoken

    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != [*range(256, 256 + len(merged))]:
        return slow
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in name): i for name, i in model["vocab"].items() if i < 256 + len(merged)}
    quick = tiktoken.Encoding("byte-pairs", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts):
        texts = [" " + t for t in texts]
        hard = [k for k, t in enumerate(texts) if UNUSUAL.search(t)]
        other = dict(zip(hard, slow([texts[k] for k in hard])))
        return [other[k] if k in other else quick.encode_ordinary(t) for k, t in enumerate(texts)]
    return encode


@functools.cache
def vocabularies(folder: str = FOLDER) -> tuple[_Vocabulary, _Vocabulary]:
    """Both sides, loaded once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(os.path.join(folder, FILES[0]))
    left.encode_special_tokens = True
    letters, names = _byte_letters(), left.get_vocab(with_added_tokens=True)
    entries = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        entries[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    many = getattr(left, "encode_batch_fast", left.encode_batch)
    a = _Vocabulary(entries, _byte_encoder(os.path.join(folder, FILES[0]),
                                           lambda texts: [e.ids for e in many(texts, add_special_tokens=False)]))
    right = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, FILES[1]))
    entries = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
               for i in range(right.get_piece_size())]
    return a, _Vocabulary(entries, lambda texts: right.encode(texts, num_threads=1))


def row_products(ptr: np.ndarray, columns: np.ndarray, other_ptr: np.ndarray, other_columns: np.ndarray, value=None, other_value=None):
    """Gustavson's product of two CSR matrices: (ptr, columns, values); missing values are ones.

    Each entry of a row brings the whole row of the other matrix that its column names; entries that meet are added.
    """
    lens = np.diff(other_ptr)[columns]
    at = ranges(other_ptr[columns], lens)
    rows = np.repeat(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), lens)
    found = other_columns[at]
    values = np.ones(len(found), np.int64) if value is None else np.repeat(value, lens) * other_value[at]
    if len(found) and ((rows[1:] == rows[:-1]) & (found[1:] < found[:-1])).any():
        order = np.lexsort((found, rows))
        rows, found, values = rows[order], found[order], values[order]
    first = group_starts(rows, found)
    values = np.add.reduceat(values, first) if len(first) else values
    return np.searchsorted(rows[first], np.arange(len(ptr))), found[first], values


class Aligned:
    """Texts encoded by both sides: tokens, overlap links and groups of the texts that both give back; arrays over all texts.

    ``ids[s]`` are the tokens of side s and ``ptr[s]`` their first places by text; ``links`` is the CSR matrix of A tokens by B tokens
    with shared bytes; ``group[s]`` numbers the group of each token and ``group_ptr`` the first group of each text.
    """

    def __init__(self, texts: list[str | None], folder: str = FOLDER):
        sides, texts = vocabularies(folder), [t or "" for t in texts]
        whole = [b" " + t.encode() if t else b"" for t in texts]
        sizes = np.array([len(w) for w in whole], np.int64)
        found = []
        for side in sides:
            ids = side.encode(texts)
            ids = [x if n else [] for x, n in zip(ids, sizes)]
            counts = np.array([len(x) for x in ids], np.int64)
            found.append((np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum())), counts))
        good = sizes > 0
        for side, (ids, counts) in zip(sides, found):
            good &= np.bincount(np.repeat(np.arange(len(texts)), counts), weights=side.lens[ids], minlength=len(texts)) == sizes
        for side, (ids, counts) in zip(sides, found):  # sizes agree, so bytes can be compared place by place
            there = np.frombuffer(b"".join(w for w, g in zip(whole, good) if g), np.uint8)
            differs = side.bytes_of(ids[np.repeat(good, counts)]) != there
            if differs.any():
                ends = np.cumsum(sizes[good])
                good[np.flatnonzero(good)[np.unique(np.searchsorted(ends, np.flatnonzero(differs), side="right"))]] = False
        self.good = good
        self.ids, self.ptr, ends = [], [], []
        for side, (ids, counts) in zip(sides, found):
            ids = ids[np.repeat(good, counts)]
            self.ids.append(ids)
            self.ptr.append(np.r_[0, np.cumsum(np.where(good, counts, 0))])
            ends.append(np.r_[0, np.cumsum(side.lens[ids])])
        total = int(ends[0][-1])
        token_of_byte = np.repeat(np.arange(len(self.ids[1])), np.diff(ends[1]))
        self.links = row_products(ends[0], np.arange(total), np.arange(total + 1), token_of_byte)
        ptr, reached, _ = self.links
        starts_group = np.r_[True, reached[ptr[1:-1]] != reached[ptr[1:-1] - 1]] if len(self.ids[0]) else np.zeros(0, bool)
        group = np.cumsum(starts_group) - 1
        opened = reached[ptr[:-1][starts_group]]  # the first B token of each group
        marks = np.zeros(len(self.ids[1]), np.int64)
        marks[opened] = 1
        self.group = [group, np.cumsum(marks) - 1]
        self.starts = [np.flatnonzero(starts_group), opened]
        self.group_ptr = np.searchsorted(self.starts[0], self.ptr[0])

    def n_groups(self) -> int:
        return len(self.starts[0])

    def group_ids(self, side: int, groups: np.ndarray):
        """(ids, how many) of the given groups' tokens."""
        ends = np.r_[self.starts[side][1:], len(self.ids[side])]
        lens = ends[groups] - self.starts[side][groups]
        return self.ids[side][ranges(self.starts[side][groups], lens)], lens

    def group_hashes(self) -> np.ndarray:
        """One number for each group that tells its A and B ids in order."""
        out = np.zeros(self.n_groups(), np.uint64)
        for side in (0, 1):
            place = np.arange(len(self.ids[side])) - self.starts[side][self.group[side]]
            each = mix(self.ids[side].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)), 0x1B873593 + side)
            if len(each):
                out = mix(out) + np.add.reduceat(each, self.starts[side])
        return mix(out, 99)


def _texts(ids: np.ndarray, lens: np.ndarray) -> list[str]:
    words, ends = [str(i) for i in ids.tolist()], np.cumsum(lens).tolist()
    return [",".join(words[a:b]) for a, b in zip([0, *ends], ends)]


def _counted(owner: np.ndarray, ids: np.ndarray, n: int):
    """CSR matrix of how often each owner has each id."""
    order = np.lexsort((ids, owner))
    owner, ids = owner[order], ids[order]
    first = group_starts(owner, ids)
    return np.searchsorted(owner[first], np.arange(n + 1)), ids[first], np.diff(np.r_[first, len(ids)])


SEGMENT = ("seg long, ids array<long>, n_a binary, n_b binary, n_groups binary, n_links binary, sha array<string>, doc_ptr binary, kinds binary, "
           "times binary, kind_ptr binary, pairs binary, links binary, a array<int>, b array<int>, docs array<int>")


def _segment(seg: int, ids: pa.Array, texts: list[str | None], offsets: np.ndarray, folder: str) -> list:
    """One row of SEGMENT: documents x kinds of groups, kinds x id pairs, and the id pairs with their documents."""
    n, right = len(texts), len(vocabularies(folder)[1].lens)
    name_of, parts, n_a, n_b, n_groups, sha = {}, [], [], [], [], []
    for a, b in pieces(offsets, PIECE_BYTES):
        part = Aligned(texts[a:b], folder)
        hashes, first, local = np.unique(part.group_hashes(), return_index=True, return_inverse=True)
        both = [part.group_ids(side, first) for side in (0, 1)]
        new = [k for k, h in enumerate(hashes.tolist()) if h not in name_of]
        if new:
            fresh = [_texts(*part.group_ids(side, first[new])) for side in (0, 1)]
            name_of.update(zip(hashes[new].tolist(), map("|".join, zip(*fresh))))
        names, cuts = [name_of[h] for h in hashes.tolist()], part.group_ptr.tolist()
        each = local.tolist()
        sha += ["" if x == y else hashlib.sha256(";".join([names[k] for k in each[x:y]]).encode()).hexdigest()
                for x, y in zip(cuts, cuts[1:])]
        for out, ptr in ((n_a, part.ptr[0]), (n_b, part.ptr[1]), (n_groups, part.group_ptr)):
            out.append(np.diff(ptr))
        doc = np.repeat(np.arange(a, b), np.diff(part.group_ptr))
        parts.append((hashes, both, doc, local))
    hashes, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
    n_kinds, sides = len(hashes), []
    for side in (0, 1):  # ids of each kind, taken from the piece that has it first
        kind_ids, lens = (np.concatenate([p[1][side][k] for p in parts]) for k in (0, 1))
        starts = np.r_[0, np.cumsum(lens)][:-1]
        owner = np.repeat(np.arange(n_kinds), lens[first])
        sides.append(_counted(owner, kind_ids[ranges(starts[first], lens[first])], n_kinds))
    (a_ptr, a_ids, a_times), (b_ptr, b_ids, b_times) = sides
    owner = np.repeat(np.arange(n_kinds), np.diff(a_ptr))
    _, b_found, links = row_products(np.arange(len(a_ids) + 1), owner, b_ptr, b_ids, a_times, b_times)
    reach = np.diff(b_ptr)[owner]
    key = np.repeat(a_ids, reach) * right + b_found
    kind_ptr = np.r_[0, np.cumsum(reach)][a_ptr]
    known, pairs = np.unique(key, return_inverse=True)
    docs, n_kinds_of, kinds, times = np.zeros(len(known), np.int64), np.zeros(n, np.int64), [], []
    for part_hashes, _, doc, local in parts:  # a piece of documents at a time
        if not len(doc):
            continue
        base = doc[0]
        ptr, kind, count = _counted(doc - base, np.searchsorted(hashes, part_hashes)[local], int(doc[-1] - base) + 1)
        _, held, _ = row_products(ptr, kind, kind_ptr, pairs)
        docs += np.bincount(held, minlength=len(known))
        n_kinds_of[base:base + len(ptr) - 1] = np.diff(ptr)
        kinds.append(kind)
        times.append(count)
    kinds, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kinds, times))
    doc_ptr = np.r_[0, np.cumsum(n_kinds_of)]
    of_kind = _row_sums(kind_ptr, links)
    n_links = _row_sums(doc_ptr, of_kind[kinds] * times)
    pack = lambda x, t=np.int32: x.astype(t).tobytes()
    return [seg, ids.to_pylist(), pack(np.concatenate(n_a)), pack(np.concatenate(n_b)), pack(np.concatenate(n_groups)), pack(n_links, np.int64), sha,
            pack(doc_ptr), pack(kinds), pack(times), pack(kind_ptr), pack(pairs), pack(links), (known // right).astype(np.int32).tolist(),
            (known % right).astype(np.int32).tolist(), docs.astype(np.int32).tolist()]


def _row_sums(ptr: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[ptr[1:]] - total[ptr[:-1]]


_SEGMENT_TYPES = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 4 + [pa.list_(pa.string())] + [pa.binary()] * 6 + [pa.list_(pa.int32())] * 3
_SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]


def _segments(folder: str):
    def encode(batches):
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_buffers(batch.column("text"))
            for a, b in pieces(offsets, SEGMENT_BYTES):
                row = _segment(seg, batch.column("id").slice(a, b - a), batch.column("text").slice(a, b - a).to_pylist(),
                               offsets[a:b + 1], folder)
                seg += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT_TYPES)], _SEGMENT_NAMES)
    return encode


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
_RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _summed(segment: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one segment: its matrices times the counts of its id pairs."""
    row = segment.to_pylist()[0]
    read = lambda c, t=np.int32: np.frombuffer(row[c], t).astype(np.int64)
    count, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
    at = np.asarray(counts.column("at"))
    count[at], best[at] = np.asarray(counts.column("n")), np.asarray(counts.column("best"))
    kind_ptr, pairs, links, doc_ptr = (read(c) for c in ("kind_ptr", "pairs", "links", "doc_ptr"))
    out = []
    for each in (best.astype(np.int64), count):
        of_kind = _row_sums(kind_ptr, links * each[pairs])
        out.append(_row_sums(doc_ptr, of_kind[read("kinds")] * read("times")))
    columns = [row["ids"], read("n_a"), read("n_b"), read("n_groups"), read("n_links", np.int64), *out, row["sha"]]
    types = [pa.int64()] * 7 + [pa.string()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _RESULT_NAMES)


def pair_counts(segments: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the id pair linked) and best (no B id of this A id has more)."""
    pairs = segments.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.docs").alias("n"))
    pairs = cut_lineage(pairs, "pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, tokens, groups and links of every document, with the corpus-wide counts of its links' id pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    segments = cut_lineage(rows.mapInArrow(_segments(folder), SEGMENT), "segments")
    asked = segments.select("seg", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("seg", "at", "p.a", "p.b")
    known = asked.join(pair_counts(segments), ["a", "b"]).select(F.col("seg").alias("of"), "at", "n", "best")
    return segments.drop("a", "b", "docs").groupBy("seg").cogroup(known.groupBy("of")).applyInArrow(_summed, RESULT)


TOKENS = ("doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, "
          "overlaps array<struct<a:int,b:int,n_bytes:int>>")


def tokens_and_links(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The alignment itself: token ids of both sides, their groups (from 0 in each text) and the overlap links with shared bytes."""
    def encode(batches):
        for batch in batches:
            _, offsets = text_buffers(batch.column("text"))
            for a, b in pieces(offsets, PIECE_BYTES):
                part, out = Aligned(batch.column("text").slice(a, b - a).to_pylist(), folder), []
                ptr, reached, shared = part.links
                for k, doc in enumerate(batch.column("id").slice(a, b - a).to_pylist()):
                    own = [slice(part.ptr[s][k], part.ptr[s][k + 1]) for s in (0, 1)]
                    links = slice(ptr[own[0].start], ptr[own[0].stop])
                    left = np.repeat(np.arange(own[0].stop - own[0].start), np.diff(ptr[own[0].start:own[0].stop + 1]))
                    overlaps = [{"a": x, "b": y, "n_bytes": z} for x, y, z in zip(
                        left.tolist(), (reached[links] - own[1].start).tolist(), shared[links].tolist())]
                    out.append([doc, *(part.ids[s][own[s]].tolist() for s in (0, 1)),
                                *((part.group[s][own[s]] - part.group_ptr[k]).tolist() for s in (0, 1)), overlaps])
                types = [pa.int64()] + [pa.list_(pa.int32())] * 4 + [
                    pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n_bytes", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "overlaps"])
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(encode, TOKENS)
