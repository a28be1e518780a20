"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Two documents link when 100 * |A and B| >= percent * |A or B|. Documents of equal sets form a class, and only
classes are compared.

* Light sets (up to a size chosen by cost): for each size the partner may have, the size c that the
  intersection must reach is fixed, and every c-subset is enumerated as a hash. Equal hashes are links between
  sets of these two sizes (not among sets of the larger one, whose overlap must be higher).
* Heavy sets: inverted lists are scanned for the shingles of a set that come first in a global order, rare
  ones first; linked sets share one of their first n - ceil(percent * n) + 1. The order comes from a counting
  sketch of all shingles (2^18 counters, whatever the input); any order gives whole results.
* The boundary is the size with the lowest total cost of enumerating below and scanning above it.

Lists never emit all pairs. A list of up to three sets does; a longer one links all its sets to a pivot (the set
with the fewest rarer shingles), and only sets that are still in different components meet again in the next
round, with further pivots, until no list holds an unsettled pair. So a group of near copies costs about one
comparison each, and no link is lost. Candidates pass exact bounds (sizes, positions, a 512-bit parity sketch
of the sets, for large sets a wider one made for the sets that meet) before the two texts are compared.

Defined cases: null, empty and wordless texts have no shingles and link with nothing (their component is their own
id); texts of fewer words than a shingle have one, the whole; a null id ranks above every other id and a component of null ids
alone is null; repeated rows link like other equal documents; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage
from .common import SPACE_RE, count_words, free_name, small_or_joined
from .components import components
from .packing import by_bucket, group_starts, spread, unpack_all
from .substring import _blobs, _of_kind, anywhere
from .tokens import SPACES, byte_table, mix, pieces, text_buffers, window_hashes, word_hashes, word_spans

SHINGLE, PERCENT = 5, 80
SKETCH_BITS = 18
BUCKET_BYTES = 32 << 20
#: Sizes up to this are considered for the light side; the cost picks the boundary among them.
LIGHT_SIZES = 64
_SIG = 8
_NO_ID = (1 << 63) - 1
_WORD_BYTES = byte_table(SPACES)
_POSTING = [np.uint64, np.int64, np.int32, np.int32]
_KEY = [np.uint64, np.int64, np.int32]
_META = [np.int64, np.int64, np.int64, np.int64, np.int32] + [np.int64] * _SIG


def least_overlap(a, b, percent: int):
    """The smallest intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n, percent: int):
    """Linked sets of size n share one of so many first shingles."""
    return n - -(-percent * n // 100) + 1


def shingles(data, offsets, a: int, b: int, k: int):
    """(hash, row) of the shingles of rows a to b, with repeats; hashes are of A-Z lower-cased words."""
    starts, ends, rows = word_spans(data, offsets[a:b + 1], _WORD_BYTES)
    words = word_hashes(data, starts, ends, lower=True)
    count = np.bincount(rows, minlength=b - a)
    h = window_hashes(words, k)
    whole = rows[k - 1:] == rows[:len(h)]
    out, out_rows = [h[whole]], [rows[:len(h)][whole]]
    first = np.cumsum(count) - count
    for n in range(1, k):  # texts of fewer words: the whole as one
        short = np.flatnonzero(count == n)
        if len(short):
            out.append(window_hashes(words, n)[first[short]])
            out_rows.append(short)
    return np.concatenate(out), np.concatenate(out_rows)


def distinct_by_row(h: np.ndarray, rows: np.ndarray, n_rows: int):
    """Distinct (row, hash), sorted by row, then hash."""
    by = np.argsort(h)
    small = rows[by].astype(np.uint16) if n_rows < 65536 else rows[by]
    by = by[np.argsort(small, kind="stable")]
    h, rows = h[by], rows[by]
    first = group_starts(rows, h)
    return h[first], rows[first]


# -- the order of shingles ---------------------------------------------------------------------------

def _sketch_map(bits: int, k: int):
    def run(batches):
        counts, sizes = np.zeros(1 << bits, np.int64), np.zeros(LIGHT_SIZES + 1, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in pieces(offsets):
                h, rows = shingles(data, offsets, a, b, k)
                counts += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                sizes += np.bincount(np.minimum(np.bincount(rows, minlength=b - a), LIGHT_SIZES), minlength=LIGHT_SIZES + 1)
        blocks = counts.astype(np.uint32).reshape(64, -1) if counts.max(initial=0) < 1 << 32 else counts.reshape(64, -1)
        yield _blobs([(i, block.dtype.itemsize, block.tobytes()) for i, block in enumerate(blocks)] + [(64, 8, sizes.tobytes())])
    return run


def _sketch_sum(table: pa.Table) -> pa.Table:
    total = 0
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob")):
        total = total + np.frombuffer(blob.as_py(), np.uint32 if kind == 4 else np.int64).astype(np.int64)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "blob": pa.array([total.tobytes()], pa.binary())})


def shingle_counts(texts: DataFrame, bits: int, k: int):
    """Counters of all shingles and the number of texts by size; 2^bits numbers come to the driver."""
    rows = (texts.select("text").mapInArrow(_sketch_map(bits, k), "bucket long, kind int, blob binary")
            .groupBy("bucket").applyInArrow(_sketch_sum, "bucket long, blob binary").collect())
    found = {r["bucket"]: np.frombuffer(r["blob"], np.int64) for r in rows}
    if not found:
        return np.zeros(1 << bits, np.int64), np.zeros(LIGHT_SIZES + 1, np.int64)
    return np.concatenate([found[i] for i in range(64)]), found[64]


# -- light sets --------------------------------------------------------------------------------------

def partner_sizes(n: int, percent: int, top: int) -> list[tuple[int, int]]:
    """(partner size, removed shingles) that a light set of size n enumerates subsets for."""
    out = []
    for b in range(-(-percent * n // 100), min(100 * n // percent, top) + 1):
        need = least_overlap(n, b, percent)
        if need <= min(n, b) and not (b == n == need):  # equal sets are one class already
            out.append((b, n - need))
    return out


def boundary(sizes: np.ndarray, counts: np.ndarray, percent: int) -> int:
    """The light sizes 1 to the boundary: lowest cost of subsets below it plus scanned postings above.

    A scanned posting costs 1 and, as often as its shingle repeats elsewhere, one comparison of two sets.
    """
    total = counts.sum()
    repeats = float(np.maximum(counts - counts.mean(), 0).sum() / total) if total else 0.0
    n = np.arange(len(sizes))
    subsets = np.array([sum(math.comb(int(x), r) for _, r in partner_sizes(int(x), percent, 2 * LIGHT_SIZES)) for x in n], float)
    scanned = np.array([prefix_size(int(x), percent) for x in n]) * (1 + repeats * (64 + 2 * n))
    light, heavy = sizes * subsets, sizes * scanned
    cost = np.cumsum(light) + heavy.sum() - np.cumsum(heavy)
    free = int(np.flatnonzero(subsets[1:])[0]) if subsets[1:].any() else 0  # sizes without subsets cost nothing
    return max(free, int(np.argmin(cost[:LIGHT_SIZES])))


def _light_keys(h, rows, first, size, percent: int, top: int):
    """(key, row, side) of every enumerated subset; a subset's hash is the sum of its members' hashes.

    The side is 0 for partners of the same size, else 1 for the smaller and 2 for the larger set.
    """
    keys, owners, sides = [], [], []
    for n in np.unique(size[(size > 0) & (size <= top)]):
        own = np.flatnonzero(size == n)
        members = mix(h[first[own][:, None] + np.arange(n)], 11)
        whole = members.sum(axis=1, dtype=np.uint64)
        for b, removed in partner_sizes(int(n), percent, top):
            pick = np.array(list(combinations(range(n), removed)), np.int64).reshape(math.comb(int(n), removed), removed)
            part = whole[:, None] - members[:, pick].sum(axis=2, dtype=np.uint64)
            salt = (min(int(n), b) << 20) | max(int(n), b)
            keys.append(mix(part, salt).ravel())
            owners.append(np.repeat(rows[first[own]], len(pick)))
            sides.append(np.full(len(owners[-1]), 0 if b == n else 1 if n < b else 2, np.int32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(sides)


def _light_pairs(key, s, side):
    """(x, y) that connect all sets linked by a key: a star for one size, two stars across for two sizes.

    Sets of equal side share a key without being linked, unless the side is 0; so the first set of each side is paired
    with all sets of the other.
    """
    by = np.lexsort((s, side, key))
    key, s, side = key[by], s[by], side[by]
    first = group_starts(key)
    low = spread(first, first, len(key))
    large = np.searchsorted(np.flatnonzero(side == 2), first)  # first set of the larger size at or after the group's start
    large = np.r_[np.flatnonzero(side == 2), len(key)][large]
    high = spread(first, large, len(key))
    both = (side[low] == 1) & (key[np.minimum(high, len(key) - 1)] == key) & (high < len(key))
    equal, up, down = side == 0, both & (side == 2), both & (side == 1)
    return np.concatenate([s[low[equal]], s[low[up]], s[high[down]]]), np.concatenate([s[equal], s[up], s[down]])


# -- postings ----------------------------------------------------------------------------------------

def _posting_map(counts: np.ndarray, bits: int, k: int, percent: int, top: int, buckets: int):
    rank = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)
    scanned = -(-percent * (top + 1) // 100)  # smaller sets can only link with light ones

    def one(data, offsets, a, b, o, th, sent):
        h, rows = distinct_by_row(*shingles(data, offsets, a, b, k), b - a)
        size = np.bincount(rows, minlength=b - a)
        first = np.cumsum(size) - size
        s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
        some = np.flatnonzero(size)
        if len(some):
            s1[some] = mix(np.add.reduceat(mix(h, 1), first[some]) + size[some].astype(np.uint64))
            s2[some] = mix(np.add.reduceat(mix(h, 2), first[some]) + size[some].astype(np.uint64))
        bit = (mix(h, 3) >> np.uint64(55)).astype(np.int64)
        parity = np.bincount(rows * 512 + bit, minlength=(b - a) * 512).reshape(b - a, 64, 8) & 1
        signature = np.packbits(parity.astype(np.uint8).reshape(b - a, 512), axis=1).view(np.int64)
        meta = [o[a:b], th[a:b], s1.view(np.int64), s2.view(np.int64), size.astype(np.int32)] + [signature[:, i] for i in range(_SIG)]
        # copies of a set in this batch send its postings once
        new = np.zeros(b - a, bool)
        for i in some:
            if s1[i] not in sent:
                sent.add(s1[i])
                new[i] = True
        keys, owner, side = _light_keys(h, rows, first, np.where(new, size, 0), percent, top)
        light = [keys, s1[owner].view(np.int64), side]
        use = new[rows] & (size[rows] >= scanned)
        h, rows = h[use], rows[use]
        common = rank[(h >> np.uint64(64 - bits)).astype(np.int64)]
        by = np.argsort(common, kind="stable")  # h is sorted inside a row, so ties go by hash
        small = rows[by].astype(np.uint16) if b - a < 65536 else rows[by]
        by = by[np.argsort(small, kind="stable")]
        h, rows = h[by], rows[by]
        start = group_starts(rows)
        at = np.arange(len(rows)) - spread(start, start, len(rows))
        lead = at < prefix_size(size[rows], percent)
        heavy = [h[lead], s1[rows[lead]].view(np.int64), size[rows[lead]].astype(np.int32), at[lead].astype(np.int32)]
        return meta, light, heavy

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            o, th = (np.asarray(batch.column(c)) for c in ("o", "th"))
            sent: set = set()
            parts = [one(data, offsets, a, b, o, th, sent) for a, b in pieces(offsets)]
            if not parts:
                continue
            meta, light, heavy = ([np.concatenate(c) for c in zip(*group)] for group in zip(*parts))
            place = lambda x: (mix(x.view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)
            out = [(x, 1, blob) for x, blob in by_bucket(anywhere(buckets, meta[0], meta[1], np.arange(len(meta[0]))), meta)]
            out += [(x, 2, blob) for x, blob in by_bucket(place(light[0]), light)]
            out += [(x, 0, blob) for x, blob in by_bucket(place(heavy[0]), heavy)]
            if out:
                yield _blobs(out)
    return run


_FOUND = ("kind int, e long, x long, y long, n int, pos int, done boolean, o long, th long, s1 long, s2 long, "
          + ", ".join(f"g{i} long" for i in range(_SIG)))
_FOUND_ARROW = {"kind": pa.int32(), "e": pa.int64(), "x": pa.int64(), "y": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "done": pa.bool_(),
                "o": pa.int64(), "th": pa.int64(), "s1": pa.int64(), "s2": pa.int64()} | {f"g{i}": pa.int64() for i in range(_SIG)}
_PAIR, _LIST, _DOC = 0, 1, 2


def _rows(kind: int, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({name: pa.array(np.full(n, kind, np.int32)) if name == "kind" else
                     pa.array(columns[name]).cast(t) if name in columns else pa.nulls(n, t) for name, t in _FOUND_ARROW.items()})


def _pairs(x, y) -> pa.Table:
    """Distinct pairs with the smaller id first."""
    x, y = np.minimum(x, y), np.maximum(x, y)
    by = np.lexsort((y, x))
    x, y = x[by], y[by]
    first = group_starts(x, y)
    keep = first[x[first] != y[first]]
    return _rows(_PAIR, x=x[keep], y=y[keep])


def _possible(na, pa_, nb, pb, percent: int, top: int):
    """Bounds by size and by the positions of a shared shingle; both light is settled elsewhere."""
    need = least_overlap(na.astype(np.int64), nb.astype(np.int64), percent)
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return (np.maximum(na, nb) > top) & (need <= np.minimum(na, nb)) & (need <= most)


def _posting_reduce(percent: int, top: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        meta = unpack_all(_of_kind(table, 1), _META)
        if len(meta[0]):
            out.append(_rows(_DOC, o=meta[0], th=meta[1], s1=meta[2], s2=meta[3], n=meta[4], **{f"g{i}": meta[5 + i] for i in range(_SIG)}))
        out.append(_pairs(*_light_pairs(*unpack_all(_of_kind(table, 2), _KEY))))
        e, s, n, pos = unpack_all(_of_kind(table, 0), _POSTING)
        by = np.lexsort((s, e))
        keep = by[group_starts(e[by], s[by])]
        first = group_starts(e[keep])
        length = np.diff(np.r_[first, len(keep)])
        keep = keep[spread(first, length > 1, len(keep))]
        by = keep[np.lexsort((s[keep], pos[keep], e[keep]))]  # the pivot of a list comes first
        e, s, n, pos = e[by], s[by], n[by], pos[by]
        first = group_starts(e)
        length = np.diff(np.r_[first, len(e)])
        a, b = [spread(first, first, len(e))], [np.arange(len(e))]
        three = first[length == 3]
        a, b = np.concatenate([*a, three + 1]), np.concatenate([*b, three + 2])
        ok = (a != b) & _possible(n[a], pos[a], n[b], pos[b], percent, top)
        out.append(_pairs(s[a[ok]], s[b[ok]]))
        long = spread(first, length > 3, len(e))
        done = np.zeros(len(e), bool)
        done[first] = True
        out.append(_rows(_LIST, e=e[long].view(np.int64), x=s[long], n=n[long], pos=pos[long], done=done[long]))
        return pa.concat_tables(out)
    return run


def _round_reduce(percent: int, top: int):
    """Another round over open lists: sets of one component need no comparison any more.

    Pivots are taken in order until a list has looked at 512 pairs or emitted 8 per member, or all is settled;
    pairs that the parity sketches tell apart are settled at once.
    """
    def run(table: pa.Table) -> pa.Table:
        e, s, n, pos, done, label = (np.asarray(table.column(c)) for c in ("e", "x", "n", "pos", "done", "label"))
        by = np.lexsort((s, pos, e))
        e, s, n, pos, done, label = (c[by] for c in (e, s, n, pos, done, label))
        sketch = np.stack([np.asarray(table.column(f"g{i}"))[by] for i in range(_SIG)], axis=1)
        first = np.r_[group_starts(e), len(e)]
        xs, ys, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(first[:-1], first[1:]):
            left = a + np.flatnonzero(~done[a:b])
            looked = sent = p = 0
            while p < len(left) and looked <= 512 * len(left) and sent <= 8 * len(left):
                i, j = left[p], left[p + 1:]
                looked += len(j)
                j = j[label[j] != label[i]]
                j = j[_possible(n[i], pos[i], n[j], pos[j], percent, top)]
                size = n[j].astype(np.int64) + n[i]
                j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= size - 2 * least_overlap(n[j].astype(np.int64), int(n[i]), percent)]
                xs.append(np.full(len(j), s[i]))
                ys.append(s[j])
                sent += len(j)
                p += 1
            done[left[:p]] = True
            if len(np.unique(label[left[p:]])) > 1:
                rest.append(np.arange(a, b))
        r = np.concatenate(rest)
        return pa.concat_tables([_pairs(np.concatenate(xs), np.concatenate(ys)),
                                 _rows(_LIST, e=e[r], x=s[r], n=n[r], pos=pos[r], done=done[r])])
    return run


# -- comparison --------------------------------------------------------------------------------------

def _compare_map(k: int, percent: int):
    def run(batches):
        for batch in batches:
            (da, oa), (db, ob) = text_buffers(batch.column("text_a")), text_buffers(batch.column("text_b"))
            for a, b in pieces((oa - oa[0]) + (ob - ob[0])):  # a few megabytes of both texts at a time
                n = b - a
                (ha, ra), (hb, rb) = (distinct_by_row(*shingles(d, o, a, b, k), n) for d, o in ((da, oa), (db, ob)))
                na, nb = (np.bincount(r, minlength=n) for r in (ra, rb))
                h, rows = np.concatenate([ha, hb]), np.concatenate([ra, rb])
                by = np.lexsort((h, rows))
                twice = (h[by][1:] == h[by][:-1]) & (rows[by][1:] == rows[by][:-1])
                both = np.bincount(rows[by][1:][twice], minlength=n)
                yield batch.select(["u", "v"]).slice(a, n).filter(pa.array(100 * both >= percent * (na + nb - both)))
    return run


# -- wide sketches -----------------------------------------------------------------------------------

def _difference(size, percent: int):
    """The most shingles in which linked sets of ``size`` shingles together differ."""
    return size - 2 * (-(-percent * size // (100 + percent)))


def sketch_width(n: int, percent: int) -> int:
    """Bits of a set's parity sketch: a power of two of at least four times the differences that a link allows, so that
    the sketches of unlike sets, which differ in half their bits, are told apart."""
    return max(1024, 1 << int(4 * _difference(2 * n, percent) - 1).bit_length())


def _wide_map(k: int, percent: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in pieces(offsets):
                h, rows = distinct_by_row(*shingles(data, offsets, a, b, k), b - a)
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                bits = mix(h, 4)
                out = []
                for i, j in zip(cuts[:-1], cuts[1:]):
                    width = sketch_width(int(j - i), percent)
                    parity = np.bincount((bits[i:j] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    out.append(np.packbits(parity.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(a, b - a), pa.array(out, pa.binary())], ["c", "wide"])
    return run


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two parity sketches differ; the wider one is folded to the width of the other."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _wide_filter(percent: int):
    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("n_x")).astype(np.int64) + np.asarray(batch.column("n_y"))
            most = _difference(sizes, percent)
            near = [_apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column("wide_x"), batch.column("wide_y"), most)]
            yield batch.select(["c_x", "c_y"]).filter(pa.array(near, pa.bool_()))
    return run


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): the pairs of classes that link. ``pairs`` has 64-bit set ids x and y."""
    side = lambda name: classes.select(F.col("s1").alias(name), F.col("c").alias(f"c_{name}"), F.col("n").alias(f"n_{name}"),
                                       *[F.col(f"g{i}").alias(f"{name}{i}") for i in range(_SIG)])
    apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, _SIG)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    size = F.col("n_x") + F.col("n_y")
    need = F.ceil(size * percent / F.lit(100 + percent))
    met = cut_lineage(pairs.distinct().join(side("x"), "x").join(side("y"), "y").where(apart <= size - 2 * need)
                      .select("c_x", "c_y", "n_x", "n_y"), "met")
    # the sketches of the postings have 8 * 64 bits, of which unlike sets differ in half: larger sets need wider ones
    small = size - 2 * need < 32 * _SIG - 4 * 16
    large = met.where(~small)
    of = lambda rows: rows.select(F.col("c_x").alias("c")).union(rows.select("c_y")).distinct()
    asked = of(large)
    wide = texts.join(small_or_joined(asked, asked.count()), "c", "left_semi").select("c", "text").mapInArrow(
        _wide_map(k, percent), "c string, wide binary")
    wide = cut_lineage(wide, "wide")
    named = lambda name: wide.select(F.col("c").alias(f"c_{name}"), F.col("wide").alias(f"wide_{name}"))
    large = large.join(named("x"), "c_x").join(named("y"), "c_y").mapInArrow(_wide_filter(percent), "c_x string, c_y string")
    near = cut_lineage(met.where(small).select("c_x", "c_y").unionByName(large), "near")
    # only the texts that these pairs compare are shuffled
    wanted = of(near)
    texts = texts.join(small_or_joined(wanted, wanted.count()), "c", "left_semi")
    text = lambda name, out: texts.select(F.col("c").alias(name), F.col("text").alias(out))
    return (near.join(text("c_x", "text_a"), "c_x").join(text("c_y", "text_b"), "c_y")
            .select(F.col("c_x").alias("u"), F.col("c_y").alias("v"), "text_a", "text_b")
            .mapInArrow(_compare_map(k, percent), "u string, v string"))


def _members(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS,
             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(o, th, n, component, least), one row per document.

    ``component`` is the smallest name of the component's classes, null without words; ``least`` its smallest id, which
    unrelated components may share.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("o"), F.xxhash64(text).alias("th"), text.alias("text"))
    counts, sizes = shingle_counts(texts, sketch_bits, k)
    top = boundary(sizes, counts, percent)
    buckets = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / bucket_bytes))
    found = cut_lineage(texts.mapInArrow(_posting_map(counts, sketch_bits, k, percent, top, buckets), "bucket long, kind int, blob binary")
                        .groupBy("bucket").applyInArrow(_posting_reduce(percent, top), _FOUND), "postings")
    members = found.where(F.col("kind") == _DOC)
    first = members.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min(F.struct("o", "th", *[f"g{i}" for i in range(_SIG)])).alias("r"))
    name = F.concat(F.hex("s1"), F.lit("-"), F.hex("s2"), F.lit("-"), F.hex("n"))
    classes = cut_lineage(first.select("s1", "n", name.alias("c"), "r.*"), "classes")
    links, open_lists, pairs = None, found.where(F.col("kind") == _LIST), found.where(F.col("kind") == _PAIR).select("x", "y")
    open_lists = open_lists.select("e", "x", "n", "pos", "done")
    # the texts of sets that any list or key brings together
    wanted = pairs.select(F.col("x").alias("s1")).union(pairs.select("y")).union(open_lists.select("x")).distinct()
    copies = members.groupBy("o", "th").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    wanted = cut_lineage(classes.join(wanted, "s1", "left_semi").select("c", "o", "th").join(copies, ["o", "th"]), "wanted")
    kept_texts = cut_lineage(texts.join(wanted, ["o", "th"]).select("c", "repeated", "text"), "texts")
    if not wanted.where("repeated").isEmpty():  # equal ids with equal texts are repeated rows: one of them is enough
        kept_texts = cut_lineage(kept_texts.where("not repeated").unionByName(
            kept_texts.where("repeated").dropDuplicates(["c"])), "texts")
    listed = cut_lineage(classes.join(open_lists.select(F.col("x").alias("s1")).distinct(), "s1", "left_semi").select(
        F.col("s1").alias("x"), "c", *[f"g{i}" for i in range(_SIG)]), "listed")
    while True:
        new = cut_lineage(_linked(pairs, classes, kept_texts, k, percent), "links")
        links = new if links is None else links.unionByName(new)
        label = components(links)
        if open_lists.isEmpty():
            break
        # only the sets of open lists are told their components; their sketches come by the set's id
        labels = listed.select("x", "c").join(label.select(F.col("node").alias("c"), "component"), "c", "left").select(
            "x", F.xxhash64(F.coalesce("component", "c")).alias("label"))
        step = cut_lineage(open_lists.join(labels, "x").join(listed.drop("c"), "x").withColumn("bucket", F.pmod(F.xxhash64("e"), F.lit(buckets)))
                           .groupBy("bucket").applyInArrow(_round_reduce(percent, top), _FOUND), "round")
        pairs = step.where(F.col("kind") == _PAIR).select("x", "y")
        open_lists = step.where(F.col("kind") == _LIST).select("e", "x", "n", "pos", "done")
        if pairs.isEmpty() and open_lists.isEmpty():
            break
    comp = classes.join(label.select(F.col("node").alias("c"), "component"), "c", "left")
    least = comp.withColumn("component", F.coalesce("component", "c"))
    ids = least.groupBy("component").agg(F.min("o").alias("component_id"))
    ids = least.join(ids, "component").select(F.col("c").alias("class"), "component", "component_id")
    own = members.withColumn("class", F.when(F.col("n") > 0, name))
    return own.join(ids, "class", "left").select("o", "th", "n", "component", F.coalesce("component_id", "o").alias("least"))


def jaccard_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id), one row per document."""
    null_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return _members(docs, **options).select(null_id("o").alias("doc_id"), F.col("th").alias("text_key"),
                                            F.col("n").cast("long").alias("n_shingles"), null_id("least").alias("component_id"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """One row of each linked group of ``docs``, the one of the smallest id, with all its columns; texts without words all stay."""
    o, th = free_name("_o", docs.columns), free_name("_th", docs.columns)
    order = F.struct(F.col("o").alias(o), F.col("th").alias(th))
    stays = (_members(docs, **options).where("n > 0").groupBy("component")
             .agg(F.min(order).alias("k")).select(f"k.{o}", f"k.{th}"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({o: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), th: F.xxhash64(text)})
    wordless = count_words(F.col("text"), SPACE_RE) == 0
    return (keyed.where(~wordless).join(stays, [o, th], "left_semi").dropDuplicates([o, th])
            .unionByName(keyed.where(wordless)).drop(o, th))
