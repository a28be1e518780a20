"""Language identification by interpolated Kneser-Ney character models.

Texts become sequences of symbols: a space for every run of non-letters and the code point of each lower-cased letter, whatever
its script. All 4-grams of all training texts are counted per language; the lower orders come from the 4-gram types (Kneser-Ney
continuation counts) and end in a small even share for letters never seen. The model holds the 64-bit hashes of the 4-, 3- and
2-grams and letters in sorted arrays, found through their top bits, with one log probability or back-off weight per language.
No letter shares a symbol with another and no gram is left out, so the model grows with the text. A text gets the language of
the lowest cross-entropy per symbol.

Rejection is calibrated on the model: the mean and deviation of a symbol's log probability in each language's own
training text say how far above the mean the cross-entropy of n symbols may lie; beyond, the text is in none of the languages.
A letter that no training text holds costs some 24 bits, so a text in an unlearned script is far beyond.

Counting and scoring are numpy over batches of texts inside tasks; counts are summed by Spark. The driver receives each language's
4-gram types (some 25 bytes each), and each worker holds 8 + 4 x languages bytes for every entry. Two different grams with the same 64-bit
hash would be taken for one.

Defined cases: a null text and a text without letters are `und` with score 0 and rejected; texts of any length are
scored whole; rows without a language are not learned from; without any training text all are `und`; null ids count as
training rows (their text form is empty); repeated rows count and score alike; an empty table gives no rows. Ties go to the language first in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .tokens import mix, pieces, text_buffers

#: Code points, and the share of a unigram that is spread evenly over them.
LETTERS, UNSEEN = 0x110000, 0.01
#: Log2 units per symbol that a text may lie above its language's mean, besides Z deviations of the mean of its symbols.
MARGIN, Z = 2.0, 6.0
#: Bytes of texts, and grams of them, worked on at a time; 4-gram types held by a counting task before it passes them on.
_PIECE, _GRAMS, _HELD = 1 << 18, 1 << 18, 1 << 19
_U, _BITS = np.uint64, np.uint64(21)
_ONE, _TWO = _U((1 << 21) - 1), _U((1 << 42) - 1)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point its lower-cased letter, or 0 if it is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(LETTERS, np.uint32)
        for i in range(LETTERS):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters = table
    return _letters


def _code_points(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased letters or 0 for each code point of a piece, and the row of each."""
    begin, raw = int(offsets[0]), data[int(offsets[0]):int(offsets[-1])]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before each byte
    return letter_table()[points], heads[offsets - begin]


def _grams(letters: np.ndarray, cuts: np.ndarray):
    """(contexts, symbols after them, row of each, letters per row): each row reads as three spaces, its words, one space.

    A context is the three symbols before in 63 bits."""
    rows = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    is_letter = letters > 0
    n_letters = np.bincount(rows[is_letter], minlength=len(cuts) - 1)
    # keep letters and the first of each run of other characters
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (rows[1:] == rows[:-1])
    codes, rows = letters[keep], rows[keep]
    n = np.bincount(rows, minlength=len(cuts) - 1)
    ends_in_letter = np.zeros(len(n), bool)
    some = np.flatnonzero(n)
    last = np.cumsum(n) - 1
    ends_in_letter[some] = codes[last[some]] > 0
    extra = 3 + ends_in_letter
    start = np.cumsum(n + extra) - (n + extra)
    out = np.zeros(int((n + extra).sum()), _U)
    first = np.cumsum(n) - n
    out[(start + 3)[rows] + np.arange(len(rows)) - first[rows]] = codes
    if len(out) < 4:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), n_letters
    contexts = (out[:-3] << _U(42)) | (out[1:-2] << _BITS) | out[2:-1]
    length = n + extra
    own = np.repeat(np.arange(len(n)), length)[3:]
    whole = np.arange(3, len(out)) - start[own] >= 3
    return contexts[whole], out[3:][whole], own[whole], n_letters


def _hash(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams of a context and the symbol after it."""
    return mix(mix(context) + last)


def _added(context, last, n):
    """The same counts with each 4-gram once."""
    h = _hash(context, last)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    at = order[first]
    return context[at], last[at], np.add.reduceat(n[order], first) if len(first) else n


def _count_map(batches):
    held: dict[str, list] = {}

    def merge(lang):
        held[lang] = [_added(*(np.concatenate(c) for c in zip(*held[lang])))]

    def passed_on():
        for lang in list(held):
            merge(lang)
            for context, last, n in held.pop(lang):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(context.astype(np.int64)), pa.array(last.astype(np.int32)),
                                                  pa.array(n)], ["lang", "context", "last", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            data, offsets = text_buffers(batch.column("text").filter(pa.array([x == lang for x in langs])))
            for a, b in pieces(offsets, _PIECE):
                context, last, _, _ = _grams(*_code_points(data, offsets[a:b + 1]))
                held.setdefault(lang, []).append(_added(context, last, np.ones(len(last), np.int64)))
                if len(held[lang]) > 16:
                    merge(lang)
        if sum(len(part[2]) for parts in held.values() for part in parts) > _HELD:
            yield from passed_on()
    yield from passed_on()


class Hashes:
    """A sorted array of 64-bit hashes with a row of values for each; found through the top bits and a few steps on."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.keys = np.r_[hashes[order], _U(2 ** 64 - 1)]
        self.values = values[order]
        self.shift = _U(64 - max(1, len(hashes).bit_length()))
        self.start = None

    def __getstate__(self):
        return {**self.__dict__, "start": None}  # each worker makes its own index

    def find(self, hashes: np.ndarray):
        """(place, found) of each hash."""
        if self.start is None:
            tops = np.arange(1 << (64 - int(self.shift)), dtype=_U) << self.shift
            self.start = np.searchsorted(self.keys[:-1], tops).astype(np.int32)
        at = self.start[(hashes >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < hashes[behind]]
        found = self.keys[at] == hashes
        found &= at < len(self.values)
        return at, found

    def get(self, hashes: np.ndarray, default) -> np.ndarray:
        """The values of each hash; ``default`` (a number or rows) where it is not stored."""
        at, found = self.find(hashes)
        out = np.empty((len(hashes), self.values.shape[1]), np.float32)
        out[:] = default
        out[found] = self.values[at[found]]
        return out


class Model:
    """Languages, probabilities of 4-grams (log2) to 1-grams, back-off weights of contexts of three symbols to one."""

    def __init__(self, langs, probs, weights, mean, deviation):
        self.langs, self.mean, self.deviation = langs, mean, deviation
        self.probs, self.weights = probs, weights  # by order: {4, 3, 2, 1}, {3, 2, 1}

    def log_probs(self, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """[grams, languages] log2 probabilities of each symbol after its context."""
        at, found = self.probs[4].find(_hash(context, last))
        out = np.empty((len(last), len(self.langs)), np.float32)
        out[found] = self.probs[4].values[at[found]]
        miss = np.flatnonzero(~found)
        if len(miss):
            c, x = context[miss], last[miss]
            out[miss] = np.log2(self.weights[3].get(mix(c), 1.0) * self._lower(c & _TWO, x, 3))
        return out

    def _lower(self, context, last, order):
        if order == 1:
            return self.probs[1].get(mix(last), UNSEEN / LETTERS)
        at, found = self.probs[order].find(_hash(context, last))
        out = np.empty((len(last), len(self.langs)), np.float32)
        out[found] = self.probs[order].values[at[found]]
        miss = np.flatnonzero(~found)
        if len(miss):
            c, x = context[miss], last[miss]
            out[miss] = self.weights[order - 1].get(mix(c), 1.0) * self._lower(c & _ONE, x, order - 1)
        return out


def _discount(n: np.ndarray) -> float:
    """Kneser-Ney's discount from the number of counts 1 and 2."""
    one, two = float((n == 1).sum()), float((n == 2).sum())
    return min(max(one / (one + 2 * two) if one else 0.5, 0.1), 0.9)


def _interpolated(keys: np.ndarray, contexts: np.ndarray, own: np.ndarray, counts: np.ndarray, own_contexts: np.ndarray, key_contexts: np.ndarray,
                  shorter: np.ndarray):
    """(probability of each of all keys, back-off weight of each of all contexts) in one language.

    ``own`` are the places of the language's grams among ``keys`` and ``own_contexts`` those of their contexts among ``contexts``;
    ``shorter`` has the probability of each key without its first symbol."""
    d = _discount(counts)
    full = np.bincount(own_contexts, counts, minlength=len(contexts))
    types = np.bincount(own_contexts, minlength=len(contexts))
    back = np.where(full > 0, d * types / np.maximum(full, 1), 1.0)
    probs = back[key_contexts] * shorter
    probs[own] += np.maximum(counts - d, 0) / full[own_contexts]
    return probs, back


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's 4-gram counts (contexts, symbols, counts), each 4-gram once."""
    langs = sorted(counts)
    n = len(langs)
    context, last, _ = _added(*(np.concatenate([counts[x][i] for x in langs]) for i in range(3)))
    hashes = _hash(context, last)
    order = np.argsort(hashes)
    context, last, hashes = context[order], last[order], hashes[order]
    ends = ((context & _TWO) << _BITS) | last                    # 4-grams without their first symbol
    keys = {3: np.unique(ends)}
    keys[2] = np.unique(keys[3] & _TWO)
    keys[1] = np.unique(keys[2] & _ONE)
    contexts = {3: np.unique(context), 2: np.unique(keys[3] >> _BITS), 1: np.unique(keys[2] >> _BITS)}
    place4 = np.searchsorted(contexts[3], context)
    shorter = {4: np.searchsorted(keys[3], ends), 3: np.searchsorted(keys[2], keys[3] & _TWO), 2: np.searchsorted(keys[1], keys[2] & _ONE)}
    above = {3: np.searchsorted(contexts[2], keys[3] >> _BITS), 2: np.searchsorted(contexts[1], keys[2] >> _BITS)}
    probs = {4: np.zeros((len(hashes), n), np.float32), **{k: np.zeros((len(keys[k]), n), np.float32) for k in keys}}
    weights = {k: np.zeros((len(contexts[k]), n), np.float32) for k in contexts}
    mean, deviation = np.zeros(n), np.zeros(n)
    for i, lang in enumerate(langs):
        own_context, own_last, c4 = counts[lang]
        c4 = c4.astype(np.float64)
        k3, c3 = np.unique(((own_context & _TWO) << _BITS) | own_last, return_counts=True)  # continuation counts: distinct symbols before
        k2, c2 = np.unique(k3 & _TWO, return_counts=True)
        k1, c1 = np.unique(k2 & _ONE, return_counts=True)
        p = np.full(len(keys[1]), UNSEEN / LETTERS)
        p[np.searchsorted(keys[1], k1)] += (1 - UNSEEN) * c1 / c1.sum()
        probs[1][:, i] = p
        for k, own, c in ((2, k2, c2), (3, k3, c3)):
            p, back = _interpolated(keys[k], contexts[k - 1], np.searchsorted(keys[k], own), c.astype(np.float64),
                                    np.searchsorted(contexts[k - 1], own >> _BITS), above[k], p[shorter[k]])
            probs[k][:, i], weights[k - 1][:, i] = p, back
        own = np.searchsorted(hashes, _hash(own_context, own_last))
        p, back = _interpolated(hashes, contexts[3], own, c4, place4[own], place4, p[shorter[4]])
        logs = np.log2(p)
        probs[4][:, i], weights[3][:, i] = logs, back
        mean[i] = -(c4 * logs[own]).sum() / c4.sum()
        deviation[i] = np.sqrt(max((c4 * logs[own] ** 2).sum() / c4.sum() - mean[i] ** 2, 0.0))
    stored = {4: Hashes(hashes, probs[4]), 1: Hashes(mix(keys[1]), probs[1])}
    stored.update({k: Hashes(_hash(keys[k] >> _BITS, keys[k] & _ONE), probs[k]) for k in (2, 3)})
    return Model(langs, stored, {k: Hashes(mix(contexts[k]), weights[k]) for k in contexts}, mean, deviation)


def train(rows: DataFrame) -> Model | None:
    """A model of (text, lang) rows; None without any. The driver receives the counted 4-gram types of each language."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    table = (rows.mapInArrow(_count_map, "lang string, context long, last int, n long")
             .groupBy("lang", "context", "last").agg(F.sum("n").alias("n")).toArrow())
    if not table.num_rows:
        return None
    lang = table.column("lang").combine_chunks().dictionary_encode()
    context, last, n = (table.column(c).to_numpy() for c in ("context", "last", "n"))
    number = lang.indices.to_numpy()
    counts = {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        own = np.flatnonzero(number == i)
        own = own[np.lexsort((last[own], context[own]))]  # the same model however the counts arrive
        counts[name] = (context[own].astype(_U), last[own].astype(_U), n[own])
    return fit(counts)


def _score_map(shared, text: str):
    def run(batches):
        model = shared.value
        names = np.array(model.langs, object)
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            best, score, bits, rejected = [], [], [], []
            for a, b in pieces(offsets, _PIECE):
                context, last, rows, letters = _grams(*_code_points(data, offsets[a:b + 1]))
                n = np.bincount(rows, minlength=b - a)
                sums = np.zeros((b - a, len(names)))
                for i in range(0, len(rows), _GRAMS):  # rows are in order: each slice adds its runs of one row
                    own = rows[i:i + _GRAMS]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    sums[own[first]] += np.add.reduceat(model.log_probs(context[i:i + _GRAMS], last[i:i + _GRAMS]), first, axis=0, dtype=np.float64)
                entropy = -sums / np.maximum(n, 1)[:, None]
                pick = entropy.argmin(axis=1)
                low = entropy[np.arange(b - a), pick]
                # posterior of the best language, as if a symbol in eight were independent evidence
                odds = np.exp2(-(entropy - low[:, None]) * np.maximum(n, 1)[:, None] / 8).sum(axis=1)
                known = letters > 0
                limit = model.mean[pick] + MARGIN + Z * model.deviation[pick] / np.sqrt(np.maximum(n, 1))
                best.append(np.where(known, names[pick], "und"))
                score.append(np.where(known, 1 / odds, 0.0))
                bits.append(np.where(known, low, 0.0))
                rejected.append(~known | (low > limit))
            join = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != text]
                + [join(best, pa.string()), join(score, pa.float64()), join(bits, pa.float64()), join(rejected, pa.bool_())],
                [c for c in batch.schema.names if c != text] + ["lang_pred", "score", "bits", "rejected"])
    return run


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score, bits, rejected) of each row from its text alone; bits is the cross-entropy per symbol."""
    text = free_name("_text", keep)
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce("text", F.lit("")).alias(text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    if model is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score_map(shared, text), f"{kept}, lang_pred string, score double, bits double, rejected boolean")


def held_out(id_col: str = "doc_id", modulo: int = 4, remainder: int = 2):
    """Whether a row is kept from training: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulo == remainder, F.lit(False))
