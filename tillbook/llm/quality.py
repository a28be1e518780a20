"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text has a small learned vector; filters of eight bytes run over the whole text. The filter values are
max-pooled over chunks of 256 positions, of which neighbouring ones overlap by 64 and which together cover the whole text.
The mean and the maximum of the chunks' pools go through one logistic unit.

Training takes place on a bounded sample of labelled rows that have a document (``max_rows``, chosen by a hash of the id), on all
chunks of their texts, by Adam with fixed seeds, on the driver, which holds these texts. Scoring reads every byte of every text, in
numpy inside tasks, a bounded block of bytes at a time.

Defined cases: null and empty texts are scored as one chunk of padding; label rows without id or label, or
whose document is missing, are left out; a document with several labels counts once with each; of the
documents of a repeated id the one of the smallest text hash is learned; without any labels, or with one
kind only, every score is that share (0.5 without labels); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .langid import held_out
from .tokens import pieces, text_buffers

WIDTH, DIM, FILTERS = 8, 4, 16
BLOCK, CHUNK, STEP = 64, 256, 192
MAX_ROWS, EPOCHS, BATCH, RATE = 3000, 14, 32, 0.004
_AT_ONCE = 1 << 18
_FIT_CHUNKS = 512


def chunk_counts(lengths: np.ndarray) -> np.ndarray:
    """Chunks of a text of so many bytes: one, and one more for each further 192 positions begun beyond 256."""
    return 1 + np.maximum(0, -(-(np.asarray(lengths) - CHUNK) // STEP))


def text_chunks(raw: bytes, most: int | None = None) -> list[bytes]:
    """All or at most ``most`` evenly spaced chunks of a text, each with the bytes its last windows reach."""
    n = int(chunk_counts(np.array([len(raw)]))[0])
    pick = np.unique(np.linspace(0, n - 1, min(n, most or n)).round().astype(int))
    size = CHUNK + WIDTH - 1
    return [raw[i * STEP:i * STEP + size].ljust(size, b"\0") for i in pick]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)),
                  "shift": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "bias": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][0] = 0  # padding

    def activations(self, data: np.ndarray) -> np.ndarray:
        """[len(data) - WIDTH + 1, FILTERS]: each filter at each position, at least 0."""
        vectors = np.ascontiguousarray(self.p["emb"][data])
        windows = np.lib.stride_tricks.as_strided(vectors, (len(data) - WIDTH + 1, WIDTH * DIM), (vectors.strides[0], vectors.strides[1]))
        return np.maximum(windows @ self.p["filters"] + self.p["shift"], 0)

    def pools(self, data: np.ndarray, offsets: np.ndarray):
        """(chunk pools, chunks per row) of consecutive rows; every row is padded to whole blocks."""
        length = np.diff(offsets)
        count = chunk_counts(length)
        blocks = 3 * count + 1  # STEP is three blocks, CHUNK four
        first = np.cumsum(blocks) - blocks
        laid = np.zeros(int(blocks.sum()) * BLOCK + WIDTH - 1, np.uint8)
        at = np.arange(int(length.sum())) + np.repeat(first * BLOCK - (offsets[:-1] - offsets[0]), length)
        laid[at] = data[int(offsets[0]):int(offsets[-1])]
        best = np.empty((int(blocks.sum()), FILTERS), np.float32)
        for a in range(0, len(best), _AT_ONCE // BLOCK):
            b = min(a + _AT_ONCE // BLOCK, len(best))
            best[a:b] = self.activations(laid[a * BLOCK:b * BLOCK + WIDTH - 1]).reshape(b - a, BLOCK, FILTERS).max(axis=1)
        chunk_row = np.repeat(np.arange(len(count)), count)
        start = first[chunk_row] + 3 * (np.arange(len(chunk_row)) - np.repeat(np.cumsum(count) - count, count))
        pool = np.maximum(np.maximum(best[start], best[start + 1]), np.maximum(best[start + 2], best[start + 3]))
        return pool, count

    def combine(self, pool: np.ndarray, count: np.ndarray):
        first = np.cumsum(count) - count
        mean = np.add.reduceat(pool, first, axis=0) / count[:, None]
        return np.concatenate([mean, np.maximum.reduceat(pool, first, axis=0)], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features = self.combine(*self.pools(data, offsets))
        return 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["bias"][0], -40, 40).astype(np.float64)))


def _gradients(net: Network, chunk_bytes: np.ndarray, count: np.ndarray, target: np.ndarray):
    """Gradients of the mean log loss over rows; chunk_bytes is [chunks, CHUNK + WIDTH - 1]."""
    p, n = net.p, len(count)
    blocks = [slice(a, a + _FIT_CHUNKS) for a in range(0, len(chunk_bytes), _FIT_CHUNKS)]  # a long text has many chunks
    peak, pool = (np.concatenate(x) for x in zip(*[_peaks(net, chunk_bytes[x]) for x in blocks]))
    features = net.combine(pool, count)
    error = (1 / (1 + np.exp(-np.clip(features @ p["out"] + p["bias"][0], -40, 40))) - target) / n
    back = error[:, None] * p["out"][None, :]
    row = np.repeat(np.arange(n), count)
    is_top = pool == features[row, FILTERS:]
    d_pool = (back[row, :FILTERS] / count[row][:, None] + back[row, FILTERS:] * is_top) * (pool > 0)
    grads = {"out": features.T @ error, "bias": np.array([error.sum()], np.float32), "shift": d_pool.sum(axis=0)}
    d_filters, d_emb = np.zeros_like(p["filters"]), np.zeros_like(p["emb"])
    for x in blocks:
        chunk = np.arange(len(chunk_bytes[x]))
        for f in range(FILTERS):
            under = chunk_bytes[x][chunk[:, None], peak[x, f][:, None] + np.arange(WIDTH)]
            d_filters[:, f] += d_pool[x, f] @ p["emb"][under].reshape(len(chunk), -1)
            np.add.at(d_emb, under.ravel(), (d_pool[x, f][:, None] * p["filters"][:, f]).reshape(-1, DIM))
    d_emb[0] = 0
    return grads | {"filters": d_filters, "emb": d_emb}


def _peaks(net: Network, chunk_bytes: np.ndarray):
    """(position of each filter's highest value, the value), both [chunks, FILTERS]."""
    flat = net.p["emb"][chunk_bytes]
    size = flat.strides
    windows = np.lib.stride_tricks.as_strided(flat, (len(flat), CHUNK, WIDTH * DIM), (size[0], size[1], size[2]))
    values = np.maximum(windows.reshape(-1, WIDTH * DIM) @ net.p["filters"] + net.p["shift"], 0).reshape(len(flat), CHUNK, FILTERS)
    peak = values.argmax(axis=1)
    return peak, np.take_along_axis(values, peak[:, None, :], axis=1)[:, 0, :]


def fit(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network | float:
    """A network from the chunks of each text; the share of label 1 if there is nothing to tell apart."""
    if len(set(labels)) < 2:
        return float(labels[0]) if labels else 0.5
    net, rng = Network(seed), np.random.default_rng(seed)
    target = np.array(labels, np.float32)
    chunks = [np.frombuffer(b"".join(t), np.uint8).reshape(len(t), -1) for t in texts]
    share = target.mean()
    net.p["bias"][0] = np.log(share / (1 - share))
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(chunks))
        for a in range(0, len(order), BATCH):
            own = order[a:a + BATCH]
            grads = _gradients(net, np.concatenate([chunks[i] for i in own]), np.array([len(chunks[i]) for i in own]), target[own])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network | float:
    """A network for ``labels`` (doc_id, label 0 or 1) over the texts of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).dropna().distinct()
    sample = (rows.groupBy("doc_id").agg(F.min("key").alias("key")).join(labelled, "doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("doc_id", "label")).limit(max_rows))
    found = rows.join(F.broadcast(sample), ["doc_id", "key"]).dropDuplicates(["doc_id", "label"]).select("key", "doc_id", "label", F.col("text").cast("binary")).collect()
    found = sorted((r["key"], r["doc_id"], r["label"], bytes(r["text"])) for r in found)
    return fit([text_chunks(x) for *_, x in found], [y for *_, y, _ in found])


def _score_map(shared, text: str):
    def run(batches):
        net = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            parts = [net.scores(data, offsets[a:b + 1]) for a, b in pieces(offsets, 1 << 20)]
            names = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(np.concatenate(parts) if parts else np.zeros(0))], names + ["score"])
    return run


def predict(docs: DataFrame, net: Network | float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, score, predicted) of each row from its text alone."""
    text = free_name("_text", keep)
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce("text", F.lit("")).alias(text))
    if isinstance(net, float):
        scored = rows.select(*keep, F.lit(net).alias("score"))
    else:
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
        scored = rows.mapInArrow(_score_map(docs.sparkSession.sparkContext.broadcast(net), text), f"{kept}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_held_out():
    return held_out("doc_id", 3, 1)
