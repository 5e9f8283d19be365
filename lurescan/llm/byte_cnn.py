"""Operator 8: quality classifier, a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole text, and rectified
responses are max-pooled over chunks of ``CHUNK`` bytes that overlap by half.
The chunks' pooled responses are combined to one vector a document (their mean
and their maximum), and a logistic unit gives the probability of label 1.

Training (Adam on log loss, numpy on the driver) takes at most
``max_train`` labelled documents, half of them of either label as far as there
are so many, chosen by a hash of the id, and of each at most ``train_bytes``
bytes, as randomly placed chunks.  This bounded sample fits the weights;
scoring reads every byte of every text in numpy tasks, with the weights (some
kilobytes) in the tasks' closure.

Only rows whose crc32 of the id as text is not 1 modulo 3 are learned from, and
only the text is an input.

Cases
-----
* null or empty text, or fewer bytes than a filter: no response, so the score is
  that of the bias; still between 0 and 1.
* null ids: scored; held_out is false (they carry no label).
* several labels for one id, null labels: the smallest label counts; null is no label.
* no labels, or only one kind: the constant share of label 1 (0.5 without any).
* a score of exactly 0.5 is predicted 1.
* empty table: an empty result; extra columns are ignored.
* very long texts: convolved in blocks, so memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm import common

EMBED, WIDTH, FILTERS = 4, 6, 24
CHUNK, HALF = 512, 256
BLOCK = 1 << 16
MAX_TRAIN, TRAIN_BYTES, EPOCHS, BATCH, RATE = 3000, 6144, 14, 64, 0.01


class Weights:
    """The network's numbers."""

    NAMES = ("embed", "filters", "bias", "out", "out_bias")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (EMBED * WIDTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.out_bias = np.zeros(1, np.float32)


def windows(w: Weights, data: np.ndarray) -> np.ndarray:
    """(n - WIDTH + 1, EMBED * WIDTH) embedded windows."""
    flat = w.embed[data].ravel()
    n = len(data) - WIDTH + 1
    view = np.lib.stride_tricks.as_strided(flat, (n, EMBED * WIDTH), (4 * EMBED, 4))
    return np.ascontiguousarray(view)


def half_maxima(w: Weights, data: np.ndarray) -> np.ndarray:
    """Largest response of each filter in every run of HALF window places; (0, FILTERS) for short texts."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros((0, FILTERS), np.float32)
    out = []
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        got = windows(w, data[a:b + WIDTH - 1]) @ w.filters
        out.append(np.maximum.reduceat(got, np.arange(0, b - a, HALF), axis=0))
    return np.maximum(np.concatenate(out) + w.bias, 0)


def chunk_maxima(half: np.ndarray) -> np.ndarray:
    """Overlapping chunks are two neighbouring halves."""
    return np.maximum(half[:-1], half[1:]) if len(half) > 1 else half


def pooled(w: Weights, data: np.ndarray) -> np.ndarray:
    chunks = chunk_maxima(half_maxima(w, data))
    if not len(chunks):
        return np.zeros(2 * FILTERS, np.float32)
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def probability(w: Weights, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ w.out + w.out_bias[0], -30, 30).astype(np.float64)))


def score_slice(w: Weights, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Probabilities of every text of a slice.

    Texts are convolved together.  Each begins at a multiple of HALF and all
    its bytes fit before the next one, so no window reads another text's bytes;
    places behind a text's last window are left out.
    """
    n = len(offsets) - 1
    length = np.diff(offsets)
    places = np.maximum(length - WIDTH + 1, 0)
    room = -(-length // HALF)  # halves that hold the bytes; the last may have no place
    begin = np.cumsum(room) - room
    features = np.zeros((n, 2 * FILTERS), np.float32)
    total = int(room.sum())
    if places.any():
        grid = np.zeros(total * HALF + WIDTH, np.uint8)
        row = np.repeat(np.arange(n), length)
        grid[np.arange(len(data)) - offsets[row] + begin[row] * HALF] = data
        owner = np.repeat(np.arange(n), room)
        inside = np.minimum(HALF, places[owner] - (np.arange(total) - begin[owner]) * HALF)
        maxima = np.empty((total, FILTERS), np.float32)
        step = BLOCK // HALF
        for a in range(0, total, step):
            b = min(a + step, total)
            got = (windows(w, grid[a * HALF:b * HALF + WIDTH - 1]) @ w.filters).reshape(b - a, HALF, FILTERS)
            for i in np.flatnonzero(inside[a:b] < HALF):
                got[i, max(inside[a + i], 0):] = -np.inf
            maxima[a:b] = got.max(axis=1)
        real = inside > 0
        maxima, owner = maxima[real], owner[real]
        halves = np.bincount(owner, minlength=n)
        begin = np.cumsum(halves) - halves
        maxima = np.maximum(maxima + w.bias, 0)
        # chunks: a half and the next one of the same text; a text of one half has that one chunk
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        chunk = np.maximum(maxima[pair], maxima[pair + 1])
        of = owner[pair]
        single = np.flatnonzero(halves == 1)
        chunk, of = np.concatenate([chunk, maxima[begin[single]]]), np.concatenate([of, single])
        order = np.argsort(of, kind="stable")
        chunk, of = chunk[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        count = np.diff(np.append(first, len(of)))
        features[of[first], :FILTERS] = np.add.reduceat(chunk, first, axis=0) / count[:, None]
        features[of[first], FILTERS:] = np.maximum.reduceat(chunk, first, axis=0)
    return probability(w, features)


def sample_bytes(text: bytes, limit: int, rng) -> np.ndarray:
    """The text, or randomly placed chunks of it one after another."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= limit:
        return data
    at = np.sort(rng.integers(0, len(data) - CHUNK, limit // CHUNK))
    return np.concatenate([data[a:a + CHUNK] for a in at])


def backward(w: Weights, data: np.ndarray, error_out: np.ndarray, grads: dict) -> None:
    """Add one document's gradient; ``error_out`` is d loss / d features."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return
    win = windows(w, data)
    got = win @ w.filters
    starts = np.arange(0, n, HALF)
    pad = np.full((len(starts) * HALF, FILTERS), -np.inf, np.float32)
    pad[:n] = got
    place = pad.reshape(len(starts), HALF, FILTERS).argmax(axis=1) + starts[:, None]
    half = np.maximum(np.take_along_axis(got, place, 0) + w.bias, 0)
    if len(half) > 1:
        right = half[1:] > half[:-1]
        chunk = np.where(right, half[1:], half[:-1])
        source = np.arange(len(half) - 1)[:, None] + right
    else:
        chunk, source = half, np.zeros((1, FILTERS), np.int64)
    d_chunk = np.repeat(error_out[None, :FILTERS] / len(chunk), len(chunk), axis=0)
    d_chunk[chunk.argmax(axis=0), np.arange(FILTERS)] += error_out[FILTERS:]
    d_half = np.zeros_like(half)
    np.add.at(d_half, (source, np.arange(FILTERS)[None, :]), d_chunk)
    d_half[half <= 0] = 0
    grads["bias"] += d_half.sum(axis=0)
    rows, cols = np.nonzero(d_half)
    value, at = d_half[rows, cols], place[rows, cols]
    np.add.at(grads["filters"].T, cols, value[:, None] * win[at])
    d_win = (value[:, None] * w.filters.T[cols]).reshape(len(rows), WIDTH, EMBED)
    np.add.at(grads["embed"], data[at[:, None] + np.arange(WIDTH)], d_win)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS,
          train_bytes: int = TRAIN_BYTES) -> Weights:
    """Fit the network; the labels weigh alike in sum."""
    w, rng = Weights(seed), np.random.default_rng(seed)
    ones = float(labels.sum())
    if not len(labels) or ones in (0, len(labels)):
        share = 0.5 if not len(labels) else min(max(ones / len(labels), 0.01), 0.99)
        w.out_bias[0] = np.log(share / (1 - share))
        return w
    weight = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * (len(labels) - ones)))
    moment = {k: (np.zeros_like(getattr(w, k)), np.zeros_like(getattr(w, k))) for k in Weights.NAMES}
    t = 0
    w.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            batch = order[a:a + BATCH]
            grads = {k: np.zeros_like(getattr(w, k)) for k in Weights.NAMES}
            for i in batch.tolist():
                data = sample_bytes(texts[i], train_bytes, rng)
                f = pooled(w, data)
                error = np.float32((probability(w, f) - labels[i]) * weight[i] / len(batch))
                grads["out"] += error * f
                grads["out_bias"] += error
                backward(w, data, error * w.out, grads)
            t += 1
            for k in Weights.NAMES:
                m, v = moment[k]
                g = grads[k] + 1e-4 * getattr(w, k) * (k in ("filters", "out"))
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                getattr(w, k)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_train: int = MAX_TRAIN) -> Weights:
    """Weights from a bounded sample of labelled rows that are not held out."""
    own = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1) & ~held_out(id_col)).groupBy(
        F.col(f"`{id_col}`").alias("key")).agg(F.min(F.col(f"`{label_col}`")).cast("int").alias("label"))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = None
    for label in (0, 1):
        part = own.where(F.col("label") == label).orderBy(*order).limit(max_train // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = common.materialise(chosen, "op8-sample")  # at most max_train ids
    texts = docs.select(F.col(f"`{id_col}`").alias("key"), common.text_of(F.col(f"`{text_col}`")).alias("text"))
    got = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = sorted(got.collect(), key=lambda r: r["key"])  # the bounded sample
    return train([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.int64))


def scores(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), common.text_of(F.col(f"`{text_col}`")).alias("text"))

    def kernel(ids, offsets, data):
        return pa.RecordBatch.from_arrays([ids, pa.array(score_slice(weights, offsets, data))], ["id", "score"])

    out = common.map_texts(rows, kernel, f"id {key}, score double").withColumnRenamed("id", id_col)
    return out.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")}).select(
        id_col, "held_out", "score", "predicted")


def query(spark, sf_dir) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return scores(docs, fit(docs, common.documents(spark, sf_dir, "labels").select("doc_id", "quality")))
