"""Quality by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are read in chunks of 512 that overlap by 64 or more and cover it whole.  A byte is a learnt vector
and one mark more, which says that the eight bytes from here on repeat those at most ``ECHO`` places before.  Learnt
filters of eight bytes run over a chunk, and each gives its largest answer there (max-pooling); a document has the mean
and the largest of its chunks' answers, and a hidden layer combines them into one score, calibrated to a probability.

Learning: a bounded sample of labelled rows (``MAX_ROWS``, by hash of the id; rows of more than ``MAX_BYTES`` are not
learnt from) is collected; four fifths train the network by Adam, through the places of the maxima, and a fifth that it
has not seen calibrates it (Platt).  Scoring runs over all documents, whole, in Arrow batches without a shuffle.

Defined cases: null and empty texts are one chunk of nothing, and scored; rows without a label, or with a null id or
label, are not learnt from; without learnable rows of both labels every score is 1; repeated rows are scored each;
columns named ``score`` and ``predicted`` are replaced, others kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeline.llm.common import steps, texts_of
from takeline.llm.toxicity import labelled_sample

MAX_ROWS = 1500
MAX_BYTES = 100_000
THRESHOLD = 0.7
CHUNK, OVERLAP, WIDTH = 512, 64, 8
VECTOR, FILTERS, HIDDEN = 7, 24, 16
ECHO = 24
EPOCHS, ROWS_PER_STEP, RATE = 14, 32, 0.01
#: Chunks that one step works on, so that its windows stay in the cache.
CHUNKS_PER_STEP = 16


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts (bytes by row), the bytes that count in each, and the text of each."""
    starts, sizes, owners, begin = [], [], [], 0
    for k, text in enumerate(texts):
        n = len(text)
        own = [*range(0, n - CHUNK, CHUNK - OVERLAP), n - CHUNK] if n > CHUNK else [0]
        starts += [begin + s for s in own]
        sizes += [min(n, CHUNK)] * len(own)
        owners += [k] * len(own)
        begin += n
    buffer = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
    return sliding_window_view(buffer, CHUNK)[starts], np.array(sizes), np.array(owners)


def echoes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the eight bytes from a place on equal those some places before it."""
    out = np.zeros(rows.shape, bool)
    for lag in range(1, ECHO + 1):
        run = rows[:, lag:] == rows[:, :-lag]
        for step in (1, 2, 4):
            run = run[:, :-step] & run[:, step:]
        out[:, lag : lag + run.shape[1]] |= run
    return out & (np.arange(CHUNK) <= (sizes - WIDTH)[:, None])


@dataclass
class Network:
    """Byte vectors, filters, the hidden layer and the output; Platt's slope and shift."""

    vectors: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def windows(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Inputs under each filter place: chunk, place, byte in the window and channel in one row."""
        x = np.empty((*rows.shape, VECTOR + 1), np.float32)
        x[:, :, :VECTOR] = self.vectors[rows]
        x[:, :, VECTOR] = echoes(rows, sizes)
        if (short := np.flatnonzero(sizes < CHUNK)).size:
            x[short] *= (np.arange(CHUNK) < sizes[short, None])[:, :, None]
        flat = x.reshape(len(rows), -1)
        return np.ascontiguousarray(sliding_window_view(flat, WIDTH * (VECTOR + 1), axis=1)[:, :: VECTOR + 1])

    def pooled(self, rows: np.ndarray, sizes: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest answer in each chunk, and its place if asked for."""
        best, places = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64) if where else None
        for s in range(0, len(rows), CHUNKS_PER_STEP):
            part = slice(s, s + CHUNKS_PER_STEP)
            answers = self.windows(rows[part], sizes[part]) @ self.filters
            if (short := np.flatnonzero(sizes[part] < CHUNK)).size:
                beyond = np.arange(answers.shape[1]) > np.maximum(sizes[part][short] - WIDTH, 0)[:, None]
                answers[short] = np.where(beyond[:, :, None], -np.inf, answers[short])
            if places is not None:
                places[part] = answers.argmax(1)
            best[part] = answers.max(1)
        return best + self.filter_bias, places

    def combine(self, features: np.ndarray) -> np.ndarray:
        return np.maximum(features @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def raw(self, texts: list[bytes]) -> np.ndarray:
        rows, sizes, owners = chunks(texts)
        return self.combine(features(np.maximum(self.pooled(rows, sizes)[0], 0), owners, len(texts))[0]).astype(float)

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.slope * self.raw(texts) + self.shift, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 6)


def features(answers: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and maximum over each text's chunks, which lie together; the chunks of each, and which chunk had the maximum."""
    starts = np.searchsorted(owners, np.arange(n))
    count = np.diff(np.r_[starts, len(owners)])
    mean = np.add.reduceat(answers, starts, axis=0) / count[:, None]
    top = np.maximum.reduceat(answers, starts, axis=0)
    return np.concatenate([mean, top], axis=1).astype(np.float32), count, top


def new_network(seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, size: (size * rng.standard_normal(shape)).astype(np.float32)
    channels = WIDTH * (VECTOR + 1)
    return Network(draw(256, VECTOR, size=0.5), draw(channels, FILTERS, size=channels**-0.5), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, HIDDEN, size=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, size=HIDDEN**-0.5), np.zeros(1, np.float32))


PARAMETERS = [f.name for f in fields(Network)][:7]


def gradients(net: Network, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean log loss, by parameter."""
    rows, sizes, owners = chunks(texts)
    best, places = net.pooled(rows, sizes, where=True)
    answers = np.maximum(best, 0)
    x, count, top = features(answers, owners, len(texts))
    h = x @ net.hidden + net.hidden_bias
    a = np.maximum(h, 0)
    g = (weight * (1 / (1 + np.exp(-np.clip(a @ net.out + net.out_bias[0], -30, 30))) - y) / len(y)).astype(np.float32)
    dh = g[:, None] * net.out * (h > 0)
    dx = dh @ net.hidden.T
    # To the chunks: an equal part of the mean to each, the maximum's to those that reach it.
    reach = answers == top[owners]
    starts = np.searchsorted(owners, np.arange(len(texts)))
    ties = np.add.reduceat(reach.astype(np.float32), starts, axis=0)
    da = (dx[owners, :FILTERS] / count[owners, None] + reach * (dx[:, FILTERS:] / ties)[owners]) * (best > 0)
    # To the window under each maximum: its bytes, again with their vectors.
    at = places[:, :, None] + np.arange(WIDTH)
    found = rows[np.arange(len(rows))[:, None, None], np.minimum(at, CHUNK - 1)]
    inside = at < sizes[:, None, None]
    marks = echoes(rows, sizes)[np.arange(len(rows))[:, None, None], np.minimum(at, CHUNK - 1)]
    inputs = np.concatenate([net.vectors[found], marks[..., None]], axis=3) * inside[..., None]
    d_filters = np.einsum("ck,ckd->dk", da, inputs.reshape(len(rows), FILTERS, -1), optimize=True)
    back = da[:, :, None, None] * net.filters.T.reshape(FILTERS, WIDTH, VECTOR + 1)[None, :, :, :VECTOR] * inside[..., None]
    flat = found.ravel()
    d_vectors = np.stack([np.bincount(flat, back[..., v].ravel(), 256) for v in range(VECTOR)], axis=1)
    return [d_vectors, d_filters, da.sum(0), x.T @ dh, dh.sum(0), a.T @ g, g.sum().reshape(1)]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make ``z`` log odds of ``y``, by Newton's method on smoothed targets."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    design, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    prior = np.diag([1e-3, 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - target) + prior @ (w - [1, 0])
        curve = (design * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ design + prior
        w = w - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(w[0]), float(w[1])


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network | None:
    """None unless both labels occur on both sides of the calibration split."""
    apart = np.arange(len(y)) % 5 == 4
    if any(len(set(y[m].tolist())) < 2 for m in (apart, ~apart)):
        return None
    net, rng, train = new_network(seed), np.random.default_rng(seed), np.flatnonzero(~apart)
    share = y[train].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))  # both labels weigh the same
    moments = [(np.zeros_like(getattr(net, p)), np.zeros_like(getattr(net, p))) for p in PARAMETERS]
    step, total = 0, epochs * -(-len(train) // ROWS_PER_STEP)
    for _ in range(epochs):
        order = rng.permutation(train)
        for s in range(0, len(order), ROWS_PER_STEP):
            some = np.sort(order[s : s + ROWS_PER_STEP])
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for name, g, (m, v) in zip(PARAMETERS, gradients(net, [texts[i] for i in some], y[some], weight[some]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value = getattr(net, name)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    rest = np.flatnonzero(apart)
    net.slope, net.shift = platt(net.raw([texts[i] for i in rest]), y[rest].astype(float))
    return net


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Network | None:
    """Fit on labelled rows that are not held out."""
    sample = labelled_sample(documents, labels, "quality", max_rows, lambda i: ~held_out(i))
    sample = sample.withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary")).where(F.octet_length("text") <= max_bytes)
    rows = sorted((xxhash.xxh3_64_intdigest(str(r["doc_id"])), bytes(r["text"]), r["y"]) for r in sample.collect() if r["y"] in (0, 1))
    return fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))


def score(documents: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to the table, in place of columns of that name."""
    documents = documents.drop("score", "predicted")
    schema = documents.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t or b"" for t in texts_of(batch)]
            p = np.ones(len(texts)) if network is None else network.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, schema)
