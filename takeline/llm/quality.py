"""Quality rules: fixed text statistics, and a calibrated logistic regression over hashed word and character n-grams.

The model sees mean counts of hashed words, word pairs and character 1- to 4-grams of words (case kept).  It is fitted on
a bounded sample of labelled rows (``max_rows``, by hash of the id), its scores are calibrated on a fifth of the sample
that it has not seen (Platt), and a fixed threshold decides.  A word's part of the score depends on the word alone, so
scoring remembers it and is a sum over words.

Defined cases: null and empty texts have no words and fail the base rules; without labelled rows of both kinds the
verdict is to keep; rows without a label are not learnt from; repeated rows are judged each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from takeline.llm.common import MEMO_ENTRIES, WordHashes, rolling, scramble, steps, texts_of
from takeline.llm.toxicity import labelled_sample

MAX_ROWS = 3000
BUCKETS = 1 << 13
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Factor on mean counts, so that weights of usual size matter.
SCALE = 20.0


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of distinct words and of their character 1- to 4-grams (marked at both ends), and the number of their word."""
    texts = [f"^{w.decode()}$" for w in words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    whole = scramble(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), 30)
    buckets, owners = [whole % np.uint64(BUCKETS)], [np.arange(len(words))]
    for n in range(1, 5):
        inside = left >= n
        grams = rolling(chars, n, 30 + n)
        inside = inside[: len(grams)]
        buckets.append(grams[inside] % np.uint64(BUCKETS))
        owners.append(of[: len(grams)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def pair_buckets(h: np.ndarray) -> np.ndarray:
    return (scramble(rolling(h, 2), 21) % np.uint64(BUCKETS)).astype(np.int64)


def base_stats(text: bytes | None, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or b""
    chars = len(text.translate(None, SPACES).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) > 3:
        triple = rolling(hashes, 3)
        if len(set(triple.tolist())) < len(triple):
            _, inverse, count = np.unique(triple, return_inverse=True, return_counts=True)
            twice, covered = count[inverse] > 1, np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass(frozen=True)
class Model:
    """Weights by bucket, bias, and Platt's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.shift, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 120, l2: float = 1e-4) -> Model | None:
    """``rows``: buckets, mean counts, label; None unless both labels occur on both sides of the calibration split."""
    apart = np.arange(len(rows)) % 5 == 4
    y = np.array([r[2] for r in rows], np.float32)
    if any(len(set(y[m].tolist())) < 2 for m in (apart, ~apart)):
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (buckets, values, _) in enumerate(rows):
        x[i, buckets] = SCALE * values
    xt, yt = x[~apart], y[~apart]
    w, b = np.zeros(BUCKETS, np.float32), np.float32(0)
    mw, sw, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(yt == 1, 0.5 / yt.mean(), 0.5 / (1 - yt.mean())).astype(np.float32)
    for t in range(1, epochs + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(xt @ w + b, -30, 30))) - yt) / len(yt)
        gw, gb = g @ xt + l2 * w, float(g.sum())
        mw += 0.1 * (gw - mw)
        sw += 0.01 * (gw * gw - sw)
        mb += 0.1 * (gb - mb)
        sb += 0.01 * (gb * gb - sb)
        w -= 0.05 * (mw / (1 - 0.9**t)) / (np.sqrt(sw / (1 - 0.99**t)) + 1e-8)
        b -= np.float32(0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8))
    z, yc = (x[apart] @ w + b).astype(float), y[apart].astype(float)
    n1, n0 = yc.sum(), (1 - yc).sum()
    target = np.where(yc == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * z).sum() + 1e-3 * (slope - 1), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -2, 2))
    return Model(SCALE * w.astype(float), float(b), slope, shift)


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in steps(batches):
            out = []
            for text in texts_of(batch):
                words = (text or b"").split()
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                times = np.bincount([number[w] for w in words], minlength=len(number)) if words else np.zeros(0, np.int64)
                grams, owner = word_grams(list(number))
                count = np.bincount(grams, times[owner], BUCKETS) + np.bincount(pair_buckets(hashes(words)), minlength=BUCKETS)
                buckets = np.flatnonzero(count)
                count = count[buckets]
                out.append((buckets.astype("<u2").tobytes(), (count / max(len(words), 1)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([b for b, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary())], names=["doc_id", "y", "buckets", "means"])

    sample = labelled_sample(documents, labels, "quality", max_rows)
    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(grams, f"doc_id {kind}, y int, buckets binary, means binary").collect()
    ordered = sorted((xxhash.xxh3_64_intdigest(str(r["doc_id"])), bytes(r["buckets"]), bytes(r["means"]), r["y"]) for r in rows if r["y"] in (0, 1))
    return fit([(np.frombuffer(b, "<u2"), np.frombuffer(v, "<f4"), y) for _, b, v, y in ordered])


def judge(documents: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``quality`` (probability of label 1) and ``kept``."""
    kind = dict(documents.dtypes)["doc_id"]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        weights = None if model is None else model.weights
        known: dict[bytes, float] = {}  # a word's part of the score
        for batch in steps(batches):
            if len(known) > MEMO_ENTRIES:
                known.clear()
            texts = texts_of(batch)
            split = [(t or b"").split() for t in texts]
            if weights is not None and (new := list(set().union(*split).difference(known))):
                grams, owner = word_grams(new)
                known.update(zip(new, np.bincount(owner, weights[grams], len(new)).tolist(), strict=True))
            stats, raw = [], []
            for text, words in zip(texts, split, strict=True):
                h = hashes(words)
                stats.append(base_stats(text, words, h))
                raw.append(0.0 if weights is None else (sum(map(known.__getitem__, words)) + weights[pair_buckets(h)].sum()) / max(len(words), 1))
            s = np.array(stats, np.int64).reshape(-1, 5)
            failed = (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PERCENT * s[:, 0])
            p = np.ones(len(raw)) if model is None else model.probability(np.array(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean")
