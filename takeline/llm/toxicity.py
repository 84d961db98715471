"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words (lower case, marks at the ends removed) and their beginnings of 3 to 6 letters,
hashed.  A second-order factorization machine scores ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``, so a pair of terms (an
insult and the group it is aimed at) can weigh more than both do alone.

Learning: a bounded sample of labelled rows (``max_rows``, by hash of the id) is turned into terms by the executors
and collected; the terms whose presence says most about the label are kept (``MAX_TERMS``, ``MIN_GAIN``), and both terms
of the pairs that say most more than either alone (``MAX_PAIRS``, ``MIN_PAIR_GAIN``), so a pair is learnt too whose terms
are each even between the labels; the machine is
fitted by full-batch Adam with L2, and its bias set so that the sample's labels part best at the threshold.  Scoring
runs over all documents in Arrow batches without a shuffle.

Defined cases: null and empty texts have no terms and score as the bias does; rows without a label, or with a null id
or label, are not learnt from; without learnable rows of both labels every score is 0; repeated rows are scored each;
other columns are ignored; an empty table gives no rows.

Pairs are screened among the ``PAIR_TERMS`` commonest terms of the sample.  These bounds limit the model, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeline.llm.common import Memo, steps, texts_of

MAX_ROWS = 8000
MAX_TERMS = 600
BUCKETS = 1 << 20
FACTORS = 4
#: Ones with a single weak term are rare in a sample and lie low, so the cut stands nearer to the zeros.
CUT = 0.25
#: Log-likelihood (nats) that a term's presence must add about the label; chance adds this to one term in a thousand.
MIN_GAIN = 5.4
#: The same of a pair beyond its better term; chance adds this to about one of the screened pairs in a thousand samples.
MIN_PAIR_GAIN = 21.0
#: Terms whose pairs are screened, rows of the sample that a pair must have, pairs kept.
PAIR_TERMS, PAIR_ROWS, MAX_PAIRS = 2000, 5, 100
#: Terms that one step pairs with all others; it bounds memory.
PAIR_BLOCK = 100
THRESHOLD = 0.7
_MARKS = "\"'`.,;:!?()[]{}<>*#$%&|_-~"


def word_terms(word: bytes) -> tuple[int, ...]:
    """Hashed terms of one word."""
    low = word.decode().lower().strip(_MARKS)
    if not low:
        return ()
    names = ["w" + low, *("p" + low[:n] for n in range(3, 7) if len(low) > n)]
    return tuple(xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS for x in names)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """A fitted factorization machine: column of each term, weights and factors."""

    columns: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: list[list[int]]) -> np.ndarray:
        """Probabilities of texts given the columns of their terms."""
        out = np.full(len(found), self.bias)
        for i, columns in enumerate(found):
            if columns:
                v = self.factors[columns]
                total = v.sum(0)
                out[i] += self.weights[columns].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def label_gain(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood that presence adds about the label, of ``a`` of ``n1`` ones and ``b`` of ``n0`` zeros."""
    share = (a + b) / (n1 + n0)
    x = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0)
    return x(a, n1 * share) + x(b, n0 * share) + x(n1 - a, n1 * (1 - share)) + x(n0 - b, n0 * (1 - share))


def choose_terms(rows: list[tuple[np.ndarray, int]], max_terms: int) -> list[int]:
    """Terms by the log-likelihood ratio with the label, then those of pairs; three rows must have a term."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    c = np.zeros((2, BUCKETS))
    for terms, y in rows:
        c[y, terms] += 1
    both = c.sum(0)
    have = np.flatnonzero(both >= 3)
    gain = label_gain(c[1, have], c[0, have], n1, n0)
    order = np.argsort(-gain, kind="stable")[:max_terms]
    chosen = have[order[gain[order] >= MIN_GAIN]].tolist()
    return list(dict.fromkeys(chosen + paired_terms(rows, have, gain, both, n1, n0)))


def paired_terms(rows: list[tuple[np.ndarray, int]], have: np.ndarray, gain: np.ndarray, both: np.ndarray, n1: int, n0: int) -> list[int]:
    """Terms of the pairs whose presence together says most about the label beyond what the better one says alone."""
    some = np.argsort(-both[have], kind="stable")[:PAIR_TERMS]
    some = some[both[have[some]] < 0.9 * len(rows)]
    column = np.full(BUCKETS, -1, np.int32)
    column[have[some]] = np.arange(len(some))
    by_label = [np.zeros((n, len(some)), np.float32) for n in (n0, n1)]
    at = [0, 0]
    for terms, y in rows:
        found = column[terms]
        by_label[y][at[y], found[found >= 0]] = 1
        at[y] += 1
    best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(some), PAIR_BLOCK):  # terms by terms, a stripe at a time
        zeros, ones = (x[:, start : start + PAIR_BLOCK].T @ x for x in by_label)  # rows of each label with both terms
        left, right = np.nonzero(zeros + ones >= PAIR_ROWS)
        later = right > left + start
        left, right = left[later], right[later]
        more = label_gain(ones[left, right].astype(float), zeros[left, right].astype(float), n1, n0) - np.maximum(gain[some[left + start]], gain[some[right]])
        good = np.flatnonzero(more >= MIN_PAIR_GAIN)
        best.append((more[good], left[good] + start, right[good]))
    more, left, right = (np.concatenate(c) for c in zip(*best, strict=True))
    order = np.argsort(-more, kind="stable")[:MAX_PAIRS]
    return [int(have[some[k]]) for i in order.tolist() for k in (left[i], right[i])]


def fit_machine(rows: list[tuple[np.ndarray, int]], max_terms: int = MAX_TERMS, factors: int = FACTORS, epochs: int = 400, l2: float = 2e-5, l2_factors: float = 8e-3) -> Machine | None:
    """``rows``: term ids and label; None unless both labels occur."""
    if len({y for _, y in rows}) < 2:
        return None
    terms = choose_terms(rows, max_terms)
    columns = {t: k for k, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, (found, _) in enumerate(rows):
        x[i, [columns[t] for t in found.tolist() if t in columns]] = 1
    y = np.array([y for _, y in rows], np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)  # both labels weigh the same
    rng = np.random.default_rng(7)
    params = [np.zeros(1, np.float32), np.zeros(len(terms), np.float32), (0.01 * rng.standard_normal((len(terms), factors))).astype(np.float32)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        b, w, v = params
        xv = x @ v
        z = b + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gx = g @ x
        grads = [g.sum().reshape(1), gx + l2 * w, x.T @ (g[:, None] * xv) - gx[:, None] * v + l2_factors * v]
        for p, d, m, s in zip(params, grads, mean, square, strict=True):
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    b, w, v = params
    xv = x @ v
    z = (b + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))).astype(float)
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(z, y)
    return Machine(columns, float(b[0] + shift), w.astype(float), v.astype(float))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where the sample's labels part best (share of ones above less share of zeros above), a part ``CUT`` of the way between its rows."""
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    ones, zeros = ys.sum(), (1 - ys).sum()
    gain = (np.cumsum(1 - ys) / zeros - np.cumsum(ys) / ones)[:-1]  # of a cut behind each row but the last
    gain[zs[1:] == zs[:-1]] = -2
    k = int(gain.argmax())
    return float(zs[k] + CUT * (zs[k + 1] - zs[k]))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, keep=None) -> DataFrame:
    """``doc_id, text, y`` of at most ``max_rows`` labelled rows, chosen by a hash of the id.

    An id with several labels or texts counts once, with the least of each, so rows that repeat an id don't add up.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if keep is None else rows.where(keep(F.col("doc_id")))
    labelled = rows.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine | None:
    """Fit on labelled rows that are not held out."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_terms)
        for batch in steps(batches):
            memo.trim()
            rows = [np.unique(np.array([t for w in set((x or b"").split()) for t in memo[w]], np.int32)) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["y", "terms"])

    sample = labelled_sample(documents, labels, "toxic", max_rows, lambda i: ~held_out(i))
    rows = sorted((r["y"], bytes(r["terms"])) for r in sample.mapInArrow(terms, "y int, terms binary").collect())
    return fit_machine([(np.frombuffer(t, np.int32), y) for y, t in rows if y in (0, 1)])


def score(documents: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to the table, in place of columns of that name."""
    documents = documents.drop("score", "predicted")
    schema = documents.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    sent = machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {} if sent is None else sent.columns
        memo = Memo(lambda w: tuple(known[t] for t in word_terms(w) if t in known))
        for batch in steps(batches):
            memo.trim()
            found = [sorted({c for w in set((x or b"").split()) for c in memo[w]}) for x in texts_of(batch)]
            p = np.zeros(len(found)) if sent is None else sent.score(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return documents.mapInArrow(run, schema)
