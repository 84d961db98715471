"""Helpers that the training-data operators share.

Words are runs of bytes other than space and ``\\t\\n\\v\\f\\r``: exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Upper-case ASCII to lower case; other characters stay.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Entries a per-task memo may hold; it bounds memory and never changes results.
MEMO_ENTRIES = 600_000
#: Bytes of text that one vectorised step works on (a longer document is a step of its own).
STEP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder, and a cluster, whose machines share none, an error.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="takeline-"))
        known = sc.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_table(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table in the shared folder; ``remove_scratch`` removes those of this application."""
    return f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Remove a written table, or all of this application's, once no result is read from them any more."""
    path = path or _scratch(spark)
    if not path.startswith(_scratch(spark)):
        raise ValueError(f"{path} is no scratch table of this application")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo(dict):
    """``memo[key]`` computes a missing value (never None) once; ``trim`` keeps the number of entries bounded.

    Half of the bound is for keys of late.  When it is full they become the older half, from which a key comes back
    when it is asked for again, so that frequent keys stay and rare ones go.
    """

    def __init__(self, compute: Callable) -> None:
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES // 2:
            self.older = dict(self)
            self.clear()


class WordHashes:
    """64-bit hashes of words, remembered per task: most words of a text have been seen before."""

    def __init__(self, of: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> None:
        self.memo = Memo(of)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        self.memo.trim()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes, by position of the first word (shorter input: none)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * m + h[k : k + n]
    return scramble(out, seed)


def scramble(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads all bits."""
    x = x + np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def steps(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``STEP_BYTES`` of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(column.cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False), dtype=object)
        done = np.cumsum(np.fromiter(map(len, sizes), np.int64, len(sizes)))
        start = 0
        while start < batch.num_rows:
            base = done[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(done, base + STEP_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()

