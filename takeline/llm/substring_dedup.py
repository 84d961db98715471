"""Substring dedup by fixed-block anchors.

A run of ``window`` words that occurs twice holds, at its first place, a whole block of ``window // 2 + 1`` words that
starts at a multiple of that size in its document.  So:

1. *Anchors.* Documents are dealt to chunks.  Each chunk hashes its non-overlapping reference blocks and every rolling
   window of a block's size, keeps each hash once (with marks "is a reference block" and "more than once here"), and
   sends them, packed, to the hash's bucket.  A bucket finds the hashes that are a reference block somewhere and occur
   twice, and tells each chunk which of its hashes those are.  A passage that a third of all documents share costs one
   entry a chunk, not one a document.
2. *Extension.* Each chunk looks at the windows of ``window`` words that hold an anchor hit, hashes them with 96 bits,
   and buckets find those that occur twice, again with one entry a chunk.  Neighbouring repeated windows are the
   maximal exact repeats.
3. *Removal.* Each chunk drops the words that repeated windows cover.

Chunks are groups of a bounded size in one shuffled copy of the texts, which all three steps share.  A row goes to a
chunk by the hash of all its columns; rows that are equal in all of them more than ``COPIES`` times are dealt to several.
Every row of an exchange packs all hashes that a chunk has for a bucket, so there are never more rows than distinct
hashes of each chunk, and at ordinary sizes some thousand times fewer.

Defined cases: null and empty texts have no words and the hash of the empty string; documents under ``window`` words
keep all; repeated rows count as places of their own, so equal rows lose all repeated words alike; null ``doc_id``
passes through; other columns are ignored (``remove_repeats`` carries those it is told to, and raises if one is named like
a result).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from takeline.llm.common import WordHashes, cut, rolling

WINDOW = 35
#: Characters of text in a chunk, about.
CHUNK_CHARS = 6_000_000
#: Chunks that one task works on, one after another, where the session's shuffle partitions would leave more.
CHUNKS_A_TASK = 8
#: Characters of text whose hashes make one bucket, about: some million entries at most.
BUCKET_CHARS = 24_000_000
#: Equal rows that go to one chunk, at most; and texts that do so more often, whose table is broadcast, at most.
COPIES, SEND_COPIED = 64, 100_000

_ANCHOR, _MANY = np.uint64(1), np.uint64(2)


class _Chunk:
    """Word hashes of a chunk's documents, end to end."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes) -> None:
        self.words = [(t or b"").split() for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.cumsum(self.sizes) - self.sizes
        parts = [hashes(w) for w in self.words]
        self.hash = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def windows(self, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes, and whether each starts a window inside one document."""
        h = rolling(self.hash, width, seed)
        left = np.repeat(self.first + self.sizes, self.sizes)[: len(h)] - np.arange(len(h))
        return h, left >= width

    def position(self, n: int) -> np.ndarray:
        """Place of each of the first ``n`` words in its document."""
        return np.arange(n) - np.repeat(self.first, self.sizes)[:n]


def _once(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys; marks joined, with ``_MANY`` where a key occurs twice."""
    order = np.argsort(keys, kind="stable")
    keys, marks = keys[order], marks[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, marks
    count = np.diff(np.r_[first, len(keys)])
    return keys[first], np.bitwise_or.reduceat(marks, first) | np.where(count > 1, _MANY, np.uint64(0))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _packed(owner: str, buckets: np.ndarray, name: str, value: int, body: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows of ``_SENT``: slice ``at[k]`` to ``at[k + 1]`` of the body for the ``k``-th number of column ``owner``; empty slices go."""
    full = at[1:] > at[:-1]
    offsets = np.r_[at[:-1][full], at[-1:]] * body.itemsize  # full slices touch each other
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(full.sum()), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body.tobytes())])
    columns = {owner: pa.array(buckets[full]), name: pa.array(np.full(int(full.sum()), value)), "body": packed.cast(pa.binary())}
    return pa.table({f.name: columns[f.name].cast(f.type) for f in _SENT}, schema=_SENT)


def _send(chunk: int, keys: np.ndarray, body: np.ndarray, buckets: int) -> pa.Table:
    """Rows ``bucket, chunk, body`` of sorted keys."""
    bucket = _bucket_of(keys, buckets).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return _packed("bucket", bucket[first], "chunk", chunk, body, np.r_[first, len(body)])


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
_SENT_SQL = "bucket int, chunk long, body binary"


def _short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """30 bits of a key within its bucket; equal keys stay equal, and others meet now and then, which step 2 rights."""
    spread = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B1) + (keys >> np.uint64(32)) * np.uint64(buckets)
    return (spread & np.uint64(0xFFFFFFFF)) >> np.uint64(2)


def _anchors(width: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        chunk = _Chunk(group.column("text").cast(pa.large_binary()).to_pylist(), WordHashes())
        h, inside = chunk.windows(width)
        marks = np.where(chunk.position(len(h)) % width == 0, _ANCHOR, np.uint64(0))
        keys, marks = _once(h[inside], marks[inside])
        body = (_short(keys, buckets) << np.uint64(2) | marks).astype("<u4")
        return _send(group.column("chunk")[0].as_py(), keys, body, buckets)

    return run


def _hits(kind: str):
    """In a bucket: keys that occur twice, told to each chunk that has them."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, "<u4" if kind == "anchors" else _WIDE) for b in group.column("body").to_pylist()]
        entry = np.concatenate(parts)
        if kind == "anchors":
            key, marks = entry >> 2, entry.astype(np.uint64) & np.uint64(3)
            order = np.argsort(key, kind="stable")
            new = key[order][1:] != key[order][:-1]
        else:
            key, more, marks = entry["key"], entry["more"], entry["many"].astype(np.uint64) * _MANY
            order = np.lexsort((more, key))
            new = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
        first = np.flatnonzero(np.r_[True, new])
        count = np.diff(np.r_[first, len(entry)])
        joined = np.bitwise_or.reduceat(marks[order], first)
        good = (count > 1) | (joined & _MANY > 0)
        if kind == "anchors":
            good &= joined & _ANCHOR > 0
        hit = np.zeros(len(entry), bool)
        hit[order] = np.repeat(good, count)
        ends = np.cumsum(np.array([len(p) for p in parts]))
        mine = entry[hit]
        told = np.r_[0, np.cumsum(hit)[ends - 1]]  # each chunk's hits are neighbours
        return _packed("chunk", group.column("chunk").to_numpy(), "bucket", group.column("bucket")[0].as_py(), mine >> 2 if kind == "anchors" else mine, told)

    return run


_WIDE = np.dtype([("key", "<u8"), ("more", "<u4"), ("many", "u1")])


def _member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def _candidates(width: int, window: int, buckets: int):
    """Windows that hold an anchor hit of their document: 96-bit hashes to the buckets."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not hits.num_rows or not docs.num_rows:
            return _SENT.empty_table()
        chunk = _Chunk(docs.column("text").cast(pa.large_binary()).to_pylist(), WordHashes())
        h, inside = chunk.windows(width)
        told = [np.uint64(b << 30) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in zip(hits.column("bucket").to_pylist(), hits.column("body").to_pylist(), strict=True)]
        hit = inside & _member(_bucket_of(h, buckets) << np.uint64(30) | _short(h, buckets), np.sort(np.concatenate(told)))
        wide, whole = chunk.windows(window, 1)
        more = rolling(chunk.hash, window, 2)
        seen = np.r_[0, np.cumsum(hit)]
        at = np.arange(len(wide))
        held = whole & (seen[np.minimum(at + window - width + 1, len(hit))] > seen[at])
        wide, more = wide[held], more[held] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((more, wide))
        wide, more = wide[order], more[order]
        if not len(wide):
            return _SENT.empty_table()
        first = np.flatnonzero(np.r_[True, (wide[1:] != wide[:-1]) | (more[1:] != more[:-1])])
        body = np.zeros(len(first), _WIDE)
        body["key"], body["more"], body["many"] = wide[first], more[first], np.diff(np.r_[first, len(wide)]) > 1
        return _send(docs.column("chunk")[0].as_py(), wide[first], body, buckets)

    return run


def _removed(window: int, schema: pa.Schema):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        chunk = _Chunk(docs.column("text").cast(pa.large_binary()).to_pylist(), WordHashes())
        gone = np.zeros(len(chunk.hash), bool)
        if hits.num_rows:
            h, inside = chunk.windows(window, 1)
            more = rolling(chunk.hash, window, 2) & np.uint64(0xFFFFFFFF)
            told = np.concatenate([np.frombuffer(x, _WIDE) for x in hits.column("body").to_pylist()])
            told = told[np.argsort(told["key"], kind="stable")]
            found = np.minimum(np.searchsorted(told["key"], h), len(told) - 1)
            starts = inside & (told["key"][found] == h) & (told["more"][found] == more)
            edge = np.zeros(len(gone) + 1, np.int64)
            edge[: len(h)] += starts
            edge[window : window + len(h)] -= starts
            gone = np.cumsum(edge)[: len(gone)] > 0
        total = np.r_[0, np.cumsum(gone)]
        n_removed = total[chunk.first + chunk.sizes] - total[chunk.first]
        kept = []
        for words, a, n in zip(chunk.words, chunk.first.tolist(), n_removed.tolist(), strict=True):
            kept.append(b" ".join(words if not n else [w for w, x in zip(words, gone[a : a + len(words)].tolist(), strict=True) if not x]).decode())
        own = {"n_words": pa.array(chunk.sizes), "n_removed": pa.array(n_removed), "kept_text": pa.array(kept, pa.string()), "text": docs.column("text").combine_chunks()}
        carried = docs.column("carried").combine_chunks()
        columns = [own[f.name] if f.name in own else carried.field(f.name) for f in schema]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema.remove_metadata())

    return run


def _dealt(documents: DataFrame, carry: list[str], chunk_chars: int) -> tuple[DataFrame, int]:
    """``chunk, carried, text``, partitioned by chunk, and the characters of all texts."""
    hashed = [c for c, kind in documents.select(*carry, "text").dtypes if "map<" not in kind and "variant" not in kind]
    docs = documents.select(F.struct(*([c for c in carry if c != "text"] or [F.lit(0).alias("_")])).alias("carried"), "text", F.xxhash64(*dict.fromkeys(hashed)).alias("row_hash"))
    counts = cut(docs.groupBy("row_hash").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
    sums = counts.agg(F.sum("chars").alias("chars"), F.count_if(F.col("n") > COPIES).alias("copied")).first()
    chars = sums["chars"] or 0
    spread = F.lit(0)
    if sums["copied"]:
        copied = counts.where(F.col("n") > COPIES).select("row_hash", F.ceil(F.col("n") / COPIES).alias("parts"))
        docs = docs.join(F.broadcast(copied) if sums["copied"] <= SEND_COPIED else copied, "row_hash", "left")
        # Only equal rows are told apart by their place, so a task that runs again may number them otherwise.
        spread = F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(0)
    chunk = F.pmod(F.xxhash64("row_hash", spread), F.lit(max(1, -(-chars // chunk_chars))))
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (CHUNKS_A_TASK * chunk_chars)))
    return docs.select(chunk.alias("chunk"), "carried", "text").repartition(parts, "chunk"), chars


def remove_repeats(documents: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Per row: the ``carry`` columns, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space)."""
    if window < 2:
        raise ValueError("a window has two words at least")
    carry_list = list(carry)
    if clash := {"n_words", "n_removed", "kept_text"} & set(carry_list):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    width = (window + 1) // 2
    docs, chars = _dealt(documents, carry_list, chunk_chars)
    buckets = max(1, -(-chars // bucket_chars))
    by_chunk = docs.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_anchors(width, buckets), _SENT_SQL).groupBy("bucket").applyInArrow(_hits("anchors"), _SENT_SQL)
    wide = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_candidates(width, window, buckets), _SENT_SQL)
    repeats = wide.groupBy("bucket").applyInArrow(_hits("windows"), _SENT_SQL)
    carried = documents.select(*carry_list).schema
    sql = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), "n_words long", "n_removed long", "kept_text string"])
    schema = to_arrow_schema(carried)
    for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())):
        schema = schema.append(pa.field(name, kind))
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(_removed(window, schema), sql)
