"""Token-id files: canonical length-limited Huffman codes from global counts, blocks with bit-offset checkpoints.

Container: a Parquet dataset in the shared folder with one row per block, written by Spark's committer, so a lost
executor leaves no half file.  A block's payload is self-contained but for the code lengths, which are a table of
their own beside it:

* ``doc_ids, doc_tokens``: the whole documents of the block (about ``BLOCK_IDS`` ids, or one longer document),
* ``shard, begin``: its range partition, and the ids before it there,
* ``offsets``: a bit offset for every ``LANE`` ids, from which decoding can start,
* ``bits``: the codes, most significant bit first.

Decoding looks up ``MAX_BITS`` bits in a table and runs all lanes of a block at once.

Order: ascending ``doc_id`` (nulls first; equal ones by a hash of their ids), by range partitioning and a sort in each partition.
Defined cases: null text is empty (one end id); repeated rows are all kept; other columns are ignored; an empty table
gives an empty dataset; more than 65,536 different ids have no codes of ``MAX_BITS`` bits and raise.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.llm.common import scratch_table, steps, texts_of
from takeline.llm.tokens import TokenIds

MAX_BITS = 16
LANE = 64
BLOCK_IDS = 1 << 16


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    items = sorted((n, s) for s, n in counts.items() if n > 0)
    if not items:
        return {}
    if len(items) == 1:
        return {items[0][1]: 1}
    if len(items) > 1 << limit:
        raise ValueError(f"{len(items)} symbols don't fit {limit} bits")
    weights = np.array([n for n, _ in items], np.float64)
    # Each level, from the deepest: leaves and packages of two neighbours of the level below, lightest first.
    leaf, below = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)])
        order = np.argsort(both, kind="stable")
        leaf.append(order < len(items))
        below = both[order]
    lengths, take = np.zeros(len(items), np.int64), 2 * len(items) - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    return {s: int(n) for (_, s), n in zip(items, lengths, strict=True)}


def canonical_codes(lengths: dict[int, int]) -> dict[int, int]:
    """Codes in order of length, then id."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s], last = code, n
        code += 1
    return out


class Coder:
    """Encodes and decodes arrays of ids with one set of code lengths."""

    def __init__(self, lengths: dict[int, int], max_bits: int = MAX_BITS) -> None:
        self.max_bits = max_bits
        size = max(lengths, default=0) + 1
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.table_id, self.table_len = np.zeros(1 << max_bits, np.int64), np.ones(1 << max_bits, np.int64)
        for s, c in canonical_codes(lengths).items():
            n = lengths[s]
            self.length[s], self.code[s] = n, c
            self.table_id[c << max_bits - n : (c + 1) << max_bits - n] = s
            self.table_len[c << max_bits - n : (c + 1) << max_bits - n] = n

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every ``LANE``-th id, and the bits."""
        n = self.length[ids]
        if (n == 0).any():
            raise ValueError("an id has no code")
        ends = np.cumsum(n)
        at = ends - n
        word, shift = at >> 5, (64 - (at & 31) - n).astype(np.uint64)
        value = self.code[ids] << shift  # in the 64 bits from the start of its 32-bit word
        words = np.zeros(int(ends[-1] >> 5) + 2 if len(ids) else 0, np.uint64)
        if len(ids):
            firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[firsts]] += np.add.reduceat(value >> np.uint64(32), firsts)
            words[word[firsts] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), firsts)
        return at[::LANE].astype("<u8"), words.astype(">u4").tobytes()

    def decode(self, offsets: np.ndarray, bits: bytes, count: int) -> np.ndarray:
        out = np.zeros(len(offsets) * LANE, np.int64).reshape(-1, LANE)
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        words = np.r_[words, np.zeros(2, np.uint64)]
        at = offsets.astype(np.int64)
        keep, mask = np.int64(64 - self.max_bits), np.uint64((1 << self.max_bits) - 1)
        last = len(words) - 2
        for k in range(LANE):
            w = np.minimum(at >> 5, last)
            window = ((words[w] << np.uint64(32)) | words[w + 1]) >> (keep - (at & 31)).astype(np.uint64) & mask
            out[:, k] = self.table_id[window]
            at = at + self.table_len[window]
        return out.reshape(-1)[:count]


@functools.cache
def _kept_encoder(tokenizer: str | None, end_id: int) -> TokenIds:
    """One encoder per worker process: words that one task has encoded, the next ones need not (some 200 MB at most)."""
    return TokenIds(tokenizer, end_id)


def tokenised(documents: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """``doc_id, ids`` (bytes of the tokenizer's width), tokenised once into a written table in the shared folder."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _kept_encoder(tokenizer, end_id)
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(encode.packed, texts_of(batch))), pa.binary())], names=["doc_id", "ids"])

    path = scratch_table(documents.sparkSession, "token-ids")
    documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary").write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def count_ids(tokens: DataFrame, dtype: np.dtype) -> dict[int, int]:
    """Count of every id over all documents; as many rows reach the driver as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                counts = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(start, 1000).to_pylist()), dtype), minlength=len(total))
                counts[: len(total)] += total
                total = counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


BLOCK = "shard int, block int, begin long, doc_ids array<{}>, doc_tokens array<long>, n_ids long, offsets binary, bits binary"


def write_token_files(documents: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1, shards: int | None = None) -> str:
    """Encode all documents in order into ``path/blocks`` and ``path/lengths``; returns ``path``."""
    spark = documents.sparkSession
    path = path or scratch_table(spark, "token-files")
    dtype = TokenIds(tokenizer, end_id).dtype
    tokens = tokenised(documents, tokenizer, end_id)
    lengths = code_lengths(count_ids(tokens, dtype))
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    kind = dict(documents.dtypes)["doc_id"]
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(lengths), TaskContext.get().partitionId()
        docs, counts, pending, block, begin, size, id_type = [], [], [], 0, 0, 0, pa.int64()

        def flushed() -> pa.RecordBatch:
            offsets, bits = coder.encode(np.frombuffer(b"".join(pending), dtype))
            row = [[shard], [block], [begin], [docs], [counts], [size], [offsets.tobytes()], [bits]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "block", "begin", "doc_ids", "doc_tokens", "n_ids", "offsets", "bits"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(doc_id)
                pending.append(ids.as_py())
                counts.append(len(pending[-1]) // dtype.itemsize)
                size += counts[-1]
                if size >= BLOCK_IDS:
                    yield flushed()
                    docs, counts, pending, block, begin, size = [], [], [], block + 1, begin + size, 0
        if docs:
            yield flushed()

    ordered = tokens.repartitionByRange(shards, F.col("doc_id"), F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
    ordered.mapInArrow(run, BLOCK.format(kind)).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document; ``ids`` are little-endian unsigned 32-bit.

    Each block decodes on its own.  The driver holds the code lengths (a row per vocabulary id) and one sum per shard.
    """
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/lengths").collect()}
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    base, at = {}, 0
    for shard, n in sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        base[shard], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for whole in batches:
            for r in range(whole.num_rows):
                b = whole.slice(r, 1)
                row = {n: b.column(n)[0].as_py() for n in ("shard", "begin", "doc_tokens", "n_ids", "offsets", "bits")}
                ids = coder.decode(np.frombuffer(row["offsets"], "<u8"), row["bits"], row["n_ids"]).astype("<u4").tobytes()
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                texts = [ids[4 * a : 4 * e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = base[row["shard"]] + row["begin"]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids").flatten(), pa.array(starts + first), pa.array(counts), pa.array(list(map(zlib.crc32, texts)), pa.int64()), pa.array(texts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
