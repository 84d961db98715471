"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents.  In every round a queue's deficit grows by its quantum, ``window`` tokens times
its target share, and it sends whole documents while the next one fits its deficit; what is left of the deficit carries
on to later rounds, and so across windows.  Documents longer than ``packet`` tokens take part as packets of that length,
so after any round each queue has sent its share to within one packet.  The stream of what is sent is cut at window ends
only.  A queue that runs dry sends no more, and the others fill up.  Default targets are the sources' shares of all
tokens: then all end together.

*Packets.* How near a window comes to the mixture is a matter of ``packet``: a window of 2,048 tokens can't hold 2 % of a
source whose documents have 1,000 tokens, unless these are cut.  Of 20 sources, one with a third of 10,000 documents, the
mean distance (total variation) to the mixture of one window, of runs of 8 and of 64 windows, and the pieces a document:

======  =====  =====  =====  ======
packet      1      8     64  pieces
======  =====  =====  =====  ======
64      0.156  0.014  0.002  9.9
128     0.217  0.029  0.004  7.8
512     0.725  0.117  0.013  2.7
2,048   0.838  0.375  0.044  1.6
======  =====  =====  =====  ======

A document whose tokens end at place ``e`` of its queue is sent in the first round whose quanta sum to ``e``:
``ceil(e / quantum)``.  That needs no state of the rounds before, so deficits carry across partitions without passing
through one task, and the stream is the documents in the order of (round, queue, place).

Windows after the last full one hold a power of two of tokens, so nothing is padded.

Steps: tokenise once into a written table in the shared folder, with places counted per input part and queue; sums by
(queue, part) give each part's place in its queue, sums by blocks of rounds each block's place in the stream, and a
running sum within a block each document's.  These steps shuffle numbers; the ids follow once, by row.

Defined cases: null text is empty (one end id); a null source is a queue of its own; repeated rows are packed each;
null ``doc_id`` passes through; other columns are ignored; an empty table gives an empty result.  Sources without a
weight, where weights are given, wait until the others have run dry and then go by their token counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.llm.common import cut, scratch_table, steps, texts_of
from takeline.llm.tokens import TokenIds

WINDOW = 2048
#: Largest packet, in tokens: the most by which a source may be off its share after a round.
PACKET = 512
#: Ranges over which a queue's start positions are summed.
PARTS_PER_RANGE = 256
#: Rounds in a block, blocks in a group, and so on: each level's running sum is over at most this many rows.
RADIX = 1024


def tail_starts(total: int, window: int = WINDOW) -> list[int]:
    """Starts of the windows after the last full one, and the end: powers of two, the largest first."""
    at, out = total // window * window, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return [*out, total]


class Cutter:
    """Cuts intervals of the stream at window ends."""

    def __init__(self, total: int, window: int) -> None:
        self.window, self.full = window, total // window
        self.tail = tail_starts(total, window)

    def pieces(self, packets: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """``(start, length, sequence_id, offset)`` of packets ``(start, length, place in the stream)`` of a document."""
        out: list[tuple[int, int, int, int]] = []
        for start, length, place in packets:
            while length:
                if place < self.full * self.window:
                    number, offset = divmod(place, self.window)
                    room = self.window - offset
                else:
                    k = bisect_right(self.tail, place) - 1
                    number, offset, room = self.full + k, place - self.tail[k], self.tail[k + 1] - place
                take = min(length, room)
                last = out[-1] if out else None
                if last and last[2] == number and last[0] + last[1] == start and last[3] + last[1] == offset:
                    out[-1] = (last[0], last[1] + take, number, last[3])
                else:
                    out.append((start, take, number, offset))
                start, length, place = start + take, length - take, place + take
        return out


def tokenised(documents: DataFrame, tokenizer: str | None, end_id: int) -> str:
    """Write ``row, doc_id, queue, part, begin, n, ids`` (``begin``: tokens of the queue before the row in its part)."""
    spark = documents.sparkSession
    queue = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part, row = TokenIds(tokenizer, end_id), {}, TaskContext.get().partitionId(), 0
        for batch in steps(batches):
            packed = [encode.packed(t) for t in texts_of(batch)]
            begins, counts = [], []
            for q, ids in zip(batch.column("queue").to_pylist(), packed, strict=True):
                n = len(ids) // encode.dtype.itemsize
                begins.append(at.get(q, 0))
                counts.append(n)
                at[q] = begins[-1] + n
            rows = np.arange(row, row + len(packed)) + (part << 33)
            row += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(packed), pa.int32()), pa.array(begins, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["row", "doc_id", "queue", "part", "begin", "n", "ids"])

    path = scratch_table(spark, "packing-ids")
    schema = f"row long, doc_id {kind}, queue string, part int, begin long, n long, ids binary"
    documents.select("doc_id", "text", queue.alias("queue")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return path


def _before(value: str, order: Column, *by: str) -> Column:
    """Sum of ``value`` over the rows before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def part_starts(sums: DataFrame) -> DataFrame:
    """``queue, part, base``: tokens of the queue in the parts before; summed in two levels, so no queue is one task."""
    ranged = sums.withColumn("range", F.floor(F.col("part") / PARTS_PER_RANGE))
    ranges = ranged.groupBy("queue", "range").agg(F.sum("tokens").alias("in_range"))
    ranges = ranges.select("queue", "range", _before("in_range", F.col("range"), "queue").alias("range_base"))
    ranged = ranged.withColumn("part_base", _before("tokens", F.col("part"), "queue", "range"))
    return ranged.join(ranges, ["queue", "range"]).select("queue", "part", (F.col("range_base") + F.col("part_base")).alias("base"))


def quanta(queues: DataFrame, window: int, weights: dict[str, float] | None) -> DataFrame:
    """``queue, first, quantum``: the rounds before a queue's first one, and its tokens a round; ``queues``: ``queue, tokens``."""
    given = {f"s:{k}": float(w) for k, w in (weights or {}).items() if w > 0}
    if not given:
        total = queues.agg(F.sum("tokens")).first()[0] or 1
        return queues.select("queue", F.lit(0).cast("long").alias("first"), (F.col("tokens") * F.lit(window) / F.lit(total)).alias("quantum"))
    named = queues.sparkSession.createDataFrame(list(given.items()), "queue string, weight double")  # what the caller names
    weighed = queues.join(F.broadcast(named), "queue", "left")
    sums = weighed.agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("weight").isNull(), F.col("tokens"))).alias("rest")).first()
    quantum = F.coalesce(F.col("weight") / F.lit(sums["weight"] or 1.0), F.col("tokens") / F.lit(float(sums["rest"] or 1))) * F.lit(float(window))
    sized = weighed.select("queue", "tokens", F.col("weight").isNull().alias("rest"), quantum.alias("quantum"))
    ends = sized.agg(F.max(F.when(~F.col("rest"), F.ceil(F.col("tokens") / F.col("quantum"))))).first()[0] or 0
    return sized.select("queue", F.when(F.col("rest"), F.lit(ends)).otherwise(F.lit(0)).cast("long").alias("first"), "quantum")


def places(packets: DataFrame) -> DataFrame:
    """Add ``place``, the tokens of all packets before in the order of (round, queue, end)."""
    blocked = packets.withColumn("block", F.floor(F.col("round") / RADIX))
    sums = blocked.groupBy("block").agg(F.sum("length").alias("tokens")).withColumn("group", F.floor(F.col("block") / RADIX))
    groups = sums.groupBy("group").agg(F.sum("tokens").alias("in_group")).withColumn("top", F.floor(F.col("group") / RADIX))
    tops = groups.groupBy("top").agg(F.sum("in_group").alias("in_top"))  # a row for each 2 ** 30 rounds
    tops = tops.select("top", _before("in_top", F.col("top")).alias("top_base"))
    groups = groups.withColumn("group_base", _before("in_group", F.col("group"), "top")).join(F.broadcast(tops), "top")
    bases = sums.withColumn("block_base", _before("tokens", F.col("block"), "group")).join(groups.select("group", (F.col("top_base") + F.col("group_base")).alias("base")), "group")
    within = _before("length", F.struct("round", "queue", "end"), "block")
    return blocked.withColumn("within", within).join(bases.select("block", (F.col("base") + F.col("block_base")).alias("base")), "block").withColumn("place", F.col("base") + F.col("within"))


def pack(documents: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = 1, weights: dict[str, float] | None = None, packet: int | None = None) -> DataFrame:
    """Pieces: ``doc_id, source_queue, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's ids as little-endian integers of the tokenizer's width (see ``tokens``); ``weights`` are
    target proportions by source; ``packet`` is the largest packet in tokens (by default ``PACKET``, at most a window).
    """
    spark, packet = documents.sparkSession, min(packet or PACKET, window)
    if packet < 1:
        raise ValueError("a packet has a token at least")
    path = tokenised(documents, tokenizer, end_id)
    sums = cut(spark.read.parquet(path).groupBy("queue", "part").agg(F.sum("n").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    queues = quanta(sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")), window, weights)
    starts = part_starts(sums).join(queues, "queue")
    rows = spark.read.parquet(path).select("row", "queue", "part", "begin", "n").where("n > 0").join(starts, ["queue", "part"])
    packets = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))))
    packets = packets.withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(packet))).withColumn("end", F.col("base") + F.col("begin") + F.col("start") + F.col("length"))
    packets = cut(packets.select("row", "queue", "start", "length", "end", (F.col("first") + F.ceil(F.col("end") / F.col("quantum"))).alias("round")))
    placed = places(packets).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "place"))).alias("packets"))
    width = 2 if TokenIds(tokenizer, end_id).dtype.itemsize == 2 else 4
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(total, window)
        names = ["doc_id", "source_queue", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        types = [None, pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for whole in batches:
            types[0] = whole.schema.field("doc_id").type
            for s in range(0, whole.num_rows, 2000):
                batch = whole.slice(s, 2000)
                cols: list[list] = [[] for _ in names]
                lists = batch.column("packets")
                ends, flat = lists.offsets.to_numpy(), lists.values
                first, length, place = (flat.field(c).to_pylist() for c in ("start", "length", "place"))
                for k, (doc_id, queue, n, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "n", "ids")), strict=True)):
                    wide = packed if width == 4 else np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                    a, b = ends[k], ends[k + 1]
                    for start, size, number, offset in cutter.pieces(list(zip(first[a:b], length[a:b], place[a:b], strict=True))):
                        row = (doc_id, queue, start, size, packed[width * start : width * (start + size)], zlib.crc32(wide[4 * start : 4 * (start + size)]), n, number, offset)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    whole = spark.read.parquet(path).select("row", "doc_id", "queue", "n", "ids").join(placed, "row").select("doc_id", "queue", "n", "ids", "packets")
    return whole.mapInArrow(run, f"doc_id {kind}, source_queue string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
