"""Lossless coding of tensors that are tables of codes: bit packing, context-ordered residuals, byte planes, checked chunks.

A tensor is rows ``key, idx, code`` with ``idx`` from 0 without gaps (``numbered`` makes one), so one of any size is
spread over tasks.  What is stored is rows too: chunks of fixed length, each compressed, hashed and checked on its own.

A *layout* is ``key, method, place, byte``: one way to line up a tensor's bytes.  ``smallest`` compresses the chunks of
each and keeps the layout with the fewest bytes; ``layout_bytes`` is its inverse and raises on a faulty stream.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.operators import spans
from takeline.sources.settled import settled

#: Codes of a packed chunk, bytes of a compressed chunk, places that are counted together.
PACKED_CODES, CHUNK_BYTES, BLOCK = 4096, 1 << 16, 1 << 16
#: Levels and limits of the compressors are part of the format.
ZLIB_LEVEL, LZMA_PRESET, LZMA_MEMORY = 6, 6, 128 << 20

PAYLOAD = "key string, method string, chunk long, codec string, length int, packed binary, sha256 string"


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Number the rows of each ``by`` from 0 in the given total order, by a range sort over all."""
    ranked = spans.ranked(rows, [*by, *order], "_rank")
    first = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, by).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def fault(what: str, key: Column) -> Column:
    return F.raise_error(F.concat(F.lit(what + " "), key.cast("string")))


# Bit packing.


def _group(bits: int) -> int:
    """Codes that make whole bytes and, as a number, stay below 2 ** 63."""
    if not 1 <= bits <= 8:
        raise ValueError("codes have 1 to 8 bits")
    return 8 if bits < 8 else 4


def packed_chunks(codes: DataFrame, by: list[str], idx: str, code: str, bits: int, chunk: int = PACKED_CODES) -> DataFrame:
    """``by, chunk, n, stream``: codes of ``bits`` bits end to end, lowest bit first, unused high bits of the last byte zero.

    Codes are joined by shifts in groups that fill whole bytes, and groups are joined in a chunk.  A code out of range
    raises, and so does a gap or a repeated place within a chunk.
    """
    size = _group(bits)
    if chunk % size:
        raise ValueError(f"a chunk has a multiple of {size} codes")
    named = codes.select(*by, F.col(idx).cast("long").alias("_idx"), F.col(code).cast("long").alias("_code"))
    value = F.when((F.col("_code") >= 0) & (F.col("_code") < 1 << bits), F.col("_code")).otherwise(fault(f"not a code of {bits} bits:", F.col("_code")).cast("long"))
    at = F.col("_idx") % size
    word = F.bit_or(F.call_function("shiftleft", value, (at * bits).cast("int")))
    words = named.groupBy(*by, F.floor(F.col("_idx") / size).alias("_word")).agg(word.alias("_bits"), F.count("*").cast("int").alias("_n"), (F.max(at) + 1).cast("int").alias("_end"))
    digits = F.lpad(F.hex("_bits"), 16, "0")
    little = F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size * bits // 8)))
    used = F.when(F.col("_n") == F.col("_end"), F.ceil(F.col("_n") * bits / 8).cast("int")).otherwise(fault("places are not 0, 1, 2 ... at word", F.col("_word")).cast("int"))
    part = F.struct("_word", F.substring(little, F.lit(1), 2 * used).alias("hex"), F.col("_n").alias("n"))
    listed = words.groupBy(*by, F.floor(F.col("_word") * size / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    n = F.aggregate("_parts", F.lit(0), lambda total, p: total + p["n"])
    last = F.element_at("_parts", -1)
    whole = (last["_word"] - F.col("chunk") * (chunk // size)) * size + last["n"]
    joined = F.when(whole == n, F.unhex(F.array_join(F.transform("_parts", lambda p: p["hex"]), ""))).otherwise(fault("places are not 0, 1, 2 ... in chunk", F.col("chunk")).cast("binary"))
    return listed.select(*by, "chunk", n.alias("n"), joined.alias("stream"))


def bit_packed(codes: DataFrame, by: list[str], order: str, code: str, bits: int) -> DataFrame:
    """``by, n, stream``: the chunks of each tensor as one stream, for tensors that fit a row."""
    chunks = packed_chunks(codes, by, order, code, bits)
    joined = chunks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chunk", "n", "stream"))).alias("c"), F.max("chunk").alias("last"))
    full = F.forall(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda x: x["n"] == PACKED_CODES) & (F.size("c") == F.col("last") + 1)
    hexed = F.array_join(F.transform("c", lambda x: F.hex(x["stream"])), "")
    stream = F.when(full, F.unhex(hexed)).otherwise(fault("places are not 0, 1, 2 ... in", F.concat_ws("/", *(F.col(c).cast("string") for c in by))).cast("binary"))
    return joined.select(*by, F.aggregate("c", F.lit(0), lambda total, x: total + x["n"]).alias("n"), stream.alias("stream"))


def bit_unpacked(chunks: DataFrame, by: list[str], bits: int, chunk: int = PACKED_CODES) -> DataFrame:
    """``by, idx, code`` of ``packed_chunks``; a stream of the wrong length, or with unused bits set, raises."""
    size = _group(bits)
    width = size * bits // 8  # bytes of a group
    right = F.octet_length("stream") == F.ceil(F.col("n") * bits / 8)
    stream = F.when(right & (F.col("n") <= chunk), F.col("stream")).otherwise(fault("wrong length of chunk", F.col("chunk")).cast("binary"))
    count = F.ceil(F.col("n") / size).cast("int")
    little = lambda w: F.rpad(F.hex(F.substring(F.col("stream"), w * width + 1, F.lit(width))), 2 * width, "0")
    number = lambda digits: F.conv(F.concat(*(F.substring(digits, 2 * width - 1 - 2 * k, 2) for k in range(width))), 16, 10).cast("long")
    words = chunks.withColumn("stream", stream).where("n > 0").select(*by, "chunk", "n", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), little)).alias("word", "digits"))
    words = words.select(*by, "chunk", "n", "word", number(F.col("digits")).alias("bits"))
    codes = F.array(*(F.shiftright("bits", k * bits).bitwiseAND((1 << bits) - 1) for k in range(size)))
    found = words.select(*by, "chunk", "n", "word", F.posexplode(codes).alias("k", "code")).withColumn("at", F.col("word") * size + F.col("k"))
    code = F.when((F.col("at") < F.col("n")) | (F.col("code") == 0), F.col("code")).otherwise(fault("unused bits are set in chunk", F.col("chunk")).cast("long"))
    checked = found.select(*by, (F.col("chunk") * chunk + F.col("at")).alias("idx"), code.cast("int").alias("code"), (F.col("at") < F.col("n")).alias("own"))
    return checked.where("own or code != 0").drop("own")


# Layouts.


def byte_layouts(values: DataFrame, width: int) -> DataFrame:
    """Layouts of integers ``key, idx, value`` of ``width`` bytes, lowest first: ``identity``, and ``byteplanes``, all lowest bytes first, then all second ones."""
    counts = values.groupBy("key").agg(F.count("*").alias("n"))
    split = values.join(counts, "key").select("key", "idx", "n", F.posexplode(F.array(*(F.shiftright(F.col("value").cast("long"), 8 * k).bitwiseAND(255).cast("int") for k in range(width)))).alias("plane", "byte"))
    plain = split.select("key", F.lit("identity").alias("method"), (F.col("idx") * width + F.col("plane")).alias("place"), "byte")
    return plain if width == 1 else plain.unionByName(split.select("key", F.lit("byteplanes").alias("method"), (F.col("plane") * F.col("n") + F.col("idx")).alias("place"), "byte"))


def from_layout(layout: DataFrame, width: int) -> DataFrame:
    """``key, idx, value`` (signed) of a layout of ``byte_layouts``; bytes that don't make whole values raise."""
    counts = layout.groupBy("key").agg(F.count("*").alias("bytes"))
    n = F.floor(F.col("bytes") / width)
    planes = F.col("method") == "byteplanes"
    placed = layout.join(counts, "key").select("key", F.when(planes, F.col("place") % n).otherwise(F.floor(F.col("place") / width)).alias("idx"), F.when(planes, F.floor(F.col("place") / n)).otherwise(F.col("place") % width).alias("plane"), "byte")
    joined = placed.groupBy("key", "idx").agg(F.bit_or(F.call_function("shiftleft", F.col("byte").cast("long"), (F.col("plane") * 8).cast("int"))).alias("value"), F.count("*").alias("n"))
    signed = F.when(F.col("value") >= 1 << (8 * width - 1), F.col("value") - (1 << (8 * width))).otherwise(F.col("value")) if width < 8 else F.col("value")
    return joined.select("key", "idx", F.when(F.col("n") == width, signed).otherwise(fault("no whole value in", F.col("key")).cast("long")).alias("value"))


def context_order(base: DataFrame) -> DataFrame:
    """Add ``place``: where a code comes when its tensor is sorted by code, equal ones by ``idx``.

    A counting sort: codes are few, so blocks of ``BLOCK`` places are counted by code, and a code's place is the sum of
    what lies before.  No task sees more than a block of one code.
    """
    blocked = base.withColumn("_block", F.floor(F.col("idx") / BLOCK))
    counts = blocked.groupBy("key", "code", "_block").agg(F.count("*").alias("_n"))
    before = lambda n, *by: F.coalesce(F.sum(n).over(Window.partitionBy("key", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    codes = counts.groupBy("key", "code").agg(F.sum("_n").alias("_all")).withColumn("_base", before("_all", "code"))
    starts = counts.withColumn("_in_code", before("_n", "code", "_block")).join(codes, ["key", "code"]).select("key", "code", "_block", (F.col("_base") + F.col("_in_code")).alias("_start"))
    number = F.row_number().over(Window.partitionBy("key", "code", "_block").orderBy("idx")) - 1
    return blocked.withColumn("_in", number).join(starts, ["key", "code", "_block"]).withColumn("place", F.col("_start") + F.col("_in")).drop("_block", "_in", "_start")


def predicted(base_code: Column, base_scale: Column, scale: Column, bits: int) -> Column:
    """A code as its base says: 8 bits at the target's scale (a scale of 0: as it is), fewer bits in their own range."""
    top = (1 << (bits - 1)) - 1
    if bits < 8:
        return F.rint(base_code * top / 127).cast("int")
    ratio = F.when(scale != 0, base_scale / scale).otherwise(1.0)
    return F.least(F.greatest(F.rint(base_code * ratio), F.lit(-127.0)), F.lit(127.0)).cast("int")


def residual_layouts(target: DataFrame, base: DataFrame, bits: int = 8) -> DataFrame:
    """Layouts of ``key, idx, code, scale`` against another such table of 8-bit codes, mod 256.

    ``original-residual``: code less base code, by ``idx``; ``scale-context-residual``: code less prediction, in the
    order of the base's codes, so that equal contexts lie together.  A code on one side only raises.
    """
    known = context_order(base.select("key", "idx", "code", F.col("scale").alias("base_scale"))).withColumnRenamed("code", "base_code")
    both = target.select("key", "idx", "code", "scale").join(known, ["key", "idx"], "full")
    code = F.when(F.col("code").isNotNull() & F.col("base_code").isNotNull(), F.col("code")).otherwise(fault("a code on one side only in", F.col("key")).cast("int"))
    plain, context = (F.pmod(code - other, F.lit(256)).cast("int") for other in (F.col("base_code"), predicted(F.col("base_code"), F.col("base_scale"), F.col("scale"), bits)))
    forms = F.array(F.struct(F.lit("original-residual").alias("method"), F.col("idx").cast("long").alias("place"), plain.alias("byte")), F.struct(F.lit("scale-context-residual").alias("method"), F.col("place"), context.alias("byte")))
    return both.select("key", F.inline(forms))


def from_residuals(layout: DataFrame, base: DataFrame, scales: DataFrame, bits: int = 8) -> DataFrame:
    """``key, idx, code, scale`` of the target, from its kept layout, its base and its scales ``key, idx, scale``.

    Raises where places and base codes don't agree, or a code is out of its range.
    """
    methods = layout.groupBy("key").agg(F.min("method").alias("method"))
    known = context_order(base.select("key", "idx", "code", F.col("scale").alias("base_scale"))).withColumnRenamed("code", "base_code").join(methods, "key", "left")
    context = F.col("method") == "scale-context-residual"
    placed = known.withColumn("place", F.when(context, F.col("place")).otherwise(F.col("idx")))
    both = placed.join(layout, ["key", "method", "place"], "full").join(scales.select("key", "idx", "scale"), ["key", "idx"], "left")
    whole = F.col("byte").isNotNull() & F.col("idx").isNotNull() & F.col("scale").isNotNull()
    start = F.when(context, predicted(F.col("base_code"), F.col("base_scale"), F.col("scale"), bits)).otherwise(F.col("base_code"))
    byte = F.pmod(start + F.when(whole, F.col("byte")).otherwise(fault("places don't meet the base's codes in", F.col("key")).cast("int")), F.lit(256))
    code = F.when(byte > 127, byte - 256).otherwise(byte)
    top = (1 << (bits - 1)) - 1
    if bits < 8:
        code = F.when(F.abs(code) <= top, code).otherwise(fault(f"not a code of {bits} bits in", F.col("key")).cast("int"))
    return both.select("key", "idx", code.cast("int").alias("code"), "scale")


# Chunks.


def chunked(layouts: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``key, method, chunk, raw``: a layout's bytes by fixed lengths."""
    listed = layouts.groupBy("key", "method", F.floor(F.col("place") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "byte"))).alias("b"))
    return listed.select("key", "method", "chunk", F.unhex(F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")).alias("raw"))


def smallest(layouts: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Payload ``key, method, chunk, codec, length, packed, sha256`` of each key's layout with the fewest bytes (ties: by name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                forms = {"lzma": lzma.compress(row["raw"], preset=LZMA_PRESET), "zlib": zlib.compress(row["raw"], ZLIB_LEVEL)}
                codec, packed = min(forms.items(), key=lambda form: (len(form[1]), form[0]))
                yield pa.RecordBatch.from_pylist([row | {"raw": None, "codec": codec, "packed": packed}], schema)

    schema = pa.schema([("key", pa.string()), ("method", pa.string()), ("chunk", pa.int64()), ("codec", pa.string()), ("length", pa.int32()), ("packed", pa.binary()), ("sha256", pa.string())])
    raw = chunked(layouts, chunk).select(F.col("key").cast("string").alias("key"), "method", "chunk", F.octet_length("raw").alias("length"), F.sha2("raw", 256).alias("sha256"), "raw")
    packed = settled(raw.mapInArrow(run, PAYLOAD))
    sizes = packed.groupBy("key", "method").agg(F.sum(F.octet_length("packed")).alias("bytes"))
    best = sizes.groupBy("key").agg(F.min(F.struct("bytes", "method"))["method"].alias("method"))
    return packed.join(best, ["key", "method"]).select("key", "method", "chunk", "codec", "length", "packed", "sha256")


def inflated(codec: str, packed: bytes, length: int) -> bytes:
    """Exactly ``length`` bytes of one complete stream with nothing behind it; anything else raises."""
    if codec == "zlib":
        stream = zlib.decompressobj()
    elif codec == "lzma":
        stream = lzma.LZMADecompressor(memlimit=LZMA_MEMORY)
    else:
        raise ValueError(f"unknown codec {codec}")
    try:
        raw = stream.decompress(packed, length + 1)
    except (zlib.error, lzma.LZMAError) as e:
        raise ValueError(f"not a {codec} stream: {e}") from e
    if len(raw) != length or not stream.eof or stream.unused_data or getattr(stream, "unconsumed_tail", b""):
        raise ValueError(f"not one complete {codec} stream of {length} bytes")
    return raw


def layout_bytes(payload: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The layout ``key, method, place, byte`` that a payload holds; a stream that is cut, too long or changed raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            for row in batch.to_pylist():
                try:
                    raw = inflated(row["codec"], row["packed"], row["length"])
                except ValueError as e:
                    raise ValueError(f"{row['key']}, chunk {row['chunk']}: {e}") from e
                if sha256(raw).hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['key']}, chunk {row['chunk']}: wrong hash")
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * n, pa.string()), pa.array([row["method"]] * n, pa.string()), pa.array(np.arange(n) + row["chunk"] * chunk, pa.int64()), pa.array(np.frombuffer(raw, np.uint8).astype(np.int32))], names=["key", "method", "place", "byte"])

    return payload.select("key", "method", "chunk", "codec", "length", "packed", "sha256").mapInArrow(run, "key string, method string, place long, byte int")


def tensor_hashes(codes: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``key, elements, sha256`` of ``key, idx, code``: the hash of the hashes of chunks of codes, each as a byte."""
    bytes_ = codes.select("key", F.lit("").alias("method"), F.col("idx").alias("place"), F.pmod("code", F.lit(256)).alias("byte"))
    parts = chunked(bytes_, chunk).select("key", "chunk", F.octet_length("raw").cast("long").alias("n"), F.sha2("raw", 256).alias("h"))
    listed = parts.groupBy("key").agg(F.sum("n").alias("elements"), F.sort_array(F.collect_list(F.struct("chunk", "h"))).alias("c"))
    return listed.select("key", "elements", F.sha2(F.array_join(F.transform("c", lambda x: x["h"]), ""), 256).alias("sha256"))


def encode_delta(target: DataFrame, base: DataFrame, bits: int = 8, chunk: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The payload of a target's codes against its base's, and a manifest ``key, base_sha256, elements, sha256`` of both."""
    hashes = tensor_hashes(target).join(tensor_hashes(base).select("key", F.col("sha256").alias("base_sha256")), "key")
    return smallest(residual_layouts(target, base, bits), chunk), hashes.select(F.col("key").cast("string").alias("key"), "base_sha256", "elements", "sha256")


def decode_delta(payload: DataFrame, manifest: DataFrame, base: DataFrame, scales: DataFrame, bits: int = 8, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``key, idx, code, scale`` again; another base than the one coded against, or another result, raises.

    The checked base and the result are each read more than once, so they are written first.
    """
    manifest = settled(manifest)
    checked = settled(_checked(base, manifest.select("key", F.col("base_sha256").alias("sha256")), "another base for"))
    decoded = settled(from_residuals(layout_bytes(payload, chunk), checked, scales, bits))
    return _checked(decoded, manifest.select("key", "sha256"), "wrong hash of")


def _checked(codes: DataFrame, wanted: DataFrame, what: str) -> DataFrame:
    """``codes``, or an error where the hash of a tensor isn't the wanted one or a tensor is missing."""
    found = tensor_hashes(codes).select(F.col("key").cast("string").alias("key"), F.col("sha256").alias("found")).join(wanted, "key", "full")
    good = found.select("key", F.when(F.col("found").eqNullSafe(F.col("sha256")), True).otherwise(fault(what, F.col("key")).cast("boolean")).alias("good"))
    return codes.withColumn("key", F.col("key").cast("string")).join(good, "key", "right").where("good").drop("good")
