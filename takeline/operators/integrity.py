"""Manifests, quantisation, coding of blobs, recipe and identity checks."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(blobs: DataFrame) -> DataFrame:
    """``key, dtype, shape, elements, sha256`` of ``key, dtype, shape, blob``."""
    elements = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return blobs.select("key", "dtype", "shape", elements.alias("elements"), F.sha2("blob", 256).alias("sha256"))


def manifest_faults(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys that are missing, unexpected or different; none means the manifests agree."""
    a = found.select("key", F.struct("dtype", "shape", "elements", "sha256").alias("a"))
    b = wanted.select("key", F.struct("dtype", "shape", "elements", "sha256").alias("b"))
    fault = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return a.join(b, "key", "full").select("key", fault.alias("fault")).where("fault is not null")


def quantize(values: DataFrame, group: list[str], bits: int = 8) -> DataFrame:
    """``... idx, code, scale``: per group, ``code = rint(w / scale)`` with the largest magnitude at the top code."""
    top = 2 ** (bits - 1) - 1
    scale = values.groupBy(*group).agg((F.max(F.abs("w")) / top).alias("scale"))
    code = F.when(F.col("scale") > 0, F.rint(F.col("w") / F.col("scale"))).otherwise(0.0)
    return values.join(scale, group).select(*group, "idx", F.greatest(F.least(code, F.lit(float(top))), F.lit(float(-top))).cast("int").alias("code"), "scale")


def dequantize(codes: DataFrame) -> DataFrame:
    return codes.withColumn("w", F.col("code") * F.col("scale")).drop("code", "scale")


def weighted_soup(tensors: DataFrame) -> DataFrame:
    """Weighted mean of tensors in long form ``member, key, idx, x, w``."""
    return tensors.groupBy("key", "idx").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))


def _lzma(blob: bytes) -> bytes:
    """As ``lzma.compress``, byte counts included, but with a dictionary no larger than the blob: the tables of the default one cost more than a text."""
    size = min(max(4096, 1 << (len(blob) - 1).bit_length() if blob else 0), 8 << 20)
    return lzma.compress(blob, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": size}])


def pack_deltas(pairs: DataFrame) -> DataFrame:
    """Smallest coding of ``blob`` against ``base``: ``key, method, packed, length, sha256``.

    The bytes themselves and their difference mod 256 to the base (where it is as long) each go through zlib and LZMA;
    the shortest wins, ties by name.  Rows are dealt by key first, since a file's row group is one task however much work
    its rows are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, blob, base, sha256 in zip(rows["key"], rows["blob"], rows["base"], rows["sha256"], strict=True):
                forms = {"plain": blob}
                if base is not None and len(base) == len(blob):
                    forms["delta"] = (np.frombuffer(blob, np.uint8) - np.frombuffer(base, np.uint8)).tobytes()
                coded = {f"{form}-{name}": pack(x) for form, x in forms.items() for name, pack in (("zlib", lambda b: zlib.compress(b, 9)), ("lzma", _lzma))}
                name = min(coded, key=lambda n: (len(coded[n]), n))
                out.append((key, name, coded[name], len(blob), sha256))
            yield pd.DataFrame(out, columns=["key", "method", "packed", "length", "sha256"])

    dealt = pairs.select("key", "blob", "base").repartition("key").withColumn("sha256", F.sha2("blob", 256))
    return dealt.mapInPandas(run, "key string, method string, packed binary, length long, sha256 string")


def unpack_deltas(coded: DataFrame, bases: DataFrame) -> DataFrame:
    """``key, blob``; raises on a stream that is not complete, a wrong length or a wrong hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, method, packed, length, base, sha256 in zip(rows["key"], rows["method"], rows["packed"], rows["length"], rows["base"], rows["sha256"], strict=True):
                form, name = method.split("-")
                stream = zlib.decompressobj() if name == "zlib" else lzma.LZMADecompressor()
                blob = stream.decompress(packed, length + 1)
                if not stream.eof and name == "zlib":
                    blob += stream.flush()
                if len(blob) != length or not stream.eof or stream.unused_data:
                    raise ValueError(f"{key}: not one complete stream of {length} bytes")
                out.append((key, blob if form == "plain" else (np.frombuffer(blob, np.uint8) + np.frombuffer(base, np.uint8)).tobytes(), sha256))
            yield pd.DataFrame(out, columns=["key", "blob", "sha256"])

    joined = coded.join(bases.select("key", "base"), "key", "left")
    blobs = joined.select("key", "method", "packed", "length", "base", "sha256").mapInPandas(run, "key string, blob binary, sha256 string")
    return blobs.select("key", F.when(F.sha2("blob", 256) == F.col("sha256"), F.col("blob")).otherwise(F.raise_error(F.concat(F.lit("hash of "), F.col("key"))).cast("binary")).alias("blob"))


def recipe(record: DataFrame) -> DataFrame:
    """``cache, k, v`` of ``cache, kv`` lists of ``key=value`` strings; a later key wins."""
    pairs = record.select("cache", F.posexplode("kv").alias("i", "s")).select("cache", "i", F.substring_index("s", "=", 1).alias("k"), F.expr("substring(s, instr(s, '=') + 1)").alias("v"))
    return pairs.groupBy("cache", "k").agg(F.max_by("v", "i").alias("v"))


def recipe_differences(wanted: DataFrame, built: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``k, wanted, built, verdict`` over two recipes ``k, v``: ``differs``, ``missing`` (fatal) or ``extra``."""
    w, b = wanted.select("k", F.col("v").alias("wanted")), built.select("k", F.col("v").alias("built"))
    verdict = F.when(F.col("built").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("wanted") != F.col("built"), "differs")
    return w.join(b, "k", "full").where(~F.col("k").isin(*ignored) if ignored else F.lit(True)).withColumn("verdict", verdict).where("verdict is not null")


def recipe_arguments(pairs: DataFrame, known: dict[str, str]) -> DataFrame:
    """``k, argument`` of a recipe; a key outside ``known`` raises."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    flag = F.try_element_at(table, F.col("k"))
    return pairs.select("k", F.concat(F.coalesce(flag, F.raise_error(F.concat(F.lit("unknown key "), F.col("k"))).cast("string")), F.lit("="), F.col("v")).alias("argument"))


def size_budget(files: DataFrame, limit: int) -> DataFrame:
    """Bytes of a listing (``path, length``) and whether they stay within the limit."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("within", F.col("bytes") <= limit)


def key_map(left: DataFrame, right: DataFrame) -> DataFrame:
    """``slot, left, right`` of two key tables ``slot, key``; a slot on one side only raises."""
    both = left.select("slot", F.col("key").alias("left")).join(right.select("slot", F.col("key").alias("right")), "slot", "full")
    whole = F.col("left").isNotNull() & F.col("right").isNotNull()
    return both.select(F.when(whole, F.col("slot")).otherwise(F.raise_error(F.concat(F.lit("one-sided slot "), F.col("slot"))).cast("string")).alias("slot"), "left", "right")


def time_ledger(runs: DataFrame, stage_limit: float, total_limit: float) -> DataFrame:
    """Seconds per stage with flags for stages, and the whole, beyond their limits."""
    stage = runs.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    total = stage.agg(F.sum("seconds").alias("total"))
    return stage.crossJoin(F.broadcast(total)).select("stage", "seconds", (F.col("seconds") > stage_limit).alias("stage_over"), (F.col("total") > total_limit).alias("total_over"))
