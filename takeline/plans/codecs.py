"""Queries over coded tensors: the embeddings of a label are one tensor, a vector is one of its channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.operators import codec, integrity
from takeline.plans.catalogue import _read, _rounded, query
from takeline.sources.settled import settled


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, vec_id, i, w, v``: all numbers of the embeddings, and those of a base that lies near."""
    e = _read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("key"), "vec_id", F.posexplode("embedding").alias("i", "w"))
    w = F.col("w").cast("double")
    return e.select("key", "vec_id", "i", w.alias("w"), (w * 0.9 + 0.002 * (F.col("i") % 7)).alias("v"))


def tensors(spark: SparkSession, sf_dir: str, bits: int = 8) -> tuple[DataFrame, DataFrame]:
    """Target and base as ``key, idx, code, scale``; the base has 8 bits."""
    places = codec.numbered(weights(spark, sf_dir), ["key"], ["vec_id", "i"])
    of = lambda w, b: integrity.quantize(places.select("key", "vec_id", "idx", F.col(w).alias("w")), ["key", "vec_id"], b).drop("vec_id")
    return of("w", bits), of("v", 8)


def _tensors_sql(bits: int = 8) -> str:
    """``x``: key, idx, code, scale and the base's, as b and s."""
    top = (1 << (bits - 1)) - 1
    code = lambda w, t: f"CAST(CASE WHEN {w}s > 0 THEN round_even({w} / ({w}s / {t}), 0) ELSE 0 END AS INT)"
    return f"""e AS (
  SELECT CAST(label AS VARCHAR) AS key, vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS w, CAST(embedding[i] AS DOUBLE) * CAST(0.9 AS DOUBLE) + CAST(0.002 AS DOUBLE) * ((i - 1) % 7) AS v FROM embeddings, range(1, 65) r(i)
), m AS (SELECT *, max(abs(w)) OVER (PARTITION BY vec_id) AS ws, max(abs(v)) OVER (PARTITION BY vec_id) AS vs, row_number() OVER (PARTITION BY key ORDER BY vec_id, i) - 1 AS idx FROM e
), x AS (SELECT key, idx, {code("w", top)} AS code, ws / {top} AS scale, {code("v", 127)} AS b, vs / 127 AS s FROM m)"""


_PACKED = """b AS (SELECT key, idx // 4096 AS chunk, ((idx % 4096) * 7 + k) // 8 AS pos, sum((((code + 63) >> k) & 1) << (((idx % 4096) * 7 + k) % 8)) AS v FROM x, range(7) r(k) GROUP BY ALL)"""


@query(f"""WITH {_tensors_sql(7)}, {_PACKED}, n AS (SELECT key, idx // 4096 AS chunk, CAST(count(*) AS INT) AS n FROM x GROUP BY ALL)
SELECT key, chunk, n, sha256(unhex(string_agg(printf('%02x', CAST(v AS INT)), '' ORDER BY pos))) AS sha256, CAST(count(*) AS INT) AS bytes FROM b JOIN n USING (key, chunk) GROUP BY ALL""")
def packed_tensors(spark, sf_dir):
    """Every label's codes of 7 bits as chunks of one stream."""
    codes = tensors(spark, sf_dir, 7)[0].withColumn("code", F.col("code") + 63)
    packed = codec.packed_chunks(codes, ["key"], "idx", "code", 7)
    return packed.select("key", "chunk", "n", F.sha2("stream", 256).alias("sha256"), F.octet_length("stream").alias("bytes"))


@query(f"WITH {_tensors_sql(7)} SELECT key, idx, code + 63 AS code FROM x")
def unpacked_tensors(spark, sf_dir):
    """Codes of 7 bits, packed and unpacked."""
    codes = tensors(spark, sf_dir, 7)[0].withColumn("code", F.col("code") + 63)
    return codec.bit_unpacked(codec.packed_chunks(codes, ["key"], "idx", "code", 7), ["key"], 7)


def _residuals_sql(bits: int) -> str:
    guess = f"round_even(b * {(1 << (bits - 1)) - 1} / 127.0, 0)" if bits < 8 else "greatest(least(round_even(b * (CASE WHEN scale <> 0 THEN s / scale ELSE 1.0 END), 0), 127.0), -127.0)"
    return f"""WITH {_tensors_sql(bits)}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY b, idx) - 1 AS place FROM x)
SELECT key, 'original-residual' AS method, idx AS place, CAST((code - b + 256) % 256 AS INT) AS byte FROM o
UNION ALL SELECT key, 'scale-context-residual', place, CAST((code - CAST({guess} AS INT) + 256) % 256 AS INT) FROM o"""


@query(_residuals_sql(8))
def context_residuals(spark, sf_dir):
    """Both layouts of 8-bit codes before they are compressed."""
    return codec.residual_layouts(*tensors(spark, sf_dir))


@query(_residuals_sql(7))
def narrow_context_residuals(spark, sf_dir):
    """Both layouts of 7-bit codes, predicted in their own range."""
    return codec.residual_layouts(*tensors(spark, sf_dir, 7), bits=7)


@query(f"WITH {_tensors_sql()} SELECT key, idx, code, round(scale, 6) AS scale FROM x")
def context_codec(spark, sf_dir):
    """8-bit tensors coded against their base, the smaller layout kept, decoded and checked."""
    target, base = map(settled, tensors(spark, sf_dir))  # each is read many times
    payload, manifest = codec.encode_delta(target, base)
    return _rounded(codec.decode_delta(payload, manifest, base, target.select("key", "idx", "scale")))


@query(f"WITH {_tensors_sql(7)} SELECT key, idx, code, round(scale, 6) AS scale FROM x")
def narrow_context_codec(spark, sf_dir):
    """7-bit tensors coded against an 8-bit base, decoded and checked."""
    target, base = map(settled, tensors(spark, sf_dir, 7))
    payload, manifest = codec.encode_delta(target, base, 7)
    return _rounded(codec.decode_delta(payload, manifest, base, target.select("key", "idx", "scale"), 7))


@query(f"""WITH {_tensors_sql()}, c AS (SELECT key, idx // 65536 AS chunk, count(*) AS n, sha256(unhex(string_agg(printf('%02x', (code + 256) % 256), '' ORDER BY idx))) AS h FROM x GROUP BY ALL)
SELECT key, CAST(sum(n) AS BIGINT) AS elements, sha256(string_agg(h, '' ORDER BY chunk)) AS sha256 FROM c GROUP BY key""")
def tensor_manifest(spark, sf_dir):
    """Elements and hash of every tensor, from the hashes of its chunks."""
    return codec.tensor_hashes(tensors(spark, sf_dir)[0])


_WIDE = "v AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY vec_id, i) - 1 AS idx, CAST(round_even(w * 10000, 0) AS BIGINT) AS value, count(*) OVER (PARTITION BY key) AS n FROM e)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = codec.numbered(weights(spark, sf_dir).drop("v"), ["key"], ["vec_id", "i"])
    return numbered.select("key", "idx", F.rint(F.col("w") * 10000).cast("long").alias("value"))


@query(f"""WITH {_tensors_sql()}, {_WIDE}, p AS (SELECT key, idx, n, k, CAST((value >> (8 * k)) & 255 AS INT) AS byte FROM v, range(2) r(k))
SELECT key, 'identity' AS method, idx * 2 + k AS place, byte FROM p UNION ALL SELECT key, 'byteplanes', k * n + idx, byte FROM p""")
def byte_planes(spark, sf_dir):
    """Numbers of two bytes, value by value and plane by plane."""
    return codec.byte_layouts(_wide(spark, sf_dir), 2)


@query(f"WITH {_tensors_sql()}, {_WIDE} SELECT key, idx, value FROM v")
def byte_plane_codec(spark, sf_dir):
    """The smaller layout of two-byte numbers, compressed, inflated and joined again."""
    payload = codec.smallest(codec.byte_layouts(_wide(spark, sf_dir), 2))
    return codec.from_layout(codec.layout_bytes(payload), 2)
