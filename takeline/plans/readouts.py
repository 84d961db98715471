"""Queries over fitted readout heads; the SQL finds the same solution by plain gradient descent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.operators import heads
from takeline.plans.catalogue import _read, _rounded, query

L2 = 0.2
GROUPS = 3
CLASSES = 10


def readout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, y, grp, x``: three numbers of each embedding, its label, and one of three groups."""
    e = _read(spark, sf_dir, "embeddings").where("label is not null")
    return e.select("vec_id", F.col("label").alias("y"), (F.col("vec_id") % GROUPS).cast("int").alias("grp"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("x"))


#: Fits ``f`` without group ``f`` (``GROUPS``: on all rows): weights ``w`` by fit, class and feature (3: the bias), then each row's shares.
#: Descent on a loss whose curvature lies between L2 and about 2.2 converges by a factor of 0.9 a step.
_FITS = f"""RECURSIVE e AS (
  SELECT vec_id, label AS y, vec_id % {GROUPS} AS g, j, CASE WHEN j < 3 THEN CAST(embedding[j + 1] AS DOUBLE) ELSE 1.0 END AS v FROM embeddings, range(4) r(j) WHERE label IS NOT NULL
), fits AS (SELECT range AS f FROM range({GROUPS + 1})), m AS (
  SELECT f, j, CASE WHEN j < 3 THEN avg(v) ELSE 0 END AS mean, CASE WHEN j < 3 AND stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS scale FROM e, fits WHERE g <> f GROUP BY f, j
), x AS MATERIALIZED (
  SELECT f, vec_id, any_value(y) AS y, any_value(g) AS g, list((v - mean) / scale ORDER BY j) AS v FROM e JOIN m USING (j) GROUP BY f, vec_id
), c AS (SELECT DISTINCT f, y AS c FROM x WHERE g <> f), n AS (SELECT f, count(*) AS n FROM x WHERE g <> f GROUP BY f),
w AS (
  SELECT 0 AS it, f, c, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS w FROM c
  UNION ALL
  SELECT it + 1, f, c, [w[1] - 0.45 * (g1 / n + {L2} * w[1]), w[2] - 0.45 * (g2 / n + {L2} * w[2]), w[3] - 0.45 * (g3 / n + {L2} * w[3]), w[4] - 0.45 * g4 / n] FROM (
    SELECT it, f, c, w, sum(d * v[1]) AS g1, sum(d * v[2]) AS g2, sum(d * v[3]) AS g3, sum(d * v[4]) AS g4 FROM (
      SELECT it, f, c, w, v, z / sum(z) OVER (PARTITION BY f, vec_id) - CAST(y = c AS INT) AS d FROM (
        SELECT it, w.f, c, w, x.vec_id, y, v, exp(w[1] * v[1] + w[2] * v[2] + w[3] * v[3] + w[4] * v[4]) AS z FROM w JOIN x ON x.f = w.f AND x.g <> x.f WHERE it < 600)
    ) GROUP BY it, f, c, w
  ) JOIN n USING (f)
), found AS (SELECT f, c, w FROM w WHERE it = 600)"""

_ANSWERS = """z AS (SELECT found.f, x.vec_id, x.y, x.g, c, exp(w[1] * v[1] + w[2] * v[2] + w[3] * v[3] + w[4] * v[4]) AS z FROM found JOIN x USING (f)
), p AS (SELECT f, vec_id, y, g, c, z / sum(z) OVER (PARTITION BY f, vec_id) AS p FROM z)"""


@query(f"""WITH {_FITS} SELECT CAST(c AS INT) AS cls, CAST(j - 1 AS INT) AS feature, round(w[j], 4) + 0.0 AS weight FROM found, range(1, 5) r(j) WHERE f = {GROUPS}""")
def head_weights(spark, sf_dir):
    """Weights and bias (feature 3) of a head fitted on all rows, to four places."""
    head = heads.fit(readout_rows(spark, sf_dir), L2)
    rows = [(int(c), j, float(round(v, 4)) + 0.0) for c, w, b in zip(head.classes, head.weight, head.bias, strict=True) for j, v in enumerate([*w, b])]
    return spark.createDataFrame(rows, "cls int, feature int, weight double")


def _search_sql() -> str:
    """Tables ``t0 .. t4`` of the best temperature (log) by member, on ever finer grids."""
    points, sql, low, high, step = heads.SEARCH_POINTS - 1, "", "ln(0.25::DOUBLE)", "ln(4.0::DOUBLE)", float("inf")
    width, k = 2.772588722239781, 0
    source = f"SELECT range AS f, {low} AS low, {high} AS high FROM range({GROUPS})"
    while step > heads.SEARCH_STEP:
        step = width / points
        sql += f""", s{k} AS ({source}), l{k} AS (
  SELECT s.f, s.low, s.high, i, avg(-ln(greatest(CASE WHEN p.c = p.y THEN q END, 1e-12))) AS loss FROM (
    SELECT s.f, s.low, s.high, i, p.vec_id, p.c, p.y, exp(ln(greatest(p, 1e-12)) / exp(low + (high - low) / {points} * i)) / sum(exp(ln(greatest(p, 1e-12)) / exp(low + (high - low) / {points} * i))) OVER (PARTITION BY s.f, i, p.vec_id) AS q
    FROM s{k} s JOIN p ON p.f = s.f AND p.g = s.f, range({points + 1}) r(i)) AS p, s{k} s WHERE s.f = p.f AND p.c = p.y GROUP BY s.f, s.low, s.high, i
), t{k} AS (SELECT f, any_value(low) AS low, any_value(high) AS high, arg_min(i, loss) AS i FROM l{k} GROUP BY f)"""
        source = f"SELECT f, low + (high - low) / {points} * greatest(i - 1, 0) AS low, low + (high - low) / {points} * least(i + 1, {points}) AS high FROM t{k}"
        width, k = 2 * step, k + 1
    return sql + f", t AS (SELECT f, exp(low + (high - low) / {points} * i) AS t FROM t{k - 1})"


@query(f"""WITH {_FITS}, {_ANSWERS}{_search_sql()}, q AS (SELECT p.f, vec_id, c, exp(ln(greatest(p, 1e-12)) / t) AS z FROM p JOIN t USING (f))
SELECT vec_id, CAST(c AS INT) AS cls, round(avg(s), 3) AS p FROM (SELECT vec_id, c, z / sum(z) OVER (PARTITION BY f, vec_id) AS s FROM q) GROUP BY vec_id, c""")
def head_bag(spark, sf_dir):
    """Mean of three heads, each fitted without one group and set to the temperature its rows ask for, to three places."""
    rows = readout_rows(spark, sf_dir)
    members = heads.fit_bag(rows, L2, CLASSES, GROUPS)
    out = heads.bagged(rows, members, CLASSES).select("vec_id", F.posexplode("p").alias("cls", "p"))
    return _rounded(out, 3)
