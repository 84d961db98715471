"""Queries over fused, decoded and scored probabilities, thinned takes, gates and tables of runs, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeline.functions import columns as C
from takeline.operators import decode, evaluate, fusion, integrity, sampling, spans, studies
from takeline.plans.catalogue import GAP_MS, LONG_SQL, PROBS_SQL, TAKES_SQL, _read, _rounded, _takes_sql, embedding_probs, embedding_takes, event_takes, query, take_rows
from takeline.sources import files
from takeline.sources.settled import settled, shared_folder
from takeline.streaming import takes


def _u(text: str) -> str:
    """The draw of ``sampling.draw`` in SQL; ``text``: an SQL expression of the parts joined by bars."""
    return f"CAST(('0x' || substr(sha256({text}), 1, 12)) AS BIGINT) / 281474976710656.0"


@query(f"""WITH {LONG_SQL}, m AS (SELECT vec_id, cls, (3.0 * p + q) / 4.0 AS v FROM lg) SELECT vec_id, CAST(cls AS INT) AS cls, round(v / sum(v) OVER (PARTITION BY vec_id), 6) AS p FROM m""")
def mean_of_passes(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    rows = d.select("clip_id", F.lit(3.0).alias("m"), F.posexplode("p").alias("cls", "p")).unionByName(d.select("clip_id", F.lit(1.0).alias("m"), F.posexplode("q").alias("cls", "p")))
    return _rounded(fusion.fuse_members(rows, F.col("m"), "arithmetic").select(F.col("clip_id").cast("long").alias("vec_id"), "cls", "p"))


@query(f"""WITH {LONG_SQL}, a AS (SELECT *, vec_id % 2 = 0 AS i, vec_id % 3 = 0 AS d FROM lg)
SELECT vec_id, CAST(cls AS INT) AS cls, round(CASE WHEN i OR d THEN 0.8 * p + 0.2 * (CASE WHEN i THEN q ELSE 0 END + CASE WHEN d THEN (p + q) / 2 ELSE 0 END) / (CAST(i AS INT) + CAST(d AS INT)) ELSE p END, 6) AS p FROM a""")
def available_fusion(spark, sf_dir):
    d, v = embedding_probs(spark, sf_dir), F.col("vec_id")
    half = F.zip_with("p", "q", lambda a, b: (a + b) / 2)
    fused = fusion.available_average(F.col("p"), [(v % 2 == 0, F.col("q")), (v % 3 == 0, half)])
    return _rounded(d.select("vec_id", F.posexplode(fused).alias("cls", "p")))


@query("""SELECT CAST(vec_id AS VARCHAR) AS clip_id, 'duplicate id' AS reason FROM embeddings WHERE vec_id % 10 = 0
UNION ALL SELECT CAST(vec_id AS VARCHAR), 'not a distribution' FROM embeddings WHERE vec_id % 7 IN (1, 2, 3)""")
def probability_faults(spark, sf_dir):
    """Sums that are off, negative numbers, missing numbers, and ids that occur twice."""
    d, v = embedding_probs(spark, sf_dir).select("vec_id", "clip_id", "p"), F.col("vec_id")
    bad = F.when(v % 7 == 1, F.transform("p", lambda x: x * 1.1)).when(v % 7 == 2, F.transform("p", lambda x, i: F.when(i == 0, -x).otherwise(x))).when(v % 7 == 3, F.transform("p", lambda x, i: F.when(i == 0, float("nan")).otherwise(x))).otherwise(F.col("p"))
    rows = d.select("clip_id", bad.alias("p")).unionByName(d.where("vec_id % 10 = 0").select("clip_id", F.array(*[F.lit(0.1)] * 10).alias("p")))
    return fusion.invalid(rows, 10)


@query(f"""WITH {LONG_SQL} SELECT vec_id, CAST(cls AS INT) AS cls, round(p, 6) AS probs, CASE WHEN cls = label THEN 1.0 ELSE 0.0 END::DOUBLE AS onehot, round(0.5 * p + CASE WHEN cls = label THEN 0.5 ELSE 0 END, 6) AS half,
  round(CASE WHEN cls = label THEN 0.9 ELSE 0 END + 0.01, 6)::DOUBLE AS smoothed FROM lg""")
def soft_targets(spark, sf_dir):
    p, y = F.col("p"), F.col("label")
    kinds = [C.soft_target(p, y, k) for k in ("probs", "onehot", "half")] + [C.smoothed_onehot(y, 10, 0.1)]
    rows = embedding_probs(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(*(k.alias(n) for k, n in zip(kinds, ("a", "b", "c", "d"), strict=True)))).alias("cls", "s"))
    return _rounded(rows.select("vec_id", "cls", *(F.col(f"s.{a}").alias(n) for a, n in (("a", "probs"), ("b", "onehot"), ("c", "half"), ("d", "smoothed")))))


@query(f"""WITH {PROBS_SQL}, r AS (SELECT vec_id, vec_id // 8 AS step, p, q, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS w, lead(p) OVER (PARTITION BY vec_id // 2 ORDER BY vec_id) AS a, lag(p) OVER (PARTITION BY vec_id // 2 ORDER BY vec_id) AS b FROM em),
o AS (SELECT *, coalesce(a, b, p) AS op, CASE WHEN (vec_id // 2 * 4 + 1 - vec_id) % 3 = 0 THEN 0.5 ELSE 1.0 END AS ow FROM r),
m AS (SELECT step, list_sum(list_transform(range(1, 11), lambda i: (0.7 * w * p[i] + 0.3 * ow * op[i]) * ln(greatest(q[i], 1e-12)))) AS s FROM o)
SELECT step, round(-sum(s) * 20 / 300.0, 5) AS loss FROM m GROUP BY step""")
def mixed_loss(spark, sf_dir):
    """Weighted soft cross-entropy of rows mixed pairwise, normalised by the epoch's mass."""
    d, v = embedding_probs(spark, sf_dir), F.col("vec_id")
    other = F.floor(v / 2) * 4 + 1 - v  # its neighbour of two
    weight = lambda i: F.when(i % 3 == 0, 0.5).otherwise(1.0)
    pair = d.join(d.select(other.alias("vec_id"), F.col("p").alias("o")), "vec_id", "left").withColumn("o", F.coalesce("o", "p"))
    mass = C.mixed_mass(F.col("p"), weight(v), F.col("o"), weight(other), 0.7)
    rows = pair.select(F.floor(v / 8).alias("step"), F.explode(F.zip_with(mass, C.logs(F.col("q")), lambda m, z: F.struct(m.alias("mass"), z.alias("logp")))).alias("s"))
    return _rounded(evaluate.soft_cross_entropy(rows.select("step", "s.mass", "s.logp"), 20, 300.0), 5)


@query(f"""WITH {LONG_SQL}, z AS (SELECT vec_id, cls, exp(ln(greatest(p, 1e-12)) / 2.0) AS a, exp(ln(greatest(q, 1e-12)) / 0.5) AS b FROM lg)
SELECT vec_id, CAST(cls AS INT) AS cls, round((a / sum(a) OVER w + b / sum(b) OVER w) / 2, 6) AS p FROM z WINDOW w AS (PARTITION BY vec_id)""")
def bagged_heads(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    return _rounded(d.select("vec_id", F.posexplode(C.bag([(F.col("p"), 2.0), (F.col("q"), 0.5)])).alias("cls", "p")))


@query("""WITH h AS (SELECT vec_id, f, k, list_sum(list_transform(range(1, 9), lambda i: (CAST(embedding[CASE WHEN f = 0 THEN i ELSE 9 - i END] AS DOUBLE) - 0.01 * i) / (0.5 + 0.1 * i) * ((k + 1) * i % 5 - 2))) + 0.1 * k AS z FROM embeddings, range(0, 2) a(f), range(0, 3) b(k)),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, f)) AS e FROM h), p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id, f) AS p FROM e)
SELECT vec_id, CAST(c AS INT) AS cls, round(coalesce(avg(p), 0), 6) AS p FROM (SELECT vec_id, c FROM embeddings, range(0, 6) t(c)) LEFT JOIN p USING (vec_id) WHERE false GROUP BY ALL
UNION ALL SELECT x.vec_id, CAST(c AS INT), round(coalesce(m, 0), 6) FROM (SELECT vec_id, c FROM embeddings, range(0, 6) t(c)) x LEFT JOIN (SELECT vec_id, CASE k WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE 3 END AS c, avg(p) AS m FROM p GROUP BY ALL) y USING (vec_id, c)""")
def head_flips(spark, sf_dir):
    """A three-class head on standardised features, averaged over two flips and put at its classes 4, 0 and 3 of six."""
    lits = lambda f: F.array(*(F.lit(float(f(i))) for i in range(1, 9)))
    x = F.transform(F.slice("embedding", 1, 8), lambda z: z.cast("double"))

    def head(values):
        s = C.standardise(values, lits(lambda i: 0.01 * i), lits(lambda i: 0.5 + 0.1 * i))
        return C.softmax(F.array(*(C.linear(s, lits(lambda i, k=k: (k + 1) * i % 5 - 2), F.lit(0.1 * k)) for k in range(3))))

    both = F.zip_with("a", "b", lambda u, w: (u + w) / 2)
    d = _read(spark, sf_dir, "embeddings").select("vec_id", head(x).alias("a"), head(F.reverse(x)).alias("b"))
    return _rounded(d.select("vec_id", F.posexplode(C.scattered(both, [4, 0, 3], 6)).alias("cls", "p")))


@query(f"""WITH {_takes_sql(2)}, s AS (SELECT a.take_id, a.cls AS l0, b.cls AS l1, a.lp + b.lp AS score FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls),
m AS (SELECT take_id, l0, l1 FROM s QUALIFY row_number() OVER (PARTITION BY take_id ORDER BY score DESC, l0, l1) = 1)
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN l0 ELSE l1 END AS label FROM embeddings JOIN m ON take_id = vec_id // 2""")
def assignment_pairs(spark, sf_dir):
    """Without a prior: the assignment with the largest sum of logs."""
    out = decode.decode_takes(embedding_takes(spark, sf_dir, 2), embedding_probs(spark, sf_dir), None, "assign", classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


@query(f"""WITH {_takes_sql(3)}, s AS (SELECT a.take_id, a.cls AS l0, b.cls AS l1, c.cls AS l2, a.lp + b.lp + c.lp AS score FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls JOIN tr c ON c.take_id = a.take_id AND c.position = 2 AND c.cls <> a.cls AND c.cls <> b.cls),
m AS (SELECT take_id, [l0, l1, l2] AS l FROM s QUALIFY row_number() OVER (PARTITION BY take_id ORDER BY score DESC, l0, l1, l2) = 1)
SELECT vec_id, l[vec_id % 3 + 1] AS label FROM embeddings JOIN m ON take_id = vec_id // 3""")
def assignment_triples(spark, sf_dir):
    """The best assignment over all distinct labels of whole takes of three."""
    takes = embedding_takes(spark, sf_dir, 3)
    takes = takes.join(takes.groupBy("take_id").count().where("count = 3"), "take_id", "left_semi")
    out = decode.decode_takes(takes, embedding_probs(spark, sf_dir), None, "assign", classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


def drill_prior(fold: int = 0) -> np.ndarray:
    a, b = np.arange(10)[:, None], np.arange(10)[None, :]
    counts = 1.0 + (3 * a + b + fold) % 7
    return counts / counts.sum(1, keepdims=True)


PRIOR_SQL = "pr AS (SELECT f, a, b, (1 + (3 * a + b + f) % 7) / sum(1 + (3 * a + b + f) % 7) OVER (PARTITION BY f, a) AS t FROM range(0, 4) x(f), range(0, 10) y(a), range(0, 10) z(b))"


@query(f"""WITH {_takes_sql(2)}, {PRIOR_SQL}, s AS (SELECT a.take_id, a.cls AS l0, b.cls AS l1, a.lp + b.lp + 0.75 * ln(t) AS score FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls JOIN pr ON pr.f = 0 AND pr.a = a.cls AND pr.b = b.cls),
m AS (SELECT take_id, l0, l1 FROM s QUALIFY row_number() OVER (PARTITION BY take_id ORDER BY score DESC, l0, l1) = 1)
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN l0 ELSE l1 END AS label FROM embeddings JOIN m ON take_id = vec_id // 2""")
def map_pairs(spark, sf_dir):
    """Beams of takes of two under an uneven prior: exact there."""
    out = decode.decode_takes(embedding_takes(spark, sf_dir, 2), embedding_probs(spark, sf_dir), drill_prior(), classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


@query(f"""WITH {_takes_sql(2)}, {PRIOR_SQL}, j AS (SELECT a.take_id, a.cls AS c0, b.cls AS c1, exp(a.lp + b.lp + 0.75 * ln(t)) AS w FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls JOIN pr ON pr.f = 0 AND pr.a = a.cls AND pr.b = b.cls),
x AS (SELECT 2 * take_id AS vec_id, c0 AS cls, w FROM j UNION ALL SELECT 2 * take_id + 1, c1, w FROM j), m AS (SELECT vec_id, cls, sum(w) AS w FROM x GROUP BY ALL)
SELECT vec_id, cls AS label FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, cls) = 1""")
def marginal_pairs(spark, sf_dir):
    """Each clip's most probable class over all distinct label rows of its take."""
    out = decode.decode_takes(embedding_takes(spark, sf_dir, 2), embedding_probs(spark, sf_dir), drill_prior(), "marginal", classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


def _prior_beams_sql(size: int, width: int, exact: int) -> str:
    """Beams under the uneven prior: tables ``b0 ..`` of label rows; takes of at most ``exact`` clips keep them all."""
    step = "b{k} AS (SELECT b.take, list_append(b.c, lp.cls) AS c, b.s + lp.l + 0.75 * ln(t) AS s FROM b{j} b JOIN n USING (take) JOIN lp ON lp.take = b.take AND lp.pos = {k} JOIN pr ON pr.f = 0 AND pr.a = b.c[{k}] AND pr.b = lp.cls WHERE NOT list_contains(b.c, lp.cls) QUALIFY row_number() OVER (PARTITION BY b.take ORDER BY b.s + lp.l + 0.75 * ln(t) DESC) <= CASE WHEN n.n <= {exact} THEN 1000 ELSE {width} END)"
    steps = ",\n".join(step.format(k=k, j=k - 1, width=width, exact=exact) for k in range(1, size))
    last = " UNION ALL ".join(f"SELECT b.take, b.c, b.s FROM b{k} b JOIN n ON n.take = b.take AND n.n = {k + 1}" for k in range(size))
    return f"""{LONG_SQL}, {PRIOR_SQL}, lp AS (SELECT vec_id // {size} AS take, vec_id % {size} AS pos, CAST(cls AS INT) AS cls, ln(greatest(p, 1e-12)) AS l FROM lg), n AS (SELECT take, max(pos) + 1 AS n FROM lp GROUP BY take),
b0 AS (SELECT take, [cls] AS c, l AS s FROM lp WHERE pos = 0), {steps}, f AS ({last})"""


@query(f"""WITH {_prior_beams_sql(5, 64, 0)}, m AS (SELECT take, c FROM f QUALIFY row_number() OVER (PARTITION BY take ORDER BY s DESC, c) = 1)
SELECT vec_id, c[vec_id % 5 + 1] AS label FROM embeddings JOIN m ON take = vec_id // 5""")
def prior_beams(spark, sf_dir):
    """Takes of five under an uneven prior, by beams."""
    out = decode.decode_takes(embedding_takes(spark, sf_dir, 5), embedding_probs(spark, sf_dir), drill_prior(), classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


@query(f"""WITH {_prior_beams_sql(5, 256, 3)}, w AS (SELECT take, c, exp(s - max(s) OVER (PARTITION BY take)) AS w FROM f), m AS (SELECT take, i, c[i + 1] AS cls, sum(w) AS w FROM w, range(5) r(i) WHERE i < len(c) GROUP BY ALL)
SELECT vec_id, cls AS label FROM embeddings JOIN m ON take = vec_id // 5 AND i = vec_id % 5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, cls) = 1""")
def long_marginals(spark, sf_dir):
    """Each clip's most probable class over the final beam of its take of five."""
    out = decode.decode_takes(embedding_takes(spark, sf_dir, 5), embedding_probs(spark, sf_dir), drill_prior(), "marginal", classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label")


@query(f"""WITH {PROBS_SQL} SELECT CAST(row_number() OVER (ORDER BY vec_id DESC) AS INT) AS row_no, 'test\\clips/' || vec_id || '/' AS path, CAST(list_position(p, list_max(p)) - 1 AS INT) AS prediction FROM em""")
def submission_rows(spark, sf_dir):
    """Labels in the template's order, found by the last part of its paths; every row must have one."""
    d = embedding_probs(spark, sf_dir)
    rows = spans.ranked(d.select((-F.col("vec_id")).alias("o"), "clip_id"), ["o"], "i")
    template = rows.select((F.col("i") + 1).cast("int").alias("row_no"), F.concat(F.lit("test\\clips/"), "clip_id", F.lit("/")).alias("path"))
    return decode.submission(template, d.select("clip_id", C.argmax(F.col("p")).alias("label")))


@query(f"""WITH {PROBS_SQL} SELECT CAST(vec_id * 2 AS INT) AS row_no, CAST(vec_id AS VARCHAR) AS clip_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE CAST(list_position(p, list_max(p)) - 1 AS INT) END AS label FROM em""")
def labels_to_rows(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    rows = d.select((F.col("vec_id") * 2).cast("int").alias("row_no"), "clip_id")
    return decode.labels_of_rows(rows, d.where("vec_id % 3 <> 0").select("clip_id", C.argmax(F.col("p")).alias("label")))


@query("""WITH n AS (SELECT count(*) AS clips, count(*) FILTER (vec_id % 5 <> 0) AS known, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 4 <> 0) AS covered FROM embeddings),
t AS (SELECT vec_id // 13 AS t, count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 4 <> 0 GROUP BY 1), o AS (SELECT count(*) FILTER (n > 7) AS over, coalesce(sum(n) FILTER (n <= 7), 0) AS fits FROM t)
SELECT clips, (SELECT count(DISTINCT vec_id // 13) FROM embeddings WHERE vec_id % 4 <> 0) AS takes, covered / clips AS coverage, true AS fell_back, CAST(known - fits AS BIGINT) AS filled_by_argmax, clips - known AS missing, over AS oversize_takes FROM n, o""")
def fallback_report(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    takes = embedding_takes(spark, sf_dir, 13).where("cast(clip_id as long) % 4 <> 0")
    return decode.fallback_report(d.select("clip_id"), takes, d.where("vec_id % 5 <> 0").select("clip_id", "p"), classes=7)


def study(spark: SparkSession, sf_dir: str, weights: tuple[float, ...] | None, probabilities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Takes of two, whole and thinned three times, two configurations decoded under their fold's prior (no weights: only asked for); and the truth."""
    v, d = F.col("vec_id"), embedding_probs(spark, sf_dir)
    takes = embedding_takes(spark, sf_dir, 2).withColumn("take_size", F.count("*").over(Window.partitionBy("take_id")).cast("int"))
    sizes = spark.createDataFrame([(0.0, 0.4, 1), (0.4, 1.0, 2)], "u_low double, u_high double, size int")
    primary = takes.where("cast(take_id as long) % 3 = 0")
    folds = d.select("clip_id", (F.floor(v / 2) % 4).cast("int").alias("fold"))
    if probabilities is None:
        probabilities = d.select(F.lit("A").alias("config"), "clip_id", "p").unionByName(d.select(F.lit("B").alias("config"), "clip_id", F.col("q").alias("p")))
    windows = studies.populations(takes, sizes, 3, 11, primary)
    if weights is None:
        return studies.asked_windows(windows, probabilities, folds, 10), d
    done = studies.decode_windows(windows, probabilities, folds, {f: drill_prior(f) for f in range(4)}, weights, classes=10)
    return done, d.select("clip_id", F.col("label").alias("y"))


_TWO = "SELECT 'A' AS config, vec_id, CAST(cls AS INT) AS cls, ln(greatest(p, 1e-12)) AS lp FROM lg UNION ALL SELECT 'B', vec_id, CAST(cls AS INT), ln(greatest(q, 1e-12)) FROM lg"


def study_sql(weights: tuple[float, ...], configs: str = _TWO) -> str:
    values = ", ".join(f"({w}::DOUBLE)" for w in weights)
    return f"""{LONG_SQL}, {PRIOR_SQL}, wt AS (SELECT w FROM (VALUES {values}) t(w)),
  cf AS ({configs}),
  ag AS (SELECT config, vec_id, cls AS raw FROM cf QUALIFY row_number() OVER (PARTITION BY config, vec_id ORDER BY lp DESC, cls) = 1),
  sc AS (SELECT a.config, w, a.vec_id // 2 AS take, a.cls AS l0, b.cls AS l1, a.lp + b.lp + w * ln(t) AS score FROM cf a JOIN cf b ON a.config = b.config AND b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 AND a.cls <> b.cls JOIN pr ON pr.f = a.vec_id // 2 % 4 AND pr.a = a.cls AND pr.b = b.cls, wt),
  bt AS (SELECT config, w, take, l0, l1 FROM sc QUALIFY row_number() OVER (PARTITION BY config, w, take ORDER BY score DESC, l0, l1) = 1),
  dr AS (SELECT take, r, {_u("'11|size|' || r || '|' || take")} AS us, {_u("'11|start|' || r || '|' || take")} AS ut FROM (SELECT DISTINCT vec_id // 2 AS take FROM embeddings), range(0, 3) x(r)),
  wn AS (SELECT 'full_take' AS population, 0 AS repeat, vec_id, vec_id // 2 AS take, false AS one FROM embeddings
    UNION ALL SELECT 'primary', 0, vec_id, vec_id // 2, false FROM embeddings WHERE vec_id // 2 % 3 = 0
    UNION ALL SELECT 'designated', r, vec_id, take, us < 0.4 FROM embeddings JOIN dr ON take = vec_id // 2 WHERE us >= 0.4 OR vec_id % 2 = floor(ut * 2)),
  st AS (SELECT wn.population, wn.repeat, wn.take, wn.take % 4 AS fold, wn.vec_id, ag.config, wt.w AS weight, raw, CASE WHEN one THEN raw WHEN wn.vec_id % 2 = 0 THEN l0 ELSE l1 END AS label, e.label AS y
    FROM wn JOIN ag USING (vec_id) JOIN embeddings e USING (vec_id), wt JOIN bt ON bt.w = wt.w WHERE bt.config = ag.config AND bt.take = wn.take)"""


@query(f"""WITH {study_sql((0.0, 0.75))}, e AS (SELECT config, weight, population, fold, repeat, count(*) AS n, avg(CAST(raw = y AS INT)) AS raw, avg(CAST(label = y AS INT)) AS decoded FROM st GROUP BY ALL)
SELECT config, weight, population, CAST(fold AS INT) AS fold, CAST(sum(n) AS BIGINT) AS n, round(avg(raw), 6) AS raw, round(avg(decoded), 6) AS decoded FROM e GROUP BY config, weight, population, fold""")
def population_scores(spark, sf_dir):
    """Configurations over whole takes, a subset and thinnings, at two prior weights."""
    return _rounded(studies.population_scores(*study(spark, sf_dir, (0.0, 0.75))))


@query(f"""WITH {study_sql((0.75,))}, w AS (SELECT config, population, repeat, take, string_agg(vec_id, ',' ORDER BY vec_id) AS clips FROM st GROUP BY ALL)
SELECT config, count(*) AS windows, count(DISTINCT clips) AS decoded FROM w GROUP BY config""")
def window_memo(spark, sf_dir):
    """Windows asked for, and those of them that are decoded."""
    return study(spark, sf_dir, None)[0].groupBy("config").agg(F.count("*").alias("windows"), F.count_distinct("content").alias("decoded"))


@query(f"""WITH {study_sql((0.0, 0.25, 0.75, 1.5))} SELECT config, weight, CAST(repeat AS INT) AS repeat, round(avg(CAST(label = y AS INT)), 6) AS accuracy FROM st WHERE population = 'designated' GROUP BY config, weight, repeat""")
def thinned_curve(spark, sf_dir):
    """Thinnings at several prior weights, paired."""
    done, truth = study(spark, sf_dir, (0.0, 0.25, 0.75, 1.5))
    return _rounded(studies.thinned_curve(done.where("population = 'designated'"), truth))


_PAIRED = f"""{study_sql((0.75,))}, pa AS (SELECT a.population, a.repeat, a.fold, a.vec_id, a.y, a.label AS parent, a.raw AS parent_raw, b.label, b.raw FROM st a JOIN st b ON a.config = 'A' AND b.config = 'B' AND a.population = b.population AND a.repeat = b.repeat AND a.vec_id = b.vec_id),
  ge AS (SELECT population, fold, repeat, avg(CAST(raw = y AS INT) - CAST(parent_raw = y AS INT)) AS raw, avg(CAST(label = y AS INT) - CAST(parent = y AS INT)) AS decoded, count(*) FILTER (label = y AND parent <> y) AS rescued, count(*) FILTER (label <> y AND parent = y) AS lost FROM pa GROUP BY ALL),
  ga AS (SELECT population, CAST(fold AS INT) AS fold, 100 * avg(raw) AS raw, 100 * avg(decoded) AS decoded, CAST(sum(rescued) AS BIGINT) AS rescued, CAST(sum(lost) AS BIGINT) AS lost FROM ge GROUP BY population, fold)"""


_SETTINGS = (("image", "p", 1.0, False), ("blend", "p", 5.0, False), ("blend", "q", 3.0, False), ("ladder", "p", 17.0, False), ("ladder", "q", 3.0, False), ("product", "p", 5.0, True), ("product", "q", 3.0, True))
_WEIGHTS = (0.0, 0.25, 0.75, 1.5)
_BLENDS = """SELECT 'image' AS config, vec_id, CAST(cls AS INT) AS cls, ln(greatest(p, 1e-12)) AS lp FROM lg UNION ALL SELECT 'blend', vec_id, CAST(cls AS INT), ln(greatest(p * (5 / 8.0::DOUBLE) + q * (3 / 8.0::DOUBLE), 1e-12)) FROM lg
  UNION ALL SELECT 'ladder', vec_id, CAST(cls AS INT), ln(greatest(p * (17 / 20.0::DOUBLE) + q * (3 / 20.0::DOUBLE), 1e-12)) FROM lg
  UNION ALL SELECT 'product', vec_id, CAST(cls AS INT), ln(greatest(g / sum(g) OVER (PARTITION BY vec_id), 1e-12)) FROM (SELECT *, exp(ln(greatest(p, 1e-12)) * 5 / 8 + ln(greatest(q, 1e-12)) * 3 / 8) AS g FROM lg)"""
_CURVES = f"""{study_sql(_WEIGHTS, _BLENDS)}, cu AS (SELECT config, weight, population, CAST(fold AS INT) AS fold, repeat, avg(CAST(label = y AS INT)) AS x FROM st GROUP BY ALL)"""


def fusion_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of members alone and put together, at every prior weight, over takes, a subset and thinnings."""
    d = embedding_probs(spark, sf_dir)
    members = d.select(F.lit("p").alias("member"), "clip_id", "p").unionByName(d.select(F.lit("q").alias("member"), "clip_id", F.col("q").alias("p")))
    settings = spark.createDataFrame(_SETTINGS, "config string, member string, weight double, geometric boolean")
    curves = studies.accuracy_curves(*study(spark, sf_dir, _WEIGHTS, studies.blends(members, settings)))
    return settled(curves)  # a row for each setting, and read several times


@query(f"""WITH {_CURVES}, m AS (SELECT config, population, weight, avg(x) AS x FROM cu GROUP BY ALL), b AS (SELECT config, population, weight, x FROM m QUALIFY row_number() OVER (PARTITION BY config, population ORDER BY round(x, 12) DESC, weight) = 1)
SELECT m.config, m.population, round(m.x, 6) AS stated, b.weight AS best_weight, round(b.x, 6) AS best FROM m JOIN b USING (config, population) WHERE m.weight = 0.75""")
def fusion_audit(spark, sf_dir):
    """Each way to put members together at the stated prior weight and at its best."""
    return _rounded(studies.best_weights(fusion_curves(spark, sf_dir), 0.75))


@query(f"""WITH {_CURVES} SELECT config, weight, population, fold, round(avg(x), 6) AS accuracy FROM cu GROUP BY config, weight, population, fold UNION ALL SELECT config, weight, population, NULL, round(avg(x), 6) FROM cu GROUP BY config, weight, population""")
def weight_curves(spark, sf_dir):
    """Accuracy by prior weight, each fold's and pooled."""
    return _rounded(studies.pooled_curves(fusion_curves(spark, sf_dir)))


@query(f"""WITH {_CURVES}, m AS (SELECT config, weight, avg(x) AS x FROM cu WHERE population = 'designated' GROUP BY ALL), b AS (SELECT config, weight FROM m QUALIFY row_number() OVER (PARTITION BY config ORDER BY round(x, 12) DESC, weight) = 1),
c AS (SELECT config, fold, repeat, x FROM cu JOIN b USING (config, weight) WHERE population = 'designated'), d AS (SELECT 'product over blend' AS contrast, g.x - a.x AS d FROM c g JOIN c a USING (fold, repeat) WHERE g.config = 'product' AND a.config = 'blend'
UNION ALL SELECT 'weight 0.25 over 0.75', g.x - a.x FROM cu g JOIN cu a USING (config, population, fold, repeat) WHERE g.config = 'blend' AND g.population = 'designated' AND g.weight = 0.25 AND a.weight = 0.75)
SELECT contrast, 'designated' AS population, count(*) AS pairs, round(avg(d), 6) + 0.0 AS mean, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, count(*) FILTER (d > 0) AS wins FROM d GROUP BY contrast""")
def fusion_shapes(spark, sf_dir):
    """Products against means, each at its best prior weight, and two weights of one, paired by fold and thinning."""
    curves = fusion_curves(spark, sf_dir)
    own = curves.where("config = 'blend' and population = 'designated'")
    shapes = studies.paired_curves(studies.at_best(curves, "product", "designated"), studies.at_best(curves, "blend", "designated")).withColumn("contrast", F.lit("product over blend"))
    weights = studies.paired_curves(own.where("weight = 0.25"), own.where("weight = 0.75")).withColumn("contrast", F.lit("weight 0.25 over 0.75"))
    return _rounded(shapes.unionByName(weights))


@query(f"""WITH {study_sql((0.75, 1.5))}, r AS (SELECT config, weight, population, fold, repeat, avg(CAST(raw = y AS INT)) AS raw, avg(CAST(label = y AS INT)) AS decoded FROM st WHERE population <> 'full_take' GROUP BY ALL),
e AS (SELECT population AS setting, fold, CASE WHEN config = 'A' THEN 'A' WHEN weight = 0.75 THEN 'B' ELSE 'B exact' END AS arm, avg(raw) AS raw, avg(decoded) AS decoded FROM r WHERE config = 'B' OR weight = 0.75 GROUP BY ALL),
l AS (SELECT setting, fold, 'raw' AS metric, max(raw) FILTER (arm = 'B') AS x, max(raw) FILTER (arm = 'A') AS p, max(raw) FILTER (arm = 'B exact') AS q FROM e GROUP BY ALL UNION ALL SELECT setting, fold, 'decoded', max(decoded) FILTER (arm = 'B'), max(decoded) FILTER (arm = 'A'), max(decoded) FILTER (arm = 'B exact') FROM e GROUP BY ALL),
g AS (SELECT setting, metric, count(*) AS folds, avg(100 * (x - p)) AS gain, count(*) FILTER (x > p) AS positive, avg(100 * (x - q)) AS cost, min(100 * (x - q)) AS worst FROM l GROUP BY ALL)
SELECT setting, metric, folds, round(gain, 6) AS gain, positive, round(cost, 6) AS cost, round(worst, 6) AS worst, (SELECT bool_and(folds = 4 AND gain > 0 AND cost >= -0.5 AND worst >= -1 AND (metric = 'raw' OR positive >= 3)) FROM g) AS eligible FROM g""")
def quantisation_gate(spark, sf_dir):
    """Two estimators' gains of B over A, and B's cost against itself at another prior weight."""
    scores = studies.population_scores(*study(spark, sf_dir, (0.75, 1.5))).where("population <> 'full_take' and (config = 'B' or weight = 0.75)")
    arm = F.when(F.col("config") == "A", "A").when(F.col("weight") == 0.75, "B").otherwise("B exact")
    return _rounded(evaluate.quantisation_gate(scores.select(F.col("population").alias("setting"), "fold", arm.alias("arm"), "raw", "decoded"), "B", "A", "B exact"))


_GRID = (0.0, 0.25, 0.75, 1.5)


@query(f"""WITH {study_sql(_GRID)}, ct AS (SELECT config, weight, vec_id % 11 AS subject, count(*) FILTER (label = y) AS hits, count(*) AS n FROM st WHERE population = 'designated' GROUP BY ALL),
sj AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT subject FROM ct)),
dw AS (SELECT r, j.i AS j, CAST(floor({_u("'5|' || r || '|' || j.i")} * k) AS BIGINT) AS i FROM sj j, range(0, 150) t(r)),
ea AS (SELECT r, config, weight, sum(hits) / sum(n) AS x FROM dw JOIN sj USING (i) JOIN ct USING (subject) GROUP BY ALL),
pt AS (SELECT config, weight, sum(hits) / sum(n) AS x FROM ct GROUP BY ALL),
d AS (SELECT ea.*, ea.x - p.x AS d, row_number() OVER (PARTITION BY ea.r ORDER BY ea.x DESC, ea.config, ea.weight) = 1 AS top FROM ea JOIN ea p ON p.r = ea.r AND p.config = 'A' AND p.weight = 0.75)
SELECT config, weight, round(any_value(pt.x), 6) AS accuracy, round(stddev_samp(d.x), 6) AS se, round(quantile_cont(d.x, 0.05), 6) AS low, round(quantile_cont(d.x, 0.95), 6) AS high,
  round(any_value(pt.x) - (SELECT x FROM pt WHERE config = 'A' AND weight = 0.75), 6) + 0.0 AS gain, round(stddev_samp(d), 6) AS gain_se, round(quantile_cont(d, 0.05), 6) + 0.0 AS gain_low, round(quantile_cont(d, 0.95), 6) + 0.0 AS gain_high, round(avg(CAST(d > 0 AS INT)), 6) AS positive, round(avg(CAST(top AS INT)), 6) AS best
FROM d JOIN pt USING (config, weight) GROUP BY config, weight""")
def paired_bootstrap(spark, sf_dir):
    """Two configurations at four prior weights under the same draws of subjects, against one of them."""
    done, truth = study(spark, sf_dir, _GRID)
    subjects = embedding_probs(spark, sf_dir).select("clip_id", (F.col("vec_id") % 11).alias("subject"))
    counts = studies.subject_counts(done.where("population = 'designated'"), truth, subjects)
    return _rounded(studies.paired_bootstrap(counts, ["config", "weight"], {"config": "A", "weight": 0.75}, 150, 5))


@query(f"""WITH {_PAIRED}, lo AS (SELECT population, 'raw' AS metric, raw AS x FROM ga UNION ALL SELECT population, 'decoded', decoded FROM ga)
SELECT population, metric, count(*) AS folds, round(avg(x), 6) AS mean, count(*) FILTER (x > 0) AS positive, round(stddev_samp(x) / sqrt(count(*)), 6) AS se FROM lo GROUP BY population, metric""")
def fold_contrasts(spark, sf_dir):
    """The paired gains' means over folds with their standard errors."""
    done, truth = study(spark, sf_dir, (0.75,))
    return _rounded(studies.fold_contrasts(studies.gains(studies.paired(done, truth, "A", "B"))))


@query(f"WITH {_PAIRED} SELECT population, fold, round(raw, 6) AS raw, round(decoded, 6) AS decoded, rescued, lost FROM ga")
def paired_gains(spark, sf_dir):
    done, truth = study(spark, sf_dir, (0.75,))
    return _rounded(studies.gains(studies.paired(done, truth, "A", "B")))


_GATED = """g AS (SELECT population, avg(decoded) AS m, avg(raw) AS r, min(decoded) AS w, count(*) FILTER (decoded > 0) AS k, count(*) AS n FROM ga GROUP BY population UNION ALL SELECT 'exact_length', 0.3, 0.3, 0.1, 4, 4)"""


@query(f"WITH {_PAIRED}, {_GATED}, d AS (SELECT * FROM g WHERE population = 'designated'), p AS (SELECT * FROM g WHERE population = 'primary'), e AS (SELECT * FROM g WHERE population = 'exact_length')\n" + "\nUNION ALL ".join(
    f"SELECT '{k}' AS kind, d.n = 4 AND d.m >= {m} AND d.k >= {c} AND d.w >= {w} AND p.m >= 0 AND e.m >= {x} AS accepted FROM d, p, e" for k, (m, x, c, w) in evaluate.GATES.items()) + "\nUNION ALL " + "\nUNION ALL ".join(
    f"SELECT '{k}', d.m >= {m} AND d.k >= {c} AND d.w >= -1 AND d.r >= -0.25 AND p.m >= {m} AND p.k >= {c} AND p.w >= -1 AND p.r >= -0.25{x} FROM d, p, e" for k, m, c, x in (("pilot", 0.25, 1, ""), ("fourfold", 0.5, 3, " AND e.m > 0"))))
def gate_decisions(spark, sf_dir):
    """Every form of acceptance rule on the gains of B over A, with a stated length-weighted gain."""
    done, truth = study(spark, sf_dir, (0.75,))
    folds = studies.gains(studies.paired(done, truth, "A", "B")).select("population", "fold", "raw", "decoded")
    by_length = spark.createDataFrame([("exact_length", f, x, x) for f, x in enumerate((0.1, 0.2, 0.4, 0.5))], "population string, fold int, raw double, decoded double")
    folds, out = folds.unionByName(by_length), None
    for kind in (*evaluate.GATES, "pilot", "fourfold"):
        one = evaluate.gate_forms(folds, kind)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {study_sql((0.75,))} SELECT config, weight, vec_id % 9 AS subject, count(*) FILTER (label = y) AS hits, count(*) AS n FROM st WHERE population = 'designated' GROUP BY ALL""")
def subject_hits(spark, sf_dir):
    done, truth = study(spark, sf_dir, (0.75,))
    subjects = truth.select("clip_id", (F.col("clip_id").cast("long") % 9).alias("subject"))
    return studies.subject_counts(done.where("population = 'designated'"), truth, subjects)


@query(f"""WITH {study_sql((0.75,))}, x AS (SELECT config, weight, take % 4 AS fold, raw, label, y, vec_id, take FROM st WHERE population = 'full_take'),
one AS (SELECT config, weight, fold, take, avg(CAST(raw = y AS INT)) AS r, avg(CAST(raw = y AS INT)) AS d FROM x GROUP BY ALL), two AS (SELECT config, weight, fold, take, avg(CAST(raw = y AS INT)) AS r, avg(CAST(label = y AS INT)) AS d FROM x GROUP BY ALL),
l AS (SELECT config, weight, fold, 0.3 * avg(r) AS r, 0.3 * avg(d) AS d FROM one GROUP BY ALL UNION ALL SELECT config, weight, fold, 0.7 * avg(r), 0.7 * avg(d) FROM two GROUP BY ALL)
SELECT config, weight, CAST(fold AS INT) AS fold, round(sum(r), 6) AS raw, round(sum(d), 6) AS decoded FROM l GROUP BY config, weight, fold""")
def length_weighted_scores(spark, sf_dir):
    """Every run of one and two clips, averaged by take, by length, and by the lengths' weights."""
    v, d = F.col("vec_id"), embedding_probs(spark, sf_dir)
    folds = d.select("clip_id", (F.floor(v / 2) % 4).cast("int").alias("fold"))
    probabilities = d.select(F.lit("A").alias("config"), "clip_id", "p").unionByName(d.select(F.lit("B").alias("config"), "clip_id", F.col("q").alias("p")))
    windows = studies.length_scores(embedding_takes(spark, sf_dir, 2), 2)
    done = studies.decode_windows(windows, probabilities, folds, {f: drill_prior(f) for f in range(4)}, classes=10)
    return _rounded(studies.weighted_lengths(done, d.select("clip_id", F.col("label").alias("y")), [0.3, 0.7]))


@query(f"""WITH {PROBS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (list_position(p, list_max(p)) <> list_position(q, list_max(q))) AS d FROM em) SELECT n AS clips, d AS changed, d * 201 / n AS of_scored FROM c""")
def label_changes(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    return studies.label_changes(d.select("clip_id", C.argmax(F.col("p")).alias("label")), d.select("clip_id", C.argmax(F.col("q")).alias("label")), 201)


_OOF = f"WITH {PROBS_SQL}, f AS (SELECT vec_id, vec_id % 4 AS fold, p[1] AS p0, vec_id % 4 = 3 AND vec_id % 8 <> 3 AS gone FROM em)"


@query(f"{_OOF} SELECT CAST(vec_id AS VARCHAR) AS clip_id, CAST(fold AS INT) AS fold, round(p0, 6) AS p0 FROM f WHERE NOT gone")
def out_of_fold(spark, sf_dir):
    """Answers of the model that held a clip's fold out; other models' answers about it are passed over."""
    oof, _ = studies.out_of_fold(*_oof(spark, sf_dir))
    return _rounded(oof.select("clip_id", "fold", F.get("p", 0).alias("p0")))


@query(f"{_OOF} SELECT CAST(fold AS INT) AS fold, count(*) AS missing FROM f WHERE gone GROUP BY fold")
def folds_to_resume(spark, sf_dir):
    return studies.out_of_fold(*_oof(spark, sf_dir))[1]


def _oof(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, v = embedding_probs(spark, sf_dir), F.col("vec_id")
    own = d.where("not (vec_id % 4 = 3 and vec_id % 8 <> 3)").select((v % 4).cast("int").alias("fold"), "clip_id", "p")
    others = d.select(((v + 1) % 4).cast("int").alias("fold"), "clip_id", F.col("q").alias("p"))
    return d.select("clip_id", (v % 4).cast("int").alias("fold")), own.unionByName(others)


@query(f"""WITH {PROBS_SQL}, r AS (SELECT * FROM (VALUES ('one', 'P', 'MAP'), ('two', 'Q', 'MPM'), ('again', 'P', 'MPM')) t(config, source, decoder))
SELECT config, decoder, vec_id, round(CASE WHEN source = 'P' THEN p[1] ELSE q[1] END, 6) AS p0 FROM r, em""")
def registered_probabilities(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    registry = spark.createDataFrame([("one", "P", "MAP"), ("two", "Q", "MPM"), ("again", "P", "MPM")], "config string, source string, decoder string")
    sources = d.select(F.lit("P").alias("source"), "clip_id", "p").unionByName(d.select(F.lit("Q").alias("source"), "clip_id", F.col("q").alias("p")))
    out = studies.registered(registry, sources, d.select("clip_id"))
    return _rounded(out.select("config", "decoder", F.col("clip_id").cast("long").alias("vec_id"), F.get("p", 0).alias("p0")))


_SETS = {"a": "a", "b": "b", "c": "c", "ab": "(a + b) / 2", "ac": "(a + c) / 2", "bc": "(b + c) / 2", "abc": "(a + b + c) / 3"}


@query(f"""WITH {LONG_SQL}, m AS (SELECT vec_id, label, cls, p AS a, q AS b, (p * p + q) AS c FROM lg), """ + ", ".join(
    f"s_{k} AS (SELECT avg(CAST(cls = label AS INT)) AS s FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {e} DESC, cls) = 1))" for k, e in _SETS.items()) + """,
v AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS k, s FROM s_{k}" for k in _SETS) + """), o AS (SELECT k, row_number() OVER (ORDER BY s DESC, k) AS i FROM v WHERE length(k) = 1),
k1 AS (SELECT k, s FROM v WHERE k = (SELECT k FROM o WHERE i = 1)), t2 AS (SELECT list_aggregate(list_sort([k1.k, o.k]), 'string_agg', '') AS k, o.k AS added FROM k1, o WHERE i = 2),
k2 AS (SELECT CASE WHEN v.s > k1.s THEN v.k ELSE k1.k END AS k, greatest(v.s, k1.s) AS s, v.s > k1.s AS took, t2.added FROM v JOIN t2 USING (k), k1),
t3 AS (SELECT list_aggregate(list_sort(list_concat(string_split(k2.k, ''), [o.k])), 'string_agg', '') AS k, o.k AS added FROM k2, o WHERE i = 3),
k3 AS (SELECT v.s, v.s > k2.s AS took, t3.added FROM v JOIN t3 USING (k), k2)
SELECT member, CAST(row_number() OVER (ORDER BY i) AS INT) AS place, round(s, 6) AS score FROM (SELECT 1 AS i, k AS member, s FROM k1 UNION ALL SELECT 2, added, s FROM k2 WHERE took UNION ALL SELECT 3, added, s FROM k3 WHERE took)""")  # fmt: skip
def greedy_members(spark, sf_dir):
    """The best of three members alone, and each next one if the mean then scores higher."""
    d = embedding_probs(spark, sf_dir)
    third = F.zip_with("p", "q", lambda a, b: a * a + b)
    member = lambda name, p: d.select(F.lit(name).alias("member"), "clip_id", F.posexplode(p).alias("cls", "p"))
    rows = member("a", F.col("p")).unionByName(member("b", F.col("q"))).unionByName(member("c", third))
    kept, scores = studies.greedy_selection(["a", "b", "c"], studies.mean_accuracy(rows, d.select("clip_id", F.col("label").alias("y"))))
    return _rounded(spark.createDataFrame([(m, k + 1, s) for k, (m, s) in enumerate(zip(kept, scores, strict=True))], "member string, place int, score double"))


@query("SELECT user_id AS key, min(event_id) AS first FROM events GROUP BY user_id")
def first_seen(spark, sf_dir):
    return studies.first_seen(_read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("first")), "key", "first")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_id % 3 = 0)
SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'subset', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'less', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def key_sets(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    a, b = e.where("event_type = 'click'").select("user_id").distinct(), e.where("event_id % 3 = 0").select("user_id").distinct()
    sets = {"union": a.union(b).distinct(), "subset": a.join(b, "user_id", "left_semi"), "less": a.join(b, "user_id", "left_anti"), "all": a.unionByName(b)}
    out = None
    for kind, rows in sets.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT user_id, list(event_id ORDER BY event_id) AS m FROM events GROUP BY user_id), b AS (SELECT user_id, event_id % 50 = 7 AS x, list(event_id ORDER BY event_id) AS m FROM events GROUP BY ALL)
SELECT count(*) AS n FROM ((SELECT m FROM a EXCEPT ALL SELECT m FROM b) UNION ALL (SELECT m FROM b EXCEPT ALL SELECT m FROM a))""")
def partition_equality(spark, sf_dir):
    """Member sets that only one of two groupings has."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("clip_id"))
    a = e.select(F.col("user_id").cast("string").alias("take_id"), "clip_id")
    b = e.select(F.concat_ws("_", F.col("user_id").cast("string"), (F.col("event_id") % 50 == 7).cast("string")).alias("take_id"), "clip_id")
    return spans.same_partition(a, b).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id % 3 AS epoch, event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS pseudo, sum(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 1 END) AS mass FROM events GROUP BY ALL)
SELECT CAST(epoch AS INT) AS epoch, kind, n AS samples, CAST(CASE WHEN epoch = 1 THEN n + 1 ELSE n END AS BIGINT) AS plan_samples FROM s WHERE epoch = 1""")
def epoch_ledger(spark, sf_dir):
    """Samples, pseudo samples and mass by epoch and kind against a plan that is one off in epoch 1."""
    i = F.col("event_id")
    s = _read(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("epoch"), F.col("event_type").alias("kind"), F.when(i % 4 == 0, 0.5).otherwise(1.0).alias("weight"))
    plan = s.groupBy("epoch", "kind").agg((F.count("*") + F.when(F.col("epoch") == 1, 1).otherwise(0)).alias("samples"), F.count_if(F.col("weight") != 1).alias("pseudo"), F.sum("weight").alias("mass"))
    return evaluate.ledger(s, plan).select("epoch", "kind", "samples", "plan_samples")


@query("""SELECT CAST(e AS INT) AS epoch, instr('13579bdf', substr(sha256('view-v1|42|' || e || '|' || doc_id), 2, 1)) > 0 AS local, count(*) AS n FROM documents, range(1, 5) r(e) GROUP BY ALL""")
def view_tally(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("epoch"))
    return d.select("epoch", C.view_draw("view-v1", 42, F.col("epoch"), F.col("doc_id").cast("string")).alias("local")).groupBy("epoch", "local").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(turn || ':' || coalesce(role, ''), ',' ORDER BY turn, coalesce(role, '')) AS rows FROM conversations GROUP BY conv_id")
def ragged_rows(spark, sf_dir):
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    r = files.ragged(t, "conv_id", ["turn"], ["role"])
    return r.select("conv_id", F.array_join(F.transform("data", lambda s: F.concat_ws(":", s["turn"].cast("string"), s["role"])), ",").alias("rows"))


@query(r"""WITH k AS (SELECT c_custkey AS i, 1 + c_custkey % 4 AS s, c_custkey % 6 AS b, chr(CAST(97 + c_custkey % 3 AS INT)) AS u FROM customer)
SELECT i AS slot_no, CAST(s AS INT) AS stage, CAST(b AS INT) AS block, 'conv_' || u AS role, 'weight' AS part, 'backbone.layer' || s || '.' || b || '.conv' || (1 + i % 3) || '.conv.weight' AS "left", 'blocks.' || s || '.res_blocks.' || b || '.branch2.conv_' || u || '.weight' AS "right" FROM k""")
def model_slots(spark, sf_dir):
    """Keys of two checkpoint dialects read as (stage, block, role, part)."""
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    stage, block, unit = s(1 + k % 4), s(k % 6), F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3).cast("int"))
    keys = _read(spark, sf_dir, "customer").select(k, F.concat(F.lit("backbone.layer"), stage, F.lit("."), block, F.lit(".conv"), s(1 + k % 3), F.lit(".conv.weight")).alias("left"), F.concat(F.lit("blocks."), stage, F.lit(".res_blocks."), block, F.lit(".branch2.conv_"), unit, F.lit(".weight")).alias("right"))
    read = keys.select("*", C.model_slot(F.col("left")).alias("a"), C.model_slot(F.col("right")).alias("b")).where("a <=> b")
    return read.select(k.alias("slot_no"), "a.stage", "a.block", "a.role", "a.part", "left", "right")


@query(f"""WITH {TAKES_SQL}, t AS (SELECT event_id, user_id || '_' || take_no AS take_id, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY user_id, take_no) AS n FROM tk WINDOW w AS (PARTITION BY user_id, take_no ORDER BY start_ms, CAST(event_id AS VARCHAR))),
d AS (SELECT t.*, r AS repeat, {_u("'5|size|' || r || '|' || take_id")} AS us, {_u("'5|' || r || '|' || take_id || '|' || position")} AS ur FROM t, range(0, 2) x(r)),
z AS (SELECT *, least(CASE WHEN us < 0.5 THEN 1 WHEN us < 0.8 THEN 2 ELSE 3 END, n) AS size FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY repeat, take_id ORDER BY ur, position) AS o FROM z QUALIFY o <= size)
SELECT CAST(repeat AS INT) AS repeat, take_id, CAST(event_id AS VARCHAR) AS clip_id, position, CAST(row_number() OVER (PARTITION BY repeat, take_id ORDER BY position) - 1 AS INT) AS new_position FROM k""")
def random_thinning(spark, sf_dir):
    """Places drawn at random within each take, order kept."""
    t = event_takes(spark, sf_dir).withColumn("take_id", F.concat_ws("_", F.col("user_id").cast("string"), F.col("take_no").cast("string")))
    w = Window.partitionBy("take_id")
    t = t.withColumns({"position": (F.row_number().over(w.orderBy("start_ms", "clip_id")) - 1).cast("long"), "take_size": F.count("*").over(w).cast("int")})
    sizes = spark.createDataFrame([(0.0, 0.5, 1), (0.5, 0.8, 2), (0.8, 1.0, 3)], "u_low double, u_high double, size int")
    return sampling.thin(t, sizes, 2, 5)


@query("SELECT CAST(vec_id AS VARCHAR) AS key, 'float' AS dtype, CAST(list_sum(list_transform(embedding, lambda z: CAST(z > 0 AS INT))) AS BIGINT) AS elements FROM embeddings ORDER BY vec_id LIMIT 50")
def first_rows(spark, sf_dir):
    """The first fifty in order: a report."""
    e = _read(spark, sf_dir, "embeddings").orderBy("vec_id").limit(50)
    return e.select(F.col("vec_id").cast("string").alias("key"), F.lit("float").alias("dtype"), F.size(F.filter("embedding", lambda z: z > 0)).cast("long").alias("elements"))


@query(f"""WITH {TAKES_SQL}, l AS (SELECT max(start_ms) - 86400000 AS m FROM ev)
SELECT user_id, CAST(event_id AS VARCHAR) AS clip_id, min(start_ms) OVER (PARTITION BY user_id, take_no) AS take_ms, row_number() OVER (PARTITION BY user_id, take_no ORDER BY start_ms, CAST(event_id AS VARCHAR)) - 1 AS position
FROM tk, l QUALIFY start_ms < max(m) OVER ()""")
def streamed_takes(spark, sf_dir):
    """Events replayed as a stream: what is settled a day after it, takes by the gap rule."""
    setting, folder = "spark.sql.streaming.stateStore.providerClass", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, takes.PROVIDER)
    try:
        rows = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream takes no single file
        ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
        clips = rows.select("user_id", F.col("event_id").cast("string").alias("clip_id"), F.col("ts").cast("timestamp").alias("ts"), ms.alias("end_ms"), F.lit(0).alias("first_frame"), F.lit(0).alias("last_frame"))
        found = takes.stream_takes(clips, GAP_MS, "1 day", ["user_id"], None)
        run = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
