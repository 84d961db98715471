"""Named queries over the driver's tables, with the same statement in SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeline.functions import columns as C
from takeline.operators import decode, evaluate, fusion, integrity, prior, sampling, spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GAP_MS = 6 * 3600 * 1000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clips of one moment, a device per user."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ms.alias("start_ms"))
    return rows.select("*", F.col("event_id").cast("string").alias("clip_id"), F.col("start_ms").alias("end_ms"), F.lit("all").alias("date"), F.lit(0).alias("first_frame"), F.lit(0).alias("last_frame"))


def event_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.gap_takes(event_clips(spark, sf_dir), GAP_MS, ("user_id",), None)


TAKES_SQL = f"""
  ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS start_ms FROM events),
  mk AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER w > {GAP_MS} OR lag(start_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new
         FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, CAST(event_id AS VARCHAR))),
  tk AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY start_ms, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS take_no FROM mk)"""


@query(f"""WITH {TAKES_SQL}
SELECT event_id, user_id, take_no,
  CAST(row_number() OVER (PARTITION BY user_id, take_no ORDER BY start_ms, CAST(event_id AS VARCHAR)) - 1 AS INT) AS position,
  CAST(count(*) OVER (PARTITION BY user_id, take_no) AS INT) AS take_size FROM tk""")
def take_gap_sessions(spark, sf_dir):
    t = event_takes(spark, sf_dir)
    w = Window.partitionBy("user_id", "take_no")
    return t.select("event_id", "user_id", "take_no", (F.row_number().over(w.orderBy("start_ms", "clip_id")) - 1).cast("int").alias("position"), F.count("*").over(w).cast("int").alias("take_size"))


@query(f"WITH {TAKES_SQL}, s AS (SELECT user_id, take_no, count(*) AS take_size FROM tk GROUP BY ALL) SELECT take_size, count(*) AS takes FROM s GROUP BY take_size")
def take_size_histogram(spark, sf_dir):
    return spans.size_histogram(event_takes(spark, sf_dir), ["user_id", "take_no"])


@query(f"""WITH {TAKES_SQL}, s AS (
  SELECT user_id, CAST(user_id AS VARCHAR) || '_' || CAST(take_no AS VARCHAR) AS take_id, min(start_ms) / 1000.0 AS start, max(start_ms) / 1000.0 AS "end", count(*) AS n FROM tk GROUP BY user_id, take_no
), m AS (SELECT *, CASE WHEN start - lag("end") OVER w < 86400.0 AND n = lag(n) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start, take_id)
), c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, take_id ROWS UNBOUNDED PRECEDING) AS k FROM m
), x AS (SELECT user_id, take_id, first_value(take_id) OVER (PARTITION BY user_id, k ORDER BY start, take_id) AS chain_id, CAST(count(*) OVER (PARTITION BY user_id, k) AS INT) AS chain_size FROM c)
SELECT * FROM x WHERE chain_size > 1""")
def take_chains(spark, sf_dir):
    t = event_takes(spark, sf_dir)
    s = t.groupBy("user_id", "take_no").agg((F.min("start_ms") / 1000.0).alias("start"), (F.max("start_ms") / 1000.0).alias("end"), F.count("*").alias("n"))
    s = s.withColumns({"take_id": F.concat_ws("_", F.col("user_id").cast("string"), F.col("take_no").cast("string")), "date": F.lit("all")})
    return spans.chains(s, 86400.0, ("user_id",))


def synthetic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per event: a counter at 100 ms since the hour, ended by a length that is off the tick now and then."""
    ev = event_clips(spark, sf_dir).drop("end_ms", "first_frame", "last_frame", "date")
    first = F.pmod(F.floor(F.col("start_ms") / 100), F.lit(36000)).cast("int")
    n = F.pmod("event_id", F.lit(9)).cast("int") - 1
    return ev.select("clip_id", F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd").alias("date"), "start_ms", first.alias("first_frame"), (F.col("start_ms") + n * 100 + F.when(F.pmod("event_id", F.lit(7)) == 0, 1).otherwise(0)).alias("end_ms"), (first + n).alias("last_frame"))


SPANS_SQL = """
  sp AS (SELECT CAST(event_id AS VARCHAR) AS clip_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d') AS date, epoch_us(ts) // 1000 AS start_ms,
    CAST((epoch_us(ts) // 100000) % 36000 AS INT) AS first_frame, CAST(event_id % 9 - 1 AS INT) AS n, event_id FROM events),
  sq AS (SELECT clip_id, date, start_ms, first_frame, start_ms + n * 100 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS end_ms, first_frame + n AS last_frame FROM sp),
  ck AS (SELECT *, start_ms - 100 * first_frame AS origin, CASE WHEN NOT (last_frame >= first_frame AND end_ms >= start_ms) THEN 'nonmonotone span'
    WHEN end_ms - start_ms <> 100 * (last_frame - first_frame) THEN 'not an exact 100 ms clock' END AS reason FROM sq)"""


@query(f"""WITH {SPANS_SQL}, g AS (SELECT *, 'clock_' || date || '_' || origin AS take_id FROM ck WHERE reason IS NULL)
SELECT clip_id, take_id, CAST(row_number() OVER (PARTITION BY take_id ORDER BY start_ms, end_ms, clip_id) - 1 AS INT) AS position,
  CAST(count(*) OVER (PARTITION BY take_id) AS INT) AS take_size, date, start_ms / 1000.0 AS seconds, first_frame AS frame FROM g""")
def clock_origin_groups(spark, sf_dir):
    return spans.clock_takes(synthetic_spans(spark, sf_dir))[0]


@query(f"WITH {SPANS_SQL} SELECT clip_id, reason FROM ck WHERE reason IS NOT NULL")
def clock_rejects(spark, sf_dir):
    return spans.clock_takes(synthetic_spans(spark, sf_dir))[1]


@query(f"WITH {SPANS_SQL}, n AS (SELECT count(*) AS c FROM sq GROUP BY date, start_ms, end_ms) SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS ties FROM n")
def span_ties(spark, sf_dir):
    return spans.ties(synthetic_spans(spark, sf_dir))


@query(r"""SELECT event_id, regexp_extract(f, '(\d{4}-\d{2}-\d{2})_', 1) AS date, epoch_us(ts) // 1000 % 86400000 AS ms, CAST(event_id AS INT) AS frame
FROM (SELECT event_id, ts, strftime(ts, 'Depth_%Y-%m-%d_%H-%M-%S') AS f FROM events) WHERE event_id % 5 <> 0""")
def stamp_parse(spark, sf_dir):
    ev = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    name = F.concat(F.lit("Depth_"), F.date_format("t", "yyyy-MM-dd_HH-mm-ss.SSS"), F.lit("_"), F.when(F.col("event_id") % 5 == 0, F.lit("bad")).otherwise(F.lpad(F.col("event_id").cast("string"), 8, "0")), F.lit("_Color.png"))
    return ev.withColumn("s", C.stamp(name)).where("s is not null").select("event_id", "s.date", "s.ms", "s.frame")


PRIOR_SQL = f"""{TAKES_SQL},
  bg AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id, take_no ORDER BY start_ms, CAST(event_id AS VARCHAR)) AS prev, event_type AS next FROM tk),
  cl AS (SELECT DISTINCT event_type AS c FROM events)"""


def event_bigrams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = event_takes(spark, sf_dir)
    pairs = prior.bigrams(t, ["user_id", "take_no"], ["start_ms", "clip_id"], "event_type")
    return pairs, _read(spark, sf_dir, "events").select(F.col("event_type").alias("cls")).distinct()


@query(f"""WITH {PRIOR_SQL}, g AS (SELECT a.c AS prev, b.c AS next, (SELECT count(*) FROM bg WHERE bg.prev = a.c AND bg.next = b.c) + 1 AS n FROM cl a, cl b)
SELECT prev, next, n / sum(n) OVER (PARTITION BY prev) AS p FROM g""")
def transition_prior(spark, sf_dir):
    return prior.transition_prior(*event_bigrams(spark, sf_dir))


@query(f"""WITH {PRIOR_SQL}, f AS (SELECT DISTINCT CAST(user_id % 4 AS INT) AS fold FROM bg WHERE prev IS NOT NULL),
g AS (SELECT fold, a.c AS prev, b.c AS next, (SELECT count(*) FROM bg WHERE bg.prev = a.c AND bg.next = b.c AND bg.user_id % 4 <> f.fold) + 1 AS n FROM cl a, cl b, f)
SELECT fold, prev, next, n / sum(n) OVER (PARTITION BY fold, prev) AS p FROM g""")
def prior_leave_fold_out(spark, sf_dir):
    pairs, classes = event_bigrams(spark, sf_dir)
    return prior.leave_fold_out(pairs.withColumn("fold", (F.col("user_id") % 4).cast("int")), classes)


@query("""WITH t AS (SELECT conv_id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS prev, role AS next FROM conversations WHERE role IS NOT NULL),
c AS (SELECT DISTINCT role AS c FROM conversations WHERE role IS NOT NULL),
g AS (SELECT a.c AS prev, b.c AS next, (SELECT count(*) FROM t WHERE t.prev = a.c AND t.next = b.c) + 1 AS n FROM c a, c b)
SELECT prev, next, n / sum(n) OVER (PARTITION BY prev) AS p FROM g""")
def role_prior(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return prior.transition_prior(prior.bigrams(turns, ["conv_id"], ["turn", "role"], "role"), turns.where("role is not null").select(F.col("role").alias("cls")).distinct())


def embedding_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ten-class distributions per vector, from its first and its next ten numbers."""
    e = _read(spark, sf_dir, "embeddings")
    part = lambda k: C.softmax(F.transform(F.slice("embedding", k, 10), lambda x: x.cast("double") * 4.0))
    return e.select("vec_id", F.col("vec_id").cast("string").alias("clip_id"), "label", part(1).alias("p"), part(11).alias("q"))


_SOFT = "list_transform(list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE) * 4.0), lambda x: exp(x - list_max(list_transform(embedding[{a}:{b}], lambda z: CAST(z AS DOUBLE) * 4.0))))"
PROBS_SQL = f"""
  e0 AS (SELECT vec_id, label, {_SOFT.format(a=1, b=10)} AS ep, {_SOFT.format(a=11, b=20)} AS eq FROM embeddings),
  em AS (SELECT vec_id, label, list_transform(ep, lambda x: x / list_sum(ep)) AS p, list_transform(eq, lambda x: x / list_sum(eq)) AS q FROM e0)"""
LONG_SQL = f"""{PROBS_SQL},
  lg AS (SELECT vec_id, label, i - 1 AS cls, p[i] AS p, q[i] AS q FROM em, range(1, 11) r(i))"""


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("""WITH x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
c AS (SELECT label AS cls, i, avg(v) AS m FROM x GROUP BY ALL),
s AS (SELECT vec_id, cls, sum(v * m) AS z FROM x JOIN c USING (i) GROUP BY vec_id, cls),
e AS (SELECT vec_id, cls, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM s)
SELECT vec_id, cls, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e""")
def embedding_centroid_probs(spark, sf_dir):
    """Linear readout with class centroids as weights, softmax per vector; the centroids (classes x 64) are broadcast."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centroids = means.groupBy(F.col("label").alias("cls")).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select("cls", F.transform("s", lambda s: s["m"]).alias("w"))
    z = e.crossJoin(F.broadcast(centroids)).select("vec_id", "cls", C.linear(F.col("x"), F.col("w"), F.lit(0.0)).alias("z"))
    w = Window.partitionBy("vec_id")
    return _rounded(z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w))).select("vec_id", "cls", (F.col("e") / F.sum("e").over(w)).alias("p")))


@query(f"WITH {LONG_SQL} SELECT vec_id, CAST(cls AS INT) AS cls, round(CASE WHEN vec_id % 7 <> 0 THEN 0.8 * p + 0.2 * q ELSE p END, 6) AS p FROM lg")
def fusion_arith(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    return _rounded(d.select("vec_id", F.posexplode(fusion.gated(F.col("p"), F.col("q"), F.col("vec_id") % 7 != 0, "arithmetic")).alias("cls", "p")))


@query(f"""WITH {LONG_SQL}, z AS (SELECT *, exp(0.8 * ln(greatest(p, 1e-12)) + 0.2 * ln(greatest(q, 1e-12))) AS v FROM lg)
SELECT vec_id, CAST(cls AS INT) AS cls, round(CASE WHEN vec_id % 7 <> 0 THEN v / sum(v) OVER (PARTITION BY vec_id) ELSE p END, 6) AS p FROM z""")
def fusion_geometric(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    return _rounded(d.select("vec_id", F.posexplode(fusion.gated(F.col("p"), F.col("q"), F.col("vec_id") % 7 != 0, "geometric")).alias("cls", "p")))


@query(f"""WITH {LONG_SQL}, z AS (SELECT vec_id, cls, exp((2.0 * ln(greatest(p, 1e-12)) + ln(greatest(q, 1e-12))) / 3.0) AS v FROM lg)
SELECT vec_id, CAST(cls AS INT) AS cls, round(v / sum(v) OVER (PARTITION BY vec_id), 6) AS p FROM z""")
def fusion_members(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    rows = d.select("clip_id", F.lit(2.0).alias("m"), F.posexplode("p").alias("cls", "p")).unionByName(d.select("clip_id", F.lit(1.0).alias("m"), F.posexplode("q").alias("cls", "p")))
    return _rounded(fusion.fuse_members(rows, F.col("m"), "geometric").select(F.col("clip_id").cast("long").alias("vec_id"), "cls", "p"))


@query(f"WITH {PROBS_SQL} SELECT vec_id, round(p[1], 6) AS p0, round(CASE WHEN vec_id % 3 = 0 THEN (p[1] + q[1]) / 2 ELSE p[1] END, 6) AS f0 FROM em")
def pair_average(spark, sf_dir):
    d = embedding_probs(spark, sf_dir)
    f = fusion.pair_average(d.select("clip_id", "p"), d.where("vec_id % 3 = 0").select("clip_id", F.col("q").alias("p"))).withColumnRenamed("p", "f")
    return _rounded(d.join(f, "clip_id").select("vec_id", F.get("p", 0).alias("p0"), F.get("f", 0).alias("f0")))


@query("""WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_no FROM embeddings), c AS (SELECT vec_id, row_no % 7 = 0 AS s, vec_id % 2 = 0 AS l, vec_id % 3 <> 0 AS i, vec_id % 5 <> 0 AS d FROM n),
ph AS (SELECT unnest(['warm', 'Ipartial', 'Iall', 'Dpartial', 'Dall', 'localpartial', 'localall', 'newall', 'allmissing']) AS phase)
SELECT vec_id, phase, l AND phase NOT IN ('localall', 'allmissing') AND NOT (phase = 'localpartial' AND s) AS local,
  i AND phase NOT IN ('Iall', 'allmissing', 'newall') AND NOT (phase = 'Ipartial' AND s) AS "I",
  d AND phase NOT IN ('Dall', 'allmissing', 'newall') AND NOT (phase = 'Dpartial' AND s) AS "D" FROM c, ph""")
def phase_masks(spark, sf_dir):
    rows = spans.ranked(_read(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], "row_no")
    v = F.col("vec_id")
    clips = rows.select(v.alias("clip_id"), "row_no", (v % 2 == 0).alias("local"), (v % 3 != 0).alias("I"), (v % 5 != 0).alias("D"))
    return fusion.phase_masks(clips).withColumnRenamed("clip_id", "vec_id")


@query(f"WITH {PROBS_SQL} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS label FROM em")
def argmax_labels(spark, sf_dir):
    return embedding_probs(spark, sf_dir).select("vec_id", C.argmax(F.col("p")).alias("label"))


@query(f"WITH {LONG_SQL}, r AS (SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS rank FROM lg) SELECT vec_id, CAST(rank AS INT) AS rank, CAST(cls AS INT) AS cls FROM r WHERE rank <= 3")
def topk_classes(spark, sf_dir):
    top = embedding_probs(spark, sf_dir).select("vec_id", F.posexplode(C.top_classes(F.col("p"), 3)).alias("k", "s"))
    return top.select("vec_id", (F.col("k") + 1).alias("rank"), F.col("s.cls").alias("cls"))


def take_rows(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    d = embedding_probs(spark, sf_dir)
    rows = d.select(F.floor(F.col("vec_id") / size).alias("take_id"), (F.col("vec_id") % size).alias("position"), F.posexplode("p").alias("cls", "p"))
    return rows.withColumn("lp", F.log(F.greatest("p", F.lit(1e-12))))


def _takes_sql(size: int) -> str:
    return f"{LONG_SQL}, tr AS (SELECT vec_id // {size} AS take_id, vec_id % {size} AS position, CAST(cls AS INT) AS cls, ln(greatest(p, 1e-12)) AS lp FROM lg)"


@query(f"""WITH {_takes_sql(2)}, s AS (SELECT a.take_id, a.cls AS label0, b.cls AS label1, a.lp + b.lp AS score FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls)
SELECT take_id, label0, label1, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY take_id ORDER BY score DESC, label0, label1) = 1""")
def pair_decode_exact(spark, sf_dir):
    return _rounded(decode.pair_map(take_rows(spark, sf_dir, 2)))


@query(f"""WITH {_takes_sql(3)}, j AS (SELECT a.take_id, a.cls AS c0, b.cls AS c1, c.cls AS c2, exp(a.lp + b.lp + c.lp) AS w FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls
  JOIN tr c ON c.take_id = a.take_id AND c.position = 2 AND c.cls <> a.cls AND c.cls <> b.cls),
x AS (SELECT take_id, 0 AS position, c0 AS cls, w FROM j UNION ALL SELECT take_id, 1, c1, w FROM j UNION ALL SELECT take_id, 2, c2, w FROM j),
m AS (SELECT take_id, position, cls, sum(w) AS w FROM x GROUP BY ALL)
SELECT take_id, position, cls, round(w / sum(w) OVER (PARTITION BY take_id, position), 6) AS m FROM m""")
def triple_marginals_exact(spark, sf_dir):
    return _rounded(decode.triple_marginals(take_rows(spark, sf_dir, 3)))


def embedding_takes(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    v = F.col("vec_id")
    return _read(spark, sf_dir, "embeddings").select(v.cast("string").alias("clip_id"), F.floor(v / size).cast("string").alias("take_id"), (v % size).cast("int").alias("position"))


def _beams_sql(size: int, width: int) -> str:
    """Beam search clip by clip: a table of at most ``width`` label rows per take for each place."""
    step = "b{k} AS (SELECT b.take, list_append(b.c, lp.cls) AS c, b.s + lp.l + 0.75 * ln(0.1) AS s FROM b{j} b JOIN lp ON lp.take = b.take AND lp.pos = {k} WHERE NOT list_contains(b.c, lp.cls) QUALIFY row_number() OVER (PARTITION BY b.take ORDER BY b.s + lp.l DESC) <= {width})"
    steps = ",\n".join(step.format(k=k, j=k - 1, width=width) for k in range(1, size))
    last = " UNION ALL ".join(f"SELECT b.take, b.c FROM b{k} b JOIN n ON n.take = b.take AND n.n = {k + 1} QUALIFY row_number() OVER (PARTITION BY b.take ORDER BY b.s DESC) = 1" for k in range(size))
    return f"""WITH {LONG_SQL}, lp AS (SELECT vec_id // {size} AS take, vec_id % {size} AS pos, CAST(cls AS INT) AS cls, ln(greatest(p, 1e-12)) AS l FROM lg), n AS (SELECT take, max(pos) + 1 AS n FROM lp GROUP BY take),
b0 AS (SELECT take, [cls] AS c, l AS s FROM lp WHERE pos = 0), {steps}, f AS ({last})
SELECT CAST(vec_id AS VARCHAR) AS clip_id, CAST(take AS VARCHAR) AS take_id, c[vec_id % {size} + 1] AS label FROM embeddings JOIN f ON take = vec_id // {size}"""


@query(_beams_sql(6, 64))
def beam_decode(spark, sf_dir):
    """Takes of six under an even prior; the beam's labels differ within a take."""
    import numpy as np

    return decode.decode_takes(embedding_takes(spark, sf_dir, 6), embedding_probs(spark, sf_dir), np.full((10, 10), 0.1), classes=10)


@query(f"""WITH {LONG_SQL}, lp AS (SELECT vec_id, cls, ln(greatest(p, 1e-12)) AS l, vec_id // 3 // 4 AS chain, vec_id % 3 AS position, vec_id // 3 AS take FROM lg),
ok AS (SELECT take FROM (SELECT DISTINCT vec_id, take FROM lp) GROUP BY take HAVING count(*) = 3), u AS (SELECT lp.* FROM lp JOIN ok USING (take)),
z AS (SELECT vec_id, cls, l + 0.25 * (sum(l) OVER w - l) AS z, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY chain, position, cls)),
e AS (SELECT vec_id, cls, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z WHERE n > 1), b AS (SELECT vec_id, cls, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM e)
SELECT lg.vec_id, CAST(lg.cls AS INT) AS cls, round(coalesce(b.q, lg.p), 6) AS p FROM lg LEFT JOIN b USING (vec_id, cls)""")
def repeat_borrowing(spark, sf_dir):
    d = embedding_probs(spark, sf_dir).select("clip_id", "p")
    takes = embedding_takes(spark, sf_dir, 3)
    whole = takes.groupBy("take_id").count().where("count = 3")
    chain = whole.select("take_id", F.floor(F.col("take_id").cast("long") / 4).cast("string").alias("chain_id"))
    return _rounded(fusion.borrow(d, takes, chain).select(F.col("clip_id").cast("long").alias("vec_id"), F.posexplode("p").alias("cls", "p")))


@query(f"""WITH {_takes_sql(2)}, n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 7 <> 0) AS c FROM embeddings),
present AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0), inn AS (SELECT vec_id FROM present WHERE vec_id % 7 <> 0),
both_ AS (SELECT vec_id // 2 AS take_id FROM inn GROUP BY 1 HAVING count(*) = 2),
s AS (SELECT a.take_id, a.cls AS l0, b.cls AS l1, a.lp + b.lp AS score FROM tr a JOIN tr b ON a.take_id = b.take_id AND a.position = 0 AND b.position = 1 AND a.cls <> b.cls JOIN both_ ON both_.take_id = a.take_id),
m AS (SELECT take_id, l0, l1 FROM s QUALIFY row_number() OVER (PARTITION BY take_id ORDER BY score DESC, l0, l1) = 1),
o AS (SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS own FROM em)
SELECT o.vec_id, CASE WHEN (SELECT c >= 0.5 * n FROM n) AND m.take_id IS NOT NULL THEN CASE WHEN o.vec_id % 2 = 0 THEN l0 ELSE l1 END WHEN o.vec_id % 5 = 0 THEN 0 ELSE own END AS label,
  CASE WHEN (SELECT c >= 0.5 * n FROM n) AND o.vec_id % 5 <> 0 AND o.vec_id % 7 <> 0 THEN 'decoded' WHEN o.vec_id % 5 = 0 THEN 'missing' ELSE 'argmax' END AS how
FROM o LEFT JOIN m ON m.take_id = o.vec_id // 2 AND o.vec_id % 5 <> 0 AND o.vec_id % 7 <> 0""")
def coverage_fallback(spark, sf_dir):
    """Every fifth clip lacks probabilities and every seventh a take; an even prior leaves distinctness alone to decide."""
    import numpy as np

    d = embedding_probs(spark, sf_dir)
    out = decode.decode_with_fallback(d.select("clip_id"), embedding_takes(spark, sf_dir, 2).where("cast(clip_id as long) % 7 <> 0"), d.where("vec_id % 5 <> 0").select("clip_id", "p"), np.full((10, 10), 0.1), classes=10)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), "label", "how")


@query(f"""WITH {PROBS_SQL}, s AS (SELECT vec_id % 9 AS subject, label AS y, list_position(p, list_max(p)) - 1 AS a, list_position(q, list_max(q)) - 1 AS b FROM em)
SELECT subject, count(*) AS n, count(*) FILTER (y = a) AS hits, round(avg(CAST(y = a AS INT)), 6) AS accuracy, count(*) FILTER (b = y AND a <> y) AS rescued, count(*) FILTER (a = y AND b <> y) AS lost,
  count(*) FILTER (b = y AND a <> y) - count(*) FILTER (a = y AND b <> y) AS net, count(*) FILTER (a <> b) AS changed FROM s GROUP BY subject""")
def accuracy_by_subject(spark, sf_dir):
    d = embedding_probs(spark, sf_dir).select((F.col("vec_id") % 9).alias("subject"), F.col("label").alias("y"), C.argmax(F.col("p")).alias("parent"), C.argmax(F.col("q")).alias("label"))
    a = evaluate.accuracy(d, ("subject",), label="parent")
    return _rounded(a.join(evaluate.contrast(d, ("subject",)), "subject"))


@query(f"""WITH {PROBS_SQL} SELECT label, round(avg(-ln(greatest(p[label + 1], 1e-12))), 6) AS nll, round(avg(list_sum(list_transform(p, lambda x: x * x)) - 2 * p[label + 1] + 1), 6) AS brier, round(avg(list_max(p)), 6) AS confidence FROM em GROUP BY label""")
def nll_brier(spark, sf_dir):
    return _rounded(evaluate.probability_metrics(embedding_probs(spark, sf_dir), ("label",), truth="label"))


@query(f"""WITH {LONG_SQL}, t AS (SELECT unnest(CAST([0.25, 0.5, 1.0, 2.0, 4.0] AS DOUBLE[])) AS t), z AS (SELECT vec_id, label, cls, t, ln(greatest(p, 1e-12)) / t AS z FROM lg, t),
l AS (SELECT t, vec_id, ln(sum(exp(z))) - max(CASE WHEN cls = label THEN z END) AS n FROM z GROUP BY t, vec_id), a AS (SELECT t, avg(n) AS nll FROM l GROUP BY t)
SELECT arg_min(t, nll) AS t, round(min(nll), 6) AS nll FROM a""")
def temperature_fit(spark, sf_dir):
    return _rounded(evaluate.best_temperature(embedding_probs(spark, sf_dir).select("p", F.col("label").alias("y")), [0.25, 0.5, 1.0, 2.0, 4.0]))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS h, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT sum(h) AS th, sum(n) AS tn, count(*) AS k FROM u),
x AS (SELECT (th - h) / (tn - n) AS x, k, th, tn FROM u, t) SELECT round(any_value(th / tn), 6) AS estimate, round(sqrt(var_pop(x) * (max(k) - 1)), 6) AS se FROM x""")
def jackknife_se(spark, sf_dir):
    u = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("h"), F.count("*").alias("n"))
    return _rounded(evaluate.jackknife(u, "h", "n"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS h, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS k FROM u),
d AS (SELECT r, i AS j, CAST(floor(CAST(('0x' || substr(sha256('7|' || r || '|' || i), 1, 12)) AS BIGINT) / 281474976710656.0 * k) AS BIGINT) AS pick FROM c, range(0, 200) t(r)), x AS (SELECT r, sum(h) / sum(n) AS x FROM d JOIN c ON c.i = d.pick GROUP BY r)
SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS se, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM x""")
def cluster_bootstrap(spark, sf_dir):
    u = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("h"), F.count("*").alias("n"))
    return _rounded(sampling.cluster_bootstrap(u, "user_id", "h", "n", 200, 7))


@query(f"""WITH {TAKES_SQL}, m AS (SELECT user_id, take_no, list(CAST(event_id AS VARCHAR) ORDER BY start_ms, CAST(event_id AS VARCHAR)) AS m FROM tk GROUP BY ALL),
l AS (SELECT *, unnest(range(1, least(len(m), 8) + 1)) AS len FROM m), s AS (SELECT *, unnest(range(0, len(m) - len + 1)) AS start FROM l)
SELECT CAST(user_id AS VARCHAR) || '_' || CAST(take_no AS VARCHAR) AS take_id, CAST(len AS INT) AS len, CAST(start AS INT) AS start, array_to_string(m[start + 1 : start + len], ',') AS members FROM s""")
def all_windows_1_8(spark, sf_dir):
    t = event_takes(spark, sf_dir).withColumn("take_id", F.concat_ws("_", F.col("user_id").cast("string"), F.col("take_no").cast("string")))
    t = t.withColumn("position", F.row_number().over(Window.partitionBy("take_id").orderBy("start_ms", "clip_id")))
    return evaluate.row_windows(t).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {TAKES_SQL}, c AS (SELECT CAST(user_id AS VARCHAR) || '_' || CAST(take_no AS VARCHAR) AS f, CAST(user_id AS VARCHAR) || '_' || CAST(start_ms // 86400000 AS VARCHAR) AS t FROM tk),
cell AS (SELECT t, f, count(*) AS n FROM c GROUP BY t, f), r AS (SELECT t, sum(n) AS n, count(*) AS parts, any_value(f) AS f FROM cell GROUP BY t), k AS (SELECT f, sum(n) AS m FROM cell GROUP BY f)
SELECT round((SELECT sum(n * (n - 1) / 2) FROM cell) / (SELECT sum(m * (m - 1) / 2) FROM k), 6) AS precision, round((SELECT sum(n * (n - 1) / 2) FROM cell) / (SELECT sum(n * (n - 1) / 2) FROM r), 6) AS recall,
  (SELECT count(*) FROM r JOIN k USING (f) WHERE parts = 1 AND n = m) AS exact, (SELECT count(*) FROM r) AS groups""")
def pair_precision_recall(spark, sf_dir):
    t = event_takes(spark, sf_dir)
    user = F.col("user_id").cast("string")
    c = t.select(F.concat_ws("_", user, F.col("take_no").cast("string")).alias("found"), F.concat_ws("_", user, F.floor(F.col("start_ms") / 86400000).cast("string")).alias("truth"))
    return _rounded(evaluate.pair_agreement(c, "truth", "found"))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars % 70 AS INT) AS n FROM documents)
SELECT doc_id, array_to_string(CASE WHEN n = 0 THEN [] WHEN n = 1 THEN [0] ELSE list_transform(range(0, least(n, 32)), lambda i: CAST(round_even(i * ((n - 1) / (least(n, 32) - 1)), 0) AS INT)) END, ',') AS picks FROM d""")
def even_picks(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 70).cast("int").alias("n"))
    return d.select("doc_id", F.array_join(C.even_picks(F.col("n"), 32).cast("array<string>"), ",").alias("picks"))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars % 70 AS INT) AS n FROM documents)
SELECT doc_id, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN n <= 0 THEN 0 ELSE CAST(least(floor((i + 0.5) * n / 16), n - 1) AS INT) END), ',') AS picks FROM d""")
def segment_picks(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 70).cast("int").alias("n"))
    return d.select("doc_id", F.array_join(C.segment_picks(F.col("n"), 16).cast("array<string>"), ",").alias("picks"))


@query("""SELECT doc_id, CAST(e AS INT) AS epoch, instr('13579bdf', substr(sha256('view-v1|42|' || e || '|' || doc_id), 2, 1)) > 0 AS local FROM documents, range(1, 5) r(e)""")
def hash_view_draw(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("epoch"))
    return d.select("doc_id", "epoch", C.view_draw("view-v1", 42, F.col("epoch"), F.col("doc_id").cast("string")).alias("local"))


@query("""WITH h AS (SELECT doc_id, sha256('7|' || doc_id) AS h FROM documents) SELECT doc_id FROM h ORDER BY substr(h, 1, 12), doc_id LIMIT 160""")
def seeded_sample(spark, sf_dir):
    return sampling.sample_exactly(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 160, 7)


@query("""WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, user_id FROM events), k AS (SELECT u, row_number() OVER (ORDER BY user_id > 9, user_id) - 1 AS i FROM u)
SELECT u AS "user", CAST(i % 4 AS INT) AS grp FROM k""")
def inner_groups(spark, sf_dir):
    return sampling.inner_groups(_read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user")))


@query(f"""WITH {TAKES_SQL}, t AS (SELECT event_id, user_id || '_' || take_no AS take_id, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY user_id, take_no) AS n FROM tk WINDOW w AS (PARTITION BY user_id, take_no ORDER BY start_ms, CAST(event_id AS VARCHAR))),
d AS (SELECT t.*, r AS repeat, CAST(('0x' || substr(sha256('11|size|' || r || '|' || take_id), 1, 12)) AS BIGINT) / 281474976710656.0 AS us, CAST(('0x' || substr(sha256('11|start|' || r || '|' || take_id), 1, 12)) AS BIGINT) / 281474976710656.0 AS ut FROM t, range(0, 3) x(r)),
z AS (SELECT *, least(CASE WHEN us < 0.5 THEN 1 WHEN us < 0.8 THEN 2 ELSE 3 END, n) AS size FROM d), k AS (SELECT *, floor(ut * (n - size + 1)) AS a FROM z)
SELECT CAST(repeat AS INT) AS repeat, take_id, CAST(event_id AS VARCHAR) AS clip_id, CAST(position AS INT) AS position, CAST(row_number() OVER (PARTITION BY repeat, take_id ORDER BY position) - 1 AS INT) AS new_position FROM k WHERE position >= a AND position < a + size""")
def thinned_takes(spark, sf_dir):
    t = event_takes(spark, sf_dir).withColumn("take_id", F.concat_ws("_", F.col("user_id").cast("string"), F.col("take_no").cast("string")))
    w = Window.partitionBy("take_id")
    t = t.withColumns({"position": F.row_number().over(w.orderBy("start_ms", "clip_id")) - 1, "take_size": F.count("*").over(w).cast("int")})
    sizes = spark.createDataFrame([(0.0, 0.5, 1), (0.5, 0.8, 2), (0.8, 1.0, 3)], "u_low double, u_high double, size int")
    return sampling.thin(t, sizes, 3, 11, contiguous=True)


@query("""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS "user", CAST(event_id % 3 AS INT) AS fold FROM events WHERE user_id % 10 = 0 UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(user_id % 4 AS INT) FROM events WHERE user_id % 10 <> 0)
SELECT "user", count(DISTINCT fold) AS folds FROM f GROUP BY "user" HAVING count(DISTINCT fold) > 1""")
def subject_disjoint_check(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    fold = F.when(F.col("user_id") % 10 == 0, F.col("event_id") % 3).otherwise(F.col("user_id") % 4).cast("int")
    return evaluate.shared_subjects(e.select(F.col("user_id").cast("string").alias("user"), fold.alias("fold")))


@query("""WITH a AS (SELECT event_type AS k, CAST(count(*) AS VARCHAR) AS v FROM events WHERE user_id % 2 = 0 OR event_type = 'click' GROUP BY 1), b AS (SELECT event_type AS k, CAST(count(*) AS VARCHAR) AS v FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS wanted, b.v AS built, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra' ELSE 'differs' END AS verdict FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def recipe_compare(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_type")
    count = lambda d: d.groupBy(F.col("event_type").alias("k")).agg(F.count("*").cast("string").alias("v"))
    even = F.col("user_id") % 2 == 0
    return integrity.recipe_differences(count(e.where(even | (F.col("event_type") == "click"))), count(e.where(even & (F.col("event_type") != "view"))))


@query("""WITH x AS (SELECT vec_id, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS w FROM embeddings, range(1, 65) r(i)), s AS (SELECT vec_id, max(abs(w)) / 127 AS scale FROM x GROUP BY vec_id)
SELECT vec_id, CAST(idx AS INT) AS idx, CAST(CASE WHEN scale > 0 THEN round_even(w / scale, 0) ELSE 0 END AS INT) AS code, round(scale, 6) AS scale FROM x JOIN s USING (vec_id)""")
def quantize_roundtrip(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "w")).withColumn("w", F.col("w").cast("double"))
    return _rounded(integrity.quantize(e, ["vec_id"]))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'utf8' AS dtype, CAST(octet_length(encode(text)) AS BIGINT) AS elements, sha256(text) AS sha256 FROM documents")
def manifest_sha(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("utf8").alias("dtype"), F.col("text").cast("binary").alias("blob"))
    return integrity.manifest(d.withColumn("shape", F.array(F.octet_length("blob").cast("long")))).drop("shape")


@query("""WITH f AS (SELECT CAST(user_id % 4 AS INT) AS fold, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) - 0.2 AS d FROM events GROUP BY 1)
SELECT round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(stddev_pop(d), 6) AS std_pop, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, round(min(d), 6) AS min, count(*) FILTER (d > 0) AS positives, count(d) AS folds FROM f""")
def fold_summary(spark, sf_dir):
    f = _read(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("fold")).agg((F.avg((F.col("event_type") == "click").cast("double")) - 0.2).alias("d"))
    return _rounded(evaluate.fold_summary(f, "d"))


@query("""WITH r AS (SELECT l_suppkey % 50 AS slot, l_quantity AS x, l_linenumber AS w FROM lineitem) SELECT slot, round(sum(x * w) / sum(w), 6) AS x FROM r GROUP BY slot""")
def weighted_means(spark, sf_dir):
    r = _read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("slot"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("w"))
    return _rounded(evaluate.weighted_mean(r, "x", "w", ("slot",)))
