"""Queries over frames, boxes, pixels, poses and byte codecs, made from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takeline.functions import columns as C
from takeline.operators import codec, detections, evaluate, fusion, integrity, resize, skeletons, spans
from takeline.plans.catalogue import SPANS_SQL, TAKES_SQL, _read, _rounded, event_takes, query, synthetic_spans
from takeline.sources import caches, files


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per event: six a clip, over four sources, every fifth without a stamp."""
    e = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    counter = F.when(F.col("event_id") % 5 == 0, F.lit("bad")).otherwise(F.lpad(F.col("event_id").cast("string"), 8, "0"))
    name = F.concat(F.lit("f_"), F.date_format("t", "yyyy-MM-dd_HH-mm-ss.SSS"), F.lit("_"), counter, F.lit(".png"))
    priority = (F.col("event_id") % 4).cast("int")
    return e.select(F.concat(F.lit("c"), F.floor(F.col("event_id") / 6).cast("string")).alias("clip_id"), F.get(F.array(*map(F.lit, spans.SOURCES)), priority).alias("source"), priority.alias("priority"), name.alias("file_name"))


LISTING_SQL = """
  ls AS (SELECT 'c' || (event_id // 6) AS clip_id, CAST(event_id % 4 AS INT) AS priority, event_id % 5 = 0 AS bad, strftime(ts, '%Y-%m-%d') AS date, epoch_us(ts) // 1000 % 86400000 AS ms, CAST(event_id AS INT) AS frame FROM events)"""


@query(f"""WITH {LISTING_SQL}, ok AS (SELECT *, min(priority) OVER (PARTITION BY clip_id) AS best FROM ls WHERE NOT bad)
SELECT clip_id, first(date ORDER BY date, ms, frame) AS date, first(ms ORDER BY date, ms, frame) AS start_ms, first(frame ORDER BY date, ms, frame) AS first_frame,
  last(ms ORDER BY date, ms, frame) AS end_ms, last(frame ORDER BY date, ms, frame) AS last_frame FROM ok WHERE priority = best GROUP BY clip_id""")
def span_cascade(spark, sf_dir):
    return spans.spans(listing(spark, sf_dir))


_SEEN = {"normal": "true", "Depth_hidden": "priority IN (1, 2)", "IR_hidden": "priority IN (0, 2)", "Skeleton_only": "priority = 2", "partial_clock": "priority < 3 AND i % 7 <> 0", "below50_clock": "priority < 3 AND i % 3 = 0", "all_clock_hidden": "false"}


@query(f"WITH {LISTING_SQL}, n AS (SELECT *, dense_rank() OVER (ORDER BY clip_id) - 1 AS i FROM ls)\n" + "\nUNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS files, count(DISTINCT clip_id) AS clips FROM n WHERE {w}" for m, w in _SEEN.items()))
def visibility_modes(spark, sf_dir):
    rows, out = listing(spark, sf_dir), None
    for mode in spans.MODES:
        one = spans.visible(rows, mode).agg(F.count("*").alias("files"), F.count_distinct("clip_id").alias("clips")).select(F.lit(mode).alias("mode"), "files", "clips")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SPANS_SQL}, g AS (SELECT *, 'clock_' || date || '_' || origin AS take_id FROM ck WHERE reason IS NULL)
SELECT take_id, any_value(date) AS date, min(start_ms) / 1000.0 AS start, max(start_ms) / 1000.0 AS "end", CAST(count(*) AS INT) AS n FROM g GROUP BY take_id""")
def take_summaries(spark, sf_dir):
    return spans.take_summary(spans.clock_takes(synthetic_spans(spark, sf_dir))[0])


@query(f"""WITH {SPANS_SQL}, m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w > 3600000 OR first_frame < lag(last_frame) OVER w OR lag(end_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM sq WINDOW w AS (PARTITION BY date ORDER BY start_ms, clip_id))
SELECT clip_id, date, CAST(sum(new) OVER (PARTITION BY date ORDER BY start_ms, clip_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS take_no FROM m""")
def counter_gap_takes(spark, sf_dir):
    """No device here: the windows are hours and their edges are mended."""
    return spans.gap_takes(synthetic_spans(spark, sf_dir), 3_600_000).select("clip_id", "date", "take_no")


@query(f"""WITH {SPANS_SQL}, m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w > 3600000 OR first_frame < lag(first_frame) OVER w OR lag(end_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM sq WINDOW w AS (PARTITION BY date ORDER BY start_ms, clip_id))
SELECT clip_id, date, CAST(sum(new) OVER (PARTITION BY date ORDER BY start_ms, clip_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS take_no FROM m""")
def start_counter_takes(spark, sf_dir):
    """A take ends where a clip's first counter is below that of the clip before."""
    return spans.gap_takes(synthetic_spans(spark, sf_dir), 3_600_000, frames="first_frame").select("clip_id", "date", "take_no")


_ORDERS = {"start_end": "start_ms, end_ms, clip_id", "stable_start": "start_ms, clip_id", "reverse_identical": "start_ms, end_ms, clip_id DESC"}


@query(f"WITH {SPANS_SQL}, g AS (SELECT clip_id, start_ms // 3600000 * 3600000 AS start_ms, end_ms // 3600000 * 3600000 AS end_ms, date FROM sq)\n" + "\nUNION ALL ".join(f"SELECT '{k}' AS kind, clip_id, CAST(row_number() OVER (PARTITION BY 'clock_' || date || '_' || start_ms ORDER BY {o}) - 1 AS INT) AS position FROM g WHERE start_ms = end_ms" for k, o in _ORDERS.items()))
def order_variants(spark, sf_dir):
    """Spans of whole hours, so that many clips of a take start and end together."""
    hour = lambda c: (F.floor(F.col(c) / 3_600_000) * 3_600_000).alias(c)
    s = synthetic_spans(spark, sf_dir).select("clip_id", "date", hour("start_ms"), F.lit(0).alias("first_frame"), hour("end_ms"), F.lit(0).alias("last_frame"))
    out = None
    for kind in _ORDERS:
        one = spans.clock_takes(s, kind)[0].select(F.lit(kind).alias("kind"), "clip_id", "position")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {TAKES_SQL}, g AS (SELECT (start_ms - lag(start_ms) OVER (PARTITION BY user_id, take_no ORDER BY start_ms, CAST(event_id AS VARCHAR))) / 1000.0 AS gap FROM tk)
SELECT round(quantile_cont(gap, 0.5), 6) AS q50, round(quantile_cont(gap, 0.9), 6) AS q90 FROM g WHERE gap IS NOT NULL""")
def gap_medians(spark, sf_dir):
    t = event_takes(spark, sf_dir).select(F.concat_ws("_", F.col("user_id").cast("string"), F.col("take_no").cast("string")).alias("take_id"), (F.col("start_ms") / 1000.0).alias("seconds"), "clip_id", "start_ms")
    t = t.withColumn("position", F.row_number().over(Window.partitionBy("take_id").orderBy("start_ms", "clip_id")))
    return _rounded(evaluate.gap_quantiles(t, (0.5, 0.9)))


_X, _Y = "list_transform(embedding[1:8], lambda z: CAST(z AS DOUBLE))", "list_transform(embedding[9:16], lambda z: CAST(z AS DOUBLE))"


@query(f"""WITH b AS (SELECT vec_id, {_X} AS x, {_Y} AS y FROM embeddings), s AS (SELECT *, list_sum(x) / 8 AS m FROM b), t AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m)))) AS l FROM s),
k AS (SELECT vec_id, 'velocity' AS kind, list_transform(range(1, 9), lambda i: CASE WHEN i = 1 THEN 0.0 ELSE x[i] - x[i - 1] END) AS v FROM t
UNION ALL SELECT vec_id, 'resample', list_transform(range(0, 5), lambda i: x[CAST(floor(i * 7 / 4.0) AS INT) + 1] + (i * 7 / 4.0 - floor(i * 7 / 4.0)) * (x[least(CAST(floor(i * 7 / 4.0) AS INT) + 2, 8)] - x[CAST(floor(i * 7 / 4.0) AS INT) + 1])) FROM t
UNION ALL SELECT vec_id, 'direction', list_transform(x, lambda v: (v - m) * 3.0 / greatest(l, 1e-12)) FROM t
UNION ALL SELECT vec_id, 'design', list_concat(list_concat(x, y), list_concat(list_transform(range(1, 9), lambda i: x[i] * y[i]), list_transform(range(1, 9), lambda i: abs(x[i] - y[i])))) FROM t
UNION ALL SELECT vec_id, 'standard', list_transform(range(1, 9), lambda i: (x[i] - 0.25 * i) / (0.5 + i)) FROM t
UNION ALL SELECT vec_id, 'roll', list_concat(x[6:8], x[1:5]) FROM t UNION ALL SELECT vec_id, 'back', list_concat(x[2:8], x[1:1]) FROM t UNION ALL SELECT vec_id, 'flip', list_reverse(x) FROM t)
SELECT vec_id, kind, CAST(i AS INT) AS i, round(v[i + 1], 6) AS v FROM (SELECT *, unnest(range(0, len(v))) AS i FROM k)""")
def array_functions(spark, sf_dir):
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda z: z.cast("double"))
    b = _read(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("x"), part(9).alias("y"))
    x, y = F.col("x"), F.col("y")
    lits = lambda f: F.array(*(F.lit(f(i)) for i in range(1, 9)))
    kinds = {
        "velocity": C.velocity(x), "resample": C.resample(x, 5), "direction": C.direction(x, 3.0), "design": C.readout_features(x, y), "standard": C.standardise(x, lits(lambda i: 0.25 * i), lits(lambda i: 0.5 + i)),
        "roll": C.roll(x, 3), "back": C.roll(x, -1), "flip": F.reverse(x),
    }
    each = b.select("vec_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()))).alias("s"))
    return _rounded(each.select("vec_id", "s.kind", F.posexplode("s.v").alias("i", "v")))


@query(r"""SELECT doc_id, '/a/fold' || (doc_id % 7) || '.pt' AS path, CAST(doc_id % 7 AS INT) AS fold, 'run' AS last, 'walk' AS action, 'u' || (doc_id % 5) AS "user", 't' || (doc_id % 3) AS trial, 'dev' || (doc_id % 2) AS device,
  CASE WHEN doc_id % 2 = 0 THEN 'fused' ELSE 'imu' END AS builder, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-det' || (doc_id % 3) END AS suffix FROM documents""")
def name_parts(spark, sf_dir):
    """Fold of a path, last component, parts of an id, device before a bracket, builder and suffix of a cache."""
    i = F.col("doc_id")
    text = lambda *p: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in p))
    clip = C.split_id(text("walk/u", i % 5, "/t", i % 3))
    cache = C.cache_parts(text("/c/", F.when(i % 2 == 0, "fused").otherwise("imu"), F.when(i % 3 == 0, "").otherwise(text("-det", i % 3)), "_test.npz"), ("fused", "imu"))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", text("/a/fold", i % 7, ".pt").alias("path"), C.fold_of_path(text("x/folds/fold", i % 7, ".pt")).alias("fold"), C.last_component(text("a\\", i, "/run//")).alias("last"),
        clip["action"].alias("action"), clip["user"].alias("user"), clip["trial"].alias("trial"), C.device_prefix(text("dev", i % 2, "(x)(y)")).alias("device"), cache["builder"].alias("builder"), cache["suffix"].alias("suffix"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clips of sixteen events, and two candidate boxes for each of eight probes; every ninth clip has none."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 16).alias("k"))
    i, u, clip = F.col("event_id"), F.col("user_id"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("clip_id")
    x1, y1 = (u % 200).cast("double"), (i * 7 % 90).cast("double")
    found = e.where("k % 9 <> 0").select(clip, (i % 8).cast("int").alias("probe"), x1.alias("x1"), y1.alias("y1"), (x1 + 20 + i % 13).alias("x2"), (y1 + 30 + u % 7).alias("y2"), (((i * 37 + F.col("k") * 11) % 100) * (F.col("k") % 5 + 1) / 1250.0).alias("score"))
    return e.select(clip).distinct(), found


BOXES_SQL = """
  ev AS (SELECT event_id AS i, user_id AS u, event_id // 16 AS k FROM events), cs AS (SELECT DISTINCT k, 'c' || k AS clip_id FROM ev),
  bx AS (SELECT 'c' || k AS clip_id, CAST(i % 8 AS INT) AS probe, CAST(u % 200 AS DOUBLE) AS x1, CAST(i * 7 % 90 AS DOUBLE) AS y1, CAST(u % 200 + 20 + i % 13 AS DOUBLE) AS x2, CAST(i * 7 % 90 + 30 + u % 7 AS DOUBLE) AS y2, CAST((i * 37 + k * 11) % 100 * (k % 5 + 1) AS DOUBLE) / 1250 AS score FROM ev WHERE k % 9 <> 0),
  bb AS (SELECT * FROM bx QUALIFY row_number() OVER (PARTITION BY clip_id, probe ORDER BY score DESC, x1, y1) = 1),
  st AS (SELECT clip_id, max(score) AS best_score, count(*) FILTER (score >= 0.1) AS n, greatest(stddev_pop((x1 + x2) / 2) FILTER (score >= 0.1), stddev_pop((y1 + y2) / 2) FILTER (score >= 0.1)) AS sd FROM bb GROUP BY clip_id),
  ac AS (SELECT cs.clip_id, CASE WHEN best_score IS NULL THEN 'none' WHEN best_score >= 0.3 THEN 'strong' WHEN n < 4 THEN 'sparse' WHEN sd > 64 THEN 'scattered' ELSE 'agree' END AS reason, coalesce(n, 0) AS n, coalesce(best_score, 0.0) AS best_score FROM cs LEFT JOIN st USING (clip_id)),
  pw AS (SELECT clip_id, any_value(reason) AS source, any_value(n) AS n, any_value(ac.best_score) AS best_score, quantile_cont((x1 + x2) / 2, 0.5) AS cx, quantile_cont((y1 + y2) / 2, 0.5) AS cy, greatest(max(greatest(x2 - x1, y2 - y1)) * 1.4, 0.35 * 640) / 2 AS half
    FROM ac JOIN bb USING (clip_id) WHERE reason IN ('strong', 'agree') AND score >= 0.1 GROUP BY clip_id),
  pe AS (SELECT clip_id, CAST(round_even(cy - half, 0) AS INT) AS top, CAST(round_even(cx - half, 0) AS INT) AS "left", CAST(round_even(cy + half, 0) AS INT) AS bottom, CAST(round_even(cx + half, 0) AS INT) AS "right", CAST(n AS INT) AS n_detected, source, best_score FROM pw)"""


@query(f"WITH {BOXES_SQL} SELECT * FROM bb")
def best_boxes(spark, sf_dir):
    return detections.best_per_probe(boxes(spark, sf_dir)[1])


@query(f"WITH {BOXES_SQL} SELECT clip_id, reason, CAST(CASE WHEN reason IN ('strong', 'agree') THEN n ELSE 0 END AS INT) AS n_detected, best_score FROM ac")
def detector_accept(spark, sf_dir):
    clips, found = boxes(spark, sf_dir)
    return detections.accept(detections.best_per_probe(found), 640, clips=clips)


@query(f"WITH {BOXES_SQL} SELECT reason, count(*) AS clips FROM ac GROUP BY reason")
def source_tally(spark, sf_dir):
    return detector_accept(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("clips"))


@query(f"WITH {BOXES_SQL} SELECT * FROM pe")
def person_windows(spark, sf_dir):
    return detections.person_windows(detections.best_per_probe(boxes(spark, sf_dir)[1]), 640)


@query(f"""WITH {BOXES_SQL}, mo AS (SELECT clip_id, 10 + k % 30 AS t, 20 + k % 40 AS l FROM cs WHERE k % 4 <> 0)
SELECT clip_id, CAST(coalesce(top, t - 15) AS INT) AS top, CAST(coalesce("left", l) AS INT) AS "left", CAST(coalesce(bottom, t + 65) AS INT) AS bottom, CAST(coalesce("right", l + 80) AS INT) AS "right", coalesce(source, CASE WHEN t IS NOT NULL THEN 'motion' END) AS source
FROM cs LEFT JOIN pe USING (clip_id) LEFT JOIN mo USING (clip_id)""")
def window_choice(spark, sf_dir):
    clips, found = boxes(spark, sf_dir)
    k = F.substring("clip_id", 2, 20).cast("long")
    t, x = (10 + k % 30).cast("int"), (20 + k % 40).cast("int")
    motion = clips.where(k % 4 != 0).select("clip_id", t.alias("top"), x.alias("left"), (t + 50).alias("bottom"), (x + 80).alias("right"))
    return detections.choose_window(clips, detections.person_windows(detections.best_per_probe(found), 640), motion)


@query(f"""WITH {BOXES_SQL} SELECT round(quantile_cont(score, 0.05), 6) AS q5, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.95), 6) AS q95 FROM bx""")
def percentile_summary(spark, sf_dir):
    return _rounded(evaluate.quantiles_by_rank(boxes(spark, sf_dir)[1], "score", (0.05, 0.5, 0.95)))


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height and width of the frames of each clip of ``boxes``."""
    k = F.substring("clip_id", 2, 20).cast("long")
    return boxes(spark, sf_dir)[0].select("clip_id", (480 + k % 3 * 60).cast("int").alias("height"), (640 + k % 4 * 32).cast("int").alias("width"))


_FRAMES_SQL = "fs AS (SELECT clip_id, k, CAST(480 + k % 3 * 60 AS INT) AS height, CAST(640 + k % 4 * 32 AS INT) AS width FROM cs)"
_TILES_SQL = """ti AS (SELECT clip_id, k, CAST(t AS INT) AS tile, CAST(t // 2 * (height - floor(height * 0.6)) AS INT) AS top, CAST(t % 2 * (width - floor(width * 0.6)) AS INT) AS "left", CAST(floor(height * 0.6) AS INT) AS height, CAST(floor(width * 0.6) AS INT) AS width FROM fs, range(4) r(t))"""


@query(f"WITH {BOXES_SQL}, {_FRAMES_SQL}, {_TILES_SQL} SELECT * EXCLUDE (k) FROM ti")
def corner_tiles(spark, sf_dir):
    return detections.tiles(clip_frames(spark, sf_dir))


def tile_boxes(offsets: DataFrame) -> DataFrame:
    """Boxes that a detector finds in tiles: some probes of some clips, now and then equally good in two tiles."""
    k, t, p = F.substring("clip_id", 2, 20).cast("long"), F.col("tile"), F.col("probe")
    found = offsets.where((k + t) % 3 != 0).withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x1, y1 = (k * 3 % 90 + t * 7).cast("double"), (k * 5 % 70 + p % 3).cast("double")
    score = ((k * 13 + p * 5 + F.when(p % 2 == 0, 0).otherwise(t * 31)) % 50) * (k % 4) / 400.0
    return found.select("clip_id", "probe", "tile", x1.alias("x1"), y1.alias("y1"), (x1 + 20).alias("x2"), (y1 + 40 + t).alias("y2"), score.alias("score"))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("clip_id", 2, 20).cast("long")
    t, x = (10 + k % 30).cast("int"), (20 + k % 40).cast("int")
    return boxes(spark, sf_dir)[0].where(k % 5 != 0).select("clip_id", t.alias("top"), x.alias("left"), (t + 50).alias("bottom"), (x + 80).alias("right"))


def _person_sql(name: str, boxes_of: str, source: str) -> str:
    """Tables ``{name}a`` and ``{name}``: the acceptance rule and windows of a box a probe, with widths of their own."""
    return f"""{name}a AS (SELECT clip_id, any_value(width) AS w, max(score) AS best_score, count(*) AS n, greatest(stddev_pop((x1 + x2) / 2), stddev_pop((y1 + y2) / 2)) AS sd FROM {boxes_of} JOIN fs USING (clip_id) GROUP BY clip_id),
  {name}h AS (SELECT a.clip_id, any_value(a.w) AS w, any_value(CASE WHEN a.best_score >= 0.3 THEN 'strong' ELSE 'agree' END) AS source, any_value(n) AS n, any_value(a.best_score) AS best_score, quantile_cont((x1 + x2) / 2, 0.5) AS cx, quantile_cont((y1 + y2) / 2, 0.5) AS cy, greatest(max(greatest(x2 - x1, y2 - y1)) * 1.4, any_value(a.w) * 0.35::DOUBLE) / 2 AS half
    FROM {name}a a JOIN {boxes_of} USING (clip_id) WHERE a.best_score >= 0.3 OR (n >= 4 AND sd <= 0.1::DOUBLE * a.w) GROUP BY a.clip_id),
  {name} AS (SELECT clip_id, CAST(round_even(cy - half, 0) AS INT) AS top, CAST(round_even(cx - half, 0) AS INT) AS "left", CAST(round_even(cy + half, 0) AS INT) AS bottom, CAST(round_even(cx + half, 0) AS INT) AS "right", CAST(n AS INT) AS n_detected, {source} AS source, best_score FROM {name}h)"""


_RESCUE_SQL = f"""WITH {BOXES_SQL}, {_FRAMES_SQL}, b1 AS (SELECT * FROM bb WHERE score >= 0.1), {_person_sql("pl", "b1", "source")},
  fa AS (SELECT * FROM fs WHERE clip_id NOT IN (SELECT clip_id FROM pl)), {_TILES_SQL},
  tb AS (SELECT ti.clip_id, p AS probe, tile, CAST(k * 3 % 90 + tile * 7 AS DOUBLE) + "left" AS x1, CAST(k * 5 % 70 + p % 3 AS DOUBLE) + top AS y1, CAST(k * 3 % 90 + tile * 7 + 20 AS DOUBLE) + "left" AS x2, CAST(k * 5 % 70 + p % 3 + 40 + tile AS DOUBLE) + top AS y2,
    CAST((k * 13 + p * 5 + CASE WHEN p % 2 = 0 THEN 0 ELSE tile * 31 END) % 50 * (k % 4) AS DOUBLE) / 400 AS score FROM ti, range(8) r(p) WHERE (k + tile) % 3 <> 0 AND clip_id IN (SELECT clip_id FROM fa)),
  b2 AS (SELECT * FROM (SELECT * FROM tb WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY clip_id, probe ORDER BY score DESC, tile) = 1) WHERE score >= 0.1), {_person_sql("tl", "b2", "'tiled'")},
  mo AS (SELECT clip_id, CAST(10 + k % 30 - 15 AS INT) AS top, CAST(20 + k % 40 AS INT) AS "left", CAST(10 + k % 30 + 65 AS INT) AS bottom, CAST(20 + k % 40 + 80 AS INT) AS "right" FROM cs WHERE k % 5 <> 0),
  re AS (SELECT * FROM pl UNION ALL SELECT * FROM tl UNION ALL
    SELECT fa.clip_id, coalesce(mo.top, 0), coalesce(mo."left", 0), coalesce(mo.bottom, height), coalesce(mo."right", width), 0, CASE WHEN mo.clip_id IS NULL THEN 'whole' ELSE 'motion' END, coalesce(best_score, 0.0)
    FROM fa LEFT JOIN mo USING (clip_id) LEFT JOIN (SELECT clip_id, max(score) AS best_score FROM b2 GROUP BY clip_id) USING (clip_id) WHERE fa.clip_id NOT IN (SELECT clip_id FROM tl))"""


@query(f"{_RESCUE_SQL} SELECT * FROM re")
def rescued_windows(spark, sf_dir):
    """Windows by the first rung that holds: frames, tiles, motion, the whole frame."""
    return detections.rescued_windows(clip_frames(spark, sf_dir), boxes(spark, sf_dir)[1], tile_boxes, _moved(spark, sf_dir))


@query(f"{_RESCUE_SQL} SELECT source, count(*) AS clips, CAST(sum(n_detected) AS BIGINT) AS boxes FROM re GROUP BY source")
def rescue_rungs(spark, sf_dir):
    """Clips that each rung settles."""
    return rescued_windows(spark, sf_dir).groupBy("source").agg(F.count("*").alias("clips"), F.sum("n_detected").alias("boxes"))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of three frames of 8 x 8 pixels, one pixel an event; every eleventh without a return."""
    i = F.col("event_id")
    value = F.when(i * 7919 % 11 == 0, 255).otherwise((i * 7919 + F.col("user_id")) % 251).cast("int")
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.floor(i / 192).cast("string")).alias("clip_id"), F.floor(i % 192 / 64).cast("int").alias("frame_no"), F.floor(i % 64 / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), value.alias("depth_rank"))


PIXELS_SQL = """
  px AS (SELECT 'c' || (event_id // 192) AS clip_id, CAST(event_id % 192 // 64 AS INT) AS frame_no, CAST(event_id % 64 // 8 AS INT) AS y, CAST(event_id % 8 AS INT) AS x, CAST(CASE WHEN event_id * 7919 % 11 = 0 THEN 255 ELSE (event_id * 7919 + user_id) % 251 END AS INT) AS depth_rank FROM events)"""


@query(f"""WITH {PIXELS_SQL}, l AS (SELECT clip_id, depth_rank AS v, lag(depth_rank) OVER (PARTITION BY clip_id, frame_no, y ORDER BY x) AS p FROM px)
SELECT clip_id, round(avg(abs(v - p)) FILTER (v <> 255 AND p <> 255), 6) AS smoothness FROM l GROUP BY clip_id""")
def depth_smoothness(spark, sf_dir):
    return _rounded(detections.smoothness(event_pixels(spark, sf_dir)))


@query(f"""WITH {PIXELS_SQL}, md AS (SELECT clip_id, y, x, quantile_cont(depth_rank, 0.5) AS mid FROM px WHERE depth_rank <> 255 GROUP BY ALL),
mv AS (SELECT px.clip_id, px.y, px.x, avg(abs(depth_rank - mid)) AS m FROM px JOIN md ON px.clip_id = md.clip_id AND px.y = md.y AND px.x = md.x WHERE depth_rank <> 255 GROUP BY ALL HAVING avg(abs(depth_rank - mid)) > 0),
lv AS (SELECT clip_id, quantile_cont(m, 0.9) AS level FROM mv GROUP BY clip_id),
b0 AS (SELECT clip_id, min(y) AS t, min(x) AS l, max(y) + 1 AS b, max(x) + 1 AS r FROM mv JOIN lv USING (clip_id) WHERE m >= level GROUP BY clip_id),
b1 AS (SELECT clip_id, greatest(t - floor((b - t) * 0.25), 0) AS t, greatest(l - floor((r - l) * 0.25), 0) AS l, least(b + floor((b - t) * 0.25), 8) AS b, least(r + floor((r - l) * 0.25), 8) AS r FROM b0),
b2 AS (SELECT *, greatest(b - t, r - l) AS side FROM b1 WHERE b - t >= 3 AND r - l >= 3),
b3 AS (SELECT clip_id, floor((t + b) / 2) - floor(side / 2) AS t, floor((l + r) / 2) - floor(side / 2) AS l, side FROM b2)
SELECT clip_id, CAST(coalesce(greatest(t, 0), 0) AS INT) AS top, CAST(coalesce(greatest(l, 0), 0) AS INT) AS "left", CAST(coalesce(least(t + side, 8), 8) AS INT) AS bottom, CAST(coalesce(least(l + side, 8), 8) AS INT) AS "right"
FROM (SELECT DISTINCT clip_id FROM px) LEFT JOIN b3 USING (clip_id)""")
def motion_boxes(spark, sf_dir):
    return detections.motion_boxes(event_pixels(spark, sf_dir), 8, 8, quantile=0.9, min_side=3)


@query(f"""WITH {PIXELS_SQL}, w AS (SELECT CAST(y AS INT) AS wy, CAST(x AS INT) AS wx FROM range(0, 5) a(y), range(0, 7) b(x))
SELECT clip_id, frame_no, wy, wx, depth_rank AS value FROM w JOIN px ON px.y = greatest(least(wy - 1, 7), 0) AND px.x = greatest(least(wx + 3, 7), 0)""")
def window_crop(spark, sf_dir):
    """A window that leaves the frame above and to the right: its edge is repeated."""
    px = event_pixels(spark, sf_dir)
    windows = px.select("clip_id").distinct().select("clip_id", F.lit(-1).alias("top"), F.lit(3).alias("left"), F.lit(4).alias("bottom"), F.lit(10).alias("right"))
    return detections.crop_pad(px.withColumnRenamed("depth_rank", "value"), windows, 8, 8)


@query(f"""WITH {PIXELS_SQL} SELECT CAST(x % 3 AS INT) AS channel, round(avg(depth_rank), 6) AS mean, round(sqrt(greatest(avg(depth_rank * depth_rank) - avg(depth_rank) * avg(depth_rank), 1e-12)), 6) AS std FROM px GROUP BY 1""")
def channel_stats(spark, sf_dir):
    return _rounded(detections.channel_stats(event_pixels(spark, sf_dir).select((F.col("x") % 3).alias("channel"), F.col("depth_rank").alias("value"))))


@query(f"""WITH {PIXELS_SQL}, l AS (SELECT clip_id, frame_no, quantile_cont(depth_rank, 0.01) AS lo, quantile_cont(depth_rank, 0.995) AS hi FROM px GROUP BY ALL)
SELECT px.clip_id, px.frame_no, y, x, CAST(CASE WHEN hi > lo THEN floor(greatest(least((depth_rank - lo) * 255.0 / (hi - lo), 255.0), 0.0)) ELSE depth_rank END AS INT) AS value FROM px JOIN l ON px.clip_id = l.clip_id AND px.frame_no = l.frame_no""")
def contrast_stretch(spark, sf_dir):
    return detections.stretched(event_pixels(spark, sf_dir).withColumnRenamed("depth_rank", "value"))


def colours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Coloured pixels (black where there is no return), and 256 reference colours."""
    v = F.col("depth_rank")
    shade = lambda c: F.when(v == 255, 0).otherwise(c).cast("int")
    px = event_pixels(spark, sf_dir).withColumn("packed_rgb", C.packed_rgb(shade(v % 50), shade(v * 3 % 200), shade(255 - v)))
    k = F.col("id").cast("int")
    return px, spark.range(256).select(k.alias("idx"), k.alias("r"), (255 - k).alias("g"), (k * 5 % 256).alias("b"))


COLOURS_SQL = f"""{PIXELS_SQL},
  co AS (SELECT *, CASE WHEN depth_rank = 255 THEN 0 ELSE depth_rank % 50 * 65536 + depth_rank * 3 % 200 * 256 + 255 - depth_rank END AS packed_rgb FROM px),
  rf AS (SELECT i AS idx, i AS r, 255 - i AS g, i * 5 % 256 AS b FROM range(0, 256) t(i)), ct AS (SELECT packed_rgb, count(*) AS n FROM co GROUP BY packed_rgb),
  nr AS (SELECT packed_rgb, idx, sqrt(pow(packed_rgb // 65536 - r, 2) + pow(packed_rgb // 256 % 256 - g, 2) + pow(packed_rgb % 256 - b, 2)) AS d FROM ct, rf WHERE packed_rgb <> 0 AND n >= 2 QUALIFY row_number() OVER (PARTITION BY packed_rgb ORDER BY d, idx) = 1),
  pl AS (SELECT packed_rgb, CAST(round_even(CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY idx, d, packed_rgb) - 1) * 254.0 / (count(*) OVER () - 1) ELSE 0 END, 0) AS INT) AS depth_rank FROM nr)"""


@query(f"WITH {COLOURS_SQL} SELECT CAST(packed_rgb AS INT) AS packed_rgb, n FROM ct")
def colour_counts(spark, sf_dir):
    return detections.colour_counts(colours(spark, sf_dir)[0])


@query(f"WITH {COLOURS_SQL} SELECT CAST(packed_rgb AS INT) AS packed_rgb, depth_rank FROM pl")
def palette_build(spark, sf_dir):
    px, reference = colours(spark, sf_dir)
    return detections.build_palette(detections.colour_counts(px), reference, 2)


@query(f"WITH {COLOURS_SQL} SELECT clip_id, frame_no, y, x, coalesce(pl.depth_rank, 255) AS depth_rank FROM co LEFT JOIN pl USING (packed_rgb)")
def palette_decode(spark, sf_dir):
    px, reference = colours(spark, sf_dir)
    palette = detections.build_palette(detections.colour_counts(px), reference, 2)
    return detections.decode_palette(px.drop("depth_rank"), palette).select("clip_id", "frame_no", "y", "x", "depth_rank")


@query("""WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS clip_id, vec_id % 60 - 30.0 AS t, vec_id % 40 - 20.0 AS l, 60.0 AS s FROM embeddings), g AS (SELECT w.*, CAST(a.i AS INT) AS gy, CAST(b.i AS INT) AS gx FROM w, range(0, 4) a(i), range(0, 4) b(i))
SELECT clip_id, gy, gx, round(greatest(least(t + (gy + 1) * 15, 48) - greatest(t + gy * 15, 0), 0) / 15 * greatest(least(l + (gx + 1) * 15, 64) - greatest(l + gx * 15, 0), 0) / 15, 6) AS support FROM g""")
def patch_support(spark, sf_dir):
    v = F.col("vec_id")
    t, x = (v % 60 - 30).cast("double"), (v % 40 - 20).cast("double")
    w = _read(spark, sf_dir, "embeddings").select(v.cast("string").alias("clip_id"), t.alias("top"), x.alias("left"), (t + 60).alias("bottom"), (x + 60).alias("right"))
    return _rounded(detections.patch_support(w, 48, 64, 4))


def _taps_sql(n_in: str, n_out: int) -> str:
    """A row for each tap: ``n_in, i, j, a``."""
    return f"SELECT n_in, i, j, 2 * greatest(n_in, {n_out}) - abs((2 * j + 1) * {n_out} - (2 * i + 1) * n_in) AS a FROM (SELECT DISTINCT {n_in} AS n_in FROM sz), range({n_out}) r(i), range(0, 400) q(j) WHERE j < n_in AND 2 * greatest(n_in, {n_out}) > abs((2 * j + 1) * {n_out} - (2 * i + 1) * n_in)"


def _resized_sql(height: int, width: int) -> str:
    """``rs`` from images ``im`` (``clip_id, frame_no, y, x, value, height, width``)."""
    return f"""sz AS (SELECT DISTINCT height, width FROM im), wx AS ({_taps_sql("width", width)}), wy AS ({_taps_sql("height", height)}),
  r1 AS (SELECT clip_id, frame_no, y, height, i AS x, (2 * sum(value * a) + sum(a)) // (2 * sum(a)) AS value FROM im JOIN wx ON n_in = width AND j = x GROUP BY clip_id, frame_no, y, height, i),
  rs AS (SELECT clip_id, frame_no, CAST(i AS INT) AS y, CAST(x AS INT) AS x, CAST((2 * sum(value * a) + sum(a)) // (2 * sum(a)) AS INT) AS value FROM r1 JOIN wy ON n_in = height AND j = y GROUP BY clip_id, frame_no, x, i)"""


@query(f"""WITH {PIXELS_SQL}, im AS (SELECT clip_id, frame_no, y, x, depth_rank AS value, 8 - frame_no % 2 AS height, 8 AS width FROM px WHERE y < 8 - frame_no % 2), {_resized_sql(3, 11)} SELECT * FROM rs""")
def resized_frames(spark, sf_dir):
    """Frames of two heights, made lower and wider."""
    px = event_pixels(spark, sf_dir).withColumnRenamed("depth_rank", "value").withColumns({"height": 8 - F.col("frame_no") % 2, "width": F.lit(8)}).where("y < height")
    return resize.resized(px, 3, 11)


@query(f"""WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS clip_id, vec_id % 60 - 30 AS t, vec_id % 40 - 20 AS l, 50 + vec_id % 3 * 20 AS s FROM embeddings), sz AS (SELECT DISTINCT s FROM w), tp AS ({_taps_sql("s", 24)}),
sh AS (SELECT s, o, f, (i - 2) // 5 AS cell, avg(q) AS share FROM (SELECT s, o, f, i, sum(CASE WHEN o + j >= 0 AND o + j < f THEN a ELSE 0 END) / sum(a) AS q FROM (SELECT DISTINCT s, o, f FROM (SELECT s, t AS o, 48 AS f FROM w UNION ALL SELECT s, l, 64 FROM w)) JOIN tp ON n_in = s WHERE i >= 2 AND i < 22 GROUP BY s, o, f, i) GROUP BY ALL)
SELECT clip_id, CAST(y.cell AS INT) AS gy, CAST(x.cell AS INT) AS gx, round(y.share * x.share, 6) AS support FROM w JOIN sh y ON y.s = w.s AND y.o = t AND y.f = 48 JOIN sh x ON x.s = w.s AND x.o = l AND x.f = 64""")
def resized_support(spark, sf_dir):
    """Support of the cells of windows of three sizes as a resized mask has it, without its border."""
    v = F.col("vec_id")
    t, x, s = (v % 60 - 30).cast("int"), (v % 40 - 20).cast("int"), (50 + v % 3 * 20).cast("int")
    w = _read(spark, sf_dir, "embeddings").select(v.cast("string").alias("clip_id"), t.alias("top"), x.alias("left"), (t + s).alias("bottom"), (x + s).alias("right"))
    return _rounded(detections.patch_support(w, 48, 64, 4, 24, 2))


_ONTO = "list_transform(range(0, n), lambda i: CASE WHEN {c} = n THEN i WHEN n > 1 THEN CAST(round_even(i * (({c} - 1) / (n - 1)), 0) AS INT) ELSE 0 END)"


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS clip_id, n_chars % 70 AS a, n_chars // 3 % 45 AS b, CAST(least(n_chars % 70, n_chars // 3 % 45) AS INT) AS n FROM documents),
o AS (SELECT clip_id, n, {_ONTO.format(c="a")} AS da, {_ONTO.format(c="b")} AS ib, unnest(range(0, least(n, 32))) AS k FROM d WHERE n > 0),
p AS (SELECT *, CASE WHEN least(n, 32) = 1 THEN 0 ELSE CAST(round_even(k * ((n - 1) / (least(n, 32) - 1)), 0) AS INT) END AS pick FROM o)
SELECT clip_id, CAST(k AS INT) AS k, CAST(da[pick + 1] AS INT) AS depth_no, CAST(ib[pick + 1] AS INT) AS ir_no FROM p""")
def frame_alignment(spark, sf_dir):
    n = F.col("n_chars")
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("clip_id"), (n % 70).alias("n_depth"), (F.floor(n / 3) % 45).alias("n_ir"))
    return detections.aligned_frames(d)


@query(f"""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS clip_id, CASE WHEN event_id % 3 = 0 THEN 'I' ELSE 'D' END AS m, event_id, event_id % 97 <> 0 AS ok FROM events),
fr AS (SELECT *, row_number() OVER (PARTITION BY clip_id, m ORDER BY event_id) - 1 AS no FROM f), c AS (SELECT clip_id, count(*) FILTER (m = 'D') AS a, count(*) FILTER (m = 'I') AS b FROM fr GROUP BY clip_id),
d AS (SELECT *, CAST(least(a, b) AS INT) AS n FROM c), o AS (SELECT clip_id, n, {_ONTO.format(c="a")} AS da, {_ONTO.format(c="b")} AS ib, unnest(range(0, least(n, 32))) AS k FROM d WHERE n > 0),
p AS (SELECT *, CASE WHEN least(n, 32) = 1 THEN 0 ELSE CAST(round_even(k * ((n - 1) / (least(n, 32) - 1)), 0) AS INT) END AS pick FROM o),
q AS (SELECT clip_id, k, da[pick + 1] AS dn, ib[pick + 1] AS i_n FROM p),
r AS (SELECT q.*, coalesce(x.ok, false) AS dok, coalesce(y.ok, false) AS iok FROM q LEFT JOIN fr x ON x.clip_id = q.clip_id AND x.m = 'D' AND x.no = dn LEFT JOIN fr y ON y.clip_id = q.clip_id AND y.m = 'I' AND y.no = i_n),
s AS (SELECT clip_id, bool_and(dok) AS whole, NOT bool_and(iok) AS dead FROM r GROUP BY clip_id)
SELECT r.clip_id, CAST(k AS INT) AS k, CAST(dn AS INT) AS depth_no, CAST(CASE WHEN NOT dead THEN i_n END AS INT) AS ir_no, dead AS ir_dead, a = b AND NOT dead AS aligned FROM r JOIN s USING (clip_id) JOIN d USING (clip_id) WHERE whole""")
def four_channel_frames(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clip_id"), F.when(F.col("event_id") % 3 == 0, "I").otherwise("D").alias("modality"), "event_id", (F.col("event_id") % 97 != 0).alias("readable"))
    no = F.row_number().over(Window.partitionBy("clip_id", "modality").orderBy("event_id")) - 1
    return detections.four_channels(e.withColumn("frame_no", no))


@query(f"""WITH {PIXELS_SQL}, im AS (SELECT clip_id, frame_no, y, x, depth_rank AS value, 8 - frame_no % 2 AS height, 8 AS width FROM px WHERE y < 8 - frame_no % 2), {_resized_sql(4, 4)}
SELECT clip_id, frame_no, CAST(count(*) AS INT) AS n, string_agg(value, ',' ORDER BY y, x) AS data FROM rs GROUP BY clip_id, frame_no""")
def image_cache(spark, sf_dir):
    """Frames of two heights at one size, an array each."""
    px = event_pixels(spark, sf_dir).withColumnRenamed("depth_rank", "value").withColumns({"height": 8 - F.col("frame_no") % 2, "width": F.lit(8)}).where("y < height")
    return caches.image_cache(px, 4).select("clip_id", "frame_no", "n", F.array_join(F.transform("data", lambda s: s["value"].cast("string")), ",").alias("data"))


def fused_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames of ``event_pixels`` with their modalities (every fifth clip lacks infrared), their pixels, and windows that leave the frame."""
    k = F.substring("clip_id", 2, 20).cast("long")
    frame = event_pixels(spark, sf_dir).withColumnRenamed("depth_rank", "value")
    depth = frame.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("clip_id", F.lit("D").alias("modality"), "frame_no", "channel", "y", "x", (F.col("value") * (F.col("channel") + 1) % 256).alias("value"))
    infrared = frame.where((k % 5 != 0) & (F.col("frame_no") < 2)).select("clip_id", F.lit("I").alias("modality"), "frame_no", F.lit(3).alias("channel"), "y", "x", (255 - F.col("value")).alias("value"))
    pixels = depth.unionByName(infrared)
    windows = frame.select("clip_id").distinct().select("clip_id", (k % 5 - 2).cast("int").alias("top"), (k % 3 - 1).cast("int").alias("left"), (k % 5 + 5).cast("int").alias("bottom"), (k % 3 + 6).cast("int").alias("right"))
    return pixels.select("clip_id", "modality", "frame_no").distinct().withColumn("readable", F.lit(True)), pixels, windows


_FUSED_SQL = f"""{PIXELS_SQL}, fr AS (SELECT *, CAST(substr(clip_id, 2) AS BIGINT) AS k FROM px),
  nf AS (SELECT clip_id, k, count(DISTINCT frame_no) AS nd, CASE WHEN k % 5 <> 0 THEN count(DISTINCT frame_no) FILTER (frame_no < 2) ELSE 0 END AS ni FROM fr GROUP BY clip_id, k),
  ch AS (SELECT clip_id, k AS clip, i AS k, CASE WHEN nd = least(nd, ni) THEN i WHEN least(nd, ni) > 1 THEN CAST(round_even(i * ((nd - 1) / (least(nd, ni) - 1)), 0) AS INT) ELSE 0 END AS dn, i AS i_n, nd = ni AS aligned FROM nf, range(2) r(i) WHERE i < least(nd, ni)),
  pc AS (SELECT clip_id, 'D' AS m, frame_no, c AS channel, y, x, depth_rank * (c + 1) % 256 AS value FROM fr, range(3) r(c) UNION ALL SELECT clip_id, 'I', frame_no, 3, y, x, 255 - depth_rank FROM fr),
  gr AS (SELECT clip_id, k, t - 2 AS top, l - 1 AS "left", wy, wx FROM (SELECT DISTINCT clip_id, k, k % 5 AS t, k % 3 AS l FROM fr), range(7) a(wy), range(7) b(wx)),
  im AS (SELECT gr.clip_id, ch.k * 10 + channel AS frame_no, wy AS y, wx AS x, value, 7 AS height, 7 AS width FROM gr JOIN ch USING (clip_id) JOIN pc ON pc.clip_id = gr.clip_id AND pc.frame_no = CASE WHEN m = 'D' THEN dn ELSE i_n END AND pc.y = greatest(least(top + wy, 7), 0) AND pc.x = greatest(least("left" + wx, 7), 0)),
  {_resized_sql(4, 4)}"""


@query(f"WITH {_FUSED_SQL} SELECT clip_id, CAST(frame_no // 10 AS INT) AS k, CAST(frame_no % 10 AS INT) AS channel, y, x, value FROM rs")
def fused_pixels(spark, sf_dir):
    """Chosen frames of both modalities, cut to one window and resized to one size."""
    frames, pixels, windows = fused_clips(spark, sf_dir)
    return detections.fused_pixels(detections.four_channels(frames), pixels, windows, 8, 8, 4)


@query(f"""WITH {_FUSED_SQL}, a AS (SELECT clip_id, frame_no // 10 AS k, frame_no % 10 = 3 AS ir, string_agg(value, ',' ORDER BY frame_no, y, x) AS v FROM rs GROUP BY ALL)
SELECT clip_id, CAST(d.k AS INT) AS k, d.v AS depth, i.v AS infrared, aligned FROM ch JOIN a d USING (clip_id) LEFT JOIN a i ON i.clip_id = d.clip_id AND i.k = d.k AND i.ir WHERE NOT d.ir AND ch.k = d.k""")
def fused_cache(spark, sf_dir):
    """Both modalities' arrays of each chosen frame, side by side, at one size."""
    frames, pixels, windows = fused_clips(spark, sf_dir)
    cache = caches.fused_cache(frames, *caches.sized_frames(frames, pixels, windows, 8, 8, 4))
    text = lambda c: F.array_join(F.transform(c, lambda s: s["value"].cast("string")), ",").alias(c)
    return cache.select("clip_id", "k", text("depth"), text("infrared"), "aligned")


@query("""SELECT CAST(event_id // 4 AS VARCHAR) AS clip_id, coalesce(bool_or(event_id % 3 <> 0) FILTER (event_id % 2 = 0), false) AS "I", coalesce(bool_or(event_id % 3 <> 0) FILTER (event_id % 2 = 1), false) AS "D" FROM events WHERE event_id % 5 <> 0 GROUP BY 1""")
def modality_availability(spark, sf_dir):
    i = F.col("event_id")
    e = _read(spark, sf_dir, "events").where(i % 5 != 0).select(F.floor(i / 4).cast("string").alias("clip_id"), F.when(i % 2 == 0, "I").otherwise("D").alias("modality"), (i % 3 != 0).alias("readable"))
    return files.availability(e)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of four frames; a pose is a vector's first 51 numbers."""
    v = F.col("vec_id")
    joint = lambda k: F.array(*(F.get("embedding", 3 * k + a).cast("double") for a in range(3)))
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.floor(v / 4).cast("string").alias("clip_id"), (v % 4).cast("int").alias("frame_no"), F.array(*map(joint, range(17))).alias("keypoints"))


_PARENT = "CASE j " + " ".join(f"WHEN {b} THEN {a}" for a, b in skeletons.BONES) + " END"
_OTHER = "CASE j " + " ".join(f"WHEN {x} THEN {y}" for p in skeletons.MIRRORED for x, y in (p, p[::-1])) + " ELSE j END"
POSES_SQL = f"""
  jt AS (SELECT vec_id, vec_id // 4 AS clip, CAST(j AS INT) AS j, CAST(a AS INT) AS a, CAST(embedding[3 * j + a + 1] AS DOUBLE) AS v FROM embeddings, range(0, 17) x(j), range(0, 3) y(a)),
  jp AS (SELECT jt.*, {_PARENT} AS parent, {_OTHER} AS other FROM jt)"""


@query(f"""WITH {POSES_SQL}, d AS (SELECT c.vec_id, c.j, sqrt(sum((c.v - p.v) * (c.v - p.v))) AS l FROM jp c JOIN jt p ON p.vec_id = c.vec_id AND p.j = c.parent AND p.a = c.a GROUP BY ALL)
SELECT vec_id, j AS child, round(l, 6) AS length FROM d""")
def bone_lengths(spark, sf_dir):
    child = F.get(F.array(*(F.lit(b) for _, b in skeletons.BONES)), F.col("k"))
    rows = poses(spark, sf_dir).select("vec_id", F.posexplode(skeletons.bone_lengths(F.col("keypoints"))).alias("k", "length"))
    return _rounded(rows.select("vec_id", child.alias("child"), "length"))


def _joints(df: DataFrame, kind: str, pose) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(pose).alias("joint", "c")).select("vec_id", "joint", F.posexplode("c").alias("axis", "v"))
    return _rounded(rows.select("vec_id", F.lit(kind).alias("kind"), "joint", "axis", "v"))


@query(f"""WITH {POSES_SQL} SELECT c.vec_id, 'vectors' AS kind, c.j AS joint, c.a AS axis, round(coalesce(c.v - p.v, 0.0), 6) AS v FROM jp c LEFT JOIN jt p ON p.vec_id = c.vec_id AND p.j = c.parent AND p.a = c.a
UNION ALL SELECT c.vec_id, 'mirrored', c.j, c.a, round(CASE WHEN c.a = 0 THEN -o.v ELSE o.v END, 6) FROM jp c JOIN jt o ON o.vec_id = c.vec_id AND o.j = c.other AND o.a = c.a
UNION ALL SELECT c.vec_id, 'turned', c.j, c.a, round(CASE c.a WHEN 0 THEN cos(0.5) * x.v - sin(0.5) * y.v WHEN 1 THEN sin(0.5) * x.v + cos(0.5) * y.v ELSE c.v END, 6) FROM jt c JOIN jt x ON x.vec_id = c.vec_id AND x.j = c.j AND x.a = 0 JOIN jt y ON y.vec_id = c.vec_id AND y.j = c.j AND y.a = 1""")
def pose_variants(spark, sf_dir):
    p, k = poses(spark, sf_dir), F.col("keypoints")
    out = _joints(p, "vectors", skeletons.bone_vectors(k))
    return out.unionByName(_joints(p, "mirrored", skeletons.mirrored(k))).unionByName(_joints(p, "turned", skeletons.turned(k, F.lit(0.5))))


@query(f"""WITH {POSES_SQL}, d AS (SELECT c.clip, c.vec_id, c.j, sqrt(sum((c.v - p.v) * (c.v - p.v))) AS l FROM jp c JOIN jt p ON p.vec_id = c.vec_id AND p.j = c.parent AND p.a = c.a GROUP BY ALL),
s AS (SELECT clip, vec_id, sum(l) AS s FROM d GROUP BY ALL), m AS (SELECT clip, quantile_cont(s, 0.5) AS m FROM s GROUP BY clip)
SELECT c.vec_id, 'normalised' AS kind, c.j AS joint, c.a AS axis, round((c.v - CASE WHEN c.a < 2 THEN r.v ELSE 0 END) / CASE WHEN m >= 1 THEN m ELSE 1 END, 6) AS v FROM jt c JOIN jt r ON r.vec_id = c.vec_id AND r.j = 0 AND r.a = c.a JOIN m ON m.clip = c.clip""")
def normalised_poses(spark, sf_dir):
    out = skeletons.normalised(poses(spark, sf_dir)).withColumn("vec_id", F.col("clip_id").cast("long") * 4 + F.col("frame_no"))
    return _joints(out, "normalised", F.col("keypoints"))


@query("""SELECT CAST(vec_id // 4 AS VARCHAR) AS clip_id, CAST(vec_id % 4 AS INT) AS frame_no, round(list_sum(list_transform(embedding[1:51], lambda z: CAST(z AS DOUBLE))), 4) AS total FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 13 <> 0""")
def skeleton_json(spark, sf_dir):
    """Poses written as JSON and read back; broken texts and texts without people go."""
    people = F.array(F.struct(F.col("keypoints")), F.struct(F.array().cast("array<array<double>>").alias("keypoints")))
    raw = F.when(F.col("vec_id") % 11 == 0, F.lit('{"people": [')).when(F.col("vec_id") % 13 == 0, F.lit('{"people": []}')).otherwise(F.to_json(F.struct(people.alias("people"))))
    read = files.skeletons(poses(spark, sf_dir).select("clip_id", "frame_no", raw.alias("raw")))
    return _rounded(read.select("clip_id", "frame_no", C.total(F.flatten("keypoints")).alias("total")), 4)


def _u(seed: int, what: str) -> str:
    return f"CAST(('0x' || substr(sha256('{seed}|{what}|1|' || c), 1, 12)) AS BIGINT) / 281474976710656.0"


@query(f"""WITH e AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS c, {_X} AS x FROM embeddings), k AS (SELECT *, ({_u(3, "yaw")} * 2 - 1) * 0.5 AS yaw, CAST(greatest(2, floor(8 * (0.5 + 0.5 * {_u(3, "keep")}))) AS INT) AS n FROM e),
s AS (SELECT *, CAST(least(floor({_u(3, "start")} * (8 - n + 1)), 8 - n) AS INT) AS a FROM k)
SELECT vec_id, round(yaw, 6) AS yaw, CAST(i AS INT) AS i, round(x[a + 1 + CAST(floor(i * (n - 1) / 5.0) AS INT)] + (i * (n - 1) / 5.0 - floor(i * (n - 1) / 5.0)) * (x[a + 1 + least(CAST(floor(i * (n - 1) / 5.0) AS INT) + 1, n - 1)] - x[a + 1 + CAST(floor(i * (n - 1) / 5.0) AS INT)]), 6) AS v FROM s, range(0, 6) r(i)""")
def keyed_augmentation(spark, sf_dir):
    """Yaw and cut in time drawn by hash of seed, epoch and clip."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("c"), F.transform(F.slice("embedding", 1, 8), lambda z: z.cast("double")).alias("x"))
    cut = skeletons.keyed_time_crop(F.col("x"), F.lit(8), 3, F.lit(1), F.col("c"), 0.5, 6)
    return _rounded(e.select("vec_id", skeletons.keyed_yaw(3, F.lit(1), F.col("c"), 0.5).alias("yaw"), F.posexplode(cut).alias("i", "v")))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS length FROM documents")
def delta_roundtrip(spark, sf_dir):
    """Texts coded against their reverse, decoded, and checked by length and hash on the way."""
    blob = F.coalesce("text", F.lit("")).cast("binary")
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), blob.alias("blob"), F.coalesce(F.reverse("text"), F.lit("")).cast("binary").alias("base"))
    back = integrity.unpack_deltas(integrity.pack_deltas(d), d.select("key", "base"))
    return back.select("key", F.sha2("blob", 256).alias("sha256"), F.octet_length("blob").cast("long").alias("length"))


@query("""WITH c AS (SELECT vec_id, list_transform(range(1, 12), lambda i: CAST(floor(abs(embedding[i]) * 1000) AS INT) % 8) AS c FROM embeddings),
b AS (SELECT vec_id, list_transform(range(0, 33), lambda i: (c[i // 3 + 1] >> (i % 3)) & 1) AS b FROM c)
SELECT vec_id, 11 AS n, lower(array_to_string(list_transform(range(0, 5), lambda k: printf('%02x', CAST(list_sum(list_transform(range(0, 8), lambda i: coalesce(b[8 * k + i + 1], 0) << i)) AS INT))), '')) AS stream FROM b""")
def bit_packed_codes(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 11)).alias("idx", "w"))
    scaled = F.abs("w") * F.lit(1000.0).cast("float")  # a whole number would make it a product of doubles
    codes = e.select("vec_id", "idx", (F.floor(scaled).cast("int") % 8).alias("code"))
    return codec.bit_packed(codes, ["vec_id"], "idx", "code", 3).select("vec_id", "n", F.lower(F.hex("stream")).alias("stream"))


@query("""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS key, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT CAST(doc_id AS VARCHAR) AS key, sha256(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'unexpected' ELSE 'different' END AS fault FROM a FULL JOIN b ON a.key = b.key WHERE a.h IS DISTINCT FROM b.h""")
def manifest_faults(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    blobs = lambda rows, t: integrity.manifest(rows.select(F.col("doc_id").cast("string").alias("key"), F.lit("utf8").alias("dtype"), F.array(F.lit(1).cast("long")).alias("shape"), t.cast("binary").alias("blob")))
    return integrity.manifest_faults(blobs(d.where("doc_id % 7 <> 0"), F.col("t")), blobs(d.where("doc_id % 11 <> 0"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("t"))))


@query("""WITH x AS (SELECT vec_id % 3 AS m, vec_id // 3 AS key, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 9) r(i))
SELECT CAST(key AS VARCHAR) AS key, CAST(idx AS INT) AS idx, round(sum((m + 1) * x) / sum(m + 1), 6) AS x FROM x GROUP BY key, idx""")
def weighted_soup(spark, sf_dir):
    v = F.col("vec_id")
    rows = _read(spark, sf_dir, "embeddings").select(F.floor(v / 3).cast("string").alias("key"), (v % 3 + 1).alias("w"), F.posexplode(F.slice("embedding", 1, 8)).alias("idx", "x"))
    return _rounded(integrity.weighted_soup(rows.withColumn("x", F.col("x").cast("double"))))


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS bytes, sum(n_chars) <= 100000000 AS within FROM documents")
def size_budget(spark, sf_dir):
    return integrity.size_budget(_read(spark, sf_dir, "documents").select(F.col("n_chars").alias("length")), 100_000_000)


@query("""WITH r AS (SELECT 's' || (event_id % 6) AS stage, (user_id % 10) / 2.0 AS s FROM events), g AS (SELECT stage, sum(s) AS s FROM r GROUP BY stage)
SELECT stage, s AS seconds, s > 3700 AS stage_over, (SELECT sum(s) FROM g) > 22000 AS total_over FROM g""")
def time_ledger(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return integrity.time_ledger(e.select(F.concat(F.lit("s"), (F.col("event_id") % 6).cast("string")).alias("stage"), ((F.col("user_id") % 10) / 2.0).alias("seconds")), 3700, 22000)


@query("SELECT 's' || c_custkey AS slot, 'backbone.' || c_custkey AS \"left\", 'blocks.' || (c_custkey * 3) AS \"right\" FROM customer")
def key_remap(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey")
    slot = F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("slot")
    return integrity.key_map(c.select(slot, F.concat(F.lit("backbone."), F.col("c_custkey").cast("string")).alias("key")), c.select(slot, F.concat(F.lit("blocks."), (F.col("c_custkey") * 3).cast("string")).alias("key")))


@query("""WITH k AS (SELECT doc_id, unnest(['alpha', 'beta', 'gamma']) AS k, unnest([CAST(doc_id AS VARCHAR), lang || '=x', 'late']) AS v FROM documents)
SELECT doc_id, k, '--' || CASE k WHEN 'alpha' THEN 'a' WHEN 'beta' THEN 'b' ELSE 'c' END || '=' || coalesce(v, '') AS argument FROM k""")
def recipe_arguments(spark, sf_dir):
    """Records of key=value, the later of two equal keys winning, put as command arguments."""
    i = F.col("doc_id").cast("string")
    kv = F.array(F.lit("gamma=early"), F.concat(F.lit("alpha="), i), F.concat(F.lit("beta="), F.coalesce(F.concat("lang", F.lit("=x")), F.lit(""))), F.lit("gamma=late"))
    pairs = integrity.recipe(_read(spark, sf_dir, "documents").select(i.alias("cache"), kv.alias("kv")))
    named = pairs.select(F.struct("cache", "k").alias("key"), "k", "v")
    out = integrity.recipe_arguments(named.select("k", F.concat_ws("\u0001", "key.cache", "v").alias("v")), {"alpha": "--a", "beta": "--b", "gamma": "--c"})
    parts = F.regexp_extract("argument", "^(--.)=([0-9]+)\u0001(.*)$", 2)
    return out.select(parts.cast("long").alias("doc_id"), "k", F.regexp_replace("argument", "=[0-9]+\u0001", "=").alias("argument"))


@query("""SELECT 'x' || (vec_id % 50) AS region, round(CASE WHEN sum(s) <= 0 OR sum(s) = count(*) THEN avg(z) ELSE sum(z * s) / sum(s) END, 6) AS z
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z, CASE WHEN vec_id % 50 < 5 THEN 0.0 WHEN vec_id % 50 < 10 THEN 1.0 ELSE (vec_id // 50 % 4) / 4.0 END AS s FROM embeddings) GROUP BY 1""")
def region_pooling(spark, sf_dir):
    v = F.col("vec_id")
    s = F.when(v % 50 < 5, 0.0).when(v % 50 < 10, 1.0).otherwise(F.floor(v / 50) % 4 / 4.0)
    t = _read(spark, sf_dir, "embeddings").select(F.concat(F.lit("x"), (v % 50).cast("string")).alias("region"), F.get("embedding", 0).cast("double").alias("z"), s.alias("support"))
    return _rounded(fusion.region_pool(t, ["region"]))


@query(f"""WITH {POSES_SQL}, ok AS (SELECT * FROM jp WHERE vec_id % 11 <> 0 AND vec_id % 13 <> 0), d AS (SELECT c.clip, c.vec_id, c.j, sqrt(sum((c.v - p.v) * (c.v - p.v))) AS l FROM ok c JOIN ok p ON p.vec_id = c.vec_id AND p.j = c.parent AND p.a = c.a GROUP BY ALL),
s AS (SELECT clip, vec_id, sum(l) AS s FROM d GROUP BY ALL), m AS (SELECT clip, quantile_cont(s, 0.5) AS m FROM s GROUP BY clip)
SELECT CAST(c.clip AS VARCHAR) AS clip_id, CAST(count(DISTINCT c.vec_id) AS INT) AS n, round(sum(c.v / CASE WHEN m >= 1 THEN m ELSE 1 END), 5) AS heights FROM ok c JOIN m ON m.clip = c.clip WHERE c.a = 2 GROUP BY c.clip""")
def skeleton_cache(spark, sf_dir):
    """Poses from JSON, usable ones only, normalised and gathered by clip; the sum of all heights is their digest."""
    raw = F.when(F.col("vec_id") % 11 == 0, F.lit("[")).when(F.col("vec_id") % 13 == 0, F.lit('{"people": []}')).otherwise(F.to_json(F.struct(F.array(F.struct("keypoints")).alias("people"))))
    cache = caches.skeleton_cache(poses(spark, sf_dir).select("clip_id", "frame_no", raw.alias("raw")))
    heights = F.aggregate("data", F.lit(0.0), lambda a, s: a + C.total(F.transform(s["keypoints"], lambda j: F.get(j, 2))))
    return _rounded(cache.select("clip_id", "n", heights.alias("heights")), 5)


@query("""SELECT CAST(user_id AS VARCHAR) AS clip_id, 'd' || (event_id % 3) AS device, CAST(count(*) AS INT) AS n, string_agg(CAST(event_id % 100 AS VARCHAR), ',' ORDER BY event_id) AS channel FROM events WHERE event_id % 3 <> 2 GROUP BY ALL""")
def imu_cache(spark, sf_dir):
    i = F.col("event_id")
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clip_id"), F.concat(F.lit("d"), (i % 3).cast("string")).alias("device"), i.alias("t_idx"), F.array(i % 100).alias("ch"))
    cache = caches.imu_cache(rows, ("d0", "d1"))
    return cache.select("clip_id", "device", "n", F.array_join(F.transform("data", lambda s: F.get(s["ch"], 0).cast("string")), ",").alias("channel"))


@query(f"""WITH {COLOURS_SQL}, w AS (SELECT CAST(y AS INT) AS wy, CAST(x AS INT) AS wx FROM range(0, 5) a(y), range(0, 7) b(x)), dp AS (SELECT clip_id, frame_no, y, x, coalesce(pl.depth_rank, 255) AS v FROM co LEFT JOIN pl USING (packed_rgb))
SELECT clip_id, frame_no, CAST(count(*) AS INT) AS n, string_agg(CAST(v AS VARCHAR), ',' ORDER BY wy, wx) AS ranks FROM w JOIN dp ON dp.y = greatest(least(wy - 1, 7), 0) AND dp.x = greatest(least(wx + 3, 7), 0) GROUP BY clip_id, frame_no""")
def depth_cache(spark, sf_dir):
    px, reference = colours(spark, sf_dir)
    palette = detections.build_palette(detections.colour_counts(px), reference, 2)
    windows = px.select("clip_id").distinct().select("clip_id", F.lit(-1).alias("top"), F.lit(3).alias("left"), F.lit(4).alias("bottom"), F.lit(10).alias("right"))
    cache = caches.depth_cache(px, palette, windows, 8, 8)
    return cache.select("clip_id", "frame_no", "n", F.array_join(F.transform("data", lambda s: s["value"].cast("string")), ",").alias("ranks"))
