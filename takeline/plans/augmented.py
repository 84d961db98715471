"""Queries over pixel clips under keyed draws, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeline.operators import augment
from takeline.plans.catalogue import _read, query
from takeline.plans.frames import PIXELS_SQL, _resized_sql, event_pixels

CROP = 6
_RULE = {"scale": (0.6, 1.4), "flip": 0.5, "erase": 0.5, "erased_part": 0.6, "least_side": 3}


def pixel_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels of 8 x 8 frames, the middle frame's as a second channel; and their clips in two epochs."""
    px = event_pixels(spark, sf_dir).select("clip_id", "frame_no", (F.col("frame_no") % 2).alias("channel"), "y", "x", F.col("depth_rank").alias("value"))
    clips = px.select("clip_id").distinct().select("clip_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return px, clips


def _u(what: str, seed: int = 9, epoch: str = "epoch") -> str:
    return f"(CAST(('0x' || substr(sha256('{seed}|{what}|' || {epoch} || '|' || clip_id), 1, 12)) AS BIGINT) / 281474976710656.0)"


_DRAWS = f"""cl AS (SELECT clip_id, CAST(epoch AS INT) AS epoch FROM (SELECT DISTINCT clip_id FROM px), range(1, 3) r(epoch)),
  d0 AS (SELECT *, least(greatest(CAST(round_even(6 * (0.6::DOUBLE + (1.4::DOUBLE - 0.6::DOUBLE) * {_u("scale")}), 0) AS INT), 3), 8) AS side, {_u("flip")} < 0.5 AS flip, {_u("erase")} < 0.5 AS er,
    CAST(greatest(1, floor(6 * 0.6::DOUBLE * (0.5 + 0.5 * {_u("box height")}))) AS INT) AS bh, CAST(greatest(1, floor(6 * 0.6::DOUBLE * (0.5 + 0.5 * {_u("box width")}))) AS INT) AS bw FROM cl),
  dr AS (SELECT clip_id, epoch, CAST(side AS INT) AS side, CAST(floor({_u("top")} * (9 - side)) AS INT) AS top, CAST(floor({_u("left")} * (9 - side)) AS INT) AS "left", flip, CASE WHEN er THEN CAST(floor({_u("box top")} * (7 - bh)) AS INT) END AS box_top,
    CASE WHEN er THEN CAST(floor({_u("box left")} * (7 - bw)) AS INT) END AS box_left, CASE WHEN er THEN bh END AS box_height, CASE WHEN er THEN bw END AS box_width FROM d0)"""


@query(f"WITH {PIXELS_SQL}, {_DRAWS} SELECT * FROM dr")
def drawn_views(spark, sf_dir):
    """Windows, flips and erased boxes of each clip and epoch."""
    return augment.drawn(pixel_clips(spark, sf_dir)[1], 9, CROP, **_RULE)


@query(f"""WITH {PIXELS_SQL}, {_DRAWS}, im AS (SELECT clip_id || '/' || epoch AS clip_id, frame_no * 2 + frame_no % 2 AS frame_no, y - top AS y, x - "left" AS x, depth_rank AS value, side AS height, side AS width FROM px JOIN dr USING (clip_id) WHERE y >= top AND y < top + side AND x >= "left" AND x < "left" + side),
  {_resized_sql(CROP, CROP)}, tu AS (SELECT dr.clip_id, epoch, frame_no // 2 AS frame_no, frame_no % 2 AS channel, y, CASE WHEN flip THEN 5 - x ELSE x END AS x, value, box_top, box_left, box_height, box_width FROM rs JOIN dr ON rs.clip_id = dr.clip_id || '/' || epoch)
SELECT clip_id, epoch, CAST(frame_no AS INT) AS frame_no, CAST(channel AS INT) AS channel, y, CAST(x AS INT) AS x, CASE WHEN y >= box_top AND y < box_top + box_height AND x >= box_left AND x < box_left + box_width THEN 0 ELSE value END AS value FROM tu""")
def augmented_pixels(spark, sf_dir):
    """Every clip in two epochs: cut, scaled, flipped and erased alike in all its frames."""
    px, clips = pixel_clips(spark, sf_dir)
    return augment.applied(px, augment.drawn(clips, 9, CROP, **_RULE), CROP)


@query(f"""WITH {PIXELS_SQL} SELECT clip_id, frame_no, y, x, CAST(CASE WHEN depth_rank = 255 THEN 255 ELSE greatest(least(depth_rank + CAST(floor({_u("depth", 4, "3")} * 41) AS INT) - 20, 254), 0) END AS INT) AS value FROM px""")
def shifted_depth(spark, sf_dir):
    """Valid depths moved by one number a clip."""
    return augment.shifted_depth(event_pixels(spark, sf_dir).withColumnRenamed("depth_rank", "value"), 4, 20, F.lit(3)).select("clip_id", "frame_no", "y", "x", "value")


@query(f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS clip_id, CAST(n_chars % 40 AS INT) AS n FROM documents), k AS (SELECT *, CASE WHEN n >= 4 THEN CAST(greatest(2, floor(n * (0.4::DOUBLE + 0.6::DOUBLE * {_u("keep", 4, "3")}))) AS INT) ELSE n END AS keep FROM c WHERE n > 0),
s AS (SELECT *, CASE WHEN n >= 4 THEN least(CAST(floor({_u("start", 4, "3")} * (n - keep + 1)) AS INT), n - keep) ELSE 0 END AS start FROM k)
SELECT clip_id, CAST(i AS INT) AS k, start + CAST(round_even(i * ((keep - 1) / greatest(n - 1, 1)), 0) AS INT) AS frame_no FROM s, range(0, 40) r(i) WHERE i < n""")
def time_cropped_frames(spark, sf_dir):
    """A run of each clip's frames, each place taking the nearest."""
    clips = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("clip_id"), (F.col("n_chars") % 40).cast("int").alias("n"))
    return augment.time_cropped(clips, 4, 0.4, F.lit(3))
