"""Queries that write what the tables give to the shared folder and read it back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from takeline.functions import columns as C
from takeline.plans.catalogue import PROBS_SQL, _read, _rounded, embedding_probs, query
from takeline.plans.frames import PIXELS_SQL, _resized_sql, event_pixels
from takeline.sources import caches, files
from takeline.sources.settled import shared_folder


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {PROBS_SQL} SELECT 'clips/' || vec_id || ', "a"' AS path, CAST(list_position(p, list_max(p)) - 1 AS INT) AS prediction FROM em""")
def submission_csv(spark, sf_dir):
    """Predictions written as checked CSV, names with commas and quotes too, and read with their header checked."""
    rows = embedding_probs(spark, sf_dir).select(F.format_string('clips/%d, "a"', "vec_id").alias("path"), C.argmax(F.col("p")).alias("prediction"))
    path = _fresh(spark, "csv")
    files.write_csv_once(rows, path, "path")
    return files.read_csv(spark, path, "path string, prediction int")


@query("""SELECT CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS clips, (SELECT round(avg(label), 6) FROM embeddings) AS mean_label, CAST((SELECT count(DISTINCT user_id) FROM events) AS BIGINT) AS users, CAST((SELECT max(event_id) FROM events) AS BIGINT) AS last_event""")
def run_receipt(spark, sf_dir):
    """A receipt of two tables' figures, written as JSON and read strictly."""
    clips = _read(spark, sf_dir, "embeddings").agg(F.count("*").alias("clips"), F.round(F.avg("label"), 6).alias("mean_label"))
    users = _read(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_event"))
    path = _fresh(spark, "receipt")
    files.receipt(clips=clips, users=users).write.text(path)
    return files.read_receipt(spark, path, "clips struct<clips: long, mean_label: double>, users struct<users: long, last_event: long>").select("clips.*", "users.*")


@query(f"""WITH {PIXELS_SQL}, im AS (SELECT clip_id, frame_no, y, x, depth_rank AS value, 8 AS height, 8 AS width FROM px), {_resized_sql(3, 3)} SELECT clip_id, frame_no, y, x, value FROM rs""")
def stored_cache(spark, sf_dir):
    """An image cache, written once and read row by row again."""
    px = event_pixels(spark, sf_dir).withColumnRenamed("depth_rank", "value").withColumns({"height": F.lit(8), "width": F.lit(8)})
    path = _fresh(spark, "cache")
    caches.write_cache(caches.image_cache(px, 3), path)
    return caches.read_cache(spark, path)


@query("""WITH e AS (SELECT vec_id // 10 AS clip, vec_id, CASE WHEN vec_id % 3 = 0 THEN 'WA' ELSE 'WB' END AS device, [CAST(x AS DOUBLE) FOR x IN embedding[1:16]] AS ch FROM embeddings WHERE vec_id % 7 <> 0)
SELECT 'clip=' || clip AS clip_id, device, CAST(row_number() OVER (PARTITION BY clip, device ORDER BY vec_id) - 1 AS INT) AS t_idx, round(list_sum(ch), 6) AS total FROM e""")
def inertial_files(spark, sf_dir):
    """A file of device rows for each clip, some rows of them torn, read in order."""
    v = F.col("vec_id")
    numbers = F.concat_ws(",", F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double").cast("string")))
    device = F.when(v % 3 == 0, "WA(01:02)").otherwise("WB(03:04)")
    line = F.when(v % 7 == 0, F.concat_ws(",", F.lit("t"), device, F.lit("1.0"))).otherwise(F.concat_ws(",", F.lit("t"), device, numbers))
    rows = _read(spark, sf_dir, "embeddings").select(F.floor(v / 10).alias("clip"), "vec_id", line.alias("line"))
    heads = rows.select("clip", F.lit(-1).cast("long").alias("vec_id"), F.lit("time,device").alias("line")).distinct()
    path = _fresh(spark, "inertial")
    rows.unionByName(heads).repartition("clip").sortWithinPartitions("clip", "vec_id").select("clip", "line").write.partitionBy("clip").option("quote", "\u0000").option("sep", "\u0001").csv(path)
    found = files.imu(spark, path, ("WA", "WB"))
    return _rounded(found.select("clip_id", "device", "t_idx", C.total(F.col("ch")).alias("total")))
