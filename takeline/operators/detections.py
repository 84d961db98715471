"""Person windows from detections, motion boxes from pixels, palettes; clips are the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.functions.columns import even_picks, square_window
from takeline.operators import resize
from takeline.operators.spans import ranked
from takeline.sources.settled import settled

#: Thresholds of the acceptance rule, crop margin, least side and tile size by frame width.
STRONG, WEAK, QUORUM, SPREAD, MARGIN, MIN_SIDE, TILE = 0.3, 0.1, 0.5, 0.1, 1.4, 0.35, 0.6


def best_per_probe(detections: DataFrame) -> DataFrame:
    """The best box of each probed frame; equal scores by the box's coordinates."""
    box = F.struct("x1", "y1", "x2", "y2")
    best = detections.groupBy("clip_id", "probe").agg(F.max_by(F.struct(box.alias("b"), "score"), F.struct("score", (-F.col("x1")), (-F.col("y1")))).alias("m"))
    return best.select("clip_id", "probe", "m.b.*", "m.score")


def _width(width: int | str) -> Column:
    """Of a clip's frames, as an aggregate over its boxes."""
    return F.max(width) if isinstance(width, str) else F.lit(width)


def _stats(boxes: DataFrame, weak: float, *more: Column) -> DataFrame:
    """A row for each clip with boxes, in one pass: ``clip_id, best_score``, and of its good boxes ``n, sd, cx, cy, side``."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    good = F.col("score") >= weak
    of_good = lambda c: F.when(good, c)
    return boxes.groupBy("clip_id").agg(
        F.max("score").alias("best_score"), F.count_if(good).cast("int").alias("n"), F.greatest(F.stddev_pop(of_good(cx)), F.stddev_pop(of_good(cy))).alias("sd"),
        F.percentile(of_good(cx), 0.5).alias("cx"), F.percentile(of_good(cy), 0.5).alias("cy"), F.max(of_good(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).alias("side"), *more,
    )


def _reason(width: str, probes: int, strong: float, quorum: float, spread: float) -> Column:
    """The rule over ``_stats`` and the frames' width."""
    need = max(2, round(quorum * probes))
    return F.when(F.col("best_score") >= strong, "strong").when(F.col("n") < need, "sparse").when(F.col("sd") > spread * F.col(width), "scattered").otherwise("agree")


def _window(width: str, margin: float, min_side: float) -> dict[str, Column]:
    """Edges of the square window over ``_stats`` and the frames' width."""
    half = F.greatest(F.col("side") * margin, F.col(width) * min_side) / 2
    edges = {"top": F.col("cy") - half, "left": F.col("cx") - half, "bottom": F.col("cy") + half, "right": F.col("cx") + half}
    return {n: F.rint(v).cast("int") for n, v in edges.items()}


def accept(boxes: DataFrame, width: int | str, probes: int = 8, strong: float = STRONG, weak: float = WEAK, quorum: float = QUORUM, spread: float = SPREAD, clips: DataFrame | None = None) -> DataFrame:
    """``clip_id, reason, n_detected, best_score`` by the rule strong / agree / sparse / scattered.

    Of ``clips`` (``clip_id``), those without any box are ``none``.  ``width``: of the frames, or a column of the boxes.
    """
    stats = _stats(boxes, weak, _width(width).alias("w"))
    reason = _reason("w", probes, strong, quorum, spread)
    kept = F.when(reason.isin("strong", "agree"), F.col("n")).otherwise(0)
    found = stats.select("clip_id", reason.alias("reason"), kept.alias("n_detected"), "best_score")
    if clips is None:
        return found
    every = clips.select("clip_id").join(found, "clip_id", "left")
    return every.select("clip_id", F.coalesce("reason", F.lit("none")).alias("reason"), F.coalesce("n_detected", F.lit(0)).alias("n_detected"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def person_windows(boxes: DataFrame, width: int | str, probes: int = 8, margin: float = MARGIN, min_side: float = MIN_SIDE, weak: float = WEAK, strong: float = STRONG, quorum: float = QUORUM, spread: float = SPREAD) -> DataFrame:
    """Square window of accepted clips: median centre, largest side; not clamped to the frame."""
    judged = _stats(boxes.where("clip_id is not null"), weak, _width(width).alias("w")).where("n > 0").withColumn("source", _reason("w", probes, strong, quorum, spread))
    kept = judged.where("source in ('strong', 'agree')")
    return kept.select("clip_id", *(v.alias(n) for n, v in _window("w", margin, min_side).items()), F.col("n").alias("n_detected"), "source", "best_score")


def choose_window(clips: DataFrame, person: DataFrame, motion: DataFrame, scale: float = 1.0) -> DataFrame:
    """The person window where there is one, else the motion box made square, else null; ``source`` says which."""
    box = square_window(*(F.col(c) for c in ("top", "left", "bottom", "right")), scale)
    p = person.select("clip_id", F.struct("top", "left", "bottom", "right").alias("pw"), F.col("source").alias("ps"))
    m = motion.select("clip_id", box.alias("mw"))
    out = clips.select("clip_id").join(p, "clip_id", "left").join(m, "clip_id", "left")
    return out.select("clip_id", F.coalesce("pw", "mw").alias("w"), F.coalesce("ps", F.when(F.col("mw").isNotNull(), "motion")).alias("source")).select("clip_id", "w.*", "source")


def tiles(frames: DataFrame, part: float = TILE) -> DataFrame:
    """``clip_id, tile, top, left, height, width``: the four overlapping corner tiles of each clip's frames (``clip_id, height, width``)."""
    h, w = (F.floor(F.col(c) * F.lit(part)).cast("int") for c in ("height", "width"))
    corner = lambda k: F.struct(F.lit(k).alias("tile"), (F.lit(k // 2) * (F.col("height") - h)).cast("int").alias("top"), (F.lit(k % 2) * (F.col("width") - w)).cast("int").alias("left"), h.alias("height"), w.alias("width"))
    return frames.select("clip_id", F.inline(F.array(*map(corner, range(4)))))


def best_over_tiles(found: DataFrame, offsets: DataFrame) -> DataFrame:
    """``clip_id, probe, x1, y1, x2, y2, score`` in the frame, of boxes in tiles: the best tile's best box, the first tile on ties."""
    own = Window.partitionBy("clip_id", "probe", "tile").orderBy(F.desc("score"), "x1", "y1", "x2", "y2")
    placed = found.withColumn("_n", F.row_number().over(own)).where("_n = 1 and score > 0").join(offsets.select("clip_id", "tile", "top", "left"), ["clip_id", "tile"])
    shifted = F.struct(*((F.col(c) + F.col(by)).alias(c) for c, by in (("x1", "left"), ("y1", "top"), ("x2", "left"), ("y2", "top"))), "score")
    best = placed.groupBy("clip_id", "probe").agg(F.max_by(shifted, F.struct("score", -F.col("tile"))).alias("b"))
    return best.select("clip_id", "probe", "b.*")


def _rung(frames: DataFrame, boxes: DataFrame, probes: int, margin: float, min_side: float, weak: float, strong: float, quorum: float, spread: float) -> DataFrame:
    """``frames`` with ``best_score`` of each clip's boxes, ``accepted``, and the accepted window ``w`` with its ``n_detected`` and ``source``; written once."""
    judged = frames.join(_stats(boxes, weak), "clip_id", "left").withColumn("source", _reason("width", probes, strong, quorum, spread))
    accepted = F.coalesce((F.col("n") > 0) & F.col("source").isin("strong", "agree"), F.lit(False))
    w = F.struct(*(v.alias(n) for n, v in _window("width", margin, min_side).items()))
    return settled(judged.select(*frames.columns, "best_score", accepted.alias("accepted"), w.alias("w"), F.col("n").alias("n_detected"), "source"))


def rescued_windows(
    frames: DataFrame, detections: DataFrame, in_tiles: DataFrame | Callable[[DataFrame], DataFrame], motion: DataFrame, probes: int = 8, least: float = WEAK,
    margin: float = MARGIN, min_side: float = MIN_SIDE, weak: float = WEAK, strong: float = STRONG, quorum: float = QUORUM, spread: float = SPREAD,
) -> DataFrame:
    """``clip_id, top, left, bottom, right, n_detected, source, best_score`` of each clip, by the first rung that holds.

    Rungs: boxes of whole frames (``strong``, ``agree``); for clips that these fail, boxes in corner tiles (``tiled``); for
    those that still fail the motion box, made square (``motion``); the whole frame (``whole``).  ``frames``: ``clip_id,
    height, width``, a row for each clip; ``in_tiles``: ``clip_id, probe, tile`` and a box, or what makes them from the tiles
    of the clips that go on, so that a detector sees only these.  ``best_score`` is that of the last rung with a detector.

    What each detector's rung decides is written to the shared folder, a row for each clip, so the next rung doesn't
    decide it again beside its own work.
    """
    rule = (probes, margin, min_side, weak, strong, quorum, spread)
    first = _rung(frames.select("clip_id", "height", "width"), best_per_probe(detections.where(F.col("score") >= least)), *rule)
    failed = first.where("not accepted").select("clip_id", "height", "width")
    offsets = tiles(failed)
    again = in_tiles(offsets) if callable(in_tiles) else in_tiles.join(failed, "clip_id", "left_semi")
    second = _rung(failed, best_over_tiles(again, offsets).where(F.col("score") >= least), *rule)
    plain, tiled = (rung.where("accepted").select("clip_id", "w.*", "n_detected", source.alias("source"), "best_score") for rung, source in ((first, F.col("source")), (second, F.lit("tiled"))))
    rest = second.where("not accepted").select("clip_id", "height", "width", "best_score")
    box = square_window(*(F.col(c) for c in ("top", "left", "bottom", "right")), 1.0)
    moved = rest.join(motion.select("clip_id", box.alias("w")), "clip_id", "left")
    whole = F.struct(F.lit(0).alias("top"), F.lit(0).alias("left"), F.col("height").alias("bottom"), F.col("width").alias("right"))
    last = moved.select("clip_id", F.coalesce("w", whole).alias("w"), F.lit(0).alias("n_detected"), F.when(F.col("w").isNull(), "whole").otherwise("motion").alias("source"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
    return plain.unionByName(tiled).unionByName(last.select("clip_id", "w.*", "n_detected", "source", "best_score"))


def decode_palette(pixels: DataFrame, palette: DataFrame, invalid: int = 255) -> DataFrame:
    """Add ``depth_rank`` by ``packed_rgb``; colours that the palette (some hundred rows) lacks are ``invalid``."""
    return pixels.join(F.broadcast(palette.select("packed_rgb", "depth_rank")), "packed_rgb", "left").withColumn("depth_rank", F.coalesce("depth_rank", F.lit(invalid)).cast("int"))


def colour_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("packed_rgb").agg(F.count("*").alias("n"))


def build_palette(counts: DataFrame, reference: DataFrame, min_pixels: int = 1) -> DataFrame:
    """``packed_rgb, depth_rank``: colours in the order of their nearest reference entry, ranks spread over 0..254.

    ``reference``: ``idx, r, g, b`` of 256 colours.  Black is no colour.
    """
    part = lambda shift: F.shiftright("packed_rgb", shift).bitwiseAND(F.lit(255))
    seen = counts.where((F.col("packed_rgb") != 0) & (F.col("n") >= min_pixels)).select("packed_rgb")
    colours = reference.agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("ref"))  # one row of 256 colours
    distance = lambda c: F.sqrt(F.pow(part(16) - c["r"], F.lit(2.0)) + F.pow(part(8) - c["g"], F.lit(2.0)) + F.pow(part(0) - c["b"], F.lit(2.0)))
    near = seen.crossJoin(F.broadcast(colours)).select("packed_rgb", F.array_min(F.transform("ref", lambda c: F.struct(distance(c).alias("d"), c["idx"].alias("idx")))).alias("m"))
    order = ranked(near.select("packed_rgb", F.col("m.idx").alias("idx"), F.col("m.d").alias("d")), ["idx", "d", "packed_rgb"], "i")
    placed = order.crossJoin(F.broadcast(order.agg(F.count("*").alias("k"))))
    return placed.select("packed_rgb", F.rint(F.when(F.col("k") > 1, F.col("i") * 254.0 / (F.col("k") - 1)).otherwise(0.0)).cast("int").alias("depth_rank"))


def smoothness(pixels: DataFrame, invalid: int = 255) -> DataFrame:
    """Mean absolute step between valid neighbours in a row: ``clip_id, smoothness``."""
    w = Window.partitionBy("clip_id", "frame_no", "y").orderBy("x")
    both = (F.col("depth_rank") != invalid) & (F.lag("depth_rank").over(w) != invalid)
    step = F.when(both, F.abs(F.col("depth_rank") - F.lag("depth_rank").over(w)))
    return pixels.select("clip_id", step.alias("s")).groupBy("clip_id").agg(F.avg("s").alias("smoothness"))


def motion_boxes(pixels: DataFrame, height: int, width: int, quantile: float = 0.98, margin: float = 0.25, min_side: int = 48, invalid: int = 255) -> DataFrame:
    """Box of what moves in each clip: ``clip_id, top, left, bottom, right``.

    A pixel's motion is the mean absolute deviation from its median over frames with a return; the box holds the pixels
    at or above a quantile of the non-zero motions.  It grows by the margin; under ``min_side``, or without motion, it
    is the whole frame; else its short side grows to a square.  All within the frame, in whole pixels rounded down.
    """
    seen = pixels.withColumn("depth_rank", F.when(F.col("depth_rank") != invalid, F.col("depth_rank")))
    median = seen.groupBy("clip_id", "y", "x").agg(F.percentile("depth_rank", 0.5).alias("mid"))
    moved = seen.join(median, ["clip_id", "y", "x"]).groupBy("clip_id", "y", "x").agg(F.avg(F.abs(F.col("depth_rank") - F.col("mid"))).alias("m")).where("m > 0")
    level = moved.groupBy("clip_id").agg(F.percentile("m", quantile).alias("level"))
    box = moved.join(level, "clip_id").where("m >= level").groupBy("clip_id").agg(F.min("y").alias("top"), F.min("x").alias("left"), (F.max("y") + 1).alias("bottom"), (F.max("x") + 1).alias("right"))
    clamp = lambda low, high, size: (F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(size)).cast("int"))
    pad = lambda a, b: F.floor((F.col(b) - F.col(a)) * margin)
    for step in ("pad", "square"):
        edges = []
        for a, b, size in (("top", "bottom", height), ("left", "right", width)):
            if step == "pad":
                edges += clamp(F.col(a) - pad(a, b), F.col(b) + pad(a, b), size)
            else:
                side = F.greatest(F.col("bottom") - F.col("top"), F.col("right") - F.col("left"))
                low = F.floor((F.col(a) + F.col(b)) / 2) - F.floor(side / 2)
                edges += clamp(low, low + side, size)
        box = box.select("clip_id", *(e.alias(n) for e, n in zip(edges, ("top", "bottom", "left", "right"), strict=True)))
        if step == "pad":
            box = box.where((F.col("bottom") - F.col("top") >= min_side) & (F.col("right") - F.col("left") >= min_side))
    out = pixels.select("clip_id").distinct().join(box, "clip_id", "left")
    return out.select("clip_id", *(F.coalesce(n, F.lit(d)).alias(n) for n, d in (("top", 0), ("left", 0), ("bottom", height), ("right", width))))


def crop_pad(pixels: DataFrame, windows: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of each clip's window, with the frame's edge repeated outside it: ``clip_id, frame_no, wy, wx, value``."""
    grid = windows.withColumn("wy", F.explode(F.sequence(F.lit(0), F.col("bottom") - F.col("top") - 1))).withColumn("wx", F.explode(F.sequence(F.lit(0), F.col("right") - F.col("left") - 1)))
    source = grid.select("clip_id", "wy", "wx", F.least(F.greatest(F.col("top") + F.col("wy"), F.lit(0)), F.lit(height - 1)).alias("y"), F.least(F.greatest(F.col("left") + F.col("wx"), F.lit(0)), F.lit(width - 1)).alias("x"))
    return source.join(pixels, ["clip_id", "y", "x"]).select("clip_id", "frame_no", "wy", "wx", "value")


def channel_stats(pixels: DataFrame, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    v = F.col("value").cast("double")
    return pixels.groupBy(*by).agg(F.avg(v).alias("mean"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(1e-12))).alias("std"))


def patch_support(windows: DataFrame, height: int, width: int, grid: int = 14, side: int | None = None, border: int = 0) -> DataFrame:
    """Share of each of ``grid x grid`` window cells that lies in the frame: ``clip_id, gy, gx, support``.

    By areas; or, with ``side``, as the window's mask would say that is resized to ``side x side``, cut by ``border`` on
    each edge, and averaged by cell.  A rectangle's mask is the product of its rows' and its columns' shares.
    """
    cells = windows.withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))

    def share(low, high, k, size):
        step = (high - low) / F.lit(float(grid))
        a = low + k * step
        return F.greatest(F.least(a + step, F.lit(float(size))) - F.greatest(a, F.lit(0.0)), F.lit(0.0)) / step

    if side is None:
        return cells.select("clip_id", "gy", "gx", (share(F.col("top"), F.col("bottom"), F.col("gy"), height) * share(F.col("left"), F.col("right"), F.col("gx"), width)).alias("support"))
    shares = lambda a, b, size, k, name: resize.cell_shares(windows.select(F.col(a).alias("low"), F.col(b).alias("high")), size, side, grid, border).select(F.col("low").alias(a), F.col("high").alias(b), F.col("cell").alias(k), F.col("share").alias(name))
    rows, columns = shares("top", "bottom", height, "gy", "_y"), shares("left", "right", width, "gx", "_x")
    return cells.join(rows, ["top", "bottom", "gy"]).join(columns, ["left", "right", "gx"]).select("clip_id", "gy", "gx", (F.col("_y") * F.col("_x")).alias("support"))


def stretched(pixels: DataFrame, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """``clip_id, frame_no, y, x, value``: each frame's values spread from two percentiles to 0..255; a flat frame stays."""
    levels = pixels.groupBy("clip_id", "frame_no").agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"))
    wide = F.greatest(F.least((F.col("value") - F.col("low")) * 255.0 / (F.col("high") - F.col("low")), F.lit(255.0)), F.lit(0.0))
    value = F.when(F.col("high") > F.col("low"), F.floor(wide)).otherwise(F.col("value")).cast("int")
    return pixels.join(levels, ["clip_id", "frame_no"]).select("clip_id", "frame_no", "y", "x", value.alias("value"))


def aligned_frames(counts: DataFrame, most: int = 32) -> DataFrame:
    """``clip_id, k, depth_no, ir_no`` of ``clip_id, n_depth, n_ir``: both lists thinned evenly to the shorter, then to ``most``.

    A clip without frames of either kind has no rows.
    """
    n = F.least("n_depth", "n_ir").cast("int")
    onto = lambda c: F.when(F.col(c) == n, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n > 1, F.rint(i * ((F.col(c) - 1) / F.greatest(n - 1, F.lit(1))))).otherwise(0.0).cast("int")))
    lists = counts.where(n > 0).select("clip_id", onto("n_depth").alias("d"), onto("n_ir").alias("i"), F.posexplode(even_picks(n, most)).alias("k", "pick"))
    return lists.select("clip_id", "k", F.get("d", "pick").alias("depth_no"), F.get("i", "pick").alias("ir_no"))


def four_channels(frames: DataFrame, most: int = 32) -> DataFrame:
    """``clip_id, k, depth_no, ir_no, ir_dead, aligned`` of the frames a clip is made of.

    ``frames``: ``clip_id, modality`` (``D`` or ``I``), ``frame_no`` from 0, ``readable``.  A chosen depth frame that cannot
    be read empties the clip; such an infrared frame leaves the clip with an empty fourth channel (``ir_no`` null).
    """
    counts = frames.groupBy("clip_id").agg(F.count_if(F.col("modality") == "D").alias("n_depth"), F.count_if(F.col("modality") == "I").alias("n_ir"))
    chosen = aligned_frames(counts, most)
    part = lambda m, name: frames.where(F.col("modality") == m).select("clip_id", F.col("frame_no").alias(f"{name}_no"), F.col("readable").alias(f"{name}_ok"))
    read = chosen.join(part("D", "depth"), ["clip_id", "depth_no"], "left").join(part("I", "ir"), ["clip_id", "ir_no"], "left")
    clips = read.groupBy("clip_id").agg(F.bool_and(F.coalesce("depth_ok", F.lit(False))).alias("whole"), (~F.bool_and(F.coalesce("ir_ok", F.lit(False)))).alias("ir_dead"))
    clips = clips.where("whole").join(counts, "clip_id").select("clip_id", "ir_dead", ((F.col("n_depth") == F.col("n_ir")) & ~F.col("ir_dead")).alias("aligned"))
    return chosen.join(clips, "clip_id").select("clip_id", "k", "depth_no", F.when(~F.col("ir_dead"), F.col("ir_no")).alias("ir_no"), "ir_dead", "aligned")


def fused_pixels(chosen: DataFrame, pixels: DataFrame, windows: DataFrame, height: int, width: int, side: int) -> DataFrame:
    """``clip_id, k, channel, y, x, value``: each chosen frame's window at ``side x side``, three colours and infrared.

    ``chosen``: as ``four_channels`` gives it; ``pixels``: ``clip_id, modality, frame_no, channel, y, x, value``, whose
    infrared channel is 3.  A clip without infrared has no rows of channel 3.
    """
    depth = chosen.select("clip_id", "k", F.lit("D").alias("modality"), F.col("depth_no").alias("frame_no"))
    infrared = chosen.where("ir_no is not null").select("clip_id", "k", F.lit("I").alias("modality"), F.col("ir_no").alias("frame_no"))
    used = depth.unionByName(infrared).join(pixels, ["clip_id", "modality", "frame_no"]).withColumn("frame_no", F.struct("k", "channel")).drop("k", "channel", "modality")
    cut = crop_pad(used, windows, height, width).join(windows.select("clip_id", (F.col("bottom") - F.col("top")).alias("height"), (F.col("right") - F.col("left")).alias("width")), "clip_id")
    return resize.resized(cut.select("clip_id", "frame_no", F.col("wy").alias("y"), F.col("wx").alias("x"), "value", "height", "width"), side, side).select("clip_id", "frame_no.k", "frame_no.channel", "y", "x", "value")
