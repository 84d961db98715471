"""Column functions: stamps, ids, probability arrays. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from takeline.schema import FLOOR

#: Fixed value: date, time of day with milliseconds and 8-digit counter in a frame's file name.
STAMP = r"(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})\.(\d{3})_(\d{8})"


def stamp(file_name: Column) -> Column:
    """``struct(date, ms, frame)`` of a file name; null if it has no stamp.  ``ms`` are since midnight."""
    part = lambda k: F.regexp_extract(file_name, STAMP, k)
    number = lambda k: part(k).try_cast("int")
    ms = ((number(2) * 60 + number(3)) * 60 + number(4)).cast("long") * 1000 + number(5)
    return F.when(part(1) != "", F.struct(part(1).alias("date"), ms.alias("ms"), number(6).alias("frame")))


def last_component(path: Column) -> Column:
    """Last part of a path; backslashes count as slashes, closing slashes don't."""
    return F.element_at(F.split(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)


def split_id(clip_id: Column) -> Column:
    """``struct(action, user, trial)`` of ``action/user/trial``; missing parts are null."""
    parts = F.split(clip_id, "/")
    return F.struct(F.get(parts, 0).alias("action"), F.get(parts, 1).alias("user"), F.get(parts, 2).alias("trial"))


def device_prefix(file_name: Column) -> Column:
    return F.substring_index(file_name, "(", 1)


def fold_of_path(path: Column) -> Column:
    """Number of ``folds/foldN.pt``; any other path raises."""
    number = F.regexp_extract(path, r"folds/fold([0-9]+)\.pt$", 1)
    return F.when(number != "", number.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("no fold in "), path)).cast("int"))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def logs(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(FLOOR))))


def softmax(z: Column) -> Column:
    """Shifted by the maximum."""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / total(e))


def temperature(p: Column, t: float) -> Column:
    return softmax(F.transform(logs(p), lambda x: x / F.lit(t)))


def argmax(p: Column) -> Column:
    """First place of the largest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def valid_probabilities(p: Column, classes: int, tolerance: float = 1e-5) -> Column:
    good = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((F.size(p) == classes) & good & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def top_classes(p: Column, k: int) -> Column:
    """``array<struct(p, cls)>`` of the ``k`` largest; equal ones by class."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("minus"), i.cast("int").alias("cls")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["minus"]).alias("p"), s["cls"].alias("cls")))


def geometric(a: Column, b: Column, weight: float) -> Column:
    """``a ** (1 - weight) * b ** weight``, normalised."""
    return softmax(F.zip_with(logs(a), logs(b), lambda x, y: F.lit(1 - weight) * x + F.lit(weight) * y))


def arithmetic(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(1 - weight) * x + F.lit(weight) * y)


def soft_target(p: Column, label: Column, kind: str) -> Column:
    """``probs``, ``onehot`` or ``half``."""
    one = F.transform(p, lambda x, i: F.when(i == label, 1.0).otherwise(0.0))
    return {"probs": p, "onehot": one, "half": F.zip_with(p, one, lambda x, y: 0.5 * x + 0.5 * y)}[kind]


def smoothed_onehot(label: Column, classes: int, epsilon: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, F.lit(1 - epsilon)).otherwise(F.lit(0.0)) + F.lit(epsilon / classes))


def view_draw(prefix: str, seed: int, epoch: Column, clip_id: Column) -> Column:
    """True by the lowest bit of the first byte of sha256(prefix|seed|epoch|clip)."""
    key = F.concat_ws("|", F.lit(prefix), F.lit(str(seed)), epoch.cast("string"), clip_id)
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 2, 1), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1


def even_picks(n: Column, k: int) -> Column:
    """At most ``k`` evenly spaced numbers of ``0 .. n - 1``, rounded half to even."""
    m = F.least(n, F.lit(k))
    return F.when(n <= 0, F.array().cast("array<int>")).when(m == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(2)) - 1), lambda i: F.rint(i * ((n - 1) / (F.greatest(m, F.lit(2)) - 1))).cast("int"))
    )


def segment_picks(n: Column, k: int) -> Column:
    """Centres of ``k`` equal segments of ``0 .. n - 1``; zeros if there is nothing."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(n <= 0, 0).otherwise(F.least(F.floor((i + 0.5) * n / k).cast("int"), (n - 1).cast("int"))))


def square_window(top: Column, left: Column, bottom: Column, right: Column, scale: float) -> Column:
    """Square about the box's centre, not clamped; half to even."""
    half = F.greatest(bottom - top, right - left) * F.lit(scale) / 2
    y, x = (top + bottom) / 2, (left + right) / 2
    return F.struct(*(F.rint(v).cast("int").alias(n) for n, v in (("top", y - half), ("left", x - half), ("bottom", y + half), ("right", x + half))))


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def resample(x: Column, n: int) -> Column:
    """Linear interpolation of an array of doubles at ``n`` even places; null for an empty array."""
    u = lambda i: i * (F.size(x) - 1) / F.lit(max(n - 1, 1))
    low = lambda i: F.floor(u(i)).cast("int")
    at = lambda k: F.get(x, F.least(k, F.size(x) - 1))
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(low(i)) + (u(i) - low(i)) * (at(low(i) + 1) - at(low(i)))))


def velocity(x: Column) -> Column:
    """Difference to the value before; 0 first."""
    return F.transform(x, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v - F.get(x, i - 1)))


def readout_features(i: Column, d: Column) -> Column:
    """``[I, D, I*D, |I-D|]`` end to end."""
    return F.concat(i, d, F.zip_with(i, d, lambda a, b: a * b), F.zip_with(i, d, lambda a, b: F.abs(a - b)))


def direction(x: Column, length: float) -> Column:
    """Centred and scaled to a given L2 length."""
    mean = total(x) / F.size(x)
    norm = F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))))
    return F.transform(x, lambda v: (v - mean) * F.lit(length) / F.greatest(norm, F.lit(FLOOR)))


def standardise(x: Column, mean: Column, scale: Column) -> Column:
    return F.transform(F.zip_with(x, mean, lambda a, m: a - m), lambda v, i: v / F.get(scale, i))


def roll(x: Column, k: int) -> Column:
    """Elements moved ``k`` places on, those beyond the end to the front (``k`` < 0: back)."""
    cut = F.size(x) - F.pmod(F.lit(k), F.greatest(F.size(x), F.lit(1)))
    return F.concat(F.slice(x, cut + 1, F.size(x)), F.slice(x, F.lit(1), cut))


def bag(heads: list[tuple[Column, float]]) -> Column:
    """Mean of distributions, each at its own temperature."""
    scaled = [temperature(p, t) for p, t in heads]
    return F.transform(scaled[0], lambda x, i: sum((F.get(p, i) for p in scaled), F.lit(0.0)) / len(scaled))


def scattered(p: Column, class_of: list[int], classes: int) -> Column:
    """A head's distribution over its own classes, put at their places among all (others 0)."""
    place = F.array(*(F.lit(class_of.index(c) if c in class_of else None).cast("int") for c in range(classes)))
    return F.transform(place, lambda k: F.coalesce(F.get(p, k), F.lit(0.0)))


def mixed_mass(target: Column, weight: Column, other: Column, other_weight: Column, part: float) -> Column:
    """Target mass of a row mixed with another's: each keeps its own weight."""
    return F.zip_with(F.transform(target, lambda x: x * weight * F.lit(part)), F.transform(other, lambda x: x * other_weight * F.lit(1 - part)), lambda a, b: a + b)


def cache_parts(name: Column, builders: tuple[str, ...]) -> Column:
    """``struct(builder, suffix)`` of ``<builder><suffix>_test.npz``; another name raises."""
    stem = F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^(.*)_test(?:\.[^.]*)?$", 1)
    builder = F.coalesce(*(F.when(F.startswith(stem, F.lit(b)), F.lit(b)) for b in builders), F.raise_error(F.concat(F.lit("no cache name: "), name)).cast("string"))
    return F.struct(builder.alias("builder"), F.substring(stem, F.length(builder) + 1, F.length(stem)).alias("suffix"))


def model_slot(key: Column) -> Column:
    """``struct(stage, block, role, part)`` of a checkpoint key in either of two public dialects; null if it is in none.

    Residual units: ``layerN.B.convK.{conv,bn}.part`` and ``blocks.N.res_blocks.B.branch2.{conv,norm}_k.part``.
    """
    in_layers = r"^(?:backbone\.)?layer(\d+)\.(\d+)\.conv([123])\.(conv|bn)\.(\w+)$"
    in_blocks = r"^blocks\.(\d+)\.res_blocks\.(\d+)\.branch2\.(conv|norm)_([abc])\.(\w+)$"
    a, b = (lambda k: F.regexp_extract(key, in_layers, k)), (lambda k: F.regexp_extract(key, in_blocks, k))
    kind = F.when(a(4) == "bn", "norm_").otherwise("conv_")
    first = F.struct(a(1).try_cast("int").alias("stage"), a(2).try_cast("int").alias("block"), F.concat(kind, F.translate(a(3), "123", "abc")).alias("role"), a(5).alias("part"))
    second = F.struct(b(1).try_cast("int").alias("stage"), b(2).try_cast("int").alias("block"), F.concat_ws("_", b(3), b(4)).alias("role"), b(5).alias("part"))
    return F.when(a(1) != "", first).when(b(1) != "", second)


def linear(x: Column, w: Column, b: Column) -> Column:
    return total(F.zip_with(x, w, lambda a, c: a * c)) + b
