"""Evaluation: accuracies, paired contrasts, windows, pair agreement, clustered uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.operators.spans import ranked
from takeline.schema import FLOOR


#: Mean gain, length-weighted gain, folds with a gain, worst fold of the acceptance rules.
GATES = {"root": (0.5, 0.0, 3, -1.0), "increment": (0.2, 0.0, 3, -0.5), "exploratory": (0.2, -0.1, 2, -1.0)}


def accuracy(scored: DataFrame, by: tuple[str, ...] = (), truth: str = "y", label: str = "label") -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(label)).alias("hits"), F.avg((F.col(truth) == F.col(label)).cast("double")).alias("accuracy"))


def probability_metrics(scored: DataFrame, by: tuple[str, ...] = (), truth: str = "y", p: str = "p") -> DataFrame:
    """Mean negative log-likelihood, Brier score and confidence; ``truth`` counts classes from 0."""
    py = F.get(F.col(p), F.col(truth))
    square = F.aggregate(F.col(p), F.lit(0.0), lambda a, x: a + x * x)
    return scored.groupBy(*by).agg(F.avg(-F.log(F.greatest(py, F.lit(FLOOR)))).alias("nll"), F.avg(square - 2 * py + 1).alias("brier"), F.avg(F.array_max(p)).alias("confidence"))


def contrast(paired: DataFrame, by: tuple[str, ...] = (), truth: str = "y", old: str = "parent", new: str = "label") -> DataFrame:
    """Rescued, lost, net and changed labels of a candidate against its parent."""
    was, now = F.col(old) == F.col(truth), F.col(new) == F.col(truth)
    return paired.groupBy(*by).agg(
        F.count_if(now & ~was).alias("rescued"), F.count_if(was & ~now).alias("lost"), (F.count_if(now & ~was) - F.count_if(was & ~now)).alias("net"), F.count_if(F.col(old) != F.col(new)).alias("changed")
    )


def weighted_mean(table: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value))


def fold_summary(folds: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, sample and population deviation, standard error, minimum and positives over folds."""
    v = F.col(value)
    return folds.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"), F.min(v).alias("min"), F.count_if(v > 0).alias("positives"), F.count(v).alias("folds")
    )


def gate(summary: Column, least: Column, positives: Column, min_mean: float, min_least: float, min_positive: int) -> Column:
    """True if the mean gain, the worst fold and the number of better folds all reach their limits."""
    return F.coalesce((summary >= min_mean) & (least >= min_least) & (positives >= min_positive), F.lit(False))


def gate_forms(folds: DataFrame, kind: str) -> DataFrame:
    """One row ``kind, accepted`` of the stated acceptance rules over ``population, fold, raw, decoded`` gains in points.

    * ``root``, ``increment``, ``exploratory``: four folds; on the thinnings the mean decoded gain, the folds with a gain and
      the worst fold reach their limits; no loss on the test-like subset; the length-weighted gain reaches its own.
    * ``pilot``, ``fourfold``: both populations reach a mean and a number of gains, no fold loses a point, and the raw mean
      loses a quarter at most; with four folds the length-weighted gain is positive.
    """
    each = folds.groupBy("population").agg(F.avg("decoded").alias("mean"), F.avg("raw").alias("raw"), F.min("decoded").alias("worst"), F.count_if(F.col("decoded") > 0).alias("gains"), F.count("*").alias("n"))
    of = lambda population, rule: F.coalesce(F.bool_or(F.when(F.col("population") == population, rule)), F.lit(False))
    if kind in GATES:
        mean, exact, positive, worst = GATES[kind]
        thinned = (F.col("n") == 4) & (F.col("mean") >= mean) & (F.col("gains") >= positive) & (F.col("worst") >= worst)
        passed = of("designated", thinned) & of("primary", F.col("mean") >= 0) & of("exact_length", F.col("mean") >= exact)
    else:
        mean, positive = {"pilot": (0.25, 1), "fourfold": (0.5, 3)}[kind]
        rule = (F.col("mean") >= mean) & (F.col("gains") >= positive) & (F.col("worst") >= -1) & (F.col("raw") >= -0.25)
        passed = of("designated", rule) & of("primary", rule)
        if kind == "fourfold":
            passed = passed & of("exact_length", F.col("mean") > 0)
    return each.agg(passed.alias("accepted")).select(F.lit(kind).alias("kind"), "accepted")


def quantisation_gate(folds: DataFrame, candidate: str, parent: str, exact: str, n_folds: int = 4, min_positive: int = 3, mean_cost: float = -0.5, worst_cost: float = -1.0) -> DataFrame:
    """A quantised candidate against its parent and against itself before it was quantised, under every estimator.

    ``folds``: ``setting, fold, arm, raw, decoded`` (accuracies).  Result: ``setting, metric, folds, gain, positive, cost, worst,
    eligible`` in points.  Eligible, alike in all rows, if each setting has ``n_folds`` folds with all three arms, both
    metrics gain on the mean in every setting, decoding gains in ``min_positive`` folds of each, and nowhere does
    quantisation cost more than ``mean_cost`` on the mean or ``worst_cost`` in a fold.
    """
    arm = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c)))
    each = folds.groupBy("setting", "fold").agg(*(arm(name, c).alias(f"{role}_{c}") for role, name in (("a", candidate), ("b", parent), ("c", exact)) for c in ("raw", "decoded")))
    long = each.select("setting", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), (100 * (F.col(f"a_{m}") - F.col(f"b_{m}"))).alias("gain"), (100 * (F.col(f"a_{m}") - F.col(f"c_{m}"))).alias("cost")) for m in ("raw", "decoded")))))
    whole = F.col("gain").isNotNull() & F.col("cost").isNotNull()
    rows = long.groupBy("setting", "metric").agg(F.count_if(whole).alias("folds"), F.avg("gain").alias("gain"), F.count_if(F.col("gain") > 0).alias("positive"), F.avg("cost").alias("cost"), F.min("cost").alias("worst"))
    good = (F.col("folds") == n_folds) & (F.col("gain") > 0) & (F.col("cost") >= mean_cost) & (F.col("worst") >= worst_cost) & ((F.col("metric") == "raw") | (F.col("positive") >= min_positive))
    verdict = rows.agg(F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(False)).alias("eligible"))  # one row
    return rows.crossJoin(F.broadcast(verdict))


def jackknife(per_cluster: DataFrame, num: str, den: str) -> DataFrame:
    """``estimate, se`` of ``sum(num) / sum(den)`` by leaving out one cluster at a time; two clusters at least."""
    total = per_cluster.agg(F.sum(num).alias("tn"), F.sum(den).alias("td"), F.count("*").alias("k"))  # one row
    left = per_cluster.crossJoin(F.broadcast(total)).withColumn("x", F.try_divide(F.col("tn") - F.col(num), F.col("td") - F.col(den)))
    return left.agg(F.any_value(F.col("tn") / F.col("td")).alias("estimate"), F.sqrt(F.var_pop("x") * (F.max("k") - 1)).alias("se"))


def pair_agreement(clips: DataFrame, truth: str, found: str) -> DataFrame:
    """Pair precision and recall of a grouping, and truly recovered groups, from group sizes (no pairs are formed)."""
    both = clips.where(F.col(truth).isNotNull() & F.col(found).isNotNull())
    cell = both.groupBy(truth, found).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    row = cell.groupBy(truth).agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.any_value(found).alias("f"))
    column = cell.groupBy(found).agg(F.sum("n").alias("m"))
    t = row.agg(F.sum(pairs(F.col("n"))).alias("true_pairs"), F.count("*").alias("groups"))
    f = column.agg(F.sum(pairs(F.col("m"))).alias("found_pairs"))
    b = cell.agg(F.sum(pairs(F.col("n"))).alias("both_pairs"))
    e = row.join(column, row["f"] == column[found]).where("parts = 1 and n = m").agg(F.count("*").alias("exact"))
    ratio = lambda a, c: F.coalesce(F.try_divide(F.col(a), F.col(c)), F.lit(0.0))
    return t.crossJoin(f).crossJoin(b).crossJoin(e).select(ratio("both_pairs", "found_pairs").alias("precision"), ratio("both_pairs", "true_pairs").alias("recall"), "exact", "groups")


def all_windows(members: DataFrame, longest: int = 8) -> DataFrame:
    """``take_id, len, start, members``: every run of 1 to ``longest`` clips of a take; ``members``: ordered array."""
    lengths = members.withColumn("n", F.size("members")).where("n > 0").withColumn("len", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(longest)))))
    starts = lengths.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))))
    return starts.select("take_id", "len", "start", F.slice("members", F.col("start") + 1, F.col("len")).alias("members"))


def row_windows(takes: DataFrame, longest: int = 8, member: str = "clip_id") -> DataFrame:
    """``take_id, len, start, members`` as ``all_windows``, from rows ``take_id, position, member``: each row looks
    ahead, so a take of any length is never gathered."""
    w = Window.partitionBy("take_id").orderBy("position", member)
    ahead = takes.select("take_id", (F.row_number().over(w) - 1).alias("start"), F.array(*(F.lead(member, k).over(w) for k in range(longest))).alias("ahead"), F.count("*").over(Window.partitionBy("take_id")).alias("n"))
    each = ahead.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("start"), F.lit(longest)).cast("int"))))
    return each.select("take_id", "len", F.col("start").cast("int").alias("start"), F.slice("ahead", F.lit(1), F.col("len")).alias("members"))


def ordered_members(takes: DataFrame) -> DataFrame:
    """``take_id, members`` in take order (takes are short by rule)."""
    listed = takes.groupBy("take_id").agg(F.sort_array(F.collect_list(F.struct("position", "clip_id"))).alias("m"))
    return listed.select("take_id", F.transform("m", lambda s: s["clip_id"]).alias("members"))


def shared_subjects(folds: DataFrame) -> DataFrame:
    """Subjects that are in more than one fold; none means the folds are subject-disjoint."""
    return folds.groupBy("user").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def best_temperature(scored: DataFrame, temperatures: list[float]) -> DataFrame:
    """The temperature of a grid with the least mean negative log-likelihood; ``scored``: ``p, y``."""
    grid = F.explode(F.array(*map(F.lit, temperatures))).alias("t")
    z = scored.select("y", "p", grid).withColumn("z", F.transform("p", lambda x: F.log(F.greatest(x, F.lit(FLOOR))) / F.col("t")))
    top = F.array_max("z")
    log_sum = F.log(F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    nll = z.groupBy("t").agg(F.avg(log_sum - F.get("z", F.col("y"))).alias("nll"))
    return nll.agg(F.min_by("t", F.struct("nll", "t")).alias("t"), F.min("nll").alias("nll"))


def ledger(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows per epoch and kind whose samples, pseudo samples or mass differ from the plan; none means all is as planned."""
    kinds = samples.groupBy("epoch", "kind").agg(F.count("*").alias("samples"), F.count_if(F.col("weight") != 1).alias("pseudo"), F.sum("weight").alias("mass"))
    p = plan.select("epoch", "kind", *(F.col(c).alias(f"plan_{c}") for c in ("samples", "pseudo", "mass")))
    return kinds.join(p, ["epoch", "kind"], "full").where("not (samples <=> plan_samples and pseudo <=> plan_pseudo and abs(mass - plan_mass) <= 1e-6) or mass is null or plan_mass is null")


def gap_quantiles(takes: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Percentiles of the seconds between neighbouring clips of a take."""
    gap = F.col("seconds") - F.lag("seconds").over(Window.partitionBy("take_id").orderBy("position"))
    return quantiles_by_rank(takes.select(gap.alias("gap")).where("gap is not null"), "gap", quantiles)


def quantiles_by_rank(table: DataFrame, value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """One row ``q<percent>``: exact, interpolated linearly between the two values about each place.

    The values are numbered over sorted ranges, so no task holds them all.
    """
    numbered = ranked(table.select(value), [value], "i")
    last = numbered.agg((F.count("*") - 1).alias("last"))  # one row
    place = lambda q: F.lit(float(q)) * F.col("last")
    weight = lambda q: F.greatest(F.lit(0.0), 1 - F.abs(F.col("i") - place(q)))
    near = numbered.crossJoin(F.broadcast(last))
    return near.agg(*(F.sum(F.when(weight(q) > 0, weight(q) * F.col(value))).alias(f"q{round(100 * q)}") for q in quantiles))


def soft_cross_entropy(rows: DataFrame, steps: int, epoch_weight: float) -> DataFrame:
    """``-sum(mass * log p) * steps / epoch_weight`` by step; ``rows``: ``step, mass, logp``."""
    return rows.groupBy("step").agg((-F.sum(F.col("mass") * F.col("logp")) * steps / epoch_weight).alias("loss"))
