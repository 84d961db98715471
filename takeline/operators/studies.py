"""Composed evaluations: populations of takes, configurations decoded and scored over them, paired comparisons.

A population is a table of windows (takes, whole or thinned); a configuration is a set of probabilities.  Every window of
every configuration is gathered into one row of at most as many clips as there are classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeline.functions.columns import FLOOR, softmax
from takeline.operators import evaluate, sampling
from takeline.operators.decode import beams, gathered, marginals
from takeline.operators.spans import ranked
from takeline.sources.settled import settled


def populations(takes: DataFrame, sizes: DataFrame, repeats: int, seed: int, primary: DataFrame | None = None) -> DataFrame:
    """``population, repeat, take_id, clip_id, position``: complete takes, ``repeats`` thinnings, and a given subset.

    ``takes``: ``take_id, clip_id, position, take_size``; ``sizes`` as in ``sampling.thin``.
    """
    columns = ["repeat", "take_id", "clip_id", "position"]
    whole = takes.select(F.lit("full_take").alias("population"), F.lit(0).alias("repeat"), *columns[1:])
    thinned = sampling.thin(takes, sizes, repeats, seed, contiguous=True).select("repeat", "take_id", "clip_id", F.col("new_position").alias("position"))
    out = whole.unionByName(thinned.select(F.lit("designated").alias("population"), *columns))
    return out if primary is None else out.unionByName(primary.select(F.lit("primary").alias("population"), F.lit(0).alias("repeat"), *columns[1:]))


def prior_matrices(priors: DataFrame, classes: int) -> dict[int, np.ndarray]:
    """A matrix for each fold of ``fold, prev, next, p``; a row per pair of classes and fold reaches the driver."""
    out: dict[int, np.ndarray] = {}
    for r in priors.collect():
        out.setdefault(r["fold"], np.zeros((classes, classes)))[r["prev"], r["next"]] = r["p"]
    return out


def asked_windows(windows: DataFrame, probabilities: DataFrame, folds: DataFrame, classes: int = 40) -> DataFrame:
    """``config, population, repeat, take_id, members, content`` of every window that can be decoded, without its probabilities.

    ``members``: clips and folds in order; ``content``: hash of the ordered clips, their folds and probabilities.  Windows of
    equal content (a take that a thinning leaves whole, a subset's take, a configuration that changes nothing there) have
    equal labels.  Windows with more clips than classes have no distinct labels and are left out, as in ``decode.decode_takes``.
    """
    hashed = probabilities.select("config", "clip_id", F.xxhash64("p").alias("p"))
    rows = windows.join(folds.select("clip_id", "fold"), "clip_id").join(hashed, "clip_id")
    listed = gathered(rows, ["config", "population", "repeat", "take_id"], classes, ("fold",))
    content = F.sha2(F.to_json(F.transform("members", lambda m: F.struct(m["clip_id"], m["fold"], m["p"]))), 256)
    return listed.withColumn("content", content).withColumn("members", F.transform("members", lambda m: F.struct(m["clip_id"].alias("clip_id"), m["fold"].alias("fold"))))


def decode_windows(windows: DataFrame, probabilities: DataFrame, folds: DataFrame, priors: dict[int, np.ndarray], weights: tuple[float, ...] = (0.75,), mode: str = "map", classes: int = 40) -> DataFrame:
    """``config, weight, population, repeat, take_id, fold, clip_id, raw, label`` of every window that can be decoded.

    ``probabilities``: ``config, clip_id, p``; ``folds``: ``clip_id, fold``; a fold's windows use its own prior.  Windows of
    equal content are decoded once, and the labels go back to all of them.
    """
    asked = settled(asked_windows(windows, probabilities, folds, classes))
    distinct = asked.groupBy("content").agg(F.min_by(F.struct("config", "members"), F.struct("config", "population", "repeat", "take_id")).alias("w"))
    places = distinct.select("content", F.col("w.config").alias("config"), F.posexplode("w.members").alias("position", "m")).select("content", "config", "position", "m.*")
    rows = places.join(probabilities.select("config", "clip_id", "p"), ["config", "clip_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, members in zip(batch["content"], batch["members"], strict=True):
                p, prior = np.stack([m["p"] for m in members]).astype(float), priors[int(members[0]["fold"])]
                for w in weights:
                    labels = p.argmax(1) if len(p) == 1 else marginals(p, prior, w).argmax(1) if mode == "marginal" else beams(p, prior, w, 64, 16)[1][0]
                    out.append((content, w, p.argmax(1).tolist(), [int(x) for x in labels]))
            yield pd.DataFrame(out, columns=["content", "weight", "raws", "labels"])

    done = gathered(rows, ["content"], classes, ("fold",)).mapInPandas(run, "content string, weight double, raws array<int>, labels array<int>")
    found = asked.join(done, "content").select("config", "weight", "population", "repeat", "take_id", F.explode(F.arrays_zip("members", "raws", "labels")).alias("x"))
    return found.select("config", "weight", "population", "repeat", "take_id", "x.members.fold", "x.members.clip_id", F.col("x.raws").alias("raw"), F.col("x.labels").alias("label"))


def population_scores(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """``config, weight, population, fold, n, raw, decoded``: accuracies of each repeat over its clips, averaged over repeats."""
    scored = decoded.join(truth.select("clip_id", "y"), "clip_id")
    hit = lambda c: F.avg((F.col(c) == F.col("y")).cast("double"))
    each = scored.groupBy("config", "weight", "population", "fold", "repeat").agg(F.count("*").alias("n"), hit("raw").alias("raw"), hit("label").alias("decoded"))
    return each.groupBy("config", "weight", "population", "fold").agg(F.sum("n").alias("n"), F.avg("raw").alias("raw"), F.avg("decoded").alias("decoded"))


def length_scores(takes: DataFrame, longest: int = 8) -> DataFrame:
    """Windows ``population, repeat, take_id, clip_id, position`` of every run of 1 to ``longest`` clips of each take.

    ``take_id`` names the window as ``take|length|start``; ``weighted_lengths`` puts its scores together.
    """
    runs = evaluate.row_windows(takes, longest).select(F.concat_ws("|", "take_id", "len", "start").alias("take_id"), F.posexplode("members").alias("position", "clip_id"))
    return runs.select(F.lit("exact_length").alias("population"), F.lit(0).alias("repeat"), "take_id", "clip_id", "position")


def weighted_lengths(decoded: DataFrame, truth: DataFrame, length_weights: list[float]) -> DataFrame:
    """``config, weight, fold, raw, decoded``: accuracy by window, averaged by take, then by length, then by the weights."""
    parts = F.split("take_id", r"\|")
    scored = decoded.join(truth.select("clip_id", "y"), "clip_id").select("*", F.get(parts, 0).alias("take"), F.get(parts, 1).cast("int").alias("len"))
    hit = lambda c: F.avg((F.col(c) == F.col("y")).cast("double")).alias(c)
    keys = ["config", "weight", "fold"]
    window = scored.groupBy(*keys, "len", "take", "take_id").agg(hit("raw"), hit("label"))
    length = window.groupBy(*keys, "len", "take").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label")).groupBy(*keys, "len").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"))
    w = F.get(F.array(*map(F.lit, length_weights)), F.col("len") - 1)
    return length.groupBy(*keys).agg(F.sum(w * F.col("raw")).alias("raw"), F.sum(w * F.col("label")).alias("decoded"))


def paired(decoded: DataFrame, truth: DataFrame, parent: str, candidate: str) -> DataFrame:
    """Clips of every window with both labels: ``weight, population, repeat, fold, take_id, clip_id, y, parent, parent_raw, label, raw``."""
    keys = ["weight", "population", "repeat", "take_id", "fold", "clip_id"]
    a = decoded.where(F.col("config") == parent).select(*keys, F.col("label").alias("parent"), F.col("raw").alias("parent_raw"))
    b = decoded.where(F.col("config") == candidate).select(*keys, "label", "raw")
    return a.join(b, keys).join(truth.select("clip_id", "y"), "clip_id")


def gains(pairs: DataFrame) -> DataFrame:
    """``population, fold, raw, decoded, rescued, lost``: gains in points, repeats averaged; input of ``evaluate.gate_forms``."""
    right = lambda c: (F.col(c) == F.col("y")).cast("int")
    each = pairs.groupBy("population", "fold", "repeat").agg(
        F.avg(right("raw") - right("parent_raw")).alias("raw"), F.avg(right("label") - right("parent")).alias("decoded"),
        F.count_if((right("label") == 1) & (right("parent") == 0)).alias("rescued"), F.count_if((right("label") == 0) & (right("parent") == 1)).alias("lost"),
    )
    return each.groupBy("population", "fold").agg((100 * F.avg("raw")).alias("raw"), (100 * F.avg("decoded")).alias("decoded"), F.sum("rescued").alias("rescued"), F.sum("lost").alias("lost"))


def subject_counts(decoded: DataFrame, truth: DataFrame, subjects: DataFrame) -> DataFrame:
    """``config, weight, subject, hits, n`` summed over repeats; input of the jackknife and the cluster bootstrap."""
    scored = decoded.join(truth.select("clip_id", "y"), "clip_id").join(subjects.select("clip_id", "subject"), "clip_id")
    return scored.groupBy("config", "weight", "subject").agg(F.count_if(F.col("label") == F.col("y")).alias("hits"), F.count("*").alias("n"))


def paired_bootstrap(counts: DataFrame, cell: list[str], parent: dict[str, object], draws: int, seed: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Every cell of a grid, and what it gains over the parent cell, under the same draws of subjects.

    ``counts``: ``cell`` columns, ``subject``, ``hits``, ``n``, summed over folds and repeats; a subject that a cell lacks
    counts nothing there.  A draw takes as many subjects as there are, with replacement, and every cell is scored on
    these, so that differences between cells, and which of them is best, have an uncertainty of their own.  Subjects are
    spread into a column for each cell, so one pass over draws x subjects scores them all.

    Result: ``cell`` columns, ``accuracy, se, low, high, gain, gain_se, gain_low, gain_high, positive`` (share of draws with
    a gain) and ``best`` (share of draws in which the cell has the highest accuracy; the first by its columns on ties).
    """
    cells = sorted(tuple(r) for r in counts.select(*cell).distinct().collect())  # the grid
    own = [tuple(parent[c] for c in cell)]
    if own[0] not in cells:
        raise ValueError(f"no cell {parent}")
    at = lambda values: F.lit(True) if not cell else _all(F.col(c) == F.lit(v) for c, v in zip(cell, values, strict=True))
    sums = [F.sum(F.when(at(v), F.col(c))).alias(f"{c}{k}") for k, v in enumerate(cells) for c in ("hits", "n")]
    wide = counts.groupBy("subject").agg(*sums)
    names = [f"{c}{k}" for k in range(len(cells)) for c in ("hits", "n")]
    numbered = settled(ranked(wide, ["subject"], "i").select("i", *names))
    size = numbered.agg(F.count("*").alias("k"))  # one row
    places = numbered.select(F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r")).crossJoin(F.broadcast(size))
    picked = places.withColumn("i", F.floor(sampling.draw(seed, F.col("r"), F.col("j")) * F.col("k"))).select("r", "i")
    each = picked.join(numbered, "i").groupBy("r").agg(*(F.sum(n).alias(n) for n in names))
    points = numbered.agg(*(F.sum(n).alias(n) for n in names))
    first = cells.index(own[0])

    def scores(table: DataFrame) -> DataFrame:
        """A row for each cell with its accuracy ``x``, the parent's, and whether it is the best."""
        x = F.array(*(F.try_divide(f"hits{k}", f"n{k}").cast("double") for k in range(len(cells))))
        listed = table.select(x.alias("xs"), F.posexplode(x).alias("k", "x"))
        return listed.select("k", "x", F.get("xs", F.lit(first)).alias("p"), (F.array_position("xs", F.array_max("xs")) - 1 == F.col("k")).alias("top"))

    spread = scores(each).withColumn("d", F.col("x") - F.col("p")).groupBy("k").agg(
        F.stddev_samp("x").alias("se"), F.percentile("x", low).alias("low"), F.percentile("x", high).alias("high"),
        F.stddev_samp("d").alias("gain_se"), F.percentile("d", low).alias("gain_low"), F.percentile("d", high).alias("gain_high"),
        F.avg((F.col("d") > 0).cast("double")).alias("positive"), F.avg(F.col("top").cast("double")).alias("best"),
    )
    grid = counts.sparkSession.createDataFrame([(k, *v) for k, v in enumerate(cells)], ["k", *cell])
    known = scores(points).select("k", F.col("x").alias("accuracy"), (F.col("x") - F.col("p")).alias("gain"))
    return grid.join(known, "k").join(spread, "k").select(*cell, "accuracy", "se", "low", "high", "gain", "gain_se", "gain_low", "gain_high", "positive", "best")


def _all(conditions: Iterator[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def blends(members: DataFrame, settings: DataFrame) -> DataFrame:
    """``config, clip_id, p``: members' distributions put together by ``config, member, weight, geometric``.

    Arithmetic: the weighted mean; geometric: the normalised product of powers.  Weights count as parts of their sum.  A
    clip that a weighted member lacks is left out of that configuration.
    """
    own = Window.partitionBy("config")
    parts = settings.select("config", "member", (F.col("weight") / F.sum("weight").over(own)).alias("w"), "geometric", F.count("*").over(own).alias("members"))
    ways = parts.groupBy("config", "geometric", "members").agg(F.collect_list(F.struct("member", "w")).alias("parts"))  # a row per configuration
    # Dealt by clip: members are few, so by member each would be one task; and a clip's answers stay arrays.
    dealt = members.where(F.size("p") > 0).select("clip_id", "member", "p").repartition("clip_id")
    held = dealt.groupBy("clip_id").agg(F.collect_list(F.struct("member", "p")).alias("held")).crossJoin(F.broadcast(ways))
    met = F.flatten(F.transform("parts", lambda s: F.transform(F.filter("held", lambda h: h["member"] == s["member"]), lambda h: F.struct(s["w"].alias("w"), h["p"].alias("p")))))
    whole = held.select("config", "clip_id", "geometric", "members", met.alias("met")).where(F.size("met") == F.col("members"))

    def mixed(cls: Column) -> Column:
        value = lambda m: F.when(F.col("geometric"), F.log(F.greatest(F.get(m["p"], cls), F.lit(FLOOR)))).otherwise(F.get(m["p"], cls))
        return F.aggregate(F.transform("met", lambda m: m["w"] * value(m)), F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, s, x))

    places = F.sequence(F.lit(0), F.array_min(F.transform("met", lambda m: F.size(m["p"]))) - 1)
    listed = whole.select("config", "clip_id", "geometric", F.transform(places, mixed).alias("v"))
    return listed.select("config", "clip_id", F.when(F.col("geometric"), softmax(F.col("v"))).otherwise(F.col("v")).alias("p"))


def accuracy_curves(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """``config, weight, population, fold, repeat, accuracy`` of the decoded labels over clips."""
    scored = decoded.join(truth.select("clip_id", "y"), "clip_id")
    return scored.groupBy("config", "weight", "population", "fold", "repeat").agg(F.avg((F.col("label") == F.col("y")).cast("double")).alias("accuracy"))


def pooled_curves(curves: DataFrame) -> DataFrame:
    """``config, weight, population, fold, accuracy``, the mean over repeats of each fold, and of all (fold null)."""
    keys = ["config", "weight", "population"]
    each = curves.groupBy(*keys, "fold").agg(F.avg("accuracy").alias("accuracy"))
    pooled = curves.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))
    return each.unionByName(pooled.withColumn("fold", F.lit(None).cast(dict(each.dtypes)["fold"])))


def best_weights(curves: DataFrame, stated: float) -> DataFrame:
    """``config, population, stated, best_weight, best``: the mean accuracy at a stated weight, and the weight with the highest one (the least on ties)."""
    mean = curves.groupBy("config", "population", "weight").agg(F.round(F.avg("accuracy"), 12).alias("x"))  # sums in another order tie
    top = F.max(F.struct("x", (-F.col("weight")).alias("minus")))
    return mean.groupBy("config", "population").agg(F.max(F.when(F.col("weight") == stated, F.col("x"))).alias("stated"), top.alias("t")).select("config", "population", "stated", (-F.col("t.minus")).alias("best_weight"), F.col("t.x").alias("best"))


def paired_curves(a: DataFrame, b: DataFrame) -> DataFrame:
    """``population, pairs, mean, se, wins`` of accuracies of ``a`` less those of ``b`` on the same folds and repeats.

    Each holds one configuration at one weight.
    """
    keys = ["population", "fold", "repeat"]
    d = a.select(*keys, F.col("accuracy").alias("x")).join(b.select(*keys, F.col("accuracy").alias("y")), keys).withColumn("d", F.col("x") - F.col("y"))
    return d.groupBy("population").agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), F.count_if(F.col("d") > 0).alias("wins"))


def at_best(curves: DataFrame, config: str, population: str) -> DataFrame:
    """The curves of a configuration in a population at the weight that is best there."""
    own = curves.where((F.col("config") == config) & (F.col("population") == population))
    return own.join(best_weights(own, 0.0).select(F.col("best_weight").alias("weight")), "weight", "left_semi")


def fold_contrasts(gained: DataFrame) -> DataFrame:
    """``population, metric, folds, mean, positive, se`` of ``gains``: a contrast's mean over folds, the folds above 0, and its standard error."""
    long = gained.select("population", "fold", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("raw", "decoded")))))
    return long.groupBy("population", "metric").agg(F.count("*").alias("folds"), F.avg("x").alias("mean"), F.count_if(F.col("x") > 0).alias("positive"), (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se"))


def label_changes(a: DataFrame, b: DataFrame, scored: int) -> DataFrame:
    """One row ``clips, changed, of_scored``: clips whose label differs, and what that is of ``scored`` clips."""
    both = a.select("clip_id", F.col("label").alias("a")).join(b.select("clip_id", F.col("label").alias("b")), "clip_id")
    changed = F.count_if(F.col("a") != F.col("b"))
    return both.agg(F.count("*").alias("clips"), changed.alias("changed"), F.try_divide(changed * scored, F.count("*")).alias("of_scored"))


def out_of_fold(folds: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clip_id, fold, p)`` of every clip by the model that held out its fold, and ``fold, missing`` of folds to resume.

    ``parts``: ``fold, clip_id, p`` of the folds done so far; a model's answers about other folds' clips don't count.
    """
    joined = folds.select("clip_id", "fold").join(parts.select("fold", "clip_id", "p"), ["fold", "clip_id"], "left")
    missing = joined.where("p is null").groupBy("fold").agg(F.count("*").alias("missing"))
    return joined.where("p is not null").select("clip_id", "fold", "p"), missing


def registered(registry: DataFrame, probabilities: DataFrame, clips: DataFrame) -> DataFrame:
    """``config, decoder, clip_id, p`` of each configuration of ``config, source, decoder``, aligned to the clips.

    A clip that a source lacks raises.  The registry is a row per configuration.
    """
    wanted = clips.select("clip_id").crossJoin(F.broadcast(registry.select("config", "source", "decoder")))
    found = wanted.join(probabilities.select("source", "clip_id", "p"), ["source", "clip_id"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no probabilities:"), "config", "clip_id")).cast("array<double>")
    return found.select("config", "decoder", "clip_id", F.coalesce("p", missing).alias("p"))


def greedy_selection(members: list[str], score: Callable[[list[str]], float]) -> tuple[list[str], list[float]]:
    """Members in the order kept, and the score after each: the best alone, then each next one that raises the score.

    ``score`` runs a job over the data for one set of members; there are as many sets as twice the members.
    """
    alone = {m: score([m]) for m in members}
    kept: list[str] = []
    history: list[float] = []
    for m in sorted(members, key=lambda m: -alone[m]):
        value = score([*kept, m]) if kept else alone[m]
        if not kept or value > history[-1]:
            kept.append(m)
            history.append(value)
    return kept, history


def mean_accuracy(probabilities: DataFrame, truth: DataFrame) -> Callable[[list[str]], float]:
    """Score of a set of members: accuracy of the mean of their ``member, clip_id, cls, p``."""

    def score(members: list[str]) -> float:
        mean = probabilities.where(F.col("member").isin(members)).groupBy("clip_id", "cls").agg(F.avg("p").alias("p"))
        label = mean.groupBy("clip_id").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("label"))
        return label.join(truth, "clip_id").agg(F.avg((F.col("label") == F.col("y")).cast("double"))).first()[0]

    return score


def first_seen(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, at its first place: a dedup that keeps the order."""
    return table.groupBy(key).agg(F.min(order).alias(order))


def thinned_curve(decoded: DataFrame, truth: DataFrame) -> DataFrame:
    """``config, weight, repeat, accuracy``: each thinning at every transition weight, so weights compare on the same windows."""
    scored = decoded.join(truth.select("clip_id", "y"), "clip_id")
    return scored.groupBy("config", "weight", "repeat").agg(F.avg((F.col("label") == F.col("y")).cast("double")).alias("accuracy"))
