"""Distribution drift: population stability, two-sample Kolmogorov-Smirnov, mean shift, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from offerloom.operators import prefix
from offerloom.session import materialise

EPS = 1e-4


def edges_of(base: DataFrame, features, bins: int = 10, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Per feature the sorted distinct percentile edges of the baseline, a handful of numbers each."""
    q = prefix.quantiles(long_form(base, features), ["feature"], "value", [i / bins for i in range(bins + 1)], hot_rows)
    return materialise(q.groupBy("feature").agg(F.sort_array(F.collect_set("quantile")).alias("edges")), "edges")


def bin_of(value, edges):
    """0-based bin of a value between edges, last bin closed; null outside."""
    n = F.size(edges) - F.lit(1)
    below = F.size(F.filter(edges, lambda e: e <= value))
    inside = (value >= F.get(edges, F.lit(0))) & (value <= F.get(edges, n)) & (n >= 1)
    return F.when(inside, F.least(below - F.lit(1), n - F.lit(1)))


def bin_counts(df: DataFrame, features, edges: DataFrame) -> DataFrame:
    """Rows per (feature, bin), counted before the shuffle. ``edges`` has one short array per feature."""
    placed = long_form(df, features).join(edges, "feature").withColumn("bin", bin_of(F.col("value"), F.col("edges")))
    return placed.filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count("*").alias("cnt"))


def psi_from_bins(base_bins: DataFrame, new_bins: DataFrame, edges: DataFrame) -> DataFrame:
    grid = edges.filter(F.size("edges") >= 2).select(
        "feature", F.explode(F.sequence(F.lit(0), F.size("edges") - F.lit(2))).alias("bin")
    )
    b = base_bins.withColumnRenamed("cnt", "e")
    n = new_bins.withColumnRenamed("cnt", "a")
    j = grid.join(b, ["feature", "bin"], "left").join(n, ["feature", "bin"], "left").fillna(0, ["e", "a"])
    w = Window.partitionBy("feature")
    clip = lambda c: F.least(F.greatest(c, F.lit(EPS)), F.lit(1.0))
    e = clip(F.col("e") / (F.sum("e").over(w) + F.lit(EPS)))
    a = clip(F.col("a") / (F.sum("a").over(w) + F.lit(EPS)))
    parts = j.withColumn("_e", e).withColumn("_a", a)
    psi = parts.groupBy("feature").agg(F.sum((F.col("_a") - F.col("_e")) * F.log(F.col("_a") / F.col("_e"))).alias("psi"))
    return edges.select("feature").join(psi, "feature", "left").fillna(0.0, ["psi"])


def long_form(df: DataFrame, features) -> DataFrame:
    return prefix.present(prefix.unpivot(df, features), "value")


def base_histogram(base: DataFrame, features, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    counts = prefix.value_counts(long_form(base, features), ["feature"], "value")
    return prefix.running_totals(counts, ["feature"], "value", ["cnt"], hot_rows)


def psi(base: DataFrame, new: DataFrame, features, bins: int = 10, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    edges = edges_of(base, features, bins, hot_rows)
    return psi_from_bins(bin_counts(base, features, edges), bin_counts(new, features, edges), edges)


def ks_pvalue(d, n, m):
    """Asymptotic two-sided p-value: 2 * sum (-1)^(j-1) exp(-2 j^2 t^2)."""
    en = F.sqrt(n * m / (n + m))
    t = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    term = lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * j * j * t * t)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda total, j: total + term(j))
    return F.when(t < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(base: DataFrame, new: DataFrame, features, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Largest distance of the two empirical distributions per feature, with its asymptotic p-value."""
    cells = _cells(base, new, features, None)
    return _distances(base, new, features, cells, hot_rows).select(
        "feature", "ks", "n", "m", ks_pvalue(F.col("ks"), F.col("n").cast("double"), F.col("m").cast("double")).alias("p_value"))


#: Equal steps between the baseline's extremes; what lies outside is a step of its own on either side.
STEPS = 4096


def _ranges(base: DataFrame, features) -> DataFrame:
    told = long_form(base, features).groupBy("feature").agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    return materialise(told, "ranges")  # a row per feature


def _both(base: DataFrame, new: DataFrame, features) -> DataFrame:
    return long_form(base, features).withColumn("b", F.lit(1)).unionByName(long_form(new, features).withColumn("b", F.lit(0)))


def _step():
    width = F.col("_max") - F.col("_min")
    at = F.when(width > 0, F.floor((F.col("value") - F.col("_min")) / width * STEPS)).otherwise(F.when(F.col("value") > F.col("_max"), 1).when(F.col("value") < F.col("_min"), -1).otherwise(0))
    return F.greatest(F.least(at, F.lit(STEPS + 1)), F.lit(-1)).cast("int").alias("step")


def _cells(base: DataFrame, new: DataFrame, features, edges: DataFrame | None) -> DataFrame:
    """Both tables in one scan each: per (feature, step[, bin]) counts, moments and extremes of either side, at most a few thousand rows a feature."""
    ranges = _ranges(base, features)
    both = _both(base, new, features).join(ranges, "feature").withColumn("step", _step())
    bin_ = F.lit(None).cast("int")
    if edges is not None:
        both, bin_ = both.join(edges, "feature"), bin_of(F.col("value"), F.col("edges"))
    mine = lambda b: F.when(F.col("b") == b, F.col("value"))
    cells = both.groupBy("feature", "step", bin_.alias("bin")).agg(
        F.count(mine(1)).alias("cb"), F.count(mine(0)).alias("cn"), F.avg(mine(1)).alias("mb"), F.avg(mine(0)).alias("mn"),
        F.var_pop(mine(1)).alias("vb"), F.min("value").alias("low"), F.max("value").alias("high"))
    return materialise(cells.join(ranges, "feature"), "cells")


def _distances(base: DataFrame, new: DataFrame, features, cells: DataFrame, hot_rows: int) -> DataFrame:
    """(feature, ks, n, m): the distance at the steps' ends is exact; inside a step it can be larger by the step's own share at most, so only
    steps that could hold the maximum have their values counted one by one."""
    steps = cells.groupBy("feature", "step").agg(F.sum("cb").alias("cb"), F.sum("cn").alias("cn"), F.min("low").alias("low"), F.max("high").alias("high"))
    w = Window.partitionBy("feature").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    t = Window.partitionBy("feature")
    steps = steps.select("*", F.sum("cb").over(w).alias("ub"), F.sum("cn").over(w).alias("un"), F.sum("cb").over(t).alias("n"), F.sum("cn").over(t).alias("m"))
    share = lambda b, n: F.try_divide(F.col(b), F.col("n")) - F.try_divide(F.col(n), F.col("m"))
    steps = steps.withColumn("gap", F.abs(share("ub", "un")))
    most = F.greatest(F.abs(share("ub", "un")), F.abs(F.try_divide(F.col("ub") - F.col("cb"), F.col("n")) - F.try_divide(F.col("un") - F.col("cn"), F.col("m"))))
    most = most + F.greatest(F.try_divide(F.col("cb"), F.col("n")), F.try_divide(F.col("cn"), F.col("m")))
    steps = materialise(steps.withColumn("best", F.max("gap").over(t)).withColumn("open", (F.col("low") < F.col("high")) & (most > F.col("best"))), "steps")
    open_ = steps.filter("open").select("feature", "step", (F.col("ub") - F.col("cb")).alias("_sb"), (F.col("un") - F.col("cn")).alias("_sn"), "n", "m")
    ranges = cells.select("feature", "_min", "_max").distinct()
    inside = _both(base, new, features).join(ranges, "feature").withColumn("step", _step()).join(open_.select("feature", "step"), ["feature", "step"])
    hist = inside.groupBy("feature", "step", "value").agg(F.sum("b").alias("cb"), (F.count("*") - F.sum("b")).alias("cn"))
    cum = prefix.running_totals(hist, ["feature", "step"], "value", ["cb", "cn"], hot_rows).join(open_, ["feature", "step"])
    gap = F.abs((F.col("cum_cb") + F.col("_sb")) / F.col("n") - (F.col("cum_cn") + F.col("_sn")) / F.col("m"))
    gaps = steps.select("feature", "gap", "n", "m").unionByName(cum.select("feature", gap.alias("gap"), "n", "m"))
    return gaps.groupBy("feature").agg(F.max("gap").alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))


def mean_shift(base: DataFrame, new: DataFrame, features) -> DataFrame:
    b = long_form(base, features).groupBy("feature").agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("s"))
    n = long_form(new, features).groupBy("feature").agg(F.avg("value").alias("new_mean"))
    return b.join(n, "feature").select(
        "feature", "baseline_mean", "new_mean",
        (F.abs(F.col("new_mean") - F.col("baseline_mean")) / (F.col("s") + F.lit(1e-8))).alias("mean_shift"),
    )


def drift_report(base: DataFrame, new: DataFrame, features, psi_limit: float = 0.20, alpha: float = 0.01,
                 hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Per feature: psi, ks, p-value, mean shift, drift flag, and the mean psi over features.

    Edges come from selection, bins, steps and moments from one scan of both tables; no table of all values is made.
    """
    edges = edges_of(base, features, hot_rows=hot_rows)
    cells = _cells(base, new, features, edges)
    side = lambda c: cells.filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.sum(c).alias("cnt"))
    p = psi_from_bins(side("cb"), side("cn"), edges)
    total = lambda c, x: F.try_divide(F.sum(F.col(x) * F.col(c)), F.sum(c))
    means = cells.groupBy("feature").agg(total("cb", "mb").alias("baseline_mean"), total("cn", "mn").alias("new_mean"))
    off = F.col("mb") - F.col("baseline_mean")
    spread = cells.join(means, "feature").groupBy("feature", "baseline_mean", "new_mean").agg(
        F.sqrt(F.try_divide(F.sum(F.col("cb") * (F.col("vb") + off * off)), F.sum("cb"))).alias("s"))
    out = p.join(spread, "feature").join(_distances(base, new, features, cells, hot_rows), "feature").select(
        "feature", "psi", "ks", ks_pvalue(F.col("ks"), F.col("n").cast("double"), F.col("m").cast("double")).alias("p_value"),
        "baseline_mean", "new_mean", (F.abs(F.col("new_mean") - F.col("baseline_mean")) / (F.col("s") + F.lit(1e-8))).alias("mean_shift"),
    ).withColumn("drifted", (F.col("psi") > psi_limit) | (F.col("p_value") < alpha))
    rows = out.agg(F.collect_list(F.struct(*out.columns)).alias("r"), F.avg("psi").alias("overall_psi"))  # a row per feature
    return rows.select(F.explode("r").alias("r"), "overall_psi").select("r.*", "overall_psi")


def prediction_shares(df: DataFrame, col: str) -> DataFrame:
    total = df.filter(F.col(col).isNotNull()).agg(F.count("*")).scalar()
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg((F.count("*") / total).alias("share"))


def drift_baseline(df: DataFrame, features, sample: int = 10000, seed: int = 42, hot_rows: int = prefix.HOT_ROWS):
    """(statistics per feature, hashed sample of values per feature). Statistics use all rows."""
    med = prefix.quantiles(long_form(df, features), ["feature"], "value", [0.5], hot_rows).select("feature", F.col("quantile").alias("median"))
    stats = long_form(df, features).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("*").alias("n"),
    ).join(med, "feature")
    # hashes are counted by their first 16 bits, so only rows up to the step of the sample's last one are ordered
    rows = prefix.unpivot(df.withColumn("_h", F.xxhash64(*[F.col(c) for c in sorted(df.columns)], F.lit(seed))), features, ["_h"]).filter(F.col("value").isNotNull())
    step = F.shiftright("_h", 48)
    counts = rows.groupBy("feature", step.alias("_s")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("c", F.sum("c").over(Window.partitionBy("feature").orderBy("_s")))
    last = upto.groupBy("feature").agg(F.min(F.when(F.col("c") >= sample, F.col("_s"))).alias("_last"))  # a row per feature
    near = rows.join(F.broadcast(last), "feature").filter(F.col("_last").isNull() | (step <= F.col("_last")))
    w = Window.partitionBy("feature").orderBy("_h", "value")
    drawn = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample)
    return stats, drawn.select("feature", "value")


def save_baseline(df: DataFrame, features, path: str, bins: int = 10, hot_rows: int = prefix.HOT_ROWS) -> None:
    """Edges and bin counts (enough for psi) and the value histogram (enough for ks), so a reload can test drift."""
    edges = edges_of(df, features, bins, hot_rows)
    edges.write.parquet(f"{path}/edges")
    bin_counts(df, features, edges).write.parquet(f"{path}/bins")
    prefix.value_counts(long_form(df, features), ["feature"], "value").write.parquet(f"{path}/histogram")


def load_baseline(spark, path: str):
    return tuple(spark.read.parquet(f"{path}/{p}") for p in ("histogram", "edges", "bins"))


def psi_against_saved(new: DataFrame, saved, features) -> DataFrame:
    _, edges, bins = saved
    return psi_from_bins(bins, bin_counts(new, features, edges), edges)
