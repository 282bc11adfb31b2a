"""Leakage checks: rank correlation with the target, group overlap, feature registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from offerloom.functions import fixed
from offerloom.operators import prefix



def registry_frame(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.FEATURE_USE.items()), "feature string, use string")


def classify_columns(spark, columns, uses: dict | None = None) -> DataFrame:
    """One row per column: approved, blocked, other known use, or unregistered."""
    uses = uses or fixed.FEATURE_USE
    name = {"training": "approved", "blocked": "blocked"}
    rows = [(c, name.get(uses.get(c), uses.get(c, "unregistered"))) for c in columns]
    return spark.createDataFrame(rows, "feature string, status string")


def blocked_present(columns, uses: dict | None = None) -> list[str]:
    uses = uses or fixed.FEATURE_USE
    return [c for c in columns if uses.get(c) == "blocked"]


def spearman_with_target(df: DataFrame, features, target: str, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Spearman correlation of each feature with the alphabetically encoded target.

    The data is first reduced to counts per (feature, value, target). Ranks of the values come from
    distributed running totals, ranks of the few target classes from a window over classes, and the Pearson
    correlation of the ranks is a weighted sum over the counts.
    """
    long = prefix.unpivot(df.filter(F.col(target).isNotNull()), features, [target]).filter(F.col("value").isNotNull())
    cells = long.groupBy("feature", "value", target).agg(F.count("*").alias("cnt"))
    hist = cells.groupBy("feature", "value").agg(F.sum("cnt").alias("cnt"))
    cum = prefix.running_totals(hist, ["feature"], "value", ["cnt"], hot_rows)
    x = cum.select("feature", "value", (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2).alias("rx"), "total_cnt")
    classes = cells.groupBy("feature", target).agg(F.sum("cnt").alias("c"))
    w = Window.partitionBy("feature").orderBy(target).rowsBetween(Window.unboundedPreceding, 0)
    y = classes.select("feature", target, (F.sum("c").over(w) - F.col("c") + (F.col("c") + 1) / 2).alias("ry"))
    mid = (F.col("total_cnt") + 1) / 2
    j = cells.join(x, ["feature", "value"]).join(y, ["feature", target])
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    s = j.groupBy("feature").agg(
        F.sum(F.col("cnt") * dx * dy).alias("sxy"), F.sum(F.col("cnt") * dx * dx).alias("sxx"),
        F.sum(F.col("cnt") * dy * dy).alias("syy"),
    )
    return s.select("feature", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman"))


def target_correlation(df: DataFrame, features, target: str, threshold: float = 0.95, uses: dict | None = None,
                       hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Spearman per feature with a leak flag. Raises when a blocked column is among the features."""
    bad = blocked_present(features, uses)
    if bad:
        raise ValueError(f"blocked columns among the features: {bad}")
    r = spearman_with_target(df, features, target, hot_rows)
    return r.withColumn("leak", F.coalesce(F.abs("spearman") > threshold, F.lit(False)))


def group_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row: groups in both parts, share of all groups, five examples, verdict."""
    sides = train.select(key, F.lit(1).alias("s")).distinct().unionByName(test.select(key, F.lit(2).alias("s")).distinct())
    per = sides.groupBy(key).agg(F.sum("s").alias("s"))
    both = per.filter(F.col("s") == 3)
    examples = both.orderBy(key).limit(5).agg(F.array_join(F.sort_array(F.collect_list(F.col(key))).cast("array<string>"), ","))
    return per.agg(F.count_if(F.col("s") == 3).alias("overlap"), F.count("*").alias("groups")).select(
        "overlap", "groups", F.try_divide(F.col("overlap"), F.col("groups")).alias("ratio"),
        examples.scalar().alias("examples"), (F.col("overlap") == 0).alias("passed"),
    )


def leakage_audit(train: DataFrame, test: DataFrame, features, target: str, key: str, threshold: float = 0.95,
                  uses: dict | None = None, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """All checks as report rows (check, passed, detail); nothing is raised."""
    spark = train.sparkSession
    clean = [c for c in features if c not in blocked_present(features, uses)]
    corr = spearman_with_target(train, clean, target, hot_rows).select(
        F.concat(F.lit("correlation:"), "feature").alias("check"),
        F.coalesce(F.abs("spearman") <= threshold, F.lit(True)).alias("passed"),
        F.round("spearman", 4).cast("string").alias("detail"),
    )
    overlap = group_overlap(train, test, key).select(
        F.lit("group_overlap").alias("check"), "passed", F.col("overlap").cast("string").alias("detail")
    )
    bad = blocked_present(features, uses)
    reg = spark.createDataFrame([("blocked_columns", not bad, ",".join(bad))], "check string, passed boolean, detail string")
    return corr.unionByName(overlap).unionByName(reg)


def perfect_metrics(metrics: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """(metric, value) rows that are suspiciously perfect."""
    return metrics.filter(F.col("value") >= 1.0 - epsilon)
