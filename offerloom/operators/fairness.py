"""Group bias, access, parity and odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUDGETS = (5000, 10000, 15000, 20000, 30000, 40000, 50000)


def crosstab_normalised(df: DataFrame, row: str, col: str) -> DataFrame:
    """Share of each ``col`` value within each ``row`` value, long form with zeros left out."""
    cells = df.groupBy(row, col).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))
    return cells.withColumn("share", F.col("n") / total)


def crosstab_wide(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """The same as columns, for a known value list."""
    wide = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(str(v)) for v in values), F.lit(0))
    return wide.select(row, *[(F.col(str(v)) / total).alias(str(v)) for v in values])


def group_bias(df: DataFrame, group: str, score: str, min_size: int = 10, threshold: float = 0.10) -> DataFrame:
    """Relative distance of each sufficiently large group's mean from the mean over all rows."""
    overall = df.agg(F.avg(score)).scalar()
    g = df.groupBy(group).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n")
    ).filter(F.col("n") >= min_size)
    return g.withColumn("bias", (F.col("mean") - overall) / overall).withColumn("flagged", F.abs("bias") > threshold)


def access_rates(df: DataFrame, col: str, budgets=BUDGETS) -> DataFrame:
    """Share of the non-null values within each budget."""
    row = df.agg(*[F.round(F.avg((F.col(col) <= b).cast("int")), 4).alias(f"b{i}") for i, b in enumerate(budgets)])
    pairs = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"b{i}").alias("rate")) for i, b in enumerate(budgets)])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def demographic_parity(df: DataFrame, positive, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(positive.cast("int")).alias("positive_rate"))


def equalized_odds(df: DataFrame, predicted, actual, group: str) -> DataFrame:
    """True and false positive rate per group; 0 where a group has no such rows."""
    tp, pos = F.count_if(predicted & actual), F.count_if(actual)
    fp, neg = F.count_if(predicted & ~actual), F.count_if(~actual)
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    return df.groupBy(group).agg(rate(tp, pos).alias("tpr"), rate(fp, neg).alias("fpr"), F.count("*").alias("n"))


def fairness_report(df: DataFrame, group: str, score: str, tier: str, cost: str, min_size: int = 10,
                    threshold: float = 0.10, budgets=BUDGETS, shown: int = 10) -> DataFrame:
    """One row: groups, flagged groups, largest bias, worst flagged group, access and groups without top tier."""
    bias = group_bias(df, group, score, min_size, threshold)
    summary = bias.agg(
        F.count("*").alias("n_groups"), F.count_if("flagged").alias("n_flagged"),
        F.max(F.abs("bias")).alias("max_abs_bias"),
        F.max_by(F.when(F.col("flagged"), F.col(group)),
                 F.when(F.col("flagged"), F.struct(F.round("bias", 9), F.col(group)))).alias("worst_group"),
    )
    no_top = df.groupBy(group).agg(F.count_if(F.col(tier) == "top").alias("t")).filter(F.col("t") == 0)
    names = no_top.orderBy(group).limit(shown).agg(F.array_join(F.sort_array(F.collect_list(group)), ",").alias("x"))
    rates = access_rates(df, cost, budgets).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("budget", "rate"))),
                                 lambda s: F.concat_ws("=", s["budget"].cast("string"), s["rate"].cast("string"))), ",")
    )
    return summary.select("*", no_top.agg(F.count("*")).scalar().alias("n_without_top"), names.scalar().alias("without_top"),
                          rates.scalar().alias("access"))
