"""Ranking quality. Positions only matter up to the largest k, so only those rows are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from offerloom.operators import prefix

KS = (5, 10, 20)


def rank_in_query(preds: DataFrame, query: str, item: str, score: str, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Position of every item by descending score within its query; ties by (numeric) item."""
    return prefix.row_numbers(preds, [query], [(score, True), (item, False)], "position", hot_rows)


def top_positions(preds: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The first k positions of each query. The limit is applied before the shuffle as well."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item))
    return preds.select(query, item, score).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def metrics_per_query(preds: DataFrame, truth: DataFrame, query: str = "query_id", item: str = "item_id",
                      score: str = "score", gain: str | None = None, ks=KS) -> DataFrame:
    """ndcg, map, precision, recall, hit and mrr per predicted query that has relevant items."""
    top = max(ks)
    g = F.col(gain).cast("double") if gain else F.lit(1.0)
    relevant = truth.select(query, item, g.alias("_gain")).filter(F.col("_gain") > 0)
    relevant = relevant.groupBy(query, item).agg(F.max("_gain").alias("_gain"))
    ranked = top_positions(preds, query, item, score, top)
    # the ideal list needs the k largest gains; the total number of relevant items is a plain count
    best = Window.partitionBy(query).orderBy(F.col("_gain").desc(), F.col(item))
    ideal = relevant.withColumn("_p", F.row_number().over(best)).filter(F.col("_p") <= top)
    disc = lambda p: F.log2(F.col(p) + F.lit(1.0))
    ideals = ideal.groupBy(query).agg(*[
        F.sum(F.when(F.col("_p") <= k, F.col("_gain") / disc("_p"))).alias(f"_idcg{k}") for k in ks
    ])
    sizes = relevant.groupBy(query).agg(F.count("*").alias("_nrel"))
    hits = ranked.join(relevant, [query, item], "left").withColumn("_hit", F.col("_gain").isNotNull().cast("int"))
    running = Window.partitionBy(query).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_seen", F.sum("_hit").over(running))
    aggs = []
    for k in ks:
        inside = (F.col("position") <= k) & (F.col("_hit") == 1)
        aggs += [
            F.coalesce(F.sum(F.when(inside, F.col("_gain") / disc("position"))), F.lit(0.0)).alias(f"_dcg{k}"),
            F.coalesce(F.sum(F.when(inside, F.col("_seen") / F.col("position"))), F.lit(0.0)).alias(f"_ap{k}"),
            F.count_if(inside).alias(f"_hits{k}"),
        ]
    per = hits.groupBy(query).agg(*aggs, F.min(F.when(F.col("_hit") == 1, F.col("position"))).alias("_first"))
    j = per.join(sizes, query).join(ideals, query)
    first_any = first_hit(preds, relevant, query, item, score)
    j = j.join(first_any, query, "left")
    out = []
    for k in ks:
        out += [
            (F.col(f"_dcg{k}") / F.col(f"_idcg{k}")).alias(f"ndcg_{k}"),
            (F.col(f"_ap{k}") / F.least("_nrel", F.lit(k))).alias(f"map_{k}"),
            (F.col(f"_hits{k}") / F.lit(float(k))).alias(f"precision_{k}"),
            (F.col(f"_hits{k}") / F.col("_nrel")).alias(f"recall_{k}"),
            (F.col(f"_hits{k}") > 0).cast("double").alias(f"hit_{k}"),
        ]
    return j.select(query, *out, F.coalesce(F.lit(1.0) / F.col("_pos"), F.lit(0.0)).alias("mrr"))


def first_hit(preds: DataFrame, relevant: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """Position of the first relevant item, which may lie beyond the largest k.

    It is one plus the number of items that beat the best relevant item; that needs no ordering of the query.
    """
    both = preds.select(query, item, score).join(relevant.select(query, item), [query, item])
    down = -F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))  # no score comes last
    best = both.groupBy(query).agg(F.min(F.struct(down.alias("_down"), F.col(item).alias("_item"))).alias("_b"))
    ahead = preds.select(query, item, score).join(best, query)
    beats = (down < F.col("_b._down")) | ((down == F.col("_b._down")) & (F.col(item) < F.col("_b._item")))
    return ahead.groupBy(query).agg((F.count_if(beats) + 1).alias("_pos"))


def evaluate(preds: DataFrame, truth: DataFrame, query: str = "query_id", item: str = "item_id", score: str = "score",
             gain: str | None = None, ks=KS) -> DataFrame:
    """Means over the queries with relevant items; ``n_queries`` counts every predicted query."""
    per = metrics_per_query(preds, truth, query, item, score, gain, ks)
    n = preds.select(query).distinct().agg(F.count("*")).scalar()
    names = [c for c in per.columns if c != query]
    return per.agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("n_evaluated")).withColumn("n_queries", n)


def sample_per_group(df: DataFrame, group: str, item: str, fraction: float, seed: int = 42,
                     hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """A seeded share of each group, at least one row, without replacement: exact counts, any group size."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(item), F.lit(seed)).cast("double")).withColumn("_i", F.col(item))
    ranked = prefix.row_numbers(hashed, [group], [("_h", False), ("_i", False)], "_rn", hot_rows)
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    want = F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.col("_n")))
    return ranked.join(sizes, ranked[group].eqNullSafe(sizes["_g"])).filter(F.col("_rn") <= want).select(*df.columns)
