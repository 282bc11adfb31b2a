"""Ranking clean-up and tier derivation on long (entity, system) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.functions import columns as C, fixed


def dedup_first(df: DataFrame, keys, order: str) -> DataFrame:
    """First row of each key in list order; a missing system counts as ''."""
    keyed = df.withColumn("_sys", F.coalesce(F.col(keys[-1]), F.lit("")))
    ks = [*keys[:-1], "_sys"]
    return keyed.groupBy(*ks).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_r")).select("_r.*")


def dedup_rankings_array(c) -> Column:
    """The same on an array of structs with ``ranking_type``."""
    a = F.col(c) if isinstance(c, str) else c
    name = lambda x: F.coalesce(x["ranking_type"], F.lit(""))
    names = F.transform(a, name)
    return F.filter(a, lambda x, i: F.array_position(names, name(x)) == i + 1)


def standardise_rankings_array(c) -> Column:
    """First entry per system, numeric rank from the display text where missing or zero, display trimmed."""
    return F.transform(
        dedup_rankings_array(c),
        lambda x: F.struct(
            x["ranking_type"].alias("ranking_type"),
            F.coalesce(F.when(x["rank"] != 0, x["rank"]), C.parse_rank(x["rank_display"])).cast("int").alias("rank"),
            C.strip(x["rank_display"]).alias("rank_display"),
        ),
    )


def array_rank(c, system: str) -> Column:
    """Positive rank of one system out of a standardised array."""
    a = F.col(c) if isinstance(c, str) else c
    return F.get(F.transform(F.filter(a, lambda x: (x["ranking_type"] == system) & (x["rank"] > 0)), lambda x: x["rank"]), F.lit(0))


def standardise_ranks(df: DataFrame, rank: str = "rank", display: str = "rank_display") -> DataFrame:
    """Fill the numeric rank where missing or zero, trim the display text, mark unparsed texts."""
    parsed = C.parse_rank(display)
    return (
        df.withColumn("unparsed", (F.coalesce(C.strip(display), F.lit("")) != "") & parsed.isNull())
        .withColumn(rank, F.coalesce(F.when(F.col(rank) != 0, F.col(rank)), parsed))
        .withColumn(display, C.strip(display))
    )


def extract_rank(df: DataFrame, entity: str, system_col: str, system: str, rank: str = "rank", order: str = "pos") -> DataFrame:
    first = dedup_first(df.filter(F.col(system_col) == system), [entity, system_col], order)
    return first.filter(F.col(rank) > 0).select(entity, rank)


def _composite(points, scope, weight, is_world, has_world):
    """(composite, path) from conditional aggregates."""
    weighted = F.sum(F.when(scope != "regional", points * weight)) / F.sum(F.when(scope != "regional", weight))
    regional = F.max(F.when(scope == "regional", points)) * fixed.REGIONAL_DISCOUNT
    world = F.max(is_world.cast("int")) == 1
    return F.when(world, weighted).otherwise(regional), world


def derive_tier(rankings: DataFrame, entities: DataFrame, entity: str, system: str = "ranking_type", rank: str = "rank",
                display: str = "rank_display", order: str = "pos") -> DataFrame:
    """Tier of every entity from its rankings in several systems.

    World rank present: mean of the world and global systems' points, weights renormalised over those
    present. Otherwise the best regional points times a discount. Nothing: standard. The system's scope,
    largest rank and weight come from a nine-row literal, so there is one shuffle by entity.
    """
    clean = standardise_ranks(dedup_first(rankings, [entity, system], order), rank, display).filter(F.col(rank) > 0)
    scope = C.lookup(system, {s: v for s, v, _, _ in fixed.RANKING_SYSTEMS})
    largest = C.lookup(system, {s: float(m) for s, _, m, _ in fixed.RANKING_SYSTEMS})
    weight = C.lookup(system, {s: float(w or 0) for s, _, _, w in fixed.RANKING_SYSTEMS})
    scored = clean.select(entity, rank, scope.alias("_scope"), weight.alias("_w"), C.rank_points(rank, largest).alias("_p"),
                          (F.col(system) == fixed.WORLD_SYSTEM).alias("_world")).filter(F.col("_scope").isNotNull())
    composite, world = _composite(F.col("_p"), F.col("_scope"), F.col("_w"), F.col("_world"), None)
    agg = scored.groupBy(entity).agg(
        composite.alias("_c"), world.alias("_has"),
        F.max(F.when(F.col("_world"), F.col(rank))).alias("world_rank"),
        F.count_if(F.col("_scope") != "regional").alias("_ng"), F.count_if(F.col("_scope") == "regional").alias("_nr"),
    )
    j = entities.select(entity).join(agg, entity, "left")
    path = F.when(F.col("_has"), "qs_world_primary").when(F.col("_c").isNotNull(), "regional_fallback").otherwise("no_rankings")
    n = F.when(F.col("_has"), F.col("_ng")).when(F.col("_c").isNotNull(), F.col("_nr")).otherwise(F.lit(0))
    return j.select(
        entity, "world_rank", C.tier_of_score(F.coalesce("_c", F.lit(0.0))).alias("tier"), path.alias("path"),
        C.round_to(F.coalesce("_c", F.lit(0.0)), 4).alias("composite"), n.cast("bigint").alias("n_signals"),
    )


def latest_per_key(history: DataFrame, key: str, year: str, rank: str) -> DataFrame:
    return history.groupBy(key).agg(F.max_by(rank, year).alias(rank), F.max(year).alias(year))


def rank_change(df: DataFrame, rank: str, previous: str) -> DataFrame:
    """Previous minus current: positive is an improvement."""
    return df.withColumn("rank_change", F.col(previous) - F.col(rank))


def rank_change_by_year(df: DataFrame, name: str, year: str, rank: str) -> DataFrame:
    """Change against the entity's previous year in the table; an entity has few years."""
    w = Window.partitionBy(name).orderBy(year)
    return df.withColumn("rank_change", F.lag(rank).over(w) - F.col(rank))
