"""Entity matching, reference lookups and catalogue expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions import columns as C, fixed


# --- by normalised name ------------------------------------------------------------------------


def one_per_name(rankings: DataFrame, name: str, order: str, keep: str) -> DataFrame:
    """One ranking row per normalised name: the first or the last in list order."""
    pick = F.max_by if keep == "last" else F.min_by
    cols = [c for c in rankings.columns]
    return (
        rankings.withColumn("_key", C.match_key(name)).filter(F.col("_key") != "")
        .groupBy("_key").agg(pick(F.struct(*cols), F.col(order)).alias("_r"))
    )


def match_by_name(entities: DataFrame, rankings: DataFrame, id_col: str, name: str, alternates: str | None,
                  r_name: str, r_order: str, r_rank: str, keep: str = "last") -> DataFrame:
    """Rank, country and city from the ranking row whose normalised name equals the entity's name,
    or, failing that, the first alternate name that matches. Empty places are filled, never overwritten."""
    names = F.array(F.col(name))
    if alternates:
        names = F.concat(names, F.coalesce(F.col(alternates), F.array().cast("array<string>")))
    keys = entities.select(id_col, F.posexplode(F.transform(names, C.match_key)).alias("_pos", "_key"))
    found = keys.filter(F.col("_key") != "").join(one_per_name(rankings, r_name, r_order, keep), "_key")
    best = found.groupBy(id_col).agg(F.min_by("_r", "_pos").alias("_r"))
    return apply_ranking(entities.join(best, id_col, "left"), r_rank)


def apply_ranking(joined: DataFrame, r_rank: str, only_if_empty: bool = False) -> DataFrame:
    """Column updates from a matched ranking struct ``_r``; rank 0 means unknown."""
    new_rank = F.when(F.col(f"_r.{r_rank}") != 0, F.col(f"_r.{r_rank}"))
    old_rank = F.when(F.col("rank") != 0, F.col("rank"))
    rank = F.coalesce(old_rank, new_rank, F.col("rank")) if only_if_empty else F.coalesce(new_rank, F.col("rank"))
    return (
        joined.withColumn("matched", F.col("_r").isNotNull())
        .withColumn("rank", rank)
        .withColumn("country", fill("country", F.col("_r.country")))
        .withColumn("city", fill("city", F.col("_r.city")))
        .drop("_r")
    )


def fill(col: str, value: Column) -> Column:
    """The column where it has text, else the given value."""
    return F.coalesce(F.when(F.col(col) != "", F.col(col)), value, F.col(col))


# --- by containment ----------------------------------------------------------------------------------


def _grams(text: Column, n: int) -> Column:
    return F.when(
        F.length(text) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.lit(n - 1)),
                                     lambda i: F.substring(text, i, F.lit(n)))),
    )


def containment_pairs(left: DataFrame, right: DataFrame, n: int = 4) -> DataFrame:
    """(l, r) of distinct texts where one contains the other.

    Exact: if B lies inside A, every n-gram of B is a gram of A, so joining the rarest gram of B with the
    grams of A loses nothing. Texts shorter than n are looked up by their own length.
    """
    l, r = left.select("l").distinct(), right.select("r").distinct()

    def inside(small, s, big, b):
        big_grams = big.select(F.col(b), F.explode(_grams(F.col(b), n)).alias("g"))
        freq = big_grams.groupBy("g").agg(F.count("*").alias("f"))
        probes = small.filter(F.length(s) >= n).select(F.col(s), F.explode(_grams(F.col(s), n)).alias("g"))
        # a gram no text has settles it: the left join keeps the gram with no frequency as the rarest
        rare = (
            probes.join(freq, "g", "left").groupBy(s)
            .agg(F.min_by("g", F.struct(F.coalesce("f", F.lit(0)), F.col("g"))).alias("g"))
        )
        long = rare.join(big_grams, "g").filter(F.col(b).contains(F.col(s)))
        short = small.filter((F.length(s) < n) & (F.length(s) > 0)).withColumn("g", F.col(s))
        pieces = F.flatten(F.array(*[F.coalesce(_grams(F.col(b), k), F.array().cast("array<string>"))
                                     for k in range(1, n)]))
        tiny = short.join(big.select(F.col(b), F.explode(pieces).alias("g")), "g")
        return long.select("l", "r").unionByName(tiny.select("l", "r"))

    return inside(l, "l", r, "r").unionByName(inside(r, "r", l, "l")).distinct()


def first_containing(left: DataFrame, right: DataFrame, n: int = 4) -> DataFrame:
    """(l, r): for each text ``l`` that contains a text of ``right`` (r, o) or lies in one, the ``r`` of the smallest ``o``.

    As ``containment_pairs``, but a pair is met as a candidate for the minimum of its ``l`` right after the join of the rarest grams: tasks
    hand on one candidate for each ``l``, so neither pairs nor their repetitions are shuffled.
    """
    l, r = left.select("l").distinct(), right.groupBy("r").agg(F.min("o").alias("o"))

    def inside(small, s, big, b):
        others = [c for c in ("o",) if c in big.columns]
        big_grams = big.select(b, *others, F.explode(_grams(F.col(b), n)).alias("g"))
        freq = big_grams.groupBy("g").agg(F.count("*").alias("f"))
        probes = small.filter(F.length(s) >= n).select(*small.columns, F.explode(_grams(F.col(s), n)).alias("g"))
        rare = probes.join(freq, "g", "left").groupBy(*small.columns).agg(F.min_by("g", F.struct(F.coalesce("f", F.lit(0)), F.col("g"))).alias("g"))
        short = small.filter((F.length(s) < n) & (F.length(s) > 0)).withColumn("g", F.col(s))
        pieces = F.flatten(F.array(*[F.coalesce(_grams(F.col(b), k), F.array().cast("array<string>")) for k in range(1, n)]))
        met = rare.join(big_grams, "g").filter(F.col(b).contains(F.col(s))).select("l", "r", "o")
        tiny = short.join(big.select(b, *others, F.explode(F.array_distinct(pieces)).alias("g")), "g").select("l", "r", "o")
        best = F.min(F.struct("o", "r")).alias("b")
        return met.groupBy("l").agg(best).unionByName(tiny.groupBy("l").agg(best))

    both = inside(l, "l", r, "r").unionByName(inside(r, "r", l, "l"))
    return both.groupBy("l").agg(F.min("b").alias("b")).select("l", "b.r")


def match_by_containment(entities: DataFrame, rankings: DataFrame, name: str, r_name: str, r_order: str) -> DataFrame:
    """Entities with ``_r``: the first ranking row, in list order, whose normalised name contains the
    entity's name or is contained in it; null where there is none. Empty names never match."""
    e = entities.withColumn("_key", C.match_key(name))
    first = one_per_name(rankings, r_name, r_order, "first")
    best = first_containing(
        e.filter(F.col("_key") != "").select(F.col("_key").alias("l")), first.select(F.col("_key").alias("r"), F.col(f"_r.{r_order}").alias("o"))
    ).join(first.withColumnRenamed("_key", "r"), "r").select("l", "_r")
    return e.join(best, e["_key"] == best["l"], "left").drop("_key", "l")


def fill_from_ranking(entities: DataFrame, rankings: DataFrame, name: str, r_name: str, r_order: str,
                      r_rank: str) -> DataFrame:
    return apply_ranking(match_by_containment(entities, rankings, name, r_name, r_order), r_rank, only_if_empty=True)


# --- reference tables ---------------------------------------------------------------------------------------


def alias_join(df: DataFrame, aliases: DataFrame, col: str, alias: str, target: str) -> DataFrame:
    """Rename through a mapping table; names without an entry stay. Of a repeated alias the smallest target counts."""
    m = aliases.groupBy(F.col(alias).alias("_a")).agg(F.min(target).alias("_t"))
    return df.join(m, df[col] == m["_a"], "left").withColumn(col, F.coalesce("_t", col)).drop("_a", "_t")


def fill_from_reference(df: DataFrame, reference: DataFrame, key: str, ref_key: str, texts, numbers) -> DataFrame:
    """Fill empty text and missing or zero numbers from a reference table; of rows that repeat a key the smallest counts."""
    cols = [*texts, *numbers]
    m = reference.groupBy(F.col(ref_key).alias("_k")).agg(F.min(F.struct(*[F.col(c).alias(f"_m_{c}") for c in cols])).alias("_m")).select("_k", "_m.*")
    out = df.join(m, df[key] == m["_k"], "left")
    for c in texts:
        out = out.withColumn(c, fill(c, F.col(f"_m_{c}")))
    for c in numbers:
        out = out.withColumn(c, F.coalesce(F.when(F.col(c) != 0, F.col(c)),
                                           F.when(F.col(f"_m_{c}") != 0, F.col(f"_m_{c}")), F.col(c)))
    return out.drop("_k", *[f"_m_{c}" for c in cols])


def parents_of(offers: DataFrame, name: str, order: str, carry) -> DataFrame:
    """One parent per distinct name: carried columns of its first row and a stable id."""
    return (
        offers.filter(F.col(name).isNotNull()).groupBy(name)
        .agg(F.min_by(F.struct(*carry), F.col(order)).alias("_f"), F.count("*").alias("n_offers"))
        .select(C.entity_id(name).alias("university_id"), name, *[F.col(f"_f.{c}").alias(c) for c in carry], "n_offers")
    )


def attach_parent_ids(offers: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    return offers.join(parents.select(name, "university_id"), name, "left")


def parents_with_children_stats(parents: DataFrame, children: DataFrame, name: str, child_name: str, item: str,
                                text: str, fee: str) -> DataFrame:
    """Children are reduced per (parent, item) first, so neither a large parent nor exact distinct counts
    meet in one task row by row."""
    has_text = F.coalesce(C.strip(text) != "", F.lit(False)).cast("long")
    has_fee = (F.coalesce(F.col(fee), F.lit(0)) != 0).cast("long")
    per_item = children.groupBy(F.col(child_name).alias(name), F.lower(C.strip(item)).alias("_item")).agg(
        F.count("*").alias("n"), F.sum(has_text).alias("t"), F.sum(has_fee).alias("f")
    )
    stats = per_item.groupBy(name).agg(
        F.sum("n").alias("n_offers"),
        (F.sum("t") / F.sum("n")).alias("description_coverage"),
        (F.sum("f") / F.sum("n")).alias("fee_coverage"),
        (F.sum("n") - F.count("*")).alias("duplicates"),
    )
    return parents.join(stats, name, "left").fillna(
        {"n_offers": 0, "description_coverage": 0.0, "fee_coverage": 0.0, "duplicates": 0}
    )


def expected_coverage(expected: DataFrame, df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return expected.join(counts, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.coalesce("n", F.lit(0)) > 0, "OK").otherwise("NO DATA").alias("status"),
    )


def coverage_verdict(covered: DataFrame, passing: float = 70.0) -> DataFrame:
    pct = F.count_if(F.col("status") == "OK") * 100.0 / F.count("*")
    return covered.agg(F.count("*").alias("expected"), F.count_if(F.col("status") == "OK").alias("found"),
                       pct.alias("pct")).withColumn("passed", F.col("pct") >= passing)


def country_defaults(df: DataFrame, country: str, tier: str) -> DataFrame:
    """Tuition, language and living-cost defaults by country; tuition scaled by tier and cut to whole units."""
    c = F.col(country)
    dom = C.lookup(c, {k: v[0] for k, v in fixed.COUNTRY_TUITION.items()}, fixed.DEFAULT_TUITION[0])
    intl = C.lookup(c, {k: v[1] for k, v in fixed.COUNTRY_TUITION.items()}, fixed.DEFAULT_TUITION[1])
    cur = C.lookup(c, {k: v[2] for k, v in fixed.COUNTRY_TUITION.items()}, fixed.DEFAULT_TUITION[2])
    times = C.lookup(tier, fixed.TIER_MULTIPLIER)
    return (
        df.withColumn("tuition_domestic", (dom * times).cast("bigint"))
        .withColumn("tuition_international", (intl * times).cast("bigint"))
        .withColumn("tuition_currency", cur)
        .withColumn("ielts_min", C.lookup(c, fixed.COUNTRY_IELTS, fixed.DEFAULT_IELTS))
        .withColumn("toefl_min", C.lookup(c, fixed.COUNTRY_TOEFL, fixed.DEFAULT_TOEFL))
        .withColumn("cost_of_living", C.lookup(c, fixed.COUNTRY_LIVING_COST, fixed.DEFAULT_LIVING_COST))
    )


def expand_catalog(entities: DataFrame, templates: dict, name: str, rank: str, seed: int = 42) -> DataFrame:
    """Offers of each entity from a rule table {category: [(programme, degree), ...]}.

    Rank up to 200: every category; up to 500: 5 to 7 of them; beyond: 3 to 5, chosen by a seeded hash of
    (entity, category). Programmes per category 3 / 2 / 1 for rank up to 100 / 500 / beyond; doctorates
    only up to rank 300. The whole expansion is array work inside the row: no join, no shuffle.
    """
    rk = F.col(rank)
    cats = F.array(*[
        F.struct(
            F.lit(cat).alias("category"),
            F.array(*[F.struct(F.lit(p).alias("program_name"), F.lit(d).alias("degree")) for p, d in progs if d != "PhD"])
            .alias("taught"),
            (F.array(*[F.struct(F.lit(p).alias("program_name"), F.lit(d).alias("degree")) for p, d in progs if d == "PhD"])
             .cast("array<struct<program_name:string,degree:string>>")).alias("doctoral"),
        )
        for cat, progs in templates.items()
    ])
    spread = F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(3)).cast("int")
    n_cats = F.when(rk > 500, spread + 3).when(rk > 200, spread + 5).otherwise(F.lit(len(templates)))
    chosen = F.slice(
        F.array_sort(F.transform(cats, lambda c: F.struct(
            F.when(rk > 200, F.xxhash64(F.col(name), c["category"], F.lit(seed))).otherwise(F.lit(0)).alias("h"),
            c.alias("c")))),
        1, n_cats)
    per = F.when(rk <= 100, 3).when(rk <= 500, 2).otherwise(1)
    offers = F.flatten(F.transform(chosen, lambda s: F.transform(
        F.concat(F.slice(s["c"]["taught"], F.lit(1), per),
                 F.when(rk <= 300, s["c"]["doctoral"]).otherwise(F.slice(s["c"]["doctoral"], 1, 0))),
        lambda p: F.struct(s["c"]["category"].alias("category"), p["program_name"].alias("program_name"),
                           p["degree"].alias("degree")))))
    return entities.withColumn("_o", F.explode(offers)).select(*entities.columns, "_o.*")


# --- links and changes ----------------------------------------------------------------------------------------


def backfill_from_discovery(offers: DataFrame, links: DataFrame, url: str, link_url: str, order: str | None = None) -> DataFrame:
    """Take the link's category where ours is empty or 'Other', its level where ours is empty or 'Masters'.

    Of several links of one address the first by ``order`` counts; without an order, the one with the smallest values.
    """
    told = F.struct(F.col("category").alias("_cat"), F.col("degree_level").alias("_lvl"))
    one = (F.min(told) if order is None else F.min_by(told, F.struct(F.col(order), told))).alias("_l")
    l = links.groupBy(F.col(link_url).alias("_u")).agg(one).select("_u", "_l.*")
    weak_cat = F.coalesce(F.col("category"), F.lit("")).isin("", "Other") & F.col("_cat").isNotNull()
    weak_lvl = F.coalesce(F.col("degree_level"), F.lit("")).isin("", "Masters") & F.col("_lvl").isNotNull()
    return (
        offers.join(l, offers[url] == l["_u"], "left")
        .withColumn("category", F.when(weak_cat, F.col("_cat")).otherwise(F.col("category")))
        .withColumn("degree_level", F.when(weak_lvl, F.col("_lvl")).otherwise(F.col("degree_level")))
        .drop("_u", "_cat", "_lvl")
    )


def new_only(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return batch.join(known.select(key), key, "left_anti").dropDuplicates([key])


def diff_tables(before: DataFrame, after: DataFrame, key: str, cols) -> DataFrame:
    """Keys present in both, with the list of columns that differ."""
    b = before.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols])
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in cols]))
    return after.select(key, *cols).join(b, key).select(key, changed.alias("changed"))


def diff_totals(diff: DataFrame, cols) -> DataFrame:
    return diff.agg(
        F.count_if(F.size("changed") > 0).alias("updated"),
        F.count_if(F.size("changed") == 0).alias("unchanged"),
        *[F.count_if(F.array_contains("changed", c)).alias(f"updated_{c}") for c in cols],
    )
