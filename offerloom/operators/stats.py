"""Aggregations: statistics, profiles, coverage, fairness-neutral summaries and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.functions import columns as C
from offerloom.operators import prefix



def n_distinct(df: DataFrame, *cols: str) -> DataFrame:
    """Exact distinct count as a one-row frame; distinct first, so no task holds the set."""
    return df.select(*cols).distinct().agg(F.count("*").alias("n"))


def counts_by(df: DataFrame, cols, metric: str = "n", unknown: str | None = None) -> DataFrame:
    """Long form (dimension, value, n): one scan for all dimensions."""
    long = prefix.unpivot(df, cols, name="dimension", value="value", kind="string")
    if unknown is not None:
        long = long.withColumn("value", F.coalesce("value", F.lit(unknown)))
    return long.groupBy("dimension", "value").agg(F.count("*").alias(metric))


def offer_statistics(df: DataFrame, completeness="data_completeness", confidence="confidence_score",
                     tuition="tuition") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.avg(completeness).alias("avg_completeness"),
        F.avg(confidence).alias("avg_confidence"), F.min(tuition).alias("min_tuition"),
        F.max(tuition).alias("max_tuition"), F.avg(tuition).alias("avg_tuition"),
    )


def entity_statistics(df: DataFrame, rank="rank", students="students", endowment="endowment") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.avg(rank).alias("avg_rank"), F.min(rank).alias("best_rank"),
        F.max(rank).alias("worst_rank"), F.avg(students).alias("avg_students"), F.sum(endowment).alias("sum_endowment"),
    )


def entity_rollup(df: DataFrame, keys, kind: str, updated: str) -> DataFrame:
    """Offers grouped by entity: count, distinct kinds, latest update. Kinds are reduced before they meet."""
    per_kind = df.groupBy(*keys, kind).agg(F.count("*").alias("n"), F.max(updated).alias("u"))
    return per_kind.groupBy(*keys).agg(
        F.sum("n").alias("n_offers"), F.sort_array(F.collect_list(kind)).alias("kinds"), F.max("u").alias("last_updated")
    )


def search_rollup(df: DataFrame, name: str, country: str, website: str, kind: str, updated: str, query: str | None = None, in_country: str | None = None,
                  of_kind: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of ``entity_rollup`` by name, country and website, over the offers that match: ``query`` is a part of the name in any case, taken literally."""
    some = df
    if in_country:
        some = some.filter(F.col(country) == in_country)
    if of_kind:
        some = some.filter(F.col(kind) == of_kind)
    if query:
        some = some.filter(F.lower(name).contains(query.lower()))
    return entity_rollup(some, [name, country, website], kind, updated).orderBy(name, country, website).offset(offset).limit(limit)


def coverage_totals(df: DataFrame, university: str, country: str) -> DataFrame:
    c = F.coalesce(F.col(country), F.lit("Unknown")).alias("c")
    return df.agg(F.count("*").alias("total_programs")).select(
        "total_programs",
        n_distinct(df.filter(F.col(university).isNotNull()), university).scalar().alias("universities_covered"),
        df.select(c).distinct().agg(F.count("*")).scalar().alias("countries_covered"),
    )


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), col).limit(k)


def freshness(df: DataFrame, ts: str, as_of, days: int = 30) -> DataFrame:
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    fresh = F.count_if(F.col(ts) >= cutoff)
    return df.agg(
        F.count("*").alias("total"), fresh.alias("fresh"), F.count_if(F.col(ts) < cutoff).alias("stale"),
        F.coalesce(F.try_divide(fresh, F.count("*")), F.lit(0.0)).alias("ratio"),
        F.min(ts).alias("oldest"), F.max(ts).alias("newest"),
    )


# --- column profiles --------------------------------------------------------------------------------


def profile_numeric(df: DataFrame, cols, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Per column: mean, population std, min, max, upper median, distinct, zeros, variation class.

    One unpivoted scan gives value counts; everything else is computed from those.
    """
    long = prefix.unpivot(df, cols).filter(F.col("value").isNotNull())
    cum = prefix.running_totals(prefix.value_counts(long, ["feature"], "value"), ["feature"], "value", ["cnt"], hot_rows)
    mid = F.floor(F.col("total_cnt") / 2)
    is_mid = (mid >= F.col("cum_cnt") - F.col("cnt")) & (mid < F.col("cum_cnt"))
    upper = cum.groupBy("feature").agg(
        F.max(F.when(is_mid, F.col("value"))).alias("median"), F.count("*").alias("n_distinct")
    )
    moments = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") == 0).alias("zeros"),
    )
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs("mean") * 100).otherwise(F.lit(0.0))
    return moments.join(upper, "feature").withColumn("cv", cv).withColumn(
        "variation", F.when(F.col("cv") > 50, "HIGH").when(F.col("cv") > 20, "MEDIUM").otherwise("LOW")
    )


def profile_categorical(df: DataFrame, cols, k: int = 5) -> DataFrame:
    """Distinct count and the k most frequent values per column."""
    counts = counts_by(df, cols)
    distinct = counts.filter(F.col("value").isNotNull()).groupBy("dimension").agg(F.count("*").alias("n_distinct"))
    w = Window.partitionBy("dimension").orderBy(F.col("n").desc(), "value")
    top = counts.filter(F.col("value").isNotNull()).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    return top.join(distinct, "dimension")


def profile_lists(df: DataFrame, cols, sep: str = "; ") -> DataFrame:
    """Per text-list column: filled rows and mean number of items."""
    long = prefix.unpivot(df, cols, kind="string").filter(F.coalesce(F.col("value"), F.lit("")) != "")
    return long.groupBy("feature").agg(
        F.count("*").alias("filled"), F.avg(F.size(F.split("value", sep))).alias("mean_items")
    )


def sparsity(df: DataFrame, cols, percent: float = 5.0) -> DataFrame:
    """Columns where more than ``percent`` of the rows are empty or read as zero or None."""
    long = prefix.unpivot(df, cols, kind="string")
    empty = F.col("value").isNull() | F.col("value").isin("", "0", "0.0", "None")
    return long.groupBy("feature").agg((F.avg(empty.cast("int")) * 100).alias("pct_empty")).filter(
        F.col("pct_empty") > percent
    )


def null_profile(df: DataFrame, cols) -> DataFrame:
    """Per column: nulls, percent null, distinct values, smallest value as sample."""
    per_value = prefix.unpivot(df, cols, kind="string").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) * 100.0 / F.sum("n")).alias("pct_null"),
        F.count_if(F.col("value").isNotNull()).alias("n_distinct"), F.min("value").alias("sample"),
    )


def bucket_counts(df: DataFrame, col: str, edges, labels) -> DataFrame:
    """Right-closed buckets with their share of all rows; rows without a value count in the base only."""
    chain = None
    for e, l in zip(edges, labels):
        chain = F.when(F.col(col) <= e, l) if chain is None else chain.when(F.col(col) <= e, l)
    label = F.when(F.col(col).isNotNull(), chain.otherwise(labels[-1]))
    total = df.agg(F.count("*")).scalar()
    return df.filter(F.col(col).isNotNull()).groupBy(label.alias("bucket")).agg(F.count("*").alias("n")).withColumn(
        "pct", F.col("n") * 100.0 / total
    )


def fill_rates(df: DataFrame, cols, ok: float = 90.0, warn: float = 70.0) -> DataFrame:
    long = prefix.unpivot(df, cols, kind="string")
    good = C.filled("value")
    pct = F.avg(good.cast("int")) * 100
    return long.groupBy("feature").agg(F.count_if(good).alias("filled"), pct.alias("pct")).withColumn(
        "status", F.when(F.col("pct") >= ok, "ok").when(F.col("pct") >= warn, "warn").otherwise("fail")
    )


def overall_quality(coverage: DataFrame, df: DataFrame, confidence: str) -> DataFrame:
    """Half from mean field coverage (0 to 100), half from mean confidence (0 to 1): 0 to 100."""
    conf = df.agg(F.avg(confidence)).scalar()
    return coverage.agg(F.avg("pct").alias("coverage")).select(
        "coverage", conf.alias("confidence"), (F.col("coverage") / 100 * 50 + conf * 50).alias("quality")
    )


def duplicates(df: DataFrame, group: str, name: str, allowed: float = 0.05) -> DataFrame:
    per_name = df.groupBy(group, F.lower(C.strip(name)).alias("_n")).agg(F.count("*").alias("n"))
    return per_name.groupBy(group).agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("duplicates")).withColumn(
        "within_limit", F.col("duplicates") / F.col("n_rows") <= allowed
    )


# --- distributions ---------------------------------------------------------------------------------------


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the exact minimum and maximum; the last bin is closed."""
    lo, hi = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)))
    return df.filter(F.col(col).isNotNull()).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def quartiles_by(df: DataFrame, group: str, col: str, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    q = prefix.quantiles(df, [group], col, [0.25, 0.5, 0.75], hot_rows)
    pick = lambda p, n: F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
    return q.groupBy(group).agg(pick(0.25, "q1"), pick(0.5, "median"), pick(0.75, "q3"))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair, long form, from one scan."""
    pairs = [(a, b) for a in cols for b in cols]
    aggs = [F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    row = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).agg(*aggs)
    stacked = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
                        for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(stacked).alias("s")).select("s.*")


# --- run and import summaries ---------------------------------------------------------------------------------


def run_report(results: DataFrame, target: str = "target", scraped: str = "scraped") -> DataFrame:
    """Per entity status: success at half of the target, partial above zero, else failed."""
    s, t = F.col(scraped), F.col(target)
    return results.withColumn("status", F.when((s > 0) & (s >= t * 0.5), "success").when(s > 0, "partial").otherwise("failed"))


def run_totals(report: DataFrame, level: str) -> DataFrame:
    return report.groupBy(level).agg(
        F.count("*").alias("tested"), F.count_if(F.col("status") == "success").alias("success"),
        F.sum("target").alias("links"), F.sum("scraped").alias("scraped"),
        (F.count_if(F.col("status") == "success") * 100.0 / F.count("*")).alias("success_rate"),
    )


def shares(df: DataFrame, col: str) -> DataFrame:
    """Counts of a column with percent of all rows."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / total)


def import_report(rows: DataFrame, outcome: str = "outcome", transformed: str = "transformed", tier: str = "tier", path: str = "path",
                  category: str = "category", k: int = 10) -> DataFrame:
    """(part, value, n, pct) of an import: rows read and transformed, outcomes, tiers and derivation paths, and the ``k`` largest categories.

    One scan; every row is counted once in each part before the shuffle. Outcomes are a percentage of all rows, the other parts of the transformed ones, and
    only transformed rows with a value count there.
    """
    done = F.coalesce(F.col(transformed), F.lit(False))
    part = lambda name, c, cond: F.when(cond & c.isNotNull(), F.struct(F.lit(name).alias("part"), c.cast("string").alias("value")))
    parts = F.array_compact(F.array(
        part("rows", F.lit("total"), F.lit(True)), part("rows", F.lit("transformed"), done), part("outcome", F.col(outcome), F.lit(True)),
        *[part(n, F.col(c), done) for n, c in (("tier", tier), ("path", path), ("category", category))]))
    counts = rows.select(F.explode(parts).alias("p")).groupBy("p.part", "p.value").agg(F.count("*").alias("n"))
    of = lambda v: F.max(F.when((F.col("part") == "rows") & (F.col("value") == v), F.col("n"))).over(Window.partitionBy())  # noqa: E731  a row per value
    told = counts.select("*", of("total").alias("_all"), F.coalesce(of("transformed"), F.lit(0)).alias("_done"), F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "value")).alias("_rn"))
    whole = F.when(F.col("part").isin("rows", "outcome"), F.col("_all")).otherwise(F.greatest("_done", F.lit(1)))
    return told.filter((F.col("part") != "category") | (F.col("_rn") <= k)).select("part", "value", "n", (F.col("n") * 100.0 / whole).alias("pct"))


# --- consolidation --------------------------------------------------------------------------------------------


def consolidate_pages(extracts: DataFrame, key: str, order: str, texts=(), scalars=(), lists=(), maps=()) -> DataFrame:
    """Many partial records per entity to one.

    Texts: the longest (earliest on ties). Scalars: the first that is set. Lists: union of items. Maps:
    later entries win. Lists and maps are reduced per item and per map key before they are gathered, so an
    entity with very many pages still meets in one task only as its distinct items.
    """
    o = F.col(order)
    aggs = [F.max_by(F.col(c), F.when(F.length(c) > 0, F.struct(F.length(c), -o))).alias(c) for c in texts]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in scalars]
    aggs = aggs or [F.count("*").alias("_n")]
    out = extracts.groupBy(key).agg(*aggs)
    for c in lists:
        items = extracts.select(key, F.explode(c).alias("_i")).distinct()
        out = out.join(items.groupBy(key).agg(F.sort_array(F.collect_list("_i")).alias(c)), key, "left")
    for c in maps:
        entries = extracts.select(key, o.alias("_o"), F.explode(c).alias("_k", "_v")).groupBy(key, "_k").agg(
            F.max_by("_v", "_o").alias("_v")
        )
        merged = entries.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(c))
        out = out.join(merged, key, "left")
    return out.drop("_n")


def is_empty(c: str, kind: str) -> Column:
    col = F.col(c)
    if kind == "string":
        return col.isNull() | (col == "")
    return col.isNull() | (col == 0)


def enrich_empty(existing: DataFrame, new: DataFrame, key: str, scalars=(), lists=(), maps=(), stamp: str | None = None,
                 now=None) -> DataFrame:
    """Fill empty scalars, union lists, merge maps (new wins). Only rows that change get the new time. Of several new rows of a
    key the one that is smallest as JSON counts."""
    types = dict(existing.dtypes)
    cols = [*scalars, *lists, *maps]
    row = F.struct(*[F.col(c).alias(f"_n_{c}") for c in cols])
    n = new.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_row")).select(key, "_row.*")
    j = existing.join(n, key, "left")
    fresh, changed = {}, F.lit(False)
    for c in scalars:
        kind = "string" if types[c] == "string" else "number"
        take = is_empty(c, kind) & ~is_empty(f"_n_{c}", kind)
        fresh[c] = F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c))
        changed = changed | take
    for c in lists:
        base = F.coalesce(F.col(c), F.array().cast(types[c]))
        both = F.array_union(base, F.coalesce(F.col(f"_n_{c}"), F.array().cast(types[c])))
        grew = F.size(both) > F.size(F.array_distinct(base))
        fresh[c] = F.when(grew, both).otherwise(F.col(c))
        changed = changed | grew
    for c in maps:
        base = F.coalesce(F.col(c), F.create_map().cast(types[c]))
        add = F.coalesce(F.col(f"_n_{c}"), F.create_map().cast(types[c]))
        kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(add, k))
        fresh[c] = F.when(F.size(add) > 0, F.map_concat(kept, add)).otherwise(F.col(c))
        changed = changed | (F.size(add) > 0)
    if stamp is not None:
        fresh[stamp] = F.when(changed, F.lit(now)).otherwise(F.col(stamp))
    return j.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in existing.columns])
