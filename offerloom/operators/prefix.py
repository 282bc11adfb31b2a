"""Ordered computations over groups of any size: running totals, ranks, exact quantiles.

A window without bound would pull a whole group into one task. Here a group that is too large for
one task is split into value bands (cut points from a sketch, a few KB), each band is ordered on its
own and shifted by the total of the bands before it. Cut points only decide where work is split; the
result does not depend on them. Small groups take one plain window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from offerloom.session import materialise

HOT_ROWS = 2_000_000


def _fold(group):
    """Null-safe group key columns for joins."""
    return [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")).alias(f"_k{i}") for i, g in enumerate(group)]


def _hot_bounds(df: DataFrame, group, order: str, hot_rows: int):
    """Cut points for the groups that exceed ``hot_rows``: four for every ``hot_rows`` rows of a group, in two levels.

    There are at most rows / hot_rows such groups and eight times as many cut points: 32 MB for 10^12 rows.
    """
    keyed = df.select(*_fold(group), F.col(order).cast("double").alias("_o"))
    ks = [f"_k{i}" for i in range(len(group))]
    rows = keyed.groupBy(*ks).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).collect()
    if not rows:
        return None
    spark = df.sparkSession
    schema = T.StructType([T.StructField(k, T.StringType()) for k in ks])
    if ks:
        keys = spark.createDataFrame([tuple(r[k] for k in ks) for r in rows], schema)
        keyed = keyed.join(F.broadcast(keys), ks)
    most = max(4 * -(-r["_n"] // hot_rows) for r in rows)
    probs = [i / most for i in range(1, most)]
    sketch = keyed.groupBy(*ks).agg(F.count("*").alias("_n"), F.percentile_approx("_o", probs, max(10_000, 10 * most)).alias("_c"))
    own = F.lit(4) * F.ceil(F.col("_n") / F.lit(hot_rows))
    cuts = F.transform(F.sequence(F.lit(1).cast("long"), own - 1), lambda i: F.get(F.col("_c"), (F.floor(i * F.lit(most) / own) - 1).cast("int")))
    out = []
    for r in sketch.select(*ks, F.sort_array(cuts).alias("c")).collect():
        c = [x for x in r["c"] if x is not None]
        f = math.isqrt(len(c)) + 1
        coarse = c[f - 1:: f]
        out.append(tuple(r[k] for k in ks) + (coarse, [c[i * f: i * f + f - 1] for i in range(len(coarse) + 1)]))
    schema = schema.add("_coarse", T.ArrayType(T.DoubleType())).add(
        "_fine", T.ArrayType(T.ArrayType(T.DoubleType()))
    )
    return spark.createDataFrame(out, schema), ks


def _band_of(x: Column) -> Column:
    """Odd bands hold one value, a cut point; even ones what lies between two of them."""
    i = F.size(F.filter(F.col("_coarse"), lambda c: c < x))
    j = F.size(F.filter(F.get(F.col("_fine"), i), lambda c: c < x))
    cut = F.coalesce(F.get(F.get(F.col("_fine"), i), j), F.get(F.col("_coarse"), i))
    at = i * (F.size(F.get(F.col("_fine"), F.lit(0))) + 1) + j
    return F.coalesce(F.lit(2) * at + F.coalesce((cut == x).cast("int"), F.lit(0)), F.lit(0))


def with_band(df: DataFrame, group, order: str, band: str, hot_rows: int = HOT_ROWS):
    """(df with a band number that grows with ``order``, whether any group was split)."""
    found = _hot_bounds(df, group, order, hot_rows)
    if found is None:
        return df.withColumn(band, F.lit(0)), False
    bounds, ks = found
    keyed = df.select("*", *_fold(group))
    if ks:
        joined = keyed.join(F.broadcast(bounds), ks, "left")  # bounded, see _hot_bounds
    else:
        joined = keyed.withColumn("_coarse", bounds.select("_coarse").scalar()).withColumn(
            "_fine", bounds.select("_fine").scalar())
    banded = joined.withColumn(band, _band_of(F.col(order).cast("double")))
    return banded.drop("_coarse", "_fine", *ks), True


def running_totals(hist: DataFrame, group, order: str, sums, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inclusive running sums and group totals over distinct ``order`` values.

    ``hist`` has one row per (group, order). Adds ``cum_<s>`` and ``total_<s>`` for each s.
    """
    group = list(group)
    hist = materialise(hist, "histogram")  # read by the size check, the banding and the windows
    banded, split = with_band(hist, group, order, "_band", hot_rows)
    if not split:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        t = Window.partitionBy(*group)
        return hist.select(
            "*",
            *[F.sum(s).over(w).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(t).alias(f"total_{s}") for s in sums],
        )
    banded = materialise(banded)
    per_band = banded.groupBy(*group, "_band").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = per_band.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_band").alias("_gb"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    cond = F.col("_band") == F.col("_gb")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*group, "_band").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = banded.join(offsets, cond)
    out = joined.select(
        *hist.columns,
        *[(F.sum(s).over(w) + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )
    return out


def _sorted_by(df: DataFrame, order):
    """(df with helper columns, helpers that cut bands, window order). Descending columns have their nulls last, ascending ones first; of a text
    the first twelve bytes cut bands, and no later column does."""
    kinds, names, sort, text = dict(df.dtypes), [], [], False
    for i, (c, desc) in enumerate(order):
        if kinds[c] == "string":
            sort.append(F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first())
            for j in range(0 if text else 2):
                part = F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 6 * j + 1, 6)), 12, "0")
                number = F.conv(part, 16, 10).cast("double")
                df = df.withColumn(f"_o{i}_{j}", F.coalesce(-number, F.lit(1.0)) if desc else number)
                names.append(f"_o{i}_{j}")
            text = True
            continue
        if desc:
            df = df.withColumn(f"_n{i}", F.col(c).isNull().cast("int"))
            sort.append(F.col(f"_n{i}"))
        df = df.withColumn(f"_o{i}", -F.col(c) if desc else F.col(c))
        sort.append(F.col(f"_o{i}"))
        if not text:
            names += [f"_n{i}"] * desc + [f"_o{i}"]
    return df, names, sort


def row_numbers(df: DataFrame, group, order, out: str = "row_number", hot_rows: int = HOT_ROWS, reread: bool = False) -> DataFrame:
    """Row number within each group, ordered by ``order`` = [(column, descending)], numbers or texts; nulls come last in descending
    columns and first in ascending ones.

    A group too large for one task is cut by the first order column; where one value of it is still
    too large, by the next one. Bands of several values are never cut by a later column.

    ``reread``: the frame gives the same rows whenever it is read, so it is read again instead of written, and columns that
    nobody asks for are not moved.
    """
    group = list(group)
    signed, names, sort = _sorted_by(df, order)
    bands, work, any_split = [], signed, False
    for i, name in enumerate(names):
        by = F.when(F.col(bands[-1]) % 2 == 1, F.col(name)) if bands else F.col(name)
        work, split = with_band(work.withColumn("_by", by), group + bands, "_by", f"_b{i}", hot_rows)
        work = work.drop("_by")
        if not split:
            work = work.drop(f"_b{i}")
            break
        any_split = True
        work = work if reread else materialise(work)
        bands.append(f"_b{i}")
    w = Window.partitionBy(*group, *bands).orderBy(*sort)
    if not any_split:
        return work.withColumn(out, F.row_number().over(w)).select(*df.columns, out)
    sizes = work.groupBy(*group, *bands).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(*bands).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_s_{c}") for c in group + bands],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    offsets = offsets.filter("_off > 0")  # groups that were cut, a row per band: bounded, see _hot_bounds
    cond = F.lit(True)
    for c in group + bands:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    number = F.row_number().over(w) + F.coalesce("_off", F.lit(0))
    return work.join(F.broadcast(offsets), cond, "left").withColumn(out, number.cast("int")).select(*df.columns, out)


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is there: neither null nor NaN."""
    there = F.col(value).isNotNull()
    return df.filter(there & ~F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else there)


def value_counts(df: DataFrame, group, value: str, extra=()) -> DataFrame:
    """One row per (group, value) with ``cnt``; partial sums run before the shuffle. Nulls and NaN are left out."""
    return present(df, value).groupBy(*group, value).agg(F.count("*").alias("cnt"), *extra)


def average_ranks(df: DataFrame, group, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, value, cnt, avg_rank): rank of each distinct value, ties averaged."""
    cum = running_totals(value_counts(df, group, value), group, value, ["cnt"], hot_rows)
    return cum.select(
        *group, value, "cnt", (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + F.lit(1)) / 2).alias("avg_rank")
    )


def bands_of(df: DataFrame, group, value: str, probs, accuracy: int = 10_000) -> DataFrame:
    """One row per group: ``_n`` rows, ``_min``, ``_max`` and ``_bands``, the closed intervals that hold the wanted ranks.

    A sketch of ``accuracy`` errs by less than rows / accuracy ranks, so two such steps to both sides hold a rank and its neighbours;
    groups of fewer than two rows a step are one band.
    """
    step = 2.0 / accuracy
    ends = [x for p in probs for x in (max(0.0, p - step), min(1.0, p + step))]
    v = F.col(value).cast("double")
    told = present(df, value).groupBy(*group).agg(
        F.count("*").alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, ends, accuracy).alias("_c"))
    pairs = F.array(*[F.struct(F.col("_c")[2 * i].alias("a"), F.col("_c")[2 * i + 1].alias("b")) for i in range(len(probs))])
    small = F.col("_n") < 2 * accuracy
    whole = F.array(F.struct(F.col("_min").alias("a"), F.col("_max").alias("b")))
    return materialise(told.select(*group, "_n", "_min", "_max", F.when(small, whole).otherwise(pairs).alias("_bands")), "bands")


def with_group_row(df: DataFrame, told: DataFrame, group, columns) -> DataFrame:
    """``df`` with ``columns`` of its group's one row in ``told``; null group keys match."""
    ks = [f"_k{i}" for i in range(len(group))]
    out = df.select("*", *_fold(group)).join(told.select(*_fold(group), *columns), ks) if group else df.crossJoin(F.broadcast(told.select(*columns)))
    return out.drop(*ks)


def quantiles(df: DataFrame, group, value: str, probs, hot_rows: int = HOT_ROWS, accuracy: int = 10_000) -> DataFrame:
    """Exact, linearly interpolated quantiles: (group, prob, quantile), one row per probability.

    Selection in two scans: a sketch says between which values the wanted ranks lie, then values inside these narrow bands are counted one
    by one and all between two bands together. Only values of the bands are shuffled and ordered.
    """
    told = bands_of(df, group, value, probs, accuracy)
    placed = with_group_row(present(df, value).select(*group, F.col(value).cast("double").alias("_v")), told, group, ["_bands"])
    inside = F.exists("_bands", lambda x: (x["a"] <= F.col("_v")) & (F.col("_v") <= x["b"]))
    placed = placed.select(*group, "_v", F.when(inside, F.col("_v")).alias("_own"), F.size(F.filter("_bands", lambda x: x["b"] < F.col("_v"))).alias("_seg"))
    hist = placed.groupBy(*group, "_own", F.when(F.col("_own").isNull(), F.col("_seg")).alias("_seg")).agg(F.count("*").alias("cnt"), F.min("_v").alias("_at"))
    cum = running_totals(hist.select(*group, F.col("_at").alias(value), "cnt"), group, value, ["cnt"], hot_rows)
    return quantiles_of(cum, group, value, probs)


def quantiles_of(cum: DataFrame, group, value: str, probs) -> DataFrame:
    """Quantiles read off a histogram with running totals."""
    want = F.array(*[F.lit(float(p)) for p in probs])
    pos = F.transform(want, lambda p: F.struct(p.alias("p"), (p * (F.col("total_cnt") - F.lit(1))).alias("at")))
    lo_at, hi_at = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt")
    here = F.filter(
        pos,
        lambda s: ((F.floor(s["at"]) >= lo_at) & (F.floor(s["at"]) < hi_at))
        | ((F.ceil(s["at"]) >= lo_at) & (F.ceil(s["at"]) < hi_at)),
    )
    hit = cum.filter(F.size(here) > 0).select(*group, F.col(value).cast("double").alias("_v"), lo_at.alias("_lo"),
                                              hi_at.alias("_hi"), F.explode(here).alias("_s"))
    at = F.col("_s.at")
    low = F.when((F.floor(at) >= F.col("_lo")) & (F.floor(at) < F.col("_hi")), F.col("_v"))
    high = F.when((F.ceil(at) >= F.col("_lo")) & (F.ceil(at) < F.col("_hi")), F.col("_v"))
    return (
        hit.groupBy(*group, F.col("_s.p").alias("prob"))
        .agg(F.max(low).alias("_l"), F.max(high).alias("_h"), F.max(at).alias("_at"))
        .select(*group, "prob",
                (F.col("_l") + (F.col("_h") - F.col("_l")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))
    )


def unpivot(df: DataFrame, cols, id_cols=(), name: str = "feature", value: str = "value", kind: str = "double") -> DataFrame:
    """Columns to (name, value) rows in one scan."""
    return df.select(*id_cols, *[F.col(c).cast(kind).alias(c) for c in cols]).unpivot(
        list(id_cols), list(cols), name, value
    )
