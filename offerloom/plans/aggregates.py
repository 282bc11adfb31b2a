"""Statistics, profiles, coverage, fairness and consolidation on the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from offerloom.functions import columns as C
from offerloom.operators import fairness, stats as A
from offerloom.plans import catalog as K
from offerloom.registry import query, table


def r(c, n=4):
    return C.round_to(c, n).alias(c)


def rounded(df, n=4):
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[C.round_to(c, n).alias(c) if c in doubles else F.col(c) for c in df.columns])


@query("agg01_offer_statistics", f"""WITH {K.FULL_OFFERS} SELECT count(*) AS total, round(avg(data_completeness), 4) AS avg_completeness, round(avg(confidence_score), 4) AS avg_confidence,
  min(tuition) AS min_tuition, max(tuition) AS max_tuition, round(avg(tuition), 4) AS avg_tuition FROM full_offers""")
def agg01(spark, sf):
    return rounded(A.offer_statistics(K.full_offers(spark, sf)))


@query("agg01_offers_by_dimension", f"""WITH {K.FULL_OFFERS} SELECT 'country' AS dimension, country AS value, count(*) AS n FROM full_offers GROUP BY 2
  UNION ALL SELECT 'degree_type', degree_type, count(*) FROM full_offers GROUP BY 2""")
def agg01b(spark, sf):
    return A.counts_by(K.full_offers(spark, sf), ["country", "degree_type"])


@query("agg02_entity_statistics", """SELECT count(*) AS total, round(avg(c_nationkey), 4) AS avg_rank, min(c_nationkey) AS best_rank, max(c_nationkey) AS worst_rank,
  round(avg(c_custkey), 4) AS avg_students, round(sum(c_acctbal), 2) AS sum_endowment FROM customer""")
def agg02(spark, sf):
    return A.entity_statistics(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "c_acctbal").select(
        "total", r("avg_rank"), "best_rank", "worst_rank", r("avg_students"), r("sum_endowment", 2))


@query("agg02_entities_by_dimension", f"""WITH {K.ENTITIES} SELECT 'country' AS dimension, country AS value, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'tier', tier, count(*) FROM entities GROUP BY 2""")
def agg02b(spark, sf):
    return A.counts_by(K.entities(spark, sf), ["country", "tier"])


@query("agg03_entity_rollup", """SELECT c_nationkey, o_custkey, count(*) AS n_offers, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds,
  strftime(max(o_orderdate), '%Y-%m-%d') AS last_updated FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def agg03(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = A.entity_rollup(j, ["c_nationkey", "o_custkey"], "o_orderstatus", "o_orderdate")
    return d.withColumn("kinds", F.array_join("kinds", ",")).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("agg03_search_rollup", """SELECT s_name AS university_name, 'NATION_' || s_nationkey AS country, 'https://u' || s_suppkey AS website, count(*) AS n_offers, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, strftime(max(l_shipdate), '%Y-%m-%d') AS last_updated
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'N' AND contains(lower(s_name), 'supplier#') GROUP BY ALL ORDER BY 1, 2, 3 LIMIT 5 OFFSET 2""")
def agg03b(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("university_name"), F.concat(F.lit("NATION_"), "s_nationkey").alias("country"), F.concat(F.lit("https://u"), "s_suppkey").alias("website"), "l_returnflag", "l_shipdate")
    d = A.search_rollup(j, "university_name", "country", "website", "l_returnflag", "l_shipdate", query="SUPPLIER#", of_kind="N", limit=5, offset=2)
    return d.withColumn("kinds", F.array_join("kinds", ",")).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("agg04_distinct_values", """SELECT 'p_brand' AS dimension, p_brand AS value FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type FROM part GROUP BY 2""")
def agg04(spark, sf):
    return A.counts_by(table(spark, sf, "part"), ["p_brand", "p_type"]).select("dimension", "value")


@query("agg04_count_and_newest", "SELECT count(*) AS n_rows, strftime(max(o_orderdate), '%Y-%m-%d') AS last_updated FROM orders")
def agg04b(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n_rows"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_updated"))


@query("agg05_coverage", """SELECT count(*) AS total_programs, count(DISTINCT l_suppkey) AS universities_covered, count(DISTINCT coalesce(nullif(l_returnflag, 'R'), 'Unknown')) AS countries_covered FROM lineitem""")
def agg05(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("c", F.nullif("l_returnflag", F.lit("R")))
    return A.coverage_totals(li, "l_suppkey", "c")


@query("agg05_top_universities", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def agg05b(spark, sf):
    return A.top_values(table(spark, sf, "lineitem"), "l_suppkey", 10)


@query("agg05_country_distribution", "SELECT 'flag' AS dimension, coalesce(nullif(l_returnflag, 'R'), 'Unknown') AS value, count(*) AS n FROM lineitem GROUP BY 2")
def agg05c(spark, sf):
    return A.counts_by(table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("flag")), ["flag"], unknown="Unknown")


@query("agg06_freshness", """SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY) AS fresh, count(*) FILTER (ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY) AS stale,
  round(count(*) FILTER (ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY) / count(*)::DOUBLE, 6) AS ratio, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events""")
def agg06(spark, sf):
    d = A.freshness(table(spark, sf, "events"), "ts", dt.datetime(2024, 2, 15), 30)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return d.withColumn("ratio", F.round("ratio", 6)).withColumn("oldest", F.date_format("oldest", fmt)).withColumn("newest", F.date_format("newest", fmt))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg08_profile_numeric", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in _NUM) + """),
  m AS (SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*) FILTER (value = 0) AS zeros, count(DISTINCT value) AS n_distinct,
  list_sort(list(value))[count(*) // 2 + 1] AS median FROM u GROUP BY feature)
  SELECT feature, n, round(mean, 4) AS mean, round(std, 4) AS std, min, max, zeros, n_distinct, median, round(std / abs(mean) * 100, 4) AS cv,
  CASE WHEN std / abs(mean) * 100 > 50 THEN 'HIGH' WHEN std / abs(mean) * 100 > 20 THEN 'MEDIUM' ELSE 'LOW' END AS variation FROM m""")
def agg08(spark, sf):
    d = A.profile_numeric(table(spark, sf, "lineitem"), _NUM)
    return d.select("feature", "n", r("mean"), r("std"), "min", "max", "zeros", "n_distinct", "median", r("cv"), "variation")


@query("agg09_profile_categorical", """WITH u AS (SELECT 'p_brand' AS dimension, p_brand AS value FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_type', p_type FROM part),
  c AS (SELECT dimension, value, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value)::INT AS position, count(*) OVER (PARTITION BY dimension) AS n_distinct FROM c)
  SELECT dimension, value, n, position, n_distinct FROM t WHERE position <= 5""")
def agg09(spark, sf):
    return A.profile_categorical(table(spark, sf, "part"), ["p_brand", "p_name", "p_type"]).select("dimension", "value", "n", "position", "n_distinct")


@query("agg10_profile_lists", """SELECT 'names' AS feature, count(*) AS filled, round(avg(len(string_split(s, '; '))), 6) AS mean_items FROM
  (SELECT CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name || '; ' || p_brand || '; ' || p_type ELSE '' END AS s FROM part) WHERE s <> ''""")
def agg10(spark, sf):
    p = table(spark, sf, "part").selectExpr("CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN concat_ws('; ', p_name, p_brand, p_type) ELSE '' END AS names")
    return A.profile_lists(p, ["names"]).withColumn("mean_items", F.round("mean_items", 6))


@query("agg11_sparsity", """WITH u AS (SELECT 'l_discount' AS feature, l_discount::VARCHAR AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax::VARCHAR FROM lineitem UNION ALL SELECT 'flag', nullif(l_returnflag, 'A') FROM lineitem
  UNION ALL SELECT 'l_quantity', l_quantity::VARCHAR FROM lineitem) SELECT feature, round(avg(CASE WHEN v IS NULL OR v IN ('', '0', '0.0', 'None') THEN 1 ELSE 0 END) * 100, 4) AS pct_empty FROM u GROUP BY 1
  HAVING avg(CASE WHEN v IS NULL OR v IN ('', '0', '0.0', 'None') THEN 1 ELSE 0 END) * 100 > 5""")
def agg11(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    return rounded(A.sparsity(li, ["l_discount", "l_tax", "flag", "l_quantity"]))


@query("agg11_null_profile", """WITH u AS (SELECT 'flag' AS feature, nullif(l_returnflag, 'A') AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem)
  SELECT feature, count(*) FILTER (v IS NULL) AS nulls, round(count(*) FILTER (v IS NULL) * 100 / count(*)::DOUBLE, 4) AS pct_null, count(DISTINCT v) AS n_distinct, min(v) AS sample FROM u GROUP BY 1""")
def agg11b(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("A")))
    return A.null_profile(li, ["flag", "l_linestatus"]).select("feature", "nulls", F.round(F.col("pct_null").cast("double"), 4).alias("pct_null"), "n_distinct", "sample")


_EDGES, _BANDS = [50, 100, 200, 500, 1000], ["1-50", "51-100", "101-200", "201-500", "501-1000", "1001+"]


@query("agg12_bucket_counts", """WITH x AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_partkey + 1 END AS rk FROM lineitem) SELECT CASE WHEN rk <= 50 THEN '1-50' WHEN rk <= 100 THEN '51-100' WHEN rk <= 200 THEN '101-200'
  WHEN rk <= 500 THEN '201-500' WHEN rk <= 1000 THEN '501-1000' ELSE '1001+' END AS bucket, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM x)::DOUBLE, 4) AS pct FROM x WHERE rk IS NOT NULL GROUP BY 1""")
def agg12(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_partkey + 1 END AS rk")
    return A.bucket_counts(li, "rk", _EDGES, _BANDS).select("bucket", "n", F.round(F.col("pct").cast("double"), 4).alias("pct"))


# --- fairness --------------------------------------------------------------------------------------------


@query("agg13_crosstab_normalised", """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT *, round(n / (sum(n) OVER (PARTITION BY l_suppkey))::DOUBLE, 6) AS share FROM c""")
def agg13(spark, sf):
    return rounded(fairness.crosstab_normalised(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag"), 6)


@query("agg13_crosstab_wide", """SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE, 6) AS "A", round(count(*) FILTER (l_returnflag = 'N') / count(*)::DOUBLE, 6) AS "N",
  round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 6) AS "R" FROM lineitem GROUP BY 1""")
def agg13b(spark, sf):
    return rounded(fairness.crosstab_wide(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"]), 6)


_BIAS = """b AS (SELECT l_suppkey, avg(x) AS mean, stddev_samp(x) AS std, count(x) AS n, (avg(x) - (SELECT avg(x) FROM s)) / (SELECT avg(x) FROM s) AS bias FROM s GROUP BY 1 HAVING count(x) >= 10)"""
_S = "s AS (SELECT l_suppkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS x, l_extendedprice AS cost, l_returnflag FROM lineitem)"


def _scores(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_suppkey", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS x", "l_extendedprice AS cost",
                                                   "CASE l_returnflag WHEN 'R' THEN 'top' WHEN 'A' THEN 'good' ELSE 'standard' END AS tier", "l_returnflag", "l_orderkey")


@query("agg14_group_bias", f"WITH {_S}, {_BIAS} SELECT l_suppkey, round(mean, 6) AS mean, round(std, 6) AS std, n, round(bias, 6) AS bias, abs(bias) > 0.01 AS flagged FROM b")
def agg14(spark, sf):
    return rounded(fairness.group_bias(_scores(spark, sf), "l_suppkey", "x", 10, 0.01), 6)


@query("agg15_access_rates", "SELECT b::INT AS budget, round((SELECT avg(CASE WHEN l_extendedprice <= b THEN 1 ELSE 0 END) FROM lineitem), 4) AS rate FROM (VALUES (5000), (10000), (15000), (20000), (30000), (40000), (50000)) t(b)")
def agg15(spark, sf):
    return fairness.access_rates(table(spark, sf, "lineitem"), "l_extendedprice")


_LAB = "x AS (SELECT lang, n_chars >= 1200 AS p, quality = 1 AS y FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("agg16_demographic_parity", f"WITH {_LAB} SELECT lang, round(avg(p::INT), 6) AS positive_rate FROM x GROUP BY 1")
def agg16(spark, sf):
    return rounded(fairness.demographic_parity(_labelled(spark, sf), F.col("n_chars") >= 1200, "lang"), 6)


@query("agg17_equalized_odds", f"""WITH {_LAB} SELECT lang, round(CASE WHEN count(*) FILTER (y) > 0 THEN count(*) FILTER (p AND y) / (count(*) FILTER (y))::DOUBLE ELSE 0 END, 4) AS tpr,
  round(CASE WHEN count(*) FILTER (NOT y) > 0 THEN count(*) FILTER (p AND NOT y) / (count(*) FILTER (NOT y))::DOUBLE ELSE 0 END, 4) AS fpr, count(*) AS n FROM x GROUP BY 1""")
def agg17(spark, sf):
    return fairness.equalized_odds(_labelled(spark, sf), F.col("n_chars") >= 1200, F.col("quality") == 1, "lang")


@query("agg18_fairness_report", f"""WITH {_S}, {_BIAS}, z AS (SELECT l_suppkey FROM s GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') < 1)
  SELECT (SELECT count(*) FROM b) AS n_groups, (SELECT count(*) FROM b WHERE abs(bias) > 0.01) AS n_flagged, round((SELECT max(abs(bias)) FROM b), 6) AS max_abs_bias,
  (SELECT l_suppkey FROM b WHERE abs(bias) > 0.01 ORDER BY round(bias, 9) DESC, l_suppkey DESC LIMIT 1) AS worst_group, (SELECT count(*) FROM z) AS n_without_top,
  (SELECT string_agg(v, ',' ORDER BY b) FROM (SELECT b, b::VARCHAR || '=' || round((SELECT avg(CASE WHEN cost <= b THEN 1 ELSE 0 END) FROM s), 4)::VARCHAR AS v FROM (VALUES (5000), (10000), (15000), (20000), (30000), (40000), (50000)) t(b))) AS access""")
def agg18(spark, sf):
    d = fairness.fairness_report(_scores(spark, sf), "l_suppkey", "x", "tier", "cost", threshold=0.01)
    return d.select("n_groups", "n_flagged", r("max_abs_bias", 6), "worst_group", "n_without_top", "access")


# --- consolidation -------------------------------------------------------------------------------------------


@query("agg19_consolidate_pages", """WITH e AS (SELECT user_id, event_id, event_type || ' ' || value AS txt, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, event_type, (event_id % 5)::VARCHAR AS k FROM events)
  SELECT user_id, (SELECT txt FROM e x WHERE x.user_id = g.user_id ORDER BY length(txt) DESC, event_id LIMIT 1) AS txt, (SELECT v FROM e x WHERE x.user_id = g.user_id AND v IS NOT NULL ORDER BY event_id LIMIT 1) AS v,
  (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM e x WHERE x.user_id = g.user_id) AS kinds,
  (SELECT string_agg(k || '=' || m, ',' ORDER BY k) FROM (SELECT k, max(event_id) AS m FROM e x WHERE x.user_id = g.user_id GROUP BY k)) AS links FROM (SELECT DISTINCT user_id FROM e) g""")
def agg19(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id", "event_id", "concat(event_type, ' ', value) AS txt", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v",
                                              "array(event_type) AS kinds", "map(cast(event_id % 5 AS string), event_id) AS links")
    d = A.consolidate_pages(e, "user_id", "event_id", ["txt"], ["v"], ["kinds"], ["links"])
    entries = F.transform(F.sort_array(F.map_entries("links")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return d.select("user_id", "txt", "v", F.array_join("kinds", ",").alias("kinds"), F.array_join(entries, ",").alias("links"))


@query("agg20_enrich_empty", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN coalesce(m.s, '') ELSE c_mktsegment END AS city,
  CASE WHEN (c_custkey % 4 = 0 OR c_nationkey = 0) THEN coalesce(m.n, 0) ELSE c_nationkey END AS students,
  CASE WHEN m.s IS NULL THEN 'A' ELSE 'A,' || m.s END AS tags,
  CASE WHEN (c_custkey % 3 = 0 AND m.s IS NOT NULL) OR m.s IS NOT NULL THEN 'new' ELSE 'old' END AS stamp
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus || '-x') AS s, (max(o_orderkey) % 3)::INT AS n FROM orders GROUP BY 1) m ON o_custkey = c_custkey""")
def agg20(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS city0", "c_mktsegment", "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_nationkey END AS students",
        "array('A') AS tags", "'old' AS stamp").withColumnRenamed("city0", "city")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.concat("o_orderstatus", F.lit("-x"))).alias("city"), (F.max("o_orderkey") % 3).cast("int").alias("students"))
    d = A.enrich_empty(c, o.withColumn("tags", F.array("city")), "c_custkey", ["city", "students"], ["tags"], [], "stamp", "new")
    return d.select("c_custkey", "city", "students", F.array_join("tags", ",").alias("tags"), "stamp")


# --- reports ----------------------------------------------------------------------------------------------------


@query("agg21_run_report", """WITH x AS (SELECT c_mktsegment AS level, c_custkey, count(o_orderkey) AS target, count(o_orderkey) FILTER (o_orderstatus = 'F') AS scraped FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  y AS (SELECT *, CASE WHEN scraped > 0 AND scraped >= target * 0.5 THEN 'success' WHEN scraped > 0 THEN 'partial' ELSE 'failed' END AS status FROM x)
  SELECT level, count(*) AS tested, count(*) FILTER (status = 'success') AS success, sum(target)::BIGINT AS links, sum(scraped)::BIGINT AS scraped, round(count(*) FILTER (status = 'success') * 100 / count(*)::DOUBLE, 4) AS success_rate FROM y GROUP BY 1""")
def agg21(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    x = j.groupBy(F.col("c_mktsegment").alias("level"), "c_custkey").agg(F.count("o_orderkey").alias("target"), F.count_if(F.col("o_orderstatus") == "F").alias("scraped"))
    d = A.run_totals(A.run_report(x), "level")
    return d.withColumn("success_rate", F.round(F.col("success_rate").cast("double"), 4))


_FILL = "u AS (SELECT 'a' AS feature, nullif(l_returnflag, 'R') AS v FROM lineitem UNION ALL SELECT 'b', CASE WHEN l_linenumber = 7 THEN '  ' ELSE l_linestatus END FROM lineitem UNION ALL SELECT 'c', l_shipdate::VARCHAR FROM lineitem)"


def _fill_input(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("nullif(l_returnflag, 'R') AS a", "CASE WHEN l_linenumber = 7 THEN '  ' ELSE l_linestatus END AS b", "cast(l_shipdate AS string) AS c", "l_discount * 10 AS conf")


@query("agg22_fill_rates", f"""WITH {_FILL}, p AS (SELECT feature, count(*) FILTER (trim(v) <> '') AS filled, count(*) FILTER (trim(v) <> '') * 100 / count(*)::DOUBLE AS pct FROM u GROUP BY 1)
  SELECT feature, filled, round(pct, 4) AS pct, CASE WHEN pct >= 90 THEN 'ok' WHEN pct >= 70 THEN 'warn' ELSE 'fail' END AS status FROM p""")
def agg22(spark, sf):
    return rounded(A.fill_rates(_fill_input(spark, sf), ["a", "b", "c"]))


@query("agg22_overall_quality", f"""WITH {_FILL}, p AS (SELECT feature, count(*) FILTER (trim(v) <> '') * 100 / count(*)::DOUBLE AS pct FROM u GROUP BY 1)
  SELECT round(avg(pct), 4) AS coverage, round((SELECT avg(l_discount * 10) FROM lineitem), 4) AS confidence, round(avg(pct) / 100 * 50 + (SELECT avg(l_discount * 10) FROM lineitem) * 50, 4) AS quality FROM p""")
def agg22b(spark, sf):
    d = _fill_input(spark, sf)
    return rounded(A.overall_quality(A.fill_rates(d, ["a", "b", "c"]), d, "conf"))


@query("agg23_duplicates", """SELECT p_brand, count(*) AS n_rows, count(*) - count(DISTINCT lower(trim(p_name))) AS duplicates, (count(*) - count(DISTINCT lower(trim(p_name)))) / count(*)::DOUBLE <= 0.05 AS within_limit FROM part GROUP BY 1""")
def agg23(spark, sf):
    return A.duplicates(table(spark, sf, "part"), "p_brand", "p_name")


_COR = ["l_quantity", "l_extendedprice", "l_discount"]


@query("agg25_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _COR for b in _COR))
def agg25(spark, sf):
    return rounded(A.correlation_matrix(table(spark, sf, "lineitem"), _COR), 6)


@query("agg26_histogram", """WITH m AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 40::DOUBLE AS w FROM lineitem)
  SELECT least(floor((l_extendedprice - lo) / w), 39)::BIGINT AS bin, count(*) AS n FROM lineitem, m GROUP BY 1""")
def agg26(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 40)


@query("agg26_quartiles_by", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1""")
def agg26b(spark, sf):
    return rounded(A.quartiles_by(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("agg26_top_values", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 15")
def agg26c(spark, sf):
    return A.top_values(table(spark, sf, "part"), "p_name", 15)


@query("agg27_import_summary", """WITH x AS (SELECT CASE WHEN o_orderkey % 400 = 39 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'updated' ELSE 'inserted' END AS outcome FROM orders)
  SELECT outcome, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM x)::DOUBLE, 4) AS pct FROM x GROUP BY 1""")
def agg27(spark, sf):
    x = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 400 = 39 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'updated' ELSE 'inserted' END AS outcome")
    return A.shares(x, "outcome").select("outcome", "n", F.round(F.col("pct").cast("double"), 4).alias("pct"))


_IMPORT = """x AS (SELECT o_orderkey % 9 <> 0 AS transformed, CASE WHEN o_orderkey % 400 = 39 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'updated' ELSE 'inserted' END AS outcome,
  CASE o_orderkey % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'good' WHEN 2 THEN 'standard' END AS tier, CASE WHEN o_orderkey % 5 = 0 THEN 'regional_fallback' ELSE 'qs_world_primary' END AS path, 'C' || o_custkey % 37 AS category FROM orders)"""


@query("agg27_import_report", f"""WITH {_IMPORT}, d AS (SELECT * FROM x WHERE transformed), n AS (SELECT count(*) AS total, count(*) FILTER (transformed) AS done FROM x),
  c AS (SELECT category, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, category LIMIT 10),
  u AS (SELECT 'rows' AS part, 'total' AS value, total AS n, total AS whole FROM n UNION ALL SELECT 'rows', 'transformed', done, total FROM n UNION ALL SELECT 'outcome', outcome, count(*), any_value(total) FROM x, n GROUP BY outcome
    UNION ALL SELECT 'tier', tier, count(*), any_value(done) FROM d, n WHERE tier IS NOT NULL GROUP BY tier UNION ALL SELECT 'path', path, count(*), any_value(done) FROM d, n GROUP BY path UNION ALL SELECT 'category', category, c.n, done FROM c, n)
  SELECT part, value, n, round(n * 100 / whole::DOUBLE, 4) AS pct FROM u""")
def agg27b(spark, sf):
    x = table(spark, sf, "orders").selectExpr(
        "o_orderkey % 9 <> 0 AS transformed", "CASE WHEN o_orderkey % 400 = 39 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'updated' ELSE 'inserted' END AS outcome",
        "CASE o_orderkey % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'good' WHEN 2 THEN 'standard' END AS tier", "CASE WHEN o_orderkey % 5 = 0 THEN 'regional_fallback' ELSE 'qs_world_primary' END AS path", "concat('C', o_custkey % 37) AS category")
    return A.import_report(x).select("part", "value", "n", F.round(F.col("pct").cast("double"), 4).alias("pct"))
