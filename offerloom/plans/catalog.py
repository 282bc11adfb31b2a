"""The benchmark tables in catalogue terms: offers from part, profiles from customer, entities from supplier.

Each view exists twice, as a DataFrame and as a SQL common table expression, with equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerloom.registry import table


def offers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS offer_id",
        "concat('University of ', p_brand) AS university_name",
        "p_name AS program_name",
        "concat('NATION_', p_size % 25) AS country",
        "CASE p_size % 4 WHEN 0 THEN 'Masters' WHEN 1 THEN 'PhD' WHEN 2 THEN 'Undergraduate' ELSE 'Graduate' END AS degree_level",
        "p_type AS program_category",
        "round(1 + (p_size % 31) / 10D, 1) AS gpa_min",
        "5 + (p_size % 8) * 0.5D AS ielts_min",
        "cast(60 + p_size AS double) AS toefl_min",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE round(p_retailprice * 10D - 8500 + p_size * 100, 2) END AS tuition",
        "(p_partkey % 7) / 10D AS p_top",
        "(p_partkey % 3) / 10D AS p_good",
        "1D - (p_partkey % 7) / 10D - (p_partkey % 3) / 10D AS p_standard",
    )


OFFERS = """offers AS (SELECT p_partkey AS offer_id, 'University of ' || p_brand AS university_name, p_name AS program_name,
  'NATION_' || (p_size % 25) AS country,
  CASE p_size % 4 WHEN 0 THEN 'Masters' WHEN 1 THEN 'PhD' WHEN 2 THEN 'Undergraduate' ELSE 'Graduate' END AS degree_level,
  p_type AS program_category, round(1 + (p_size % 31) / 10::DOUBLE, 1) AS gpa_min,
  5 + (p_size % 8) * 0.5::DOUBLE AS ielts_min, (60 + p_size)::DOUBLE AS toefl_min,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE round(p_retailprice * 10::DOUBLE - 8500 + p_size * 100, 2) END AS tuition,
  (p_partkey % 7) / 10::DOUBLE AS p_top, (p_partkey % 3) / 10::DOUBLE AS p_good,
  1::DOUBLE - (p_partkey % 7) / 10::DOUBLE - (p_partkey % 3) / 10::DOUBLE AS p_standard FROM part)"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS profile_id",
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(2 + (c_custkey % 21) / 10D, 1) END AS gpa",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 5.5D + (c_custkey % 7) * 0.5D END AS ielts",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast(70 + c_custkey % 50 AS double) END AS toefl",
        "c_acctbal AS budget",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('NATION_', c_nationkey) END AS country",
        "CASE c_custkey % 5 WHEN 0 THEN 'Masters' WHEN 1 THEN 'PhD' END AS degree_level",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'LARGE' WHEN 'BUILDING' THEN 'STANDARD' WHEN 'AUTOMOBILE' THEN 'PROMO' END AS program_category",
    )


PROFILES = """profiles AS (SELECT c_custkey AS profile_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(2 + (c_custkey % 21) / 10::DOUBLE, 1) END AS gpa,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 5.5::DOUBLE + (c_custkey % 7) * 0.5::DOUBLE END AS ielts,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (70 + c_custkey % 50)::DOUBLE END AS toefl, c_acctbal AS budget,
  CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey END AS country,
  CASE c_custkey % 5 WHEN 0 THEN 'Masters' WHEN 1 THEN 'PhD' END AS degree_level,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'LARGE' WHEN 'BUILDING' THEN 'STANDARD' WHEN 'AUTOMOBILE' THEN 'PROMO' END AS program_category
  FROM customer)"""

SCORED = """scored AS (SELECT *, round(least(greatest(p_top * 1.0::DOUBLE + p_good * 0.6::DOUBLE + p_standard * 0.2::DOUBLE, 0), 1), 4) AS match_score FROM offers)"""


def scored_offers(spark: SparkSession, sf: str) -> DataFrame:
    from offerloom.functions import columns as C

    probs = F.array("p_top", "p_good", "p_standard")
    return offers(spark, sf).withColumn("match_score", F.round(C.match_score(probs, ["top", "good", "standard"]), 4))


ELIGIBLE = """(p.gpa IS NULL OR p.gpa = 0 OR o.gpa_min <= p.gpa) AND (p.ielts IS NULL OR p.ielts = 0 OR o.ielts_min <= p.ielts)
  AND (p.toefl IS NULL OR p.toefl = 0 OR o.toefl_min <= p.toefl) AND (p.budget IS NULL OR p.budget = 0 OR o.tuition <= p.budget)
  AND (p.country IS NULL OR o.country = p.country) AND (p.degree_level IS NULL OR o.degree_level = p.degree_level)
  AND (p.program_category IS NULL OR o.program_category = p.program_category)"""


def full_offers(spark: SparkSession, sf: str) -> DataFrame:
    """One offer per line item with its part, order and text-like fields: the wide offer table."""
    li, pa, od = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "orders")
    j = li.join(pa, F.col("l_partkey") == F.col("p_partkey")).join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.selectExpr(
        "concat('http://catalog.example.edu/', l_orderkey, '/', l_linenumber) AS source_url",
        "p_brand AS university_name", "p_name AS program_name", "p_type AS degree_type",
        "concat('NATION_', l_suppkey % 25) AS country", "l_quantity / 12.5D AS gpa_requirement_min", "l_extendedprice AS tuition",
        "CASE WHEN l_tax > 0 THEN l_tax * 10 END AS data_completeness", "l_discount * 10 AS confidence_score", "l_shipdate AS last_updated",
    )


FULL_OFFERS = """full_offers AS (SELECT 'http://catalog.example.edu/' || l_orderkey || '/' || l_linenumber AS source_url,
  p_brand AS university_name, p_name AS program_name, p_type AS degree_type, 'NATION_' || (l_suppkey % 25) AS country,
  l_quantity / 12.5::DOUBLE AS gpa_requirement_min, l_extendedprice AS tuition,
  CASE WHEN l_tax > 0 THEN l_tax * 10 END AS data_completeness, l_discount * 10 AS confidence_score, l_shipdate AS last_updated
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as universities with a revenue rank within their nation."""
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS entity_id", "concat('University of ', s_name) AS name", "concat('NATION_', s_nationkey) AS country",
        "CASE s_suppkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'good' ELSE 'standard' END AS tier",
        "CASE s_suppkey % 2 WHEN 0 THEN 'public' ELSE 'private' END AS type",
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE cast(s_acctbal AS int) END AS rank",
        "array(concat('U', s_suppkey), concat(s_name, ' College')) AS aliases",
    )


ENTITIES = """entities AS (SELECT s_suppkey AS entity_id, 'University of ' || s_name AS name, 'NATION_' || s_nationkey AS country,
  CASE s_suppkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'good' ELSE 'standard' END AS tier,
  CASE s_suppkey % 2 WHEN 0 THEN 'public' ELSE 'private' END AS type,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE trunc(s_acctbal)::INT END AS rank,
  ['U' || s_suppkey, s_name || ' College'] AS aliases FROM supplier)"""
