"""Column standardisation, typing and cleaning on the benchmark tables.

Raw texts are derived from row values, so every rule meets as many rows as the table has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import columns as C, fixed
from offerloom.operators import standardise as Z, tiers
from offerloom.registry import query, table


def chain_sql(expr, rules, default):
    """CASE over ordered (label, words) rules with literal containment."""
    parts = " ".join("WHEN " + " OR ".join(f"contains({expr}, '{w.lower()}')" for w in words) + f" THEN '{label}'" for label, words in rules)
    return f"CASE {parts} ELSE {default} END"


# --- ranks, durations, fees -----------------------------------------------------------------------

_RANKS = """x AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 7 WHEN 0 THEN '#' || l_partkey WHEN 1 THEN ' =' || l_partkey WHEN 2 THEN l_partkey || '-' || (l_partkey + 49) WHEN 3 THEN l_partkey || '+' WHEN 4 THEN NULL WHEN 5 THEN 'abc' ELSE l_partkey || '–' || (l_partkey + 10) END AS d,
  CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey::INT WHEN l_suppkey % 4 = 1 THEN 0 END AS rank FROM lineitem)"""


def _ranks(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", """CASE l_partkey % 7 WHEN 0 THEN concat('#', l_partkey) WHEN 1 THEN concat(' =', l_partkey) WHEN 2 THEN concat(l_partkey, '-', l_partkey + 49)
        WHEN 3 THEN concat(l_partkey, '+') WHEN 4 THEN NULL WHEN 5 THEN 'abc' ELSE concat(l_partkey, '–', l_partkey + 10) END AS rank_display""",
        "CASE WHEN l_suppkey % 4 = 0 THEN cast(l_suppkey AS int) WHEN l_suppkey % 4 = 1 THEN 0 END AS rank")


@query("col01_standardise_ranks", f"""WITH {_RANKS}, y AS (SELECT *, try_cast(nullif(regexp_extract(regexp_replace(trim(d), '^#+', ''), '^=?([0-9]+)', 1), '') AS INT) AS p FROM x)
  SELECT l_orderkey, l_linenumber, coalesce(nullif(rank, 0), p) AS rank, trim(d) AS rank_display, coalesce(trim(d), '') <> '' AND p IS NULL AS unparsed FROM y""")
def col01(spark, sf):
    return tiers.standardise_ranks(_ranks(spark, sf))


@query("col01_rank_midpoint", f"""WITH {_RANKS}, y AS (SELECT *, regexp_replace(trim(d), '^#+', '') AS t FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(t, '^[0-9]+\\s*[-–]\\s*[0-9]+') THEN
  ((regexp_extract(t, '^([0-9]+)', 1)::INT + regexp_extract(t, '[-–]\\s*([0-9]+)', 1)::INT) // 2)::INT ELSE try_cast(nullif(regexp_extract(t, '^=?([0-9]+)', 1), '') AS INT) END AS mid FROM y""")
def col01b(spark, sf):
    return _ranks(spark, sf).select("l_orderkey", "l_linenumber", C.parse_rank_midpoint("rank_display").alias("mid"))


_FEE = "CASE l_partkey % 8 WHEN 0 THEN '43,800 GBP' WHEN 1 THEN '£' || l_partkey WHEN 2 THEN '$' || l_partkey || ',000.50 per year or $' || l_suppkey WHEN 3 THEN l_partkey || ' EUR' WHEN 4 THEN 'AUD ' || l_suppkey WHEN 5 THEN NULL WHEN 6 THEN 'on request' ELSE l_partkey || ' SGD' END"
_DUR = "CASE l_suppkey % 6 WHEN 0 THEN l_linenumber || ' years' WHEN 1 THEN (l_linenumber * 5) || ' Months' WHEN 2 THEN (l_linenumber * 13) || ' weeks' WHEN 3 THEN l_linenumber || '.5 year' WHEN 4 THEN 'varies' END"
_SCORE = "CASE l_suppkey % 5 WHEN 0 THEN l_linenumber || '.5+' WHEN 1 THEN 'min ' || l_linenumber WHEN 2 THEN '' END"




_SO = f"""x AS (SELECT l_orderkey, l_linenumber, {_FEE} AS fi, CASE WHEN l_linenumber = 2 THEN {_FEE} END AS fd, {_DUR} AS du, {_SCORE} AS sc, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'C' END AS city FROM lineitem),
  f AS (SELECT *, list_max(list_transform(regexp_extract_all(fi, '[0-9,]*[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda n: replace(split_part(n, '.', 1), ',', '')::BIGINT)) AS ai,
  list_max(list_transform(regexp_extract_all(fd, '[0-9,]*[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda n: replace(split_part(n, '.', 1), ',', '')::BIGINT)) AS ad FROM x WHERE city <> '')"""


@query("col03_standardise_offers", f"""WITH {_SO} SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(lower(du), '[0-9]+\\s*month') THEN round(regexp_extract(lower(du), '([0-9]+)\\s*month', 1)::DOUBLE / 12, 2)
  WHEN regexp_matches(lower(du), 'year') THEN regexp_extract(lower(du), '([0-9]+(?:\\.[0-9]+)?)\\s*year', 1)::DOUBLE WHEN regexp_matches(lower(du), 'week') THEN round(regexp_extract(lower(du), '([0-9]+)\\s*week', 1)::DOUBLE / 52, 2) END AS duration_years,
  ad AS domestic_per_year, ai AS international_per_year, CASE WHEN ad IS NULL AND ai IS NULL THEN 'EUR' ELSE 'CHF' END AS currency,
  try_cast(nullif(regexp_extract(sc, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS ielts_min, CASE WHEN try_cast(nullif(regexp_extract(sc, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) <= 4 THEN try_cast(nullif(regexp_extract(sc, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) END AS gpa_requirement_min FROM f""")
def col03(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('Brand ', l_suppkey) AS university_name", "concat('P ', l_partkey) AS program_name", "'X' AS country",
        "CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'C' END AS city", f"{_DUR} AS duration", f"CASE WHEN l_linenumber = 2 THEN {_FEE} END AS fee_domestic", f"{_FEE} AS fee_international",
        "CASE WHEN l_partkey % 8 = 6 THEN 'ask, EUR' ELSE '€' END AS tuition_fee_summary", "'CHF' AS fee_currency", "'90+' AS toefl_score", f"{_SCORE} AS ielts_score", "'x' AS pte_score", f"{_SCORE} AS bachelor_gpa")
    return Z.standardise_offers(x).select("l_orderkey", "l_linenumber", "duration_years", "domestic_per_year", "international_per_year", "currency", "ielts_min", "gpa_requirement_min")


@query("col04_coerce_numbers", """WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal::VARCHAR WHEN 1 THEN '0' WHEN 2 THEN 'n/a' END AS s FROM customer)
  SELECT c_custkey, CASE WHEN trunc(try_cast(s AS DOUBLE))::BIGINT > 0 THEN trunc(try_cast(s AS DOUBLE))::BIGINT END AS i, CASE WHEN try_cast(s AS DOUBLE) <> 0 THEN try_cast(s AS DOUBLE) END AS f FROM x""")
def col04(spark, sf):
    x = table(spark, sf, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN cast(c_acctbal AS string) WHEN 1 THEN '0' WHEN 2 THEN 'n/a' END AS s")
    return x.select("c_custkey", C.positive_int("s").alias("i"), C.nonzero_float("s").alias("f"))


_CODES = list(fixed.USD_RATES) + ["XXX"]
_CODE = "CASE o_custkey % 37 " + " ".join(f"WHEN {i} THEN '{c.lower() if i % 3 == 0 else c}'" for i, c in enumerate(_CODES)) + " END"


@query("col05_to_usd", f"""WITH r(code, rate) AS (VALUES {', '.join(f"('{c}', {v!r}::DOUBLE)" for c, v in fixed.USD_RATES.items())}) SELECT o_orderkey, round(o_totalprice * coalesce(rate, 1.0::DOUBLE), 2) AS usd FROM orders LEFT JOIN r ON code = upper({_CODE})""")
def col05(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", f"{_CODE} AS code").select("o_orderkey", C.to_usd("o_totalprice", "code").alias("usd"))


@query("col06_entity_id", r"SELECT c_custkey, substr(md5(regexp_replace(regexp_replace(trim(lower('  The ' || c_name || '  of  ' || c_mktsegment || '!')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), 1, 12) AS id FROM customer")
def col06(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.entity_id(F.concat(F.lit("  The "), "c_name", F.lit("  of  "), "c_mktsegment", F.lit("!"))).alias("id"))


# --- labels ------------------------------------------------------------------------------------------

_DEG = ["MSc", "PhD", "MBA", "Bachelor of Arts (Hons)", "M.Phil", "LLM", "", "MSc by Research", "Diploma in Law", "Master", "doctor", "engineering", "B.Eng", "Undergraduate", "research degree", "pg", "zzz"]
_DEGCASE = "CASE l_partkey % 17 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DEG)) + " END"
_EXACT = "CASE v " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in fixed.DEGREE_NAMES.items()) + " END"
_PART = "CASE " + " ".join(f"WHEN contains(v, '{k}') OR contains('{k}', v) THEN '{n}'" for k, n in fixed.DEGREE_NAMES.items()) + " END"


@query("col07_classify_degree_type", f"WITH x AS (SELECT l_orderkey, l_linenumber, lower({_DEGCASE}) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v = '' THEN 'Master of Science' ELSE coalesce({_EXACT}, {_PART}, 'Master of Science') END AS degree_type FROM x")
def col07(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_DEGCASE} AS d").select("l_orderkey", "l_linenumber", C.degree_type("d").alias("degree_type"))


@query("col08_classify_level", f"""WITH x AS (SELECT l_orderkey, l_linenumber, lower({_DEGCASE}) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v = '' THEN 'Masters' ELSE {chain_sql('v', fixed.LEVEL_WORDS, "'Masters'")} END AS level,
  {chain_sql("v || ' http://u/'", fixed.LINK_LEVEL_WORDS, "'Unknown'")} AS link_level FROM x""")
def col08(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_DEGCASE} AS d")
    return x.select("l_orderkey", "l_linenumber", C.level("d").alias("level"), C.link_level(F.col("d"), F.lit("http://u/")).alias("link_level"))


_SUBJ = ["Computer Networks", "Finance", "Nursing", "Physics", "Law and Society", "Music", "Civil Engineering", "Teaching", "Data Science", "Knitting", ""]
_SUBJCASE = "CASE l_partkey % 11 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_SUBJ)) + " END"


@query("col09_classify_category", f"""WITH x AS (SELECT l_orderkey, l_linenumber, lower({_SUBJCASE}) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v = '' THEN 'Other' ELSE {chain_sql('v', fixed.CATEGORY_WORDS, "'Other'")} END AS category,
  {chain_sql("v || ' http://u/'", fixed.LINK_CATEGORY_WORDS, "'Other'")} AS link_category FROM x""")
def col09(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_SUBJCASE} AS d")
    return x.select("l_orderkey", "l_linenumber", C.category("d").alias("category"), C.link_category(F.col("d"), F.lit("http://u/")).alias("link_category"))


# --- places -------------------------------------------------------------------------------------------

_CAMPUS = "CASE c_custkey % 5 WHEN 0 THEN c_name || ', Town ' || c_nationkey || ', US, Town' || c_nationkey || ' United States' WHEN 1 THEN 'Town ' || c_nationkey || ',  NATION_' || c_nationkey WHEN 2 THEN 'NATION_' || c_nationkey WHEN 3 THEN '' ELSE 'Hall, City' || c_nationkey || ', Land' END"


@query("col10_split_location", f"""WITH x AS (SELECT c_custkey, {_CAMPUS} AS s FROM customer), y AS (SELECT *, list_transform(string_split(s, ','), lambda p: trim(p)) AS p FROM x)
  SELECT c_custkey, CASE WHEN s = '' THEN 'Unknown' WHEN len(p) >= 3 THEN CASE WHEN contains(p[-1], ' ') THEN substr(p[-1], position(' ' IN p[-1]) + 1) ELSE p[-1] END WHEN len(p) = 2 THEN p[-1] ELSE 'Unknown' END AS country,
  CASE WHEN s = '' THEN 'Unknown' WHEN len(p) >= 2 THEN p[-2] ELSE p[1] END AS city, CASE WHEN s = '' THEN NULL WHEN len(p) = 3 THEN p[1] WHEN len(p) = 2 THEN p[2] WHEN len(p) = 1 THEN p[1] END AS plain_country,
  CASE WHEN s = '' THEN NULL WHEN len(p) = 3 THEN p[3] WHEN len(p) = 2 THEN p[1] END AS plain_city FROM y""")
def col10(spark, sf):
    x = table(spark, sf, "customer").selectExpr("c_custkey", f"{_CAMPUS} AS s")
    return x.select("c_custkey", C.campus_country("s").alias("country"), C.campus_city("s").alias("city"), C.location_country("s").alias("plain_country"), C.location_city("s").alias("plain_city"))


_NAMES = ["ETH Zurich", "Imperial College", "KAIST", "University of Toronto", "Small College", "Peking University", "Freie Universität", "Nowhere Institute"]
_NAMECASE = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_NAMES)) + " END"
_CTRY = "CASE c_nationkey % 4 WHEN 0 THEN 'Italy' WHEN 1 THEN 'Germany' WHEN 2 THEN 'Atlantis' ELSE 'Japan' END"


@query("col11_infer_city_country", f"""WITH x AS (SELECT c_custkey, lower({_NAMECASE}) AS n, {_CTRY} AS c FROM customer) SELECT c_custkey, {chain_sql('n', fixed.CITY_PATTERNS, "CASE c WHEN 'Italy' THEN 'Rome' WHEN 'Germany' THEN 'Berlin' WHEN 'Japan' THEN 'Tokyo' ELSE c END")} AS city,
  {chain_sql('n', fixed.COUNTRY_PATTERNS, "'Unknown'")} AS country FROM x""".replace("'king's college london'", "'king''s college london'"))
def col11(spark, sf):
    x = table(spark, sf, "customer").selectExpr("c_custkey", f"{_NAMECASE} AS n", f"{_CTRY} AS c")
    return x.select("c_custkey", C.infer_city("n", "c").alias("city"), C.infer_country("n").alias("country"))


_STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private not for Profit' WHEN 2 THEN 'PRIVATE for profit' WHEN 3 THEN 'private' ELSE 'other' END"
_RES = "CASE c_custkey % 5 WHEN 0 THEN 'vh' WHEN 1 THEN 'H' WHEN 2 THEN 'M' WHEN 3 THEN 'L' ELSE 'Z' END"


@query("col12_map_codes", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'private_nonprofit' WHEN 2 THEN 'private_forprofit' WHEN 3 THEN 'private' END AS ownership, CASE c_custkey % 5 WHEN 0 THEN 'very high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS research FROM customer")
def col12(spark, sf):
    x = table(spark, sf, "customer").selectExpr("c_custkey", f"{_STATUS} AS s", f"{_RES} AS q")
    return x.select("c_custkey", C.ownership("s").alias("ownership"), C.research_intensity("q").alias("research"))


@query("col13_institution_key", r"SELECT c_custkey, regexp_replace(regexp_replace(lower(trim('  ' || c_name || '   Of ' || c_mktsegment || ' (UK)  ')), '\s+', ' ', 'g'), '\s*\([^)]*\)\s*$', '') AS k FROM customer")
def col13(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.institution_key(F.concat(F.lit("  "), "c_name", F.lit("   Of "), "c_mktsegment", F.lit(" (UK)  "))).alias("k"))


@query("col14_derive_demographics", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(trunc(o_totalprice) * (o_custkey % 100) / 100)::BIGINT WHEN o_custkey > 0 THEN o_custkey END AS international_count,
  CASE WHEN o_custkey % 50 > 0 THEN round(trunc(o_totalprice) / (o_custkey % 50), 2) END AS student_faculty_ratio FROM orders""")
def col14(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice AS total_students", "CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', o_custkey % 100, '%') END AS international_students_pct",
                                              "o_custkey AS international_students", "o_custkey % 50 AS faculty_count")
    return Z.derive_demographics(x).select("o_orderkey", "international_count", "student_faculty_ratio")


@query("col15_clean_text_columns", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), '') AS text,
  CASE WHEN contains(url, 'example.com') THEN 'http://canonical/' || page_id ELSE url END AS website FROM pages""")
def col15(spark, sf):
    canonical = F.concat(F.lit("http://canonical/"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", C.clean_text("html").alias("text"), C.official_website(F.col("url"), canonical, "example.com").alias("website"))


@query("col16_highlights_to_columns", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS degree, CASE WHEN o_orderkey % 3 = 0 THEN 'last' ELSE 'On Campus' END AS mode FROM orders""")
def col16(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_orderkey", """array(named_struct('label', CASE WHEN o_orderkey % 2 = 0 THEN 'Degree' ELSE 'Qualification' END, 'value', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END),
      named_struct('label', ' Study Mode', 'value', ' On Campus '), named_struct('label', CASE WHEN o_orderkey % 3 = 0 THEN 'Study/Mode' ELSE 'Other' END, 'value', 'last'), named_struct('label', 'Degree', 'value', '')) AS h""")
    m = x.withColumn("m", Z.highlights_map(F.col("h")))
    return m.select("o_orderkey", Z.first_key(F.col("m"), "degree", "qualification").alias("degree"), Z.first_key(F.col("m"), "study_mode", "mode_of_study").alias("mode"))


@query("col17_requirements_list", "SELECT o_orderkey, 'IELTS: ' || (o_custkey % 9) || '|' || 'GRE' || CASE WHEN o_orderkey % 2 = 0 THEN ': ' || o_orderstatus ELSE '' END AS reqs FROM orders")
def col17(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_orderkey", """array(named_struct('exam_name', 'IELTS ', 'score', cast(o_custkey % 9 AS string)), named_struct('exam_name', '', 'score', '5'),
      named_struct('exam_name', 'GRE', 'score', CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END)) AS e""")
    return x.select("o_orderkey", F.array_join(Z.requirements_list(F.col("e")), "|").alias("reqs"))


# --- nested records ------------------------------------------------------------------------------------

_SYS = "QS World University Rankings"


def raw_entities(spark, sf):
    """Customers as nested raw entity records."""
    return table(spark, sf, "customer").selectExpr(
        "named_struct('name', CASE WHEN c_custkey % 20 = 0 THEN ' ' ELSE concat(' ', c_name) END, 'slug', CASE WHEN c_custkey % 2 = 0 THEN concat('slug-', c_custkey) END, 'canonical_url', concat('http://agg.example/', c_custkey)) AS identity",
        "named_struct('country', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('NATION_', c_nationkey) END, 'city', '', 'state', CAST(NULL AS string), 'address', 'a', 'latitude', cast(c_nationkey AS double), 'longitude', 0D) AS location",
        "named_struct('description_full', CASE WHEN c_custkey % 2 = 0 THEN concat('<p>', c_mktsegment, '</p>  <b>x</b>') ELSE '' END, 'description_short', c_mktsegment, 'institution_type', 'public', 'established_year', concat('', 1800 + c_custkey % 200)) AS profile",
        "named_struct('total_students', concat('', 1000 + c_custkey), 'faculty_count', concat('', c_custkey % 30), 'international_students', '77', 'international_students_pct', CASE WHEN c_custkey % 4 = 0 THEN '12.5%' END) AS demographics",
        f"""array(named_struct('ranking_type', '{_SYS}', 'rank', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(c_custkey % 700 AS int) END, 'rank_display', concat(' #', c_custkey % 900, '-999')),
          named_struct('ranking_type', '{_SYS}', 'rank', 1, 'rank_display', '1'), named_struct('ranking_type', 'Asian University Rankings', 'rank', 5, 'rank_display', '=5')) AS rankings""",
        "named_struct('website', CASE WHEN c_custkey % 2 = 0 THEN 'http://agg.example/x' ELSE concat('http://u', c_custkey, '.edu') END) AS contact",
        "named_struct('tuition_domestic', named_struct('amount', concat('', c_custkey), 'amount_min', '5'), 'tuition_international', named_struct('amount', CAST(NULL AS string), 'amount_min', '9000.7')) AS financials",
        "named_struct('canonical_url', CAST(NULL AS string), 'content_hash', md5(c_name), 'source_url', concat('http://s/', c_custkey), 'crawl_timestamp', '2025-01-01') AS crawl_metadata")


@query("col18_flatten_entities", """SELECT substr(md5(lower(CASE WHEN c_custkey % 2 = 0 THEN 'slug' || c_custkey ELSE replace(c_name, '#', '') END)), 1, 12) AS university_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE 'NATION_' || c_nationkey END AS country, 'Unknown' AS city,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' x' ELSE c_mktsegment END AS description, CASE WHEN c_custkey % 2 = 0 THEN 'http://agg.example/' || c_custkey ELSE 'http://u' || c_custkey || '.edu' END AS website,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 700 > 0 THEN (c_custkey % 700)::INT WHEN c_custkey % 900 > 0 THEN (c_custkey % 900)::INT END AS qs_world_ranking, 1000 + c_custkey AS total_students,
  CASE WHEN c_custkey % 4 = 0 THEN floor((1000 + c_custkey) * 12.5 / 100)::BIGINT ELSE 77 END AS international_students, CASE WHEN c_custkey % 30 > 0 THEN round((1000 + c_custkey) / (c_custkey % 30)::DOUBLE, 2) END AS student_faculty_ratio,
  CASE WHEN c_custkey > 0 THEN c_custkey END AS average_tuition_domestic, 9000::BIGINT AS average_tuition_international, 2 AS n_signals, 'http://s/' || c_custkey AS source_url FROM customer WHERE c_custkey % 20 <> 0""")
def col18(spark, sf):
    d = Z.flatten_entities(raw_entities(spark, sf), "agg.example")
    return d.select("university_id", "name", "country", "city", "description", "website", "qs_world_ranking", "total_students", "international_students", "student_faculty_ratio",
                    "average_tuition_domestic", "average_tuition_international", F.size("ranking_signals").alias("n_signals"), "source_url")


def raw_offers(spark, sf):
    """Parts as nested raw offer records."""
    hl = lambda l, v: f"named_struct('label', '{l}', 'value', {v})"
    return table(spark, sf, "part").selectExpr(
        "named_struct('programme_title', CASE WHEN p_partkey % 15 = 0 THEN '' ELSE p_name END, 'campus_location', concat('Town', p_size, ', NATION_', p_size % 25)) AS programme_header",
        f"named_struct('highlights', array({hl('Degree', chr(39) + 'MSc' + chr(39))}, {hl('Study Level', 'CASE WHEN p_size % 2 = 0 THEN ' + chr(39) + 'PhD' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END')}, {hl('Main Subject', 'CASE WHEN p_size % 3 = 0 THEN ' + chr(39) + 'Physics' + chr(39) + ' END')}), 'description_short', concat('<i>', p_type, '</i>')) AS overview",
        "named_struct('exam_scores', array(named_struct('exam_name', 'GRE', 'score', concat('', p_size))), 'gpa_score', CASE WHEN p_size % 2 = 0 THEN concat(p_size % 5, ' / 4') ELSE 'good' END, 'english_requirements', array(named_struct('exam_name', 'IELTS', 'score', ''))) AS admission_requirements",
        "array(named_struct('fee_amount', ''), named_struct('fee_amount', CASE WHEN p_size % 2 = 0 THEN concat('€', p_size, ',500.75') ELSE concat('$', p_size) END)) AS tuition_fees",
        "array(named_struct('label', 'Other', 'value', '3'), named_struct('label', 'World Ranking', 'value', CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('#', p_size) END)) AS badges",
        "named_struct('ranking_history', array(named_struct('year', '2024', 'rank', '9'), named_struct('year', '2025', 'rank', concat(p_size + 100, '-150')))) AS qs_subject_rankings",
        "p_brand AS parent_university_slug", "'ps' AS program_slug", "concat('http://s/', p_partkey) AS source_url", "'2025' AS crawled_at")


@query("col18_flatten_offers", """SELECT p_name AS program_name, p_brand AS university_name, 'NATION_' || (p_size % 25) AS country, 'Town' || p_size AS city, 'Master of Science' AS degree_type, CASE WHEN p_size % 2 = 0 THEN 'PhD' ELSE 'Masters' END AS degree_level,
  CASE WHEN p_size % 2 = 0 THEN (p_size % 5)::DOUBLE END AS gpa_requirement_min, 'GRE: ' || p_size || '|IELTS' AS entry_requirements, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT * 1000 + 500 ELSE p_size::BIGINT END AS international_per_year,
  CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN p_size % 4 = 0 THEN (p_size + 100)::INT ELSE p_size::INT END AS subject_ranking, p_type AS description, 'http://s/' || p_partkey AS source_url FROM part WHERE p_partkey % 15 <> 0""")
def col18b(spark, sf):
    d = Z.flatten_offers(raw_offers(spark, sf)).withColumn("entry_requirements", F.array_join("entry_requirements", "|"))
    return d.select("program_name", "university_name", "country", "city", "degree_type", "degree_level", "gpa_requirement_min", "entry_requirements", "international_per_year", "currency", "subject_ranking", "description", "source_url")


@query("col18_flatten_directory", """SELECT p_name AS program_name, 'u' || p_partkey AS program_url, p_brand AS university_name, 'NATION_' || (p_size % 25) AS country, CASE WHEN p_size % 5 > 0 THEN 'T' END AS city, p_size::INT AS rankings_position, 'dir' AS source FROM part""")
def col18c(spark, sf):
    x = table(spark, sf, "part").selectExpr("concat(' ', p_name) AS program_name", "concat('u', p_partkey) AS program_url", "p_brand AS uni_name", "'x' AS uni_url", "array(concat('NATION_', p_size % 25), 'b') AS country",
                                            "CASE WHEN p_size % 5 > 0 THEN array('T') ELSE cast(array() AS array<string>) END AS city", "'c' AS campus_name", "'r' AS region", "concat('=', p_size) AS rankings_position")
    return Z.flatten_directory(x, "dir").select("program_name", "program_url", "university_name", "country", "city", "rankings_position", "source")


@query("col19_fill_missing", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.5::DOUBLE WHEN p_size % 3 = 0 THEN 4.0 WHEN p_size % 3 = 1 THEN 2.0 END AS duration_years, CASE WHEN p_size % 4 = 0 THEN 'Switzerland' ELSE 'X' END AS country,
  CASE WHEN p_size % 5 = 0 THEN 'a long enough description' ELSE 'This is a ' || CASE p_size % 3 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' ELSE 'Other' END || ' program in Computer Science' || CASE WHEN p_size % 7 = 0 THEN ' with specializations in a, b, c' ELSE '' END || '.' ||
  CASE WHEN p_size % 2 = 0 THEN ' This 1.5-year program' WHEN p_size % 3 = 0 THEN ' This 4.0-year program' WHEN p_size % 3 = 1 THEN ' This 2.0-year program' ELSE '' END ||
  ' The program provides comprehensive education in computer science fundamentals and advanced topics. Offered by ETH Zurich.' END AS program_description FROM part""")
def col19(spark, sf):
    x = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN 1.5D END AS duration_years", "CASE p_size % 3 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' ELSE 'Other' END AS degree_type", "CASE WHEN p_size % 4 = 0 THEN '' ELSE 'X' END AS country",
                                            "'ETH Zurich' AS university_name", "CASE WHEN p_size % 5 = 0 THEN 'a long enough description' ELSE ' short ' END AS program_description",
                                            "CASE WHEN p_size % 7 = 0 THEN array('a', 'b', 'c', 'd') ELSE cast(array() AS array<string>) END AS specializations")
    return Z.fill_missing(x).select("p_partkey", "duration_years", "country", "program_description")


@query("col20_standardise_text", """SELECT p_partkey, p_brand AS university_name, p_name AS program_name, upper(p_type[1]) || lower(p_type[2:]) || ' Land' AS country, CASE p_size % 3 WHEN 0 THEN 'Master of Science' WHEN 1 THEN 'Doctor of Philosophy' ELSE 'Odd Degree' END AS degree_type FROM part""")
def col20(spark, sf):
    x = table(spark, sf, "part").selectExpr("p_partkey", "concat('  ', p_brand, '\t') AS university_name", "concat(p_name, ' ') AS program_name", "concat(' ', p_type, ' LAND') AS country", "'x' AS city",
                                            "CASE p_size % 3 WHEN 0 THEN 'MSc ' WHEN 1 THEN 'Doctoral' ELSE 'Odd Degree' END AS degree_type")
    return Z.standardise_text(x).select("p_partkey", "university_name", "program_name", "country", "degree_type")


_COMP = """x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS d, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS dur, CASE WHEN p_size % 5 = 0 THEN 0::DOUBLE WHEN p_size % 5 = 1 THEN NULL ELSE p_retailprice END AS fee, (p_size % 4)::DOUBLE AS gpa, p_size % 3 AS n FROM part)"""


@query("col21_completeness", f"""WITH {_COMP} SELECT p_partkey, round((2 + (d <> '' AND d IS NOT NULL)::INT + (dur IS NOT NULL)::INT + 1 + (n > 0)::INT + 1 + 0) / 8::DOUBLE, 6) AS eight,
  round((coalesce(d <> '', false)::INT + 0 + 1 + 1 + coalesce(dur > 0, false)::INT + coalesce(fee > 0, false)::INT + (gpa > 0)::INT + (n > 0)::INT + 1 + 0) / 10::DOUBLE, 6) AS ten FROM x""")
def col21(spark, sf):
    x = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS program_description", "CASE WHEN p_size % 2 = 0 THEN cast(p_size AS double) END AS duration_years",
        "CASE WHEN p_size % 5 = 0 THEN 0D WHEN p_size % 5 = 1 THEN NULL ELSE p_retailprice END AS international_per_year", "cast(p_size % 4 AS double) AS gpa_requirement_min",
        "slice(array('a', 'b', 'c'), 1, p_size % 3) AS prerequisites", "array('s') AS specializations", "cast(array() AS array<string>) AS faculty_research_interests", "' ' AS fall_deadline", "'c' AS country", "'t' AS city")
    return x.select("p_partkey", F.round(Z.completeness_eight(x), 6).alias("eight"), F.round(Z.completeness_ten(), 6).alias("ten"))


@query("col22_confidence", """SELECT p_partkey, round(least((p_size % 10) / 10::DOUBLE + least(CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 0.05 ELSE 0 END, 0.3)::DOUBLE, 1.0::DOUBLE), 3) AS confidence FROM part""")
def col22(spark, sf):
    m = lambda k: F.col("p_size") % k == 0
    return table(spark, sf, "part").select("p_partkey", Z.confidence(F.col("p_size") % 10 / F.lit(10.0), m(2), m(3), m(5), m(7)).alias("confidence"))


# --- typing by data ---------------------------------------------------------------------------------------


@query("col23_promote_numeric", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 20 <> 0 THEN l_partkey::DOUBLE END AS a, CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR ELSE 'x' END AS b FROM lineitem")
def col23(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 20 = 0 THEN 'n/a' ELSE cast(l_partkey AS string) END AS a", "CASE WHEN l_partkey % 2 = 0 THEN cast(l_partkey AS string) ELSE 'x' END AS b")
    return Z.promote_numeric(x)


@query("col24_impute", """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS a, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS b FROM lineitem),
  m AS (SELECT b FROM x WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1) SELECT l_orderkey, l_linenumber, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM x)), 4) AS a, coalesce(b, (SELECT b FROM m)) AS b FROM x""")
def col24(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS a", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS b")
    return Z.impute(x, ["a"], ["b"]).withColumn("a", F.round("a", 4))


@query("col25_clip_outliers", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice FROM lineitem, q""")
def col25(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return Z.clip_outliers(x, ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("col26_detect_feature_groups", "SELECT * FROM (VALUES ('doc_id', 'id'), ('text', 'text'), ('lang', 'categorical'), ('source', 'categorical'), ('n_chars', 'numeric')) t(\"column\", \"group\")")
def col26(spark, sf):
    return Z.detect_feature_groups(table(spark, sf, "documents"))


@query("col27_detect_target", "SELECT l_returnflag AS target_value, count(*) AS n FROM lineitem GROUP BY 1")
def col27(spark, sf):
    df, name = Z.detect_target(table(spark, sf, "lineitem"), ["l_partkey", "missing", "l_returnflag", "l_linestatus"])
    return df.groupBy(F.col(name).alias("target_value")).agg(F.count("*").alias("n"))


@query("col27_derive_target", "SELECT CASE WHEN l_partkey <= 100 THEN 'top' WHEN l_partkey <= 500 THEN 'good' ELSE 'standard' END AS target_value, count(*) AS n FROM lineitem GROUP BY 1")
def col27b(spark, sf):
    df, name = Z.detect_target(table(spark, sf, "lineitem"), ["l_partkey"], rank="l_partkey")
    return df.groupBy(F.col(name).alias("target_value")).agg(F.count("*").alias("n"))
