"""Validation, quality scores, leakage, drift and gates on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import drift as D, leakage as L, quality as V
from offerloom.plans.aggregates import rounded
from offerloom.registry import query, table

# --- row contracts --------------------------------------------------------------------------------

_OFF = """o AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_brand END AS university_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS program_name, p_type AS degree_type, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'X' END AS country,
  CASE p_partkey % 3 WHEN 0 THEN 'http://x/' || p_partkey WHEN 1 THEN 'HTTPS://y' ELSE 'ftp://z' END AS source_url, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 10::DOUBLE END AS gpa, p_size * 3 AS toefl, p_size / 5::DOUBLE AS ielts,
  CASE WHEN p_size % 3 = 0 THEN 'short' WHEN p_size % 3 = 1 THEN repeat('long ', 20) ELSE '' END AS descr, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 40 END AS tuition, (p_size % 10) / 10::DOUBLE AS comp, p_size / 4::DOUBLE AS dur FROM part)"""


def _offers(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_brand END AS university_name", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS program_name", "p_type AS degree_type",
        "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'X' END AS country", "CASE p_partkey % 3 WHEN 0 THEN concat('http://x/', p_partkey) WHEN 1 THEN 'HTTPS://y' ELSE 'ftp://z' END AS source_url",
        "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 10D END AS gpa_requirement_min", "p_size * 3 AS toefl_min", "p_size / 5D AS ielts_min",
        "CASE WHEN p_size % 3 = 0 THEN 'short' WHEN p_size % 3 = 1 THEN repeat('long ', 20) ELSE '' END AS program_description", "CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 40 END AS tuition",
        "(p_size % 10) / 10D AS data_completeness", "p_size / 4D AS duration_years", "substring(md5(p_brand), 1, 12) AS university_id")


@query("val01_enforce_constraints", f"""WITH {_OFF} SELECT p_partkey, concat_ws(',', CASE WHEN trim(university_name) = '' THEN 'university_name_empty' END, CASE WHEN program_name IS NULL THEN 'program_name_empty' END, CASE WHEN gpa > 4 THEN 'gpa_range' END,
  CASE WHEN ielts > 9 THEN 'ielts_range' END, CASE WHEN toefl > 120 THEN 'toefl_range' END, CASE WHEN dur > 7 THEN 'duration_range' END) AS reasons FROM o""")
def val01(spark, sf):
    return V.enforce_constraints(_offers(spark, sf), V.offer_rules()).select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query("val01_split_counts", f"""WITH {_OFF}, x AS (SELECT trim(university_name) = '' OR program_name IS NULL OR coalesce(gpa > 4, false) OR ielts > 9 OR toefl > 120 OR dur > 7 AS bad FROM o) SELECT count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected FROM x""")
def val01b(spark, sf):
    ok, bad = V.split_by_constraints(_offers(spark, sf), V.offer_rules())
    return ok.agg(F.count("*").alias("accepted")).withColumn("rejected", bad.agg(F.count("*")).scalar())


_ISSUES = f"""{_OFF}, v AS (SELECT *, trim(university_name) <> '' AS f1, program_name IS NOT NULL AS f2, country <> '' AS f4, regexp_matches(lower(source_url), '^https?:') AS u FROM o),
  i AS (SELECT *, [x FOR x IN [CASE WHEN NOT f1 THEN 'University name is required' END, CASE WHEN NOT f2 THEN 'Program name is required' END, CASE WHEN NOT f4 THEN 'Country is required' END, CASE WHEN gpa > 4 THEN 'GPA requirement must be between 0.0 and 4.0' END,
    CASE WHEN toefl > 120 THEN 'TOEFL score must be between 0 and 120' END, CASE WHEN ielts > 9 THEN 'IELTS score must be between 0.0 and 9.0' END, CASE WHEN NOT u THEN 'Source URL must use HTTP or HTTPS' END] IF x IS NOT NULL] AS issues,
    [x FOR x IN [CASE WHEN descr = 'short' THEN 'Program description seems too short' END, CASE WHEN tuition <> 0 AND tuition < 1000 THEN 'Tuition fee seems unusually low' END] IF x IS NOT NULL] AS warnings,
    (f1::INT + f2::INT + 1 + f4::INT + 1 + CASE WHEN gpa <= 4 THEN 0.5::DOUBLE ELSE 0 END + u::INT) / 7::DOUBLE AS score FROM v)"""


@query("val02_validate_offers", f"""WITH {_ISSUES} SELECT p_partkey, round(score, 6) AS score, array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings, len(issues) = 0 AS is_valid,
  concat_ws('|', CASE WHEN NOT f1 OR NOT f2 OR NOT f4 THEN 'Complete all required fields before saving' END, CASE WHEN NOT u THEN 'Verify source URL is correct and accessible' END, CASE WHEN gpa > 4 THEN 'Ensure GPA requirements are in 4.0 scale format' END,
  CASE WHEN len(warnings) > 0 THEN 'Review warnings for potential data quality issues' END) AS recommendations FROM i""")
def val02(spark, sf):
    d = V.validate_offers(_offers(spark, sf))
    join = lambda c: F.array_join(c, "|").alias(c)
    return d.select("p_partkey", F.round("score", 6).alias("score"), join("issues"), join("warnings"), "is_valid", join("recommendations"))


@query("agg07_quality_score", f"""WITH {_ISSUES}, t AS (SELECT count(*) AS total, avg(comp) AS avg_completeness, sum(len(issues))::BIGINT AS n_issues, sum(len(warnings))::BIGINT AS n_warnings, sum((NOT f1)::INT + (NOT f2)::INT + (NOT f4)::INT)::BIGINT AS n_critical FROM i)
  SELECT total, round(avg_completeness, 6) AS avg_completeness, n_issues, n_warnings, n_critical, round(least(greatest(avg_completeness * 0.7::DOUBLE - least(n_issues / total::DOUBLE, 0.3::DOUBLE) - least(n_warnings / (total * 2)::DOUBLE, 0.2::DOUBLE), 0), 1), 6) AS quality_score FROM t""")
def agg07(spark, sf):
    return rounded(V.quality_score(V.validate_offers(_offers(spark, sf))), 6)


@query("agg07_top_issues", f"WITH {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY 1 ORDER BY n DESC, issue LIMIT 3")
def agg07b(spark, sf):
    return V.top_issues(V.validate_offers(_offers(spark, sf)))


@query("agg07_recommendations", f"""WITH {_ISSUES}, t AS (SELECT avg(comp) AS a, sum(len(warnings)) AS w FROM i), k AS (SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY 1 ORDER BY n DESC, issue LIMIT 3),
  s AS (SELECT 0 AS o, 0 AS p, 'Improve data completeness - aim for 80%+ field coverage' AS r FROM t WHERE a < 0.7 UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, issue), 'Fix ' || n || ' programs with: ' || issue FROM k UNION ALL SELECT 2, 0, 'Review and address data quality warnings' FROM t WHERE w > 0),
  e AS (SELECT * FROM s UNION ALL SELECT 3, 0, 'Data quality is good - continue monitoring' WHERE NOT EXISTS (SELECT 1 FROM s))
  SELECT (row_number() OVER (ORDER BY o, p) - 1)::INT AS position, r AS recommendation FROM e""")
def agg07c(spark, sf):
    return V.quality_recommendations(V.validate_offers(_offers(spark, sf)))


# --- entities ----------------------------------------------------------------------------------------

_ENT = """e AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'X' END AS country, 'T' AS city, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(md5(c_name), 1, 12) ELSE 'bad' END AS uid,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'http://u' || c_custkey ELSE 'nohost' END AS website, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE (c_custkey % 7)::INT END AS qs, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Top' ELSE 'weird' END AS tier,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'd' END AS descr FROM customer),
  ch AS (SELECT c_name AS uni, o_orderpriority AS prog, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'text' END AS d, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END AS fee FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 8 <> 0),
  st AS (SELECT uni, count(*) AS n, avg(CASE WHEN d <> '' THEN 1 ELSE 0 END) AS dc, avg(CASE WHEN fee <> 0 THEN 1 ELSE 0 END) AS fc, count(*) - count(DISTINCT prog) AS dup FROM ch GROUP BY 1),
  j AS (SELECT e.*, coalesce(n, 0) AS n, dc, fc, dup, ((descr IS NOT NULL)::INT + (website IS NOT NULL)::INT + 1 + 1 + (qs IS NOT NULL)::INT + 1 + (tier IS NOT NULL)::INT) / 7::DOUBLE AS full_ FROM e LEFT JOIN st ON name = uni),
  ck(entity, "check", passed, severity) AS (
    SELECT name, 'required_field_name', name <> '', CASE WHEN name <> '' THEN 'info' ELSE 'error' END FROM j UNION ALL SELECT name, 'required_field_country', country IS NOT NULL, CASE WHEN country IS NOT NULL THEN 'info' ELSE 'error' END FROM j UNION ALL SELECT name, 'required_field_city', true, 'info' FROM j
    UNION ALL SELECT name, 'university_id_format', uid <> 'bad', CASE WHEN uid <> 'bad' THEN 'info' ELSE 'warning' END FROM j WHERE uid IS NOT NULL UNION ALL SELECT name, 'university_id_missing', false, 'warning' FROM j WHERE uid IS NULL
    UNION ALL SELECT name, 'website_url_valid', website <> 'nohost', CASE WHEN website <> 'nohost' THEN 'info' ELSE 'warning' END FROM j WHERE website IS NOT NULL UNION ALL SELECT name, 'website_url_missing', false, 'info' FROM j WHERE website IS NULL
    UNION ALL SELECT name, 'ranking_qs_world_ranking_valid', qs > 0, CASE WHEN qs > 0 THEN 'info' ELSE 'warning' END FROM j WHERE qs IS NOT NULL UNION ALL SELECT name, 'no_rankings', false, 'info' FROM j WHERE qs IS NULL
    UNION ALL SELECT name, 'tier_classification', tier = 'Top', CASE WHEN tier = 'Top' THEN 'info' ELSE 'warning' END FROM j WHERE tier IS NOT NULL UNION ALL SELECT name, 'tier_missing', false, 'info' FROM j WHERE tier IS NULL
    UNION ALL SELECT name, 'no_programs', false, 'error' FROM j WHERE n = 0 UNION ALL SELECT name, 'programs_count', true, 'info' FROM j WHERE n > 0
    UNION ALL SELECT name, 'program_descriptions', dc > 0.5, CASE WHEN dc < 0.5 THEN 'warning' ELSE 'info' END FROM j WHERE n > 0 UNION ALL SELECT name, 'program_fees', fc > 0.3, CASE WHEN fc < 0.3 THEN 'warning' ELSE 'info' END FROM j WHERE n > 0
    UNION ALL SELECT name, 'duplicate_programs', false, 'warning' FROM j WHERE dup > 0 UNION ALL SELECT name, 'data_completeness', full_ > 0.6, CASE WHEN full_ < 0.6 THEN 'warning' ELSE 'info' END FROM j),
  ckw AS (SELECT *, CASE WHEN contains("check", 'required') OR contains("check", 'critical') THEN 2.0::DOUBLE WHEN contains("check", 'optional') THEN 0.5 ELSE 1.0 END AS weight, NOT passed AND severity IN ('error', 'warning') AS issue FROM ck),
  sc AS (SELECT entity, sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) AS score, count(*) AS n_checks, count(*) FILTER (issue) AS n_issues FROM ckw GROUP BY 1)"""


def _checks(spark, sf):
    c = table(spark, sf, "customer")
    e = c.selectExpr(
        "CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS name", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'X' END AS country", "'T' AS city",
        "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substring(md5(c_name), 1, 12) ELSE 'bad' END AS university_id", "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('http://u', c_custkey) ELSE 'nohost' END AS website",
        "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE cast(c_custkey % 7 AS int) END AS qs_world_ranking", "CAST(NULL AS int) AS the_world_ranking", "CAST(NULL AS int) AS us_news_ranking",
        "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Top' ELSE 'weird' END AS tier", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'd' END AS description", "1900 AS founding_year", "5 AS total_students", "'public' AS type")
    o = table(spark, sf, "orders").filter("o_custkey % 8 <> 0").join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "c_name AS university_name", "o_orderpriority AS program_name", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'text' END AS program_description", "CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END AS tuition_domestic")
    return V.validate_entities(e, o)


@query("val03_validate_entities", f"WITH {_ENT} SELECT * FROM ckw WHERE entity <> ''")
def val03(spark, sf):
    return _checks(spark, sf).filter("entity <> ''")


@query("val03_entity_scores", f"WITH {_ENT} SELECT entity, round(score, 6) AS score, n_checks, n_issues FROM sc")
def val03b(spark, sf):
    return rounded(V.entity_scores(_checks(spark, sf)), 6)


@query("agg24_validation_report", f"""WITH {_ENT} SELECT count(*) AS n_entities, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 0.9) AS excellent, count(*) FILTER (score >= 0.7 AND score < 0.9) AS good, count(*) FILTER (score >= 0.5 AND score < 0.7) AS fair,
  count(*) FILTER (score < 0.5) AS poor, sum(n_issues)::BIGINT AS n_issues FROM sc""")
def agg24(spark, sf):
    return rounded(V.validation_report(_checks(spark, sf)), 6)


@query("agg24_milestones", f"""WITH {_ENT}, m AS (SELECT c_name AS entity, CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS status FROM customer), ms AS (SELECT m.*, coalesce(score, 0) AS score FROM m LEFT JOIN sc USING (entity))
  SELECT count(*) AS n_entities, count(*) FILTER (status = 'completed') AS completed, round(avg(score), 3) AS mean_score, count(*) FILTER (score >= 0.9) AS excellent, count(*) FILTER (score >= 0.7 AND score < 0.9) AS good,
  count(*) FILTER (score >= 0.5 AND score < 0.7) AS needs_improvement, count(*) FILTER (score < 0.5) AS critical_issues FROM ms""")
def agg24c(spark, sf):
    m = table(spark, sf, "customer").selectExpr("c_name AS entity", "CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS status")
    return V.milestone_report(V.entity_scores(_checks(spark, sf)), m)


@query("agg24_recommendations", f"""WITH {_ISSUES} SELECT r AS recommendation, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT f1 OR NOT f2 OR NOT f4 THEN 'Complete all required fields before saving' END, CASE WHEN NOT u THEN 'Verify source URL is correct and accessible' END,
  CASE WHEN gpa > 4 THEN 'Ensure GPA requirements are in 4.0 scale format' END, CASE WHEN len(warnings) > 0 THEN 'Review warnings for potential data quality issues' END]) AS r FROM i) WHERE r IS NOT NULL GROUP BY 1""")
def agg24d(spark, sf):
    return V.distinct_recommendations(V.validate_offers(_offers(spark, sf)))


@query("agg24_issues_by_category", f"""WITH {_ENT} SELECT "check", count(*) AS n FROM ckw WHERE issue GROUP BY 1""")
def agg24b(spark, sf):
    return V.issues_by_category(_checks(spark, sf))


# --- leakage ------------------------------------------------------------------------------------------

_FEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]


def _unpivot(cols, extra="", where=""):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value{extra} FROM lineitem {where}" for c in cols)


_SPEAR = f"""u AS ({_unpivot(_FEAT, ', l_returnflag AS y')}), rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2::DOUBLE AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2::DOUBLE AS ry FROM u), sp AS (SELECT feature, corr(rx, ry) AS spearman FROM rk GROUP BY 1)"""


@query("lk01_target_correlation", f"WITH {_SPEAR} SELECT feature, round(spearman, 6) AS spearman, abs(spearman) > 0.95 AS leak FROM sp")
def lk01(spark, sf):
    return rounded(L.target_correlation(table(spark, sf, "lineitem"), _FEAT, "l_returnflag"), 6)


@query("lk01_classify_columns", "SELECT column_name AS feature, CASE column_name WHEN 'l_quantity' THEN 'approved' WHEN 'l_extendedprice' THEN 'approved' WHEN 'l_discount' THEN 'blocked' WHEN 'l_orderkey' THEN 'id' ELSE 'unregistered' END AS status FROM (DESCRIBE lineitem)")
def lk01b(spark, sf):
    uses = {"l_quantity": "training", "l_extendedprice": "training", "l_discount": "blocked", "l_orderkey": "id"}
    return L.classify_columns(spark, table(spark, sf, "lineitem").columns, uses)


@query("lk02_leakage_audit", f"""WITH {_SPEAR.replace('FROM lineitem ', 'FROM lineitem WHERE l_orderkey % 10 < 7 ')}, ov AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 10 < 7 INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 10 >= 7))
  SELECT 'correlation:' || feature AS "check", abs(spearman) <= 0.95 AS passed FROM sp UNION ALL SELECT 'group_overlap', n = 0 FROM ov UNION ALL SELECT 'blocked_columns', true""")
def lk02(spark, sf):
    li = table(spark, sf, "lineitem")
    return L.leakage_audit(li.filter("l_orderkey % 10 < 7"), li.filter("l_orderkey % 10 >= 7"), _FEAT, "l_returnflag", "l_partkey").select("check", "passed")


# --- drift ----------------------------------------------------------------------------------------------

_DF = ["l_quantity", "l_extendedprice", "l_discount"]
_CUT = "l_shipdate < TIMESTAMP '1998-06-01'"
_U = f"b AS ({_unpivot(_DF, where='WHERE ' + _CUT)}), n AS ({_unpivot(_DF, where='WHERE NOT ' + _CUT)})"
_PSI = f"""{_U}, ed AS (SELECT feature, list_sort(list_distinct(list(q))) AS edges FROM (SELECT feature, unnest(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q FROM b GROUP BY feature) GROUP BY feature),
  pl AS (SELECT s.*, least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2) AS bin FROM (SELECT *, 1 AS base FROM b UNION ALL SELECT *, 0 FROM n) s JOIN ed USING (feature) WHERE value BETWEEN edges[1] AND edges[-1]),
  bc AS (SELECT feature, bin, sum(base) AS e, sum(1 - base) AS a FROM pl GROUP BY ALL), sh AS (SELECT feature, least(greatest(e / (sum(e) OVER (PARTITION BY feature) + 1e-4::DOUBLE), 1e-4::DOUBLE), 1) AS e, least(greatest(a / (sum(a) OVER (PARTITION BY feature) + 1e-4::DOUBLE), 1e-4::DOUBLE), 1) AS a FROM bc),
  psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM sh GROUP BY feature)"""
_KS = """kc AS (SELECT feature, value, sum(base) AS cb, sum(1 - base) AS cn FROM (SELECT *, 1 AS base FROM b UNION ALL SELECT *, 0 FROM n) GROUP BY ALL), kr AS (SELECT feature, sum(cb) OVER w AS ub, sum(cn) OVER w AS un, sum(cb) OVER p AS tb, sum(cn) OVER p AS tn FROM kc
  WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)), kd AS (SELECT feature, max(abs(ub / tb::DOUBLE - un / tn::DOUBLE)) AS ks, any_value(tb)::BIGINT AS n, any_value(tn)::BIGINT AS m FROM kr GROUP BY 1),
  kt AS (SELECT *, (sqrt(n::DOUBLE * m / (n + m)) + 0.12 + 0.11 / sqrt(n::DOUBLE * m / (n + m))) * ks AS t FROM kd), kp AS (SELECT feature, ks, n, m, CASE WHEN t < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda j: 2.0 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * t * t))), 0), 1) END AS p_value FROM kt)"""


def _halves(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter(_CUT.replace("TIMESTAMP ", "TIMESTAMP_NTZ ")), li.filter("NOT " + _CUT.replace("TIMESTAMP ", "TIMESTAMP_NTZ "))


@query("dr01_psi", f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def dr01(spark, sf):
    return rounded(D.psi(*_halves(spark, sf), _DF), 6)


@query("dr02_ks_two_sample", f"WITH {_U}, {_KS} SELECT feature, round(ks, 6) AS ks, n, m, round(p_value, 6) AS p_value FROM kp")
def dr02(spark, sf):
    return rounded(D.ks_two_sample(*_halves(spark, sf), _DF), 6)


_MS = "ms AS (SELECT feature, bm AS baseline_mean, nm AS new_mean, abs(nm - bm) / (s + 1e-8::DOUBLE) AS mean_shift FROM (SELECT feature, avg(value) AS bm, stddev_pop(value) AS s FROM b GROUP BY 1) JOIN (SELECT feature, avg(value) AS nm FROM n GROUP BY 1) USING (feature))"


@query("dr03_mean_shift", f"WITH {_U}, {_MS} SELECT feature, round(baseline_mean, 6) AS baseline_mean, round(new_mean, 6) AS new_mean, round(mean_shift, 6) AS mean_shift FROM ms")
def dr03(spark, sf):
    return rounded(D.mean_shift(*_halves(spark, sf), _DF), 6)


@query("dr04_drift_report", f"""WITH {_PSI}, {_KS}, {_MS} SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(p_value, 6) AS p_value, round(baseline_mean, 6) AS baseline_mean, round(new_mean, 6) AS new_mean, round(mean_shift, 6) AS mean_shift,
  psi > 0.2 OR p_value < 0.01 AS drifted, round(avg(psi) OVER (), 6) AS overall_psi FROM psi JOIN kp USING (feature) JOIN ms USING (feature)""")
def dr04(spark, sf):
    return rounded(D.drift_report(*_halves(spark, sf), _DF), 6)


@query("dr04_prediction_shares", "SELECT l_returnflag, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM lineitem GROUP BY 1")
def dr04b(spark, sf):
    return rounded(D.prediction_shares(table(spark, sf, "lineitem"), "l_returnflag"), 6)


@query("dr05_drift_baseline", f"WITH {_U} SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, least(count(*), 2000) AS n_sample FROM b GROUP BY 1")
def dr05(spark, sf):
    stats, sample = D.drift_baseline(_halves(spark, sf)[0], _DF, sample=2000)
    return rounded(stats.join(sample.groupBy("feature").agg(F.count("*").alias("n_sample")), "feature"), 6)


@query("dr05_psi_against_saved", f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def dr05b(spark, sf):
    from offerloom.session import scratch_path

    base, new = _halves(spark, sf)
    path = scratch_path(spark, "drift-baseline")
    D.save_baseline(base, _DF, path)
    return rounded(D.psi_against_saved(new, D.load_baseline(spark, path), _DF), 6)


# --- gates --------------------------------------------------------------------------------------------------

_RUNS = """runs AS (SELECT 'run-' || c_custkey AS run_name, 'b' AS model_backend, 't' AS target_column, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'top,good' END AS class_names, 'h' AS data_hash, c_custkey % 13 <> 0 AS leakage_check_passed,
  0.5 + (c_custkey % 51) / 100::DOUBLE AS accuracy, 0.5 + (c_custkey % 47) / 100::DOUBLE AS f1_macro, 0.5 + (c_custkey % 11) / 50::DOUBLE AS baseline_accuracy, (c_custkey % 130)::DOUBLE AS model_size_mb, (c_custkey % 4)::INT AS n_features, (c_custkey % 5)::INT AS n_blocked_documented FROM customer),
  ck(run_name, "check", passed, severity) AS (SELECT run_name, 'metadata_complete', class_names IS NOT NULL, 'error' FROM runs UNION ALL SELECT run_name, 'leakage_check_passed', leakage_check_passed, 'error' FROM runs UNION ALL SELECT run_name, 'min_accuracy', accuracy >= 0.6::DOUBLE, 'error' FROM runs
  UNION ALL SELECT run_name, 'max_accuracy', accuracy < 0.995::DOUBLE, 'warning' FROM runs UNION ALL SELECT run_name, 'baseline_gap', accuracy - baseline_accuracy >= 0.05::DOUBLE, 'error' FROM runs UNION ALL SELECT run_name, 'no_perfect_metrics', greatest(accuracy, f1_macro) < 1.0 - 1e-6::DOUBLE, 'error' FROM runs
  UNION ALL SELECT run_name, 'high_accuracy', accuracy < 0.98::DOUBLE, 'warning' FROM runs UNION ALL SELECT run_name, 'model_size', model_size_mb <= 100, 'warning' FROM runs UNION ALL SELECT run_name, 'feature_list_present', n_features > 0, 'warning' FROM runs UNION ALL SELECT run_name, 'leaky_features_documented', n_blocked_documented > 0, 'warning' FROM runs)"""


def _runs(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat('run-', c_custkey) AS run_name", "'b' AS model_backend", "'t' AS target_column", "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'top,good' END AS class_names", "'h' AS data_hash", "c_custkey % 13 <> 0 AS leakage_check_passed",
        "0.5D + (c_custkey % 51) / 100D AS accuracy", "0.5D + (c_custkey % 47) / 100D AS f1_macro", "0.5D + (c_custkey % 11) / 50D AS baseline_accuracy", "cast(c_custkey % 130 AS double) AS model_size_mb",
        "cast(c_custkey % 4 AS int) AS n_features", "cast(c_custkey % 5 AS int) AS n_blocked_documented")


@query("gt01_gate_checks", f"WITH {_RUNS} SELECT * FROM ck")
def gt01(spark, sf):
    return V.gate_runs(_runs(spark, sf))[0]


@query("gt01_gate_verdicts", f"""WITH {_RUNS} SELECT run_name, count(*) FILTER (NOT passed) = 0 AS passed, count(*) FILTER (NOT passed AND severity = 'error') AS n_errors, count(*) FILTER (NOT passed AND severity = 'warning') AS n_warnings FROM ck GROUP BY 1""")
def gt01b(spark, sf):
    return V.gate_runs(_runs(spark, sf), strict=True)[1]


@query("gt02_source_contract", r"""SELECT 'present:page_id' AS "check", true AS passed, 0::BIGINT AS n_bad UNION ALL SELECT 'present:title', false, 1 UNION ALL SELECT 'format:url', count(*) FILTER (NOT regexp_matches(url, '^https://')) = 0, count(*) FILTER (NOT regexp_matches(url, '^https://')) FROM pages
  UNION ALL SELECT 'clean:url', count(*) FILTER (regexp_matches(url, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00A0}]')) = 0, count(*) FILTER (regexp_matches(url, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00A0}]')) FROM pages
  UNION ALL SELECT 'clean:html', count(*) FILTER (regexp_matches(html, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00A0}]')) = 0, count(*) FILTER (regexp_matches(html, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00A0}]')) FROM pages""")
def gt02(spark, sf):
    return V.source_contract(table(spark, sf, "pages"), ["page_id", "title"], {"url": "^https://"})


@query("gt02_types_and_entries", r"""WITH d AS (SELECT *, doc_id % 6 <> 0 AS a, doc_id % 10 <> 0 AS s FROM documents)
  SELECT 'present:doc_id' AS "check", true AS passed, 0::BIGINT AS n_bad UNION ALL SELECT 'type:doc_id', true, 0 UNION ALL SELECT 'type:text', false, 1
  UNION ALL SELECT 'clean:text', count(*) FILTER (regexp_matches(text, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00A0}]')) = 0, count(*) FILTER (regexp_matches(text, '[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00A0}]')) FROM d
  UNION ALL SELECT 'keys:indicators', count(*) FILTER (NOT a) = 0, count(*) FILTER (NOT a) FROM d UNION ALL SELECT 'entries:indicators', count(*) FILTER (NOT s) = 0, count(*) FILTER (NOT s) FROM d""")
def gt02b(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.create_map(
        F.when(F.col("doc_id") % 6 != 0, "reputation").otherwise("other"),
        F.struct(F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("score"), F.col("doc_id").alias("rank"))).alias("indicators"))
    return V.source_contract(d, ["doc_id"], {}, {"doc_id": "bigint", "text": "bigint"}, {"indicators": (["reputation"], ["score", "rank"])})
