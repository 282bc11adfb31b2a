"""Searches, paging, sets and request checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from offerloom.operators import leakage, search as Q
from offerloom.plans import catalog as K
from offerloom.registry import query, table


@query("flt01_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42")
def flt01(spark, sf):
    return Q.lookup(table(spark, sf, "orders"), "o_custkey", 42).select("o_orderkey", "o_custkey", "o_totalprice")


@query("flt02_search_offers", f"""WITH {K.FULL_OFFERS} SELECT source_url, country, degree_type, round(tuition, 2) AS tuition FROM full_offers
  WHERE country = 'NATION_3' AND degree_type = 'LARGE' AND gpa_requirement_min <= 3.0 AND tuition <= 50000 AND
  (contains(lower(university_name), 'brand#1') OR contains(lower(program_name), 'brand#1')) ORDER BY source_url LIMIT 50""")
def flt02(spark, sf):
    d = Q.search_offers(K.full_offers(spark, sf), country="NATION_3", degree_type="LARGE", min_gpa=3.0, max_tuition=50000, query="Brand#1", tuition="tuition")
    return d.select("source_url", "country", "degree_type", F.round("tuition", 2).alias("tuition"))


@query("flt03_search_contains", """SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_brand), 'd#1')
  AND p_type = 'SMALL' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 5""")
def flt03(spark, sf):
    d = Q.search_contains(table(spark, sf, "part"), {"p_name": "RING", "p_brand": "d#1"}, {"p_type": "SMALL", "p_size": None}, ["p_name", "p_partkey"], 20, 5)
    return d.select("p_partkey", "p_name", "p_brand")


@query("flt04_search_entities", f"""WITH {K.ENTITIES} SELECT entity_id, name, tier, rank FROM entities WHERE
  (contains(lower(name), '00 college') OR len(list_filter(aliases, lambda a: contains(lower(a), '0 college'))) > 0)
  AND tier <> 'x' AND type = 'public' AND rank BETWEEN 100 AND 9000""")
def flt04(spark, sf):
    return Q.search_entities(K.entities(spark, sf), query="0 College", kind="public", lo=100, hi=9000).select("entity_id", "name", "tier", "rank")


@query("flt05_text_search", """WITH terms AS (SELECT unnest(['the', 'and', 'que', 'thou', 'nicht']) AS term),
  toks AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
  hit AS (SELECT doc_id, term FROM toks SEMI JOIN terms USING (term)), n AS (SELECT count(*) AS n FROM documents),
  idf AS (SELECT term, ln((any_value(n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf FROM hit, n GROUP BY term)
  SELECT doc_id, count(*) AS n_terms, round(sum(idf), 6) AS score FROM hit JOIN idf USING (term) GROUP BY doc_id""")
def flt05(spark, sf):
    d = Q.text_search(table(spark, sf, "documents"), "doc_id", "text", ["the", "and", "que", "thou", "Nicht"])
    return d.select("doc_id", "n_terms", F.round("score", 6).alias("score"))


@query("flt06_recent", """SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 100""")
def flt06(spark, sf):
    return Q.recent(table(spark, sf, "events"), "ts", dt.datetime(2024, 1, 30), 7, 100, "event_id").select("event_id", "user_id")


@query("flt07_filter_by_url_pattern", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]*example\.(com|org)/')")
def flt07(spark, sf):
    return Q.filter_by_url_pattern(table(spark, sf, "pages"), "url", r"^https?://[^/]*example\.(com|org)/").select("page_id", "url")


@query("flt08_browse", f"""WITH {K.OFFERS} SELECT offer_id, university_name, country, (SELECT count(*) FROM offers WHERE degree_level = 'Masters' AND program_category = 'SMALL') AS total
  FROM offers WHERE degree_level = 'Masters' AND program_category = 'SMALL' ORDER BY offer_id LIMIT 100""")
def flt08(spark, sf):
    return Q.browse(K.offers(spark, sf), {"country": None, "degree_level": "Masters", "program_category": "SMALL"}, ["offer_id", "university_name", "country"], ["offer_id"])


_FLAGS = """CASE WHEN gpa >= 3.8 AND budget < 1000 THEN 'suspicious: high gpa with tiny budget' END, CASE WHEN budget > 200000 THEN 'unrealistic: budget too high' END,
  CASE WHEN budget <= 0 THEN 'invalid: budget must be positive' END, CASE WHEN gpa < 0 OR gpa > 4 THEN 'invalid: gpa outside [0, 4]' END,
  CASE WHEN n > 10 THEN 'suspicious: too many countries' END,
  CASE WHEN coalesce(gpa, 0) = 0 AND coalesce(budget, 0) = 0 AND n = 0 THEN 'empty: no filters' END"""


@query("flt11_flag_profiles", f"""WITH p AS (SELECT c_custkey AS profile_id, (c_custkey % 45) / 10::DOUBLE AS gpa,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal * CASE WHEN c_custkey % 13 = 0 THEN 40 ELSE 1 END END AS budget, c_custkey % 13 AS n FROM customer)
  SELECT profile_id, concat_ws('|', {_FLAGS}) AS warnings FROM p""")
def flt11(spark, sf):
    p = table(spark, sf, "customer").selectExpr(
        "c_custkey AS profile_id", "(c_custkey % 45) / 10D AS gpa",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal * CASE WHEN c_custkey % 13 = 0 THEN 40 ELSE 1 END END AS budget",
        "slice(array_repeat(c_nationkey, 13), 1, cast(c_custkey % 13 AS int)) AS countries")
    return Q.flag_profiles(p).select("profile_id", F.array_join("warnings", "|").alias("warnings"))


_HITS = " + ".join(f"contains(lower(html), '{w}')::INT" for w in ["computer science", "masters", "bachelor", "phd", "admission", "tuition", "requirements", "application"])


@query("flt12_classify_urls", f"""WITH u AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN replace(url, 'example.com', 'school.edu') WHEN 1 THEN replace(url, '://', ':') ELSE url END AS url FROM pages),
  h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM u)
  SELECT page_id, CASE WHEN host = '' THEN 'Invalid URL structure' WHEN NOT (regexp_matches(host, '\\.edu$') OR regexp_matches(host, 'university|college|institute|school')) THEN 'Not a recognized university domain'
  WHEN {_HITS} < 2 THEN 'Content does not appear to be program information' ELSE 'Valid university program URL' END AS url_reason FROM h""")
def flt12(spark, sf):
    p = table(spark, sf, "pages").selectExpr(
        "page_id", "html", "CASE page_id % 4 WHEN 0 THEN replace(url, 'example.com', 'school.edu') WHEN 1 THEN replace(url, '://', ':') ELSE url END AS url")
    return Q.classify_urls(p, "url", "html").select("page_id", "url_reason")


@query("top01_top_ranked", f"WITH {K.ENTITIES} SELECT entity_id, rank FROM entities WHERE rank IS NOT NULL ORDER BY rank, entity_id LIMIT 10")
def top01(spark, sf):
    return Q.top_ranked(K.entities(spark, sf), "rank", "entity_id", 10).select("entity_id", "rank")


@query("top02_page", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25 OFFSET 100")
def top02(spark, sf):
    return Q.page(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"], 25, 100)


@query("top03_best_run", """SELECT m AS run_name, f1 FROM (SELECT strftime(l_shipdate, '%Y-%m') AS m, round(avg(l_discount), 8) AS f1 FROM lineitem GROUP BY 1) ORDER BY f1 DESC, m DESC LIMIT 1""")
def top03(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("run_name")).agg(F.round(F.avg("l_discount"), 8).alias("f1"))
    return Q.best_run(runs, "f1", "run_name")


@query("set01_group_overlap", """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1995-03-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-05-01'),
  i AS (SELECT o_custkey FROM a INTERSECT SELECT o_custkey FROM b), u AS (SELECT o_custkey FROM a UNION SELECT o_custkey FROM b)
  SELECT (SELECT count(*) FROM i) AS overlap, (SELECT count(*) FROM u) AS groups, round((SELECT count(*) FROM i) / (SELECT count(*) FROM u)::DOUBLE, 6) AS ratio,
  (SELECT string_agg(o_custkey::VARCHAR, ',' ORDER BY o_custkey) FROM (SELECT o_custkey FROM i ORDER BY o_custkey LIMIT 5)) AS examples, (SELECT count(*) FROM i) = 0 AS passed""")
def set01(spark, sf):
    o = table(spark, sf, "orders")
    d = leakage.group_overlap(o.filter("o_orderdate < DATE '1995-03-01'"), o.filter("o_orderdate >= DATE '2001-05-01'"), "o_custkey")
    return d.withColumn("ratio", F.round("ratio", 6))


@query("set02_drop_exact_duplicates", "SELECT DISTINCT p_name, p_brand, p_type FROM part")
def set02(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_brand", "p_type").dropDuplicates()


@query("set02_duplicate_count", "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part)) AS n_removed FROM part")
def set02b(spark, sf):
    d = table(spark, sf, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_removed"))


@query("set03_page_overlap", """SELECT l_partkey, count(DISTINCT l_returnflag) AS n_batches FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1""")
def set03(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").distinct()
    return pairs.groupBy("l_partkey").agg(F.count("*").alias("n_batches")).filter("n_batches > 1")


@query("set04_distinct_sorted", "SELECT DISTINCT p_name FROM part ORDER BY p_name")
def set04(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().orderBy("p_name")
