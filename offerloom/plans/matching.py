"""Matching, lookups, expansion and change reports on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import fixed
from offerloom.operators import match as M
from offerloom.plans import catalog as K
from offerloom.registry import query, table

# entities: customers named after their segment and nation, some places empty; rankings: suppliers
_ENT = """e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'University of Supplier ' || (c_custkey % 150) ELSE 'Nowhere ' || c_custkey END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN ['x', 'The SUPPLIER ' || (c_custkey % 70)] ELSE NULL END AS alternates, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS rank,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'C' || c_nationkey END AS country, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE 'T' || c_nationkey END AS city FROM customer)"""
_RANK = """r0 AS (SELECT l_orderkey * 10 + l_linenumber AS pos, 'Supplier ' || (l_suppkey % 60) AS uni, (l_partkey % 50)::INT AS rk, 'RC' || (l_partkey % 9) AS country, 'RT' || (l_partkey % 8) AS city FROM lineitem)"""


def _entities(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN concat('University of Supplier ', c_custkey % 150) ELSE concat('Nowhere ', c_custkey) END AS name",
        "CASE WHEN c_custkey % 3 = 0 THEN array('x', concat('The SUPPLIER ', c_custkey % 70)) END AS alternates", "CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS rank",
        "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('C', c_nationkey) END AS country", "CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE concat('T', c_nationkey) END AS city")


def _rankings(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS pos", "concat('Supplier ', l_suppkey % 60) AS uni", "cast(l_partkey % 50 AS int) AS rk",
        "concat('RC', l_partkey % 9) AS country", "concat('RT', l_partkey % 8) AS city")


def _by_name(pick):
    return f"""WITH {_ENT}, {_RANK}, r AS (SELECT 'supplier ' || regexp_extract(uni, '[0-9]+') AS k, arg_{pick}(rk, pos * 1000 + rk) AS rk, arg_{pick}(country, pos * 1000 + rk) AS country, arg_{pick}(city, pos * 1000 + rk) AS city FROM r0 GROUP BY 1),
  n AS (SELECT id, 0 AS p, name AS nm FROM e UNION ALL SELECT id, 1, alternates[1] FROM e WHERE alternates IS NOT NULL UNION ALL SELECT id, 2, alternates[2] FROM e WHERE alternates IS NOT NULL),
  k AS (SELECT id, p, trim(replace(replace(replace(lower(nm), 'university of', ''), 'the ', ''), ',', '')) AS k FROM n),
  b AS (SELECT id, arg_min(r.rk, p) AS rk, arg_min(r.country, p) AS country, arg_min(r.city, p) AS city FROM k JOIN r USING (k) GROUP BY id)
  SELECT e.id, b.id IS NOT NULL AS matched, CASE WHEN b.rk <> 0 THEN b.rk ELSE e.rank END AS rank, coalesce(nullif(e.country, ''), b.country, e.country) AS country, coalesce(nullif(e.city, ''), b.city, e.city) AS city FROM e LEFT JOIN b ON e.id = b.id"""


def _matched(spark, sf, keep):
    r = _rankings(spark, sf).withColumn("ord", F.col("pos") * 1000 + F.col("rk"))  # positions repeat rarely: rank settles it
    d = M.match_by_name(_entities(spark, sf), r, "id", "name", "alternates", "uni", "ord", "rk", keep)
    return d.select("id", "matched", "rank", "country", "city")


@query("jn01_match_by_name", _by_name("max"))
def jn01(spark, sf):
    return _matched(spark, sf, "last")


@query("jn02_match_first", _by_name("min"))
def jn02(spark, sf):
    return _matched(spark, sf, "first")


_CONT = """pe AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN 'The ' || upper(p_name) WHEN 2 THEN split_part(p_name, ' ', 2) ELSE p_type || p_brand END AS name,
  CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS rank, '' AS country, 'T' AS city FROM part),
  pr AS (SELECT min(p_partkey) AS pos, p_name AS uni, (min(p_partkey) % 40)::INT AS rk, 'RC' || (min(p_partkey) % 9) AS country, 'RT' AS city FROM part GROUP BY p_name),
  kk AS (SELECT DISTINCT trim(replace(lower(name), 'the ', '')) AS k FROM pe), bb AS (SELECT k, arg_min(rk, pos) AS rk, arg_min(country, pos) AS country, arg_min(uni, pos) AS uni FROM kk JOIN pr ON contains(k, uni) OR contains(uni, k) GROUP BY k)"""


def _cont_input(spark, sf):
    p = table(spark, sf, "part")
    e = p.selectExpr("p_partkey AS id", "CASE p_size % 4 WHEN 0 THEN concat(p_name, ' ', lower(p_type)) WHEN 1 THEN concat('The ', upper(p_name)) WHEN 2 THEN split_part(p_name, ' ', 2) ELSE concat(p_type, p_brand) END AS name",
                     "CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS rank", "'' AS country", "'T' AS city")
    r = p.groupBy(F.col("p_name").alias("uni")).agg(F.min("p_partkey").alias("pos")).selectExpr("pos", "uni", "cast(pos % 40 AS int) AS rk", "concat('RC', pos % 9) AS country", "'RT' AS city")
    return e, r


@query("jn03_match_by_containment", f"WITH {_CONT} SELECT id, bb.uni AS uni, bb.rk AS rk FROM pe LEFT JOIN bb ON bb.k = trim(replace(lower(name), 'the ', ''))")
def jn03(spark, sf):
    e, r = _cont_input(spark, sf)
    return M.match_by_containment(e, r, "name", "uni", "pos").select("id", F.col("_r.uni").alias("uni"), F.col("_r.rk").alias("rk"))


@query("jn06_fill_from_ranking", f"""WITH {_CONT} SELECT id, bb.k IS NOT NULL AS matched, coalesce(nullif(rank, 0), nullif(bb.rk, 0), rank) AS rank, coalesce(bb.country, pe.country) AS country FROM pe
  LEFT JOIN bb ON bb.k = trim(replace(lower(name), 'the ', ''))""")
def jn06(spark, sf):
    e, r = _cont_input(spark, sf)
    return M.fill_from_ranking(e, r, "name", "uni", "pos", "rk").select("id", "matched", "rank", "country")


@query("jn04_alias_join", """SELECT l_orderkey, l_linenumber, coalesce(s_name, 'S' || l_suppkey) AS supplier FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON 'S' || l_suppkey = 'S' || s_suppkey""")
def jn04(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), "l_suppkey").alias("supplier"))
    al = table(spark, sf, "supplier").filter("s_suppkey % 4 <> 0").select(F.concat(F.lit("S"), "s_suppkey").alias("alias"), F.col("s_name").alias("target"))
    return M.alias_join(li, al, "supplier", "alias", "target")


@query("jn05_fill_from_reference", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN coalesce(n_name, '') ELSE c_mktsegment END AS country, CASE WHEN c_custkey % 5 = 0 THEN coalesce(nullif(n_regionkey, 0), 0) ELSE 7 END AS rank
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 1) ON c_nationkey = n_nationkey""")
def jn05(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS country", "CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 7 END AS rank")
    n = table(spark, sf, "nation").filter("n_nationkey % 6 <> 1").selectExpr("n_nationkey", "n_name AS country", "n_regionkey AS rank")
    return M.fill_from_reference(c, n, "c_nationkey", "n_nationkey", ["country"], ["rank"]).select("c_custkey", "country", "rank")


@query("jn07_attach_parent_ids", """SELECT p_partkey, substr(md5(regexp_replace(lower('University of ' || p_brand), '[^a-z0-9 ]', '', 'g')), 1, 12) AS university_id FROM part""")
def jn07(spark, sf):
    o = K.offers(spark, sf)
    parents = M.parents_of(o, "university_name", "offer_id", ["country"])
    return M.attach_parent_ids(o, parents, "university_name").select(F.col("offer_id").alias("p_partkey"), "university_id")


@query("jn07_parents", f"""WITH {K.OFFERS} SELECT university_name, arg_min(country, offer_id) AS country, count(*) AS n_offers, substr(md5(regexp_replace(lower(university_name), '[^a-z0-9 ]', '', 'g')), 1, 12) AS university_id FROM offers GROUP BY university_name""")
def jn07b(spark, sf):
    return M.parents_of(K.offers(spark, sf), "university_name", "offer_id", ["country"])


@query("jn08_parents_with_children_stats", """WITH c AS (SELECT 'Brand#' || (p_size % 30) AS brand, p_name, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END AS d, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS fee FROM part),
  s AS (SELECT brand, count(*) AS n, avg(CASE WHEN trim(d) <> '' THEN 1 ELSE 0 END) AS dc, avg(CASE WHEN fee <> 0 THEN 1 ELSE 0 END) AS fc, count(*) - count(DISTINCT lower(p_name)) AS dup FROM c GROUP BY 1)
  SELECT b AS name, coalesce(n, 0) AS n_offers, round(coalesce(dc, 0), 6) AS description_coverage, round(coalesce(fc, 0), 6) AS fee_coverage, coalesce(dup, 0) AS duplicates FROM (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN s ON b = brand""")
def jn08(spark, sf):
    p = table(spark, sf, "part")
    ch = p.selectExpr("concat('Brand#', p_size % 30) AS brand", "p_name", "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END AS d", "CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS fee")
    d = M.parents_with_children_stats(p.select(F.col("p_brand").alias("name")).distinct(), ch, "name", "brand", "p_name", "d", "fee")
    return d.select("name", "n_offers", F.round("description_coverage", 6).alias("description_coverage"), F.round("fee_coverage", 6).alias("fee_coverage"), "duplicates")


@query("jn09_expected_coverage", """SELECT n_nationkey, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'OK' ELSE 'NO DATA' END AS status FROM nation LEFT JOIN
  (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def jn09(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 9000").withColumnRenamed("c_nationkey", "n_nationkey")
    return M.expected_coverage(table(spark, sf, "nation").select("n_nationkey"), c, "n_nationkey")


@query("jn09_coverage_verdict", """SELECT count(*) AS expected, count(n) AS found, round(count(n) * 100 / count(*)::DOUBLE, 4) AS pct, count(n) * 100 / count(*)::DOUBLE >= 70 AS passed FROM nation LEFT JOIN
  (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey""")
def jn09b(spark, sf):
    d = M.coverage_verdict(jn09(spark, sf))
    return d.withColumn("pct", F.round(F.col("pct").cast("double"), 4))


_COUNTRIES = list(fixed.COUNTRY_TUITION)[:20] + ["Atlantis", "Erewhon"]
_pick = lambda c, items: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


def _map_sql(c, mapping, default):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items()) + f" ELSE {default!r} END"


@query("jn10_lookup_with_default", f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_pick('l_suppkey % 22', _COUNTRIES)} AS country, CASE l_partkey % 3 WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS t FROM lineitem)
  SELECT l_orderkey, l_linenumber, trunc({_map_sql('country', {k: v[0] for k, v in fixed.COUNTRY_TUITION.items()}, 3000)} * t)::BIGINT AS tuition_domestic,
  trunc({_map_sql('country', {k: v[1] for k, v in fixed.COUNTRY_TUITION.items()}, 10000)} * t)::BIGINT AS tuition_international, {_map_sql('country', {k: v[2] for k, v in fixed.COUNTRY_TUITION.items()}, 'USD')} AS tuition_currency,
  ({_map_sql('country', fixed.COUNTRY_IELTS, 6.0)})::DOUBLE AS ielts_min, ({_map_sql('country', fixed.COUNTRY_TOEFL, 80)})::INT AS toefl_min, ({_map_sql('country', fixed.COUNTRY_LIVING_COST, 8000)})::INT AS cost_of_living FROM x""")
def jn10(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_pick('l_suppkey % 22', _COUNTRIES)} AS country",
                                                "CASE l_partkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'good' ELSE 'standard' END AS tier")
    return M.country_defaults(x, "country", "tier").drop("country", "tier")


TEMPLATES = {
    "Computing": [("Computer Science", "MSc"), ("Data Science", "MSc"), ("Software Engineering", "BSc"), ("Computer Science", "PhD")],
    "Business": [("Business Administration", "MBA"), ("Finance", "MSc"), ("Marketing", "MSc"), ("Management", "PhD")],
    "Engineering": [("Mechanical Engineering", "MEng"), ("Civil Engineering", "BEng"), ("Engineering", "PhD")],
    "Medical": [("Public Health", "MPH"), ("Nursing", "BSc")],
    "Law": [("Law", "LLM"), ("Law", "LLB")],
    "Arts": [("History", "MA"), ("Music", "BA"), ("Philosophy", "PhD")],
    "Sciences": [("Physics", "MSc"), ("Biology", "BSc"), ("Chemistry", "PhD")],
    "Education": [("Education", "MEd")],
}


@query("jn11_expand_catalog")
def jn11(spark, sf):
    s = table(spark, sf, "customer").selectExpr("c_name AS name", "cast(c_custkey % 900 + 1 AS int) AS rank")
    return M.expand_catalog(s, TEMPLATES, "name", "rank")


@query("jn11_expand_catalog_sizes", """WITH c AS (SELECT c_custkey % 900 + 1 AS rk FROM customer), t(cat, taught, doc) AS (VALUES ('Computing', 3, 1), ('Business', 3, 1), ('Engineering', 2, 1), ('Medical', 2, 0), ('Law', 2, 0), ('Arts', 2, 1), ('Sciences', 2, 1), ('Education', 1, 0))
  SELECT cat AS category, sum(least(taught, CASE WHEN rk <= 100 THEN 3 ELSE 2 END) + doc)::BIGINT AS n FROM c, t WHERE rk <= 200 GROUP BY 1""")
def jn11b(spark, sf):
    # up to rank 200 every category is taken, so the sizes are known without the hash
    s = table(spark, sf, "customer").selectExpr("c_name AS name", "cast(c_custkey % 900 + 1 AS int) AS rank").filter("rank <= 200")
    return M.expand_catalog(s, TEMPLATES, "name", "rank").groupBy("category").agg(F.count("*").alias("n"))


@query("jn12_backfill_from_discovery", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND k IS NOT NULL THEN p_brand WHEN p_size % 3 = 0 THEN 'Other' ELSE p_type END AS category,
  CASE WHEN p_size % 2 = 0 AND k IS NOT NULL THEN 'PhD' WHEN p_size % 2 = 0 THEN 'Masters' ELSE 'Graduate' END AS degree_level FROM part LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0) ON k = p_partkey""")
def jn12(spark, sf):
    p = table(spark, sf, "part")
    o = p.selectExpr("p_partkey", "concat('u', p_partkey) AS url", "CASE WHEN p_size % 3 = 0 THEN 'Other' ELSE p_type END AS category", "CASE WHEN p_size % 2 = 0 THEN 'Masters' ELSE 'Graduate' END AS degree_level")
    l = p.filter("p_partkey % 5 <> 0").selectExpr("concat('u', p_partkey) AS link", "p_brand AS category", "'PhD' AS degree_level", "p_size AS place")
    again = l.selectExpr("link", "'A later link' AS category", "'Another' AS degree_level", "place + 1 AS place")
    return M.backfill_from_discovery(o, l.unionByName(again), "url", "link", "place").drop("url")


@query("jn13_new_only", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= DATE '2001-06-01' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < DATE '1996-01-01')")
def jn13(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.new_only(li.filter("l_shipdate >= DATE '2001-06-01'").select("l_partkey"), li.filter("l_shipdate < DATE '1996-01-01'").select("l_partkey"), "l_partkey")


_DIFF = """d AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'o_totalprice' END, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 THEN 'o_orderstatus' END) AS changed FROM orders WHERE o_orderkey % 11 <> 0)"""


def _diff(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    a = o.filter("o_orderkey % 11 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice",
                                                    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return M.diff_tables(o, a, "o_orderkey", ["o_totalprice", "o_orderstatus", "o_orderpriority"])


@query("jn14_diff_tables", f"WITH {_DIFF} SELECT * FROM d")
def jn14(spark, sf):
    return _diff(spark, sf).withColumn("changed", F.array_join("changed", ","))


@query("jn14_diff_totals", f"""WITH {_DIFF} SELECT count(*) FILTER (changed <> '') AS updated, count(*) FILTER (changed = '') AS unchanged, count(*) FILTER (contains(changed, 'price')) AS updated_o_totalprice,
  count(*) FILTER (contains(changed, 'status')) AS updated_o_orderstatus FROM d""")
def jn14b(spark, sf):
    return M.diff_totals(_diff(spark, sf), ["o_totalprice", "o_orderstatus"])
