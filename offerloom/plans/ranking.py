"""Tiers, scores, recommendations, similarity, ranking windows and ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import columns as C, fixed
from offerloom.operators import evaluate as E, prefix, recommend as R, similar as S, tiers as T
from offerloom.plans import catalog as K
from offerloom.registry import query, table

_SYSTEMS = [s for s, _, _, _ in fixed.RANKING_SYSTEMS]
_W = {s: w for s, _, _, w in fixed.RANKING_SYSTEMS}
_VAL = ", ".join(f"({i}, '{s}', '{scope}', {m}, {w or 0})" for i, (s, scope, m, w) in enumerate(fixed.RANKING_SYSTEMS))

# every customer appears in some of the nine systems, some ranks only as display text, some entries twice
_LONG = f"""sys(i, ranking_type, scope, largest, w) AS (VALUES {_VAL}),
  raw AS (SELECT c_custkey AS entity, ranking_type, scope, largest::DOUBLE AS largest, w::DOUBLE AS w, i AS pos, (c_custkey * (i + 7) % (largest + 60))::INT AS rk FROM customer, sys WHERE (c_custkey + i * i) % 4 = 0),
  clean AS (SELECT * FROM raw WHERE rk > 0)"""


def _long(spark, sf):
    sysrows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("ranking_type"), F.lit(m).alias("largest")) for i, (s, _, m, _) in enumerate(fixed.RANKING_SYSTEMS)])
    x = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.explode(sysrows).alias("s")).select("entity", "s.*")
    x = x.filter((F.col("entity") + F.col("pos") * F.col("pos")) % 4 == 0).withColumn("rk", (F.col("entity") * (F.col("pos") + 7) % (F.col("largest") + 60)).cast("int"))
    x = x.withColumn("rank", F.when(F.col("entity") % 3 != 0, F.col("rk"))).withColumn("rank_display", F.when(F.col("rk") > 0, F.concat(F.lit(" #"), F.col("rk"), F.when(F.col("entity") % 2 == 0, "-9999").otherwise("+"))))
    again = x.filter(F.col("entity") % 5 == 0).withColumn("pos", F.col("pos") + 100).withColumn("rank", F.lit(1)).withColumn("rank_display", F.lit("1"))
    return x.unionByName(again).select("entity", "ranking_type", "pos", "rank", "rank_display")


@query("tier01_derive_tier", f"""WITH {_LONG}, p AS (SELECT *, greatest(0, 1 - (rk - 1) / largest) AS pts FROM clean),
  a AS (SELECT entity, max(CASE WHEN scope = 'world' THEN rk END) AS world_rank, sum(CASE WHEN scope <> 'regional' THEN pts * w END) / sum(CASE WHEN scope <> 'regional' THEN w END) AS g, max(CASE WHEN scope = 'regional' THEN pts END) * 0.70::DOUBLE AS r,
    count(*) FILTER (scope <> 'regional') AS ng, count(*) FILTER (scope = 'regional') AS nr FROM p GROUP BY 1),
  c AS (SELECT c_custkey AS entity, world_rank, CASE WHEN world_rank IS NOT NULL THEN g ELSE r END AS comp, ng, nr FROM customer LEFT JOIN a ON entity = c_custkey)
  SELECT entity, world_rank, CASE WHEN comp >= 0.7 THEN 'top' WHEN comp >= 0.35 THEN 'good' ELSE 'standard' END AS tier, CASE WHEN world_rank IS NOT NULL THEN 'qs_world_primary' WHEN comp IS NOT NULL THEN 'regional_fallback' ELSE 'no_rankings' END AS path,
  round(coalesce(comp, 0), 4) AS composite, CASE WHEN world_rank IS NOT NULL THEN ng WHEN comp IS NOT NULL THEN nr ELSE 0 END AS n_signals FROM c""")
def tier01(spark, sf):
    return T.derive_tier(_long(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), "entity")


@query("tier02_tier_by_cuts", """SELECT c_custkey, CASE WHEN rk IS NULL THEN NULL WHEN rk <= 50 THEN 'top' WHEN rk <= 200 THEN 'good' ELSE 'standard' END AS a, CASE WHEN coalesce(rk, 9999) <= 100 THEN 'top' WHEN coalesce(rk, 9999) <= 500 THEN 'good' ELSE 'standard' END AS b
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 700 END AS rk FROM customer)""")
def tier02(spark, sf):
    x = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 700 END AS rk")
    names = ["top", "good", "standard"]
    return x.select("c_custkey", C.tier_by_cuts("rk", [50, 200], names).alias("a"), C.tier_by_cuts("rk", [100, 500], names, "standard").alias("b"))


@query("col02_extract_rank", f"WITH {_LONG} SELECT entity, rk AS rank FROM clean WHERE ranking_type = 'Asian University Rankings'")
def col02(spark, sf):
    x = T.standardise_ranks(T.dedup_first(_long(spark, sf), ["entity", "ranking_type"], "pos"))
    return T.extract_rank(x, "entity", "ranking_type", "Asian University Rankings")


@query("scr01_match_score", f"WITH {K.OFFERS}, {K.SCORED} SELECT offer_id, match_score FROM scored")
def scr01(spark, sf):
    return K.scored_offers(spark, sf).select("offer_id", "match_score")


@query("scr02_confidence_band", f"WITH {K.OFFERS} SELECT offer_id, CASE WHEN greatest(p_top, p_good, p_standard) >= 0.8 THEN 'high' WHEN greatest(p_top, p_good, p_standard) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM offers")
def scr02(spark, sf):
    return K.offers(spark, sf).select("offer_id", C.confidence_band(F.array("p_top", "p_good", "p_standard")).alias("band"))


# --- recommendations ---------------------------------------------------------------------------------


@query("rec01_recommend", f"""WITH {K.OFFERS}, {K.SCORED}, {K.PROFILES}, j AS (SELECT profile_id, offer_id, match_score, row_number() OVER (PARTITION BY profile_id ORDER BY match_score DESC, offer_id)::INT AS position
  FROM profiles p JOIN scored o ON {K.ELIGIBLE}) SELECT * FROM j WHERE position <= 10""")
def rec01(spark, sf):
    return R.recommend(K.profiles(spark, sf), K.scored_offers(spark, sf), 10)


@query("rec01_candidate_counts", f"WITH {K.OFFERS}, {K.PROFILES} SELECT profile_id, count(offer_id) AS n_candidates FROM profiles p LEFT JOIN offers o ON {K.ELIGIBLE} GROUP BY 1")
def rec01b(spark, sf):
    return R.candidate_counts(K.profiles(spark, sf), K.scored_offers(spark, sf), "profile_id", "offer_id", "match_score")


@query("flt09_eligible", f"WITH {K.OFFERS} SELECT offer_id, country, tuition FROM offers WHERE gpa_min <= 3.2 AND toefl_min <= 95 AND tuition <= 3000 AND degree_level = 'Masters'")
def flt09(spark, sf):
    profile = {"gpa": 3.2, "ielts": 0, "toefl": 95, "budget": 3000, "preferred_country": None, "degree_level": "Masters"}
    return R.eligible(K.offers(spark, sf), profile).select("offer_id", "country", "tuition")


@query("flt10_relax_if_empty", f"""WITH {K.OFFERS}, {K.PROFILES}, n AS (SELECT profile_id, count(offer_id) AS n FROM profiles p LEFT JOIN offers o ON {K.ELIGIBLE} GROUP BY 1),
  q AS (SELECT p.profile_id, n = 0 AS relaxed, CASE WHEN n = 0 THEN budget * 1.3::DOUBLE ELSE budget END AS budget, CASE WHEN n > 0 THEN gpa END AS gpa, CASE WHEN n > 0 THEN ielts END AS ielts, CASE WHEN n > 0 THEN toefl END AS toefl,
    CASE WHEN n > 0 THEN country END AS country, CASE WHEN n > 0 THEN degree_level END AS degree_level, CASE WHEN n > 0 THEN program_category END AS program_category FROM profiles p JOIN n USING (profile_id))
  SELECT profile_id, any_value(relaxed) AS relaxed, count(offer_id) AS n_candidates FROM q p LEFT JOIN offers o ON {K.ELIGIBLE} GROUP BY 1""")
def flt10(spark, sf):
    offers = K.scored_offers(spark, sf)
    relaxed, counts = R.relax_if_empty(K.profiles(spark, sf), offers)
    return counts.join(relaxed.select("profile_id", "relaxed"), "profile_id")


# --- similarity -----------------------------------------------------------------------------------------

_COS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {sim} AS s FROM v a JOIN v b ON {on}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INT AS rank FROM p) SELECT query_id, item_id, round(s, 4) AS similarity, rank FROM r WHERE rank <= 5"""


@query("sim01_similar_exact", _COS.format(sim="list_cosine_similarity(a.e, b.e)", on="a.vec_id <> b.vec_id"))
def sim01(spark, sf):
    return S.similar_exact(table(spark, sf, "embeddings"), 5, "vec_id")


@query("sim01_similar_exact_l2", _COS.format(sim="1 / (1 + list_distance(a.e, b.e))", on="a.vec_id <> b.vec_id"))
def sim01b(spark, sf):
    return S.similar_exact(table(spark, sf, "embeddings"), 5, "vec_id", metric="l2")


@query("sim02_similar_ivf")
def sim02(spark, sf):
    return S.similar_ivf(table(spark, sf, "embeddings"), 5, "vec_id")


@query("sim02_similar_ivf_bounded", _COS.format(sim="list_cosine_similarity(a.e, b.e)", on="a.vec_id <> b.vec_id"))
def sim02c(spark, sf):
    return S.similar_ivf(table(spark, sf, "embeddings"), 5, "vec_id", slack=1.0)


@query("sim02_recall")
def sim02b(spark, sf):
    exact = S.similar_exact(table(spark, sf, "embeddings"), 5, "vec_id").select("query_id", "item_id")
    found = S.similar_ivf(table(spark, sf, "embeddings"), 5, "vec_id").select("query_id", "item_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "item_id"], "left").agg(F.count("*").alias("n_asked"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


@query("sim03_similar_to_vectors", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT label AS query_id, list(a ORDER BY i) AS e FROM
  (SELECT label, i, avg(e[i]) AS a FROM v, range(1, 65) t(i) GROUP BY ALL) GROUP BY label), p AS (SELECT query_id, vec_id AS item_id, list_cosine_similarity(q.e, v.e) AS s FROM q, v),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INT AS rank FROM p) SELECT query_id, item_id, round(s, 4) AS similarity, rank FROM r WHERE rank <= 5""")
def sim03(spark, sf):
    e = table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    q = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("embedding"))  # 64 entries
    return S.similar_to_vectors(e, q, 5, "vec_id", "label")


@query("sim04_index_stats", "SELECT count(*) AS n_items, 64 AS dimensions, count(*) * 256 AS n_bytes FROM embeddings")
def sim04(spark, sf):
    from offerloom.session import scratch_path

    path = scratch_path(spark, "vector-index")
    S.write_index(table(spark, sf, "embeddings"), path, "vec_id")
    cells, _ = S.read_index(spark, path)
    return S.index_stats(cells.items)


# --- windows ------------------------------------------------------------------------------------------------


@query("win01_rank_in_query", "SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber)::INT AS position FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)")
def win01(spark, sf):
    p = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "l_extendedprice").distinct()
    return E.rank_in_query(p, "l_suppkey", "item", "l_extendedprice").drop("l_extendedprice")


@query("win02_dedup_first", "SELECT l_suppkey, l_returnflag, arg_min(l_extendedprice, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber) AS l_extendedprice FROM (SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS l_returnflag, l_extendedprice, l_orderkey, l_partkey, l_linenumber FROM lineitem) GROUP BY ALL")
def win02(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_suppkey", "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS l_returnflag", "l_extendedprice", "l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS o")
    d = T.dedup_first(x, ["l_suppkey", "l_returnflag"], "o")
    return d.select("l_suppkey", F.coalesce("l_returnflag", F.lit("")).alias("l_returnflag"), "l_extendedprice")


_YEARS = "y AS (SELECT l_suppkey, year(l_shipdate)::INT AS year, (count(*) % 97)::INT AS rk FROM lineitem GROUP BY ALL)"


def _years(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg((F.count("*") % 97).cast("int").alias("rk"))


@query("win03_latest_per_key", f"WITH {_YEARS} SELECT l_suppkey, arg_max(rk, year) AS rk, max(year) AS year FROM y GROUP BY 1")
def win03(spark, sf):
    return T.latest_per_key(_years(spark, sf), "l_suppkey", "year", "rk")


@query("win04_rank_change", f"WITH {_YEARS} SELECT l_suppkey, year, rk, lag(rk) OVER (PARTITION BY l_suppkey ORDER BY year) - rk AS rank_change FROM y")
def win04(spark, sf):
    return T.rank_change_by_year(_years(spark, sf), "l_suppkey", "year", "rk")


@query("win04_rank_difference", f"WITH {_YEARS} SELECT l_suppkey, year, rk, CASE WHEN year % 2 = 0 THEN (100 - rk)::INT END - rk AS rank_change FROM y")
def win04b(spark, sf):
    y = _years(spark, sf).withColumn("previous", F.when(F.col("year") % 2 == 0, F.lit(100) - F.col("rk")))
    return T.rank_change(y, "rk", "previous").drop("previous")


@query("win05_average_ranks", """WITH c AS (SELECT l_returnflag, l_extendedprice, count(*) AS cnt FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_extendedprice, cnt,
  (sum(cnt) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - cnt + (cnt + 1) / 2::DOUBLE)::DOUBLE AS avg_rank FROM c""")
def win05(spark, sf):
    return prefix.average_ranks(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("win06_sample_per_group", "SELECT o_custkey, greatest(1, floor(0.2::DOUBLE * count(*)))::BIGINT AS n, true AS all_inside FROM orders GROUP BY 1")
def win06(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    s = E.sample_per_group(o, "o_custkey", "o_orderkey", 0.2)
    back = s.join(o.withColumn("there", F.lit(True)), ["o_custkey", "o_orderkey"], "left")
    return back.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all_inside"))


# --- ranking quality -------------------------------------------------------------------------------------------


def _history(spark, sf, when):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o.filter(when), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_suppkey").alias("item_id"), "l_quantity")


def _preds(spark, sf):
    return _history(spark, sf, "o_orderdate < DATE '1999-01-01'").groupBy("query_id", "item_id").agg(F.sum("l_quantity").alias("score"))


def _truth(spark, sf):
    return _history(spark, sf, "o_orderdate >= DATE '1999-01-01'").groupBy("query_id", "item_id").agg((F.count("*") % 3 + 1).cast("double").alias("gain"))


_EV = """h AS (SELECT o_custkey AS query_id, l_suppkey AS item_id, l_quantity, o_orderdate < DATE '1999-01-01' AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  preds AS (SELECT query_id, item_id, sum(l_quantity) AS score FROM h WHERE early GROUP BY ALL), truth AS (SELECT query_id, item_id, {gain}::DOUBLE AS gain FROM h WHERE NOT early GROUP BY ALL),
  pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS p FROM preds), ht AS (SELECT pos.*, gain, (gain IS NOT NULL)::INT AS hit FROM pos LEFT JOIN truth USING (query_id, item_id)),
  hs AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY p) AS seen FROM ht), nr AS (SELECT query_id, count(*) AS nrel FROM truth GROUP BY 1),
  idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item_id) AS p FROM truth)"""


def _per_query(k):
    return f"""coalesce(sum(CASE WHEN p <= {k} THEN gain / log2(p + 1) END), 0) / any_value((SELECT sum(i.gain / log2(i.p + 1)) FROM idl i WHERE i.query_id = hs.query_id AND i.p <= {k})) AS ndcg_{k},
  coalesce(sum(CASE WHEN p <= {k} AND hit = 1 THEN seen / p END), 0) / least(any_value(nrel), {k}) AS map_{k}, count(*) FILTER (p <= {k} AND hit = 1) / {k}::DOUBLE AS precision_{k},
  count(*) FILTER (p <= {k} AND hit = 1) / any_value(nrel)::DOUBLE AS recall_{k}, (count(*) FILTER (p <= {k} AND hit = 1) > 0)::INT::DOUBLE AS hit_{k}"""


def _metrics_sql(ks, gain="1"):
    return f"WITH {_EV.format(gain=gain)}, m AS (SELECT query_id, {', '.join(_per_query(k) for k in ks)}, coalesce(1 / min(CASE WHEN hit = 1 THEN p END)::DOUBLE, 0) AS mrr FROM hs JOIN nr USING (query_id) GROUP BY query_id)"


def _ev_query(name, cols, ks=(5, 10, 20), gain=None):
    shown = [c for c in cols]
    sql = _metrics_sql(ks, "(count(*) % 3 + 1)" if gain else "1") + " SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in shown) + " FROM m"

    @query(name, sql)
    def run(spark, sf):
        d = E.metrics_per_query(_preds(spark, sf), _truth(spark, sf), gain="gain" if gain else None, ks=ks)
        return d.select("query_id", *[F.round(c, 6).alias(c) for c in shown])

    return run


_ev_query("ev01_ndcg_at_k", ["ndcg_5", "ndcg_10", "ndcg_20"])
_ev_query("ev01_ndcg_graded", ["ndcg_5", "ndcg_10", "ndcg_20"], gain="gain")
_ev_query("ev02_map_at_k", ["map_5", "map_10", "map_20"])
_ev_query("ev03_precision_at_k", ["precision_5", "precision_10", "precision_20"])
_ev_query("ev04_recall_at_k", ["recall_5", "recall_10", "recall_20"])
_ev_query("ev05_hit_rate_at_k", ["hit_5", "hit_10", "hit_20"])
_ev_query("ev06_mrr", ["mrr"])

_ALL = [f"{m}_{k}" for k in (5, 10, 20) for m in ("ndcg", "map", "precision", "recall", "hit")] + ["mrr"]


@query("ev07_evaluate_recommendations", _metrics_sql((5, 10, 20)) + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL) + ", count(*) AS n_evaluated, (SELECT count(DISTINCT query_id) FROM preds) AS n_queries FROM m")
def ev07(spark, sf):
    d = E.evaluate(_preds(spark, sf), _truth(spark, sf))
    return d.select(*[F.round(c, 6).alias(c) for c in _ALL], "n_evaluated", "n_queries")


@query("ev08_holdout_truth", f"WITH {K.OFFERS}, {K.PROFILES} SELECT profile_id, greatest(1, floor(0.2::DOUBLE * count(*)))::BIGINT AS n_relevant FROM profiles p JOIN offers o ON {K.ELIGIBLE} GROUP BY 1")
def ev08(spark, sf):
    t = R.holdout_truth(K.profiles(spark, sf), K.offers(spark, sf), 0.2, "profile_id", "offer_id")
    return t.groupBy("profile_id").agg(F.count("*").alias("n_relevant"))
