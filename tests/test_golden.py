"""Golden rows: values fixed by the rules, independent of any table."""

import math

import pytest
from pyspark.sql import functions as F

from offerloom.functions import columns as C
from offerloom.operators import drift, evaluate, fairness, pages, quality, search, tiers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize("text,rank", [("#1", 1), ("=5", 5), ("101-150", 101), ("1401+", 1401), (None, None), ("abc", None), (" # 7 ", 7), ("##3", 3)])
def test_parse_rank(spark, text, rank):
    assert one(spark, C.parse_rank(lit(text))) == rank


@pytest.mark.parametrize("text,rank", [("1201-1400", 1300), ("101–150", 125), ("=9", 9), ("1001+", 1001), ("x", None)])
def test_parse_rank_midpoint(spark, text, rank):
    assert one(spark, C.parse_rank_midpoint(lit(text))) == rank


@pytest.mark.parametrize("text,years", [("12 months", 1.0), ("18 months", 1.5), ("2 years", 2.0), ("9 months", 0.75), ("52 weeks", 1.0), (None, None), ("soon", None)])
def test_duration(spark, text, years):
    assert one(spark, C.duration_years(lit(text))) == years


@pytest.mark.parametrize("text,amount,currency", [("43,800 GBP", 43800, "GBP"), ("£9,250", 9250, "GBP"), ("$55,000", 55000, "USD"), ("12,000.75 EUR or 9", 12000, "EUR")])
def test_fee(spark, text, amount, currency):
    assert one(spark, C.fee_amount(F.lit(text))) == amount
    assert one(spark, C.fee_currency(F.lit(text))) == currency


def test_money_and_ids(spark):
    assert one(spark, C.to_usd(F.lit(100.0), F.lit("gbp"))) == 127.0
    assert one(spark, C.to_usd(F.lit(100.0), F.lit("XXX"))) == 100.0
    assert one(spark, C.entity_id(F.lit("Technical University of Munich"))) == "9e550f3fda50"


@pytest.mark.parametrize("text,level", [("MBA", "Undergraduate"), ("PhD", "PhD"), ("Master", "Masters"), ("", "Masters"), ("Graduate School", "Graduate")])
def test_level(spark, text, level):
    assert one(spark, C.level(F.lit(text))) == level


@pytest.mark.parametrize("p,score", [([0.0, 0.0, 1.0], 1.0), ([0.0, 1.0, 0.0], 0.2), ([1.0, 0.0, 0.0], 0.6), ([1 / 3] * 3, 0.6), ([0.5, 0.5, 0.5], 0.9)])
def test_match_score(spark, p, score):
    got = one(spark, C.match_score(F.array(*[F.lit(x) for x in p]), ["good", "standard", "top"]))
    assert got == pytest.approx(score) and got <= 1.0


@pytest.mark.parametrize("top,band", [(0.85, "high"), (0.55, "medium"), (0.35, "low"), (0.80, "high"), (0.50, "medium")])
def test_band(spark, top, band):
    assert one(spark, C.confidence_band(F.array(F.lit(top), F.lit(0.1)))) == band


@pytest.mark.parametrize("rank,tier", [(451, "top"), (452, "good"), (976, "good"), (977, "standard")])
def test_world_rank_tiers(spark, rank, tier):
    r = spark.createDataFrame([(1, "QS World University Rankings", 0, rank, None)], "entity int, ranking_type string, pos int, rank int, rank_display string")
    got = tiers.derive_tier(r, r.select("entity"), "entity").first()
    assert got["tier"] == tier and got["path"] == "qs_world_primary"


def test_regional_and_unranked(spark):
    r = spark.createDataFrame([(1, "Asian University Rankings", 0, 1, None)], "entity int, ranking_type string, pos int, rank int, rank_display string")
    got = {x["entity"]: x for x in tiers.derive_tier(r, spark.range(1, 3).withColumnRenamed("id", "entity"), "entity").collect()}
    assert (got[1]["tier"], got[1]["composite"]) == ("top", 0.7)
    assert (got[2]["tier"], got[2]["path"]) == ("standard", "no_rankings")


def test_ranking_metrics(spark):
    preds = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (2, 1, 0.5)], "query_id int, item_id int, score double")
    truth = spark.createDataFrame([(1, 2)], "query_id int, item_id int")
    m = evaluate.metrics_per_query(preds, truth, ks=(3,)).first()
    assert m["ndcg_3"] == pytest.approx(1 / math.log2(3))
    assert (m["map_3"], m["recall_3"], m["hit_3"], m["mrr"]) == (0.5, 1.0, 1.0, 0.5)
    assert m["precision_3"] == pytest.approx(1 / 3)
    short = evaluate.metrics_per_query(preds.filter("query_id = 2"), spark.createDataFrame([(2, 1)], "query_id int, item_id int"), ks=(5,)).first()
    assert short["precision_5"] == pytest.approx(0.2) and short["ndcg_5"] == pytest.approx(1.0)
    assert evaluate.evaluate(preds, truth, ks=(3,)).first()["n_queries"] == 2


def test_first_hit_beyond_the_largest_k(spark):
    preds = spark.range(50).selectExpr("1 AS query_id", "id AS item_id", "100D - id AS score")
    truth = spark.createDataFrame([(1, 30)], "query_id int, item_id bigint")
    m = evaluate.metrics_per_query(preds, truth, ks=(5,)).first()
    assert m["mrr"] == pytest.approx(1 / 31) and m["hit_5"] == 0.0


def test_drift_invariants(spark):
    x = spark.range(2000).selectExpr("cast(id % 97 AS double) AS a", "5D AS b")
    got = {r["feature"]: r["psi"] for r in drift.psi(x, x, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(0.0, abs=1e-9) and got["b"] == 0.0
    ks = {r["feature"]: r for r in drift.ks_two_sample(x, x, ["a"]).collect()}
    assert ks["a"]["ks"] == 0.0 and ks["a"]["p_value"] == pytest.approx(1.0)


def test_odds_without_negatives(spark):
    d = spark.createDataFrame([("g", True, True), ("g", False, True)], "g string, p boolean, y boolean")
    r = fairness.equalized_odds(d, F.col("p"), F.col("y"), "g").first()
    assert (r["fpr"], r["tpr"]) == (0.0, 0.5)


def test_profile_flags(spark):
    d = spark.createDataFrame([(1, 3.9, 500.0), (2, 3.0, 0.0), (3, None, None), (4, 3.0, 20000.0)], "id int, gpa double, budget double").withColumn("countries", F.array().cast("array<string>"))
    got = {r["id"]: r["warnings"] for r in search.flag_profiles(d).collect()}
    assert got[1][0].startswith("suspicious") and got[2][0].startswith("invalid") and got[3][0].startswith("empty") and got[4] == []


def test_offer_validation_score(spark):
    d = spark.createDataFrame([("U", "P", "D", "C", "https://x", 3.0, 90, 6.5, "d" * 60, 5000)],
                              "university_name string, program_name string, degree_type string, country string, source_url string, gpa_requirement_min double, toefl_min int, ielts_min double, program_description string, tuition int")
    r = quality.validate_offers(d).first()
    assert r["score"] == pytest.approx(6.5 / 7) and r["is_valid"]


@pytest.mark.parametrize("href,url", [("/a", "https://h.edu/a"), ("b.html", "https://h.edu/x/b.html"), ("../c", "https://h.edu/c"), ("//k.edu/d", "https://k.edu/d"), ("http://z/e", "http://z/e"), ("?q=1", "https://h.edu/x/y?q=1")])
def test_resolve(spark, href, url):
    assert one(spark, pages.resolve(F.lit("https://h.edu/x/y?p=2#top"), F.lit(href))) == url


@pytest.mark.parametrize("text,value", [('```json\n{"a": 1}\n```', "1"), ('so: {"a": 1} ok', "1"), ("nothing", None)])
def test_parse_extractions(spark, text, value):
    r = pages.parse_extractions(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["fields"] or {}).get("a") == value


@pytest.mark.parametrize("html,text", [
    ("<p>&pound;9,250 &#163;1 &#xa3;2</p>", "£9,250 £1 £2"), ("caf&eacute; &amp;lt; &bogus; a&nbsp;b &amp", "café &lt; &bogus; a b &amp"), ("&#0;&#55296;&#9999999;", "�" * 3), ("&#128512;", "😀"),
    ("a<nav>x<nav>y</nav>z</nav>b", "a b"), ("a<header>x<nav>y</nav></header>b<footer>c", "a b"), ("a</nav>b", "a b"), ("a<navy>b", "a b"), ("", ""), (None, None), ("<html><nav>x</nav><p>b</p></html>", "b"), ("<nav>x</nav>b", "b"),
    ("a<NAV class='t'>x<script>'</nav>'</script>y</NAV>b", "a b"), ("a<!-- <nav> -->b<nav/>c", "a b c")])
def test_plain_text(spark, html, text):
    assert one(spark, pages.plain_text(lit(html))) == text


@pytest.mark.parametrize("href,url", [
    ("../" * 8 + "z", "https://h.edu/z"), ("../../../z?q=/a/../b", "https://h.edu/1/2/z?q=/a/../b"), ("./z", "https://h.edu/1/2/3/4/5/z"), ("..", "https://h.edu/1/2/3/4/"), ("/a/./b/../c", "https://h.edu/a/c"), ("//x.org/a", "https://x.org/a")])
def test_resolve(spark, href, url):
    assert one(spark, pages.resolve(F.lit("https://h.edu/1/2/3/4/5/p.html"), F.lit(href))) == url


def test_links_with_any_quotes(spark):
    html = """<a href=/one>First</a><a class='x' href='/two"s'>Second</a><a href="/it's">Third</a><a data-href="/no" href = "/four">Fourth</a>"""
    got = pages.extract_links(spark.createDataFrame([("https://h.edu/", html)], "url string, html string")).orderBy("position").collect()
    assert [r["url"] for r in got] == ["https://h.edu/one", 'https://h.edu/two"s', "https://h.edu/it's", "https://h.edu/four"]


def test_detail_boxes(spark):
    html = """<div class='detail-box big'><div><label>Duration</label></div><div class='value'>2 years</div></div><span class="value">no</span>
    <li class="badge-description"><label>Tuition fee</label></li><div class="value">outside</div><div class="detail-box"><label>Study level</label><span class="value">Master</span></div>"""
    got = one(spark, pages.detail_boxes(F.lit(html)))
    assert (got["duration"], got["tuition_fee_summary"], got["study_level"]) == ("2 years", None, "Master")
