"""Skew, size-independence and restart behaviour: the paths that only matter on large data, forced on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.operators import evaluate, match, pages, prefix, recommend, similar, stats, train
from offerloom.session import scratch_path
from offerloom.sources.sinks import BucketedTable, VersionedTable, keep_latest_versions, upsert_replace

HOT = 50


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, one value a third of that group."""
    return spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 40) END AS g", "CASE WHEN id % 9 = 0 THEN 7.5D ELSE cast((id * 7919) % 1000 AS double) END AS v", "id").persist()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_banded_row_numbers(skewed):
    plain = prefix.row_numbers(skewed, ["g"], [("v", True), ("id", False)])
    split = prefix.row_numbers(skewed, ["g"], [("v", True), ("id", False)], hot_rows=HOT)
    assert rows(plain, "g", "id", "row_number") == rows(split, "g", "id", "row_number")


def test_banded_row_numbers_without_groups(skewed):
    plain = prefix.row_numbers(skewed, [], [("v", False), ("id", False)])
    split = prefix.row_numbers(skewed, [], [("v", False), ("id", False)], hot_rows=HOT)
    assert rows(plain, "id", "row_number") == rows(split, "id", "row_number")


def test_banded_average_ranks_and_quantiles(skewed):
    assert rows(prefix.average_ranks(skewed, ["g"], "v"), "g", "v", "avg_rank") == rows(prefix.average_ranks(skewed, ["g"], "v", HOT), "g", "v", "avg_rank")
    q = {(r["g"], r["prob"]): r["quantile"] for r in prefix.quantiles(skewed, ["g"], "v", [0.1, 0.5, 0.99], HOT).collect()}
    data = skewed.toPandas()
    for g, part in data.groupby("g"):
        for p in (0.1, 0.5, 0.99):
            assert q[(g, p)] == pytest.approx(np.quantile(part["v"], p))


def test_sample_per_group_exact_sizes(skewed):
    for hot in (HOT, prefix.HOT_ROWS):
        s = evaluate.sample_per_group(skewed, "g", "id", 0.2, hot_rows=hot)
        want = {r["g"]: max(1, int(0.2 * r["count"])) for r in skewed.groupBy("g").count().collect()}
        assert {r["g"]: r["count"] for r in s.groupBy("g").count().collect()} == want


def brute(profiles, offers, n):
    out = {}
    for p in profiles:
        fit = [o for o in offers if all(not p[k] or (o[t] is not None and o[t] <= p[k]) for k, t in (("gpa", "gpa_min"), ("ielts", "ielts_min"), ("toefl", "toefl_min"), ("budget", "tuition")))
               and all(not p[k] or o[k] == p[k] for k in ("country", "degree_level", "program_category"))]
        out[p["profile_id"]] = (len(fit), [o["offer_id"] for o in sorted(fit, key=lambda o: (-o["match_score"], o["offer_id"]))[:n]])
    return out


def catalogue(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    offers = [dict(offer_id=i, country=pick("A", "A", "B"), degree_level=pick("M", "P"), program_category=pick("x", "y"), gpa_min=pick(None, 2.0, 3.0, 3.5), ielts_min=pick(6.0, 6.5), toefl_min=pick(80.0, 90.0),
                   tuition=pick(None, 0.0, rng.uniform(0, 5e4), round(rng.uniform(0, 5e4), 2), 9999.99, 5e9, -3.0), match_score=rng.randint(0, 9) / 10) for i in range(700)]
    profiles = [dict(profile_id=i, gpa=pick(None, 0.0, 2.5, 3.2, 4.0), ielts=pick(None, 6.0, 7.0), toefl=pick(None, 85.0), budget=pick(None, 0.0, -5.0, 9999.99, rng.uniform(0, 5e4), 6e9), country=pick(None, "", "A", "C"),
                     degree_level=pick(None, "M"), program_category=pick(None, "x")) for i in range(200)]
    o = spark.createDataFrame(offers, "offer_id int, country string, degree_level string, program_category string, gpa_min double, ielts_min double, toefl_min double, tuition double, match_score double")
    p = spark.createDataFrame(profiles, "profile_id int, gpa double, ielts double, toefl double, budget double, country string, degree_level string, program_category string")
    return profiles, offers, p, o


def test_recommend_against_brute_force(spark):
    profiles, offers, p, o = catalogue(spark)
    want = brute(profiles, offers, 4)
    got = {}
    for r in recommend.recommend(p, o, 4).orderBy("profile_id", "position").collect():
        got.setdefault(r["profile_id"], []).append(r["offer_id"])
    assert {k: v[1] for k, v in want.items() if v[1]} == got
    counts = {r["profile_id"]: r["n_candidates"] for r in recommend.candidate_counts(p, o, "profile_id", "offer_id", "match_score").collect()}
    assert counts == {k: v[0] for k, v in want.items()}


def test_holdout_against_brute_force(spark):
    profiles, offers, p, o = catalogue(spark)
    u = {r["offer_id"]: r["u"] for r in o.select("offer_id", recommend._uniform(F.col("offer_id"), 42).alias("u")).collect()}
    assert all(0 <= x < 1 for x in u.values()) and len(set(u.values())) == len(u)
    want = {}
    for k, (n, items) in brute(profiles, offers, len(offers)).items():
        if n:
            want[k] = sorted(sorted(items, key=u.get)[: max(1, int(0.2 * n))])
    got = {}
    for r in recommend.holdout_truth(p, o, 0.2, "profile_id", "offer_id").collect():
        got.setdefault(r["profile_id"], []).append(r["offer_id"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_containment_pairs_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(160)]
    l, r = words[:80], words[80:]
    got = {tuple(x) for x in match.containment_pairs(spark.createDataFrame([(w,) for w in l], "l string"), spark.createDataFrame([(w,) for w in r], "r string")).collect()}
    assert got == {(a, b) for a in l for b in r if a in b or b in a}


def test_ivf_recall_with_a_hot_cluster(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 16))
    label = np.where(np.arange(3000) % 3 == 0, 0, np.arange(3000) % 20)  # a third in one cluster
    data = centre[label] + rng.normal(scale=0.3, size=(3000, 16))
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id int, embedding array<double>")
    queries = items.filter("id % 10 = 0")
    exact = {(r["query_id"], r["item_id"]) for r in similar.similar_exact(items, 5, "id", queries=queries).collect()}
    near = {(r["query_id"], r["item_id"]) for r in similar.similar_ivf(items, 5, "id", clusters=40, queries=queries).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert all(q != i for q, i in near)


def test_blocks_do_not_change_exact_search(spark):
    rng = np.random.default_rng(1)
    v = [[float(x) for x in v] for v in rng.normal(size=(300, 8))]
    odd = [(300, v[0]), (301, v[0]), (302, [0.0] * 8), (303, None), (304, [])]
    items = spark.createDataFrame([*enumerate(v), *odd], "id int, embedding array<double>")
    for metric in ("cosine", "l2"):
        whole = rows(similar.similar_exact(items, 3, "id", metric=metric), "query_id", "rank", "item_id")
        assert len(whole) == 303 * 3
        assert rows(similar.similar_exact(items, 3, "id", metric=metric, block=37), "query_id", "rank", "item_id") == whole
    assert similar.similar_exact(items.limit(0), 3, "id").count() == similar.similar_ivf(items.limit(0), 3, "id").count() == 0


def test_blocks_that_cannot_hold_a_neighbour_never_meet(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(25, 12)) * 4
    data = centre[np.where(np.arange(2000) % 3 == 0, 0, np.arange(2000) % 25)] + rng.normal(scale=0.2, size=(2000, 12))
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id int, embedding array<double>")
    i = similar._prepared(items, "id", "embedding", "item_id", "l2")
    q = similar._prepared(items, "id", "embedding", "query_id", "l2")
    cells = similar.make_cells(i, similar.some_vectors(i, similar.cell_count(2000, 60)), "l2", 60)
    first = similar._best(similar._meet(cells, q, similar._visits(cells, q, 5, None), 5, True, 60), 5)
    tau = first.groupBy("query_id").agg((-F.min("closeness")).alias("tau"))
    met = similar._visits(cells, q, 5, None).unionByName(similar._visits(cells, q.join(tau, "query_id"), 5, 1.0))
    assert met.count() < 0.5 * 2000 * len(cells.told.blocks)
    exact = rows(similar.similar_exact(items, 5, "id", metric="l2"), "query_id", "rank", "item_id")
    assert rows(similar.search_cells(cells, q, 5, block=60), "query_id", "rank", "item_id") == exact


def test_a_query_is_sent_to_units_not_to_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1200, 6)))], "id int, embedding array<double>")
    i, q = (similar._prepared(items, "id", "embedding", c, "cosine") for c in ("item_id", "query_id"))
    cells = similar.make_cells(i, similar.some_vectors(i, 30), "cosine", 40)
    monkeypatch.setattr(similar, "UNITS", 4)
    units, size = cells.told.units(40)
    assert size == 300 and len(units) >= 30 and len(set(units)) <= 4
    assert max(np.bincount(units, cells.told.blocks[:, 2])) < 300 + 40
    sent, write = [], similar.materialise

    def written(d, name):
        d = write(d, name)
        sent.append(d.count())
        return d

    monkeypatch.setattr(similar, "materialise", written)
    everywhere = q.select("query_id").crossJoin(spark.createDataFrame([(int(b[0]), int(b[1])) for b in cells.told.blocks], "cell int, ib int"))
    found = similar._meet(cells, q, everywhere, 5, True, 40)
    assert sent == [1200 * len(set(units))] and found.count() == 5 * sent[0]
    best = similar._best(found, 5)
    v = np.array([r["embedding"] for r in items.orderBy("id").collect()])
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = v @ v.T
    np.fill_diagonal(close, -2)
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in best.collect()} == {(a, int(b), n + 1) for a in range(1200) for n, b in enumerate(np.argsort(-close[a])[:5])}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_clustered_search(spark, size):
    from offerloom import registry

    r = registry.QUERIES["sim02_recall"](spark, f"/root/testdata/{size}").first()
    assert r["n_found"] / r["n_asked"] == r["recall"] >= 0.9


def test_stored_index_answers_as_the_items_do(spark):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 6)))], "id int, embedding array<double>")
    path = scratch_path(spark, "index")
    similar.write_index(items, path, "id")
    cells, slack = similar.read_index(spark, path)
    q = similar._prepared(items, "id", "embedding", "query_id", "cosine")
    assert 0 < slack <= 1
    assert rows(similar.search_cells(cells, q, 3), "query_id", "rank", "item_id") == rows(similar.similar_exact(items, 3, "id"), "query_id", "rank", "item_id")


def test_an_upsert_rewrites_the_buckets_of_its_keys_alone(spark):
    t = BucketedTable(spark, scratch_path(spark, "t"), "k", "o", 16)
    t.create(spark.range(1000).selectExpr("id AS k", "id AS v", "10 AS o"))
    before = t.files()
    touched = t.upsert(spark.createDataFrame([(7, -7, 11), (7, -8, 9), (None, 0, 99)], "k long, v long, o int"))
    after = t.files()
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == set(touched)
    assert t.read().filter("k = 7").collect() == [(7, -7, 11)] and t.read().count() == 1000
    t.upsert(spark.createDataFrame([(7, 5, 10), (1000, 1, 1)], "k long, v long, o int"))  # older, and new
    assert t.read().filter("k IN (7, 1000)").orderBy("k").collect() == [(7, -7, 11), (1000, 1, 1)]
    again = rows(t.read(), "k", "v")
    t.upsert(spark.createDataFrame([(7, 5, 10), (1000, 1, 1)], "k long, v long, o int"))
    assert rows(t.read(), "k", "v") == again
    gone = t.delete(spark.createDataFrame([(7,)], "k long"))
    assert len(gone) == 1 and t.read().count() == 1000
    assert t.vacuum() >= 3 and rows(t.read(), "k", "v") == [r for r in again if r[0] != 7]
    assert t.change(spark.createDataFrame([], "k long, v long, o int"), None) == []
    hot = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id AS v", "cast(id AS int) AS o")
    t.upsert(hot)
    assert t.read().filter("k = 1").collect() == [(1, 4998, 4998)]


def test_upsert_is_idempotent_and_versions_survive(spark):
    t = VersionedTable(spark, scratch_path(spark, "t"))
    t.write(spark.range(100).selectExpr("id AS k", "id AS v"))
    batch = spark.range(50, 150).selectExpr("id % 120 AS k", "id * 10 AS v", "id AS o")
    once = upsert_replace(t.read(), batch, ["k"], "o")
    t.write(once)
    first = rows(t.read(), "k", "v")
    t.write(upsert_replace(t.read(), batch, ["k"], "o"))
    assert rows(t.read(), "k", "v") == first and len(t.versions()) == 3


def test_keep_latest_versions_with_a_hot_key(spark):
    h = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS key", "id AS version")
    kept, expired = keep_latest_versions(h, "key", "version", 5)
    assert kept.count() == 8 * 5 and kept.count() + expired.count() == 3000


def test_consolidation_of_a_hot_entity(spark):
    e = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id AS o", "repeat('x', cast(id % 50 AS int)) AS t", "array(concat('l', id % 4)) AS l", "map(id % 3, id) AS m")
    r = stats.consolidate_pages(e, "k", "o", ["t"], [], ["l"], ["m"]).filter("k = 1").first()
    assert len(r["t"]) == 49 and r["l"] == ["l0", "l1", "l2", "l3"] and r["m"] == {0: 4998, 1: 1}


def test_page_budget_of_traversal(spark):
    links = spark.range(400).selectExpr("concat('p', id % 40) AS page_url", "concat('p', (id * 7 + floor(id / 40) * 11 + 3) % 40) AS url", "id AS position")
    r = pages.reachable_pages(links, spark.createDataFrame([("p0",), ("p5",)], "url string"), depth=3, fan_out=5, max_pages=10)
    assert {x["seed"]: x["count"] for x in r.groupBy("seed").count().collect()} == {"p0": 10, "p5": 10}


def test_folds_share_no_group_and_are_even(spark):
    d = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 61 END AS g")
    f = train.group_folds(d, "g", 3, hot_rows=10)
    assert f.select("g", "fold").distinct().count() == d.select("g").distinct().count()
    again = train.group_folds(d, "g", 3)
    assert rows(f.distinct(), "g", "fold") == rows(again.distinct(), "g", "fold")


def test_group_split_of_1503_groups(spark):
    d = spark.range(1503).selectExpr("concat('u', id) AS g")
    tr, te = train.group_split(d, "g", 0.15)
    assert (tr.count(), te.count()) == (1277, 226)
    tr2, te2 = train.group_split(d, "g", 0.15, hot_rows=HOT)
    assert rows(te, "g") == rows(te2, "g")


def test_plans_stay_declarative(spark, sf):
    from offerloom import plans, registry

    plans.load()
    text = lambda n: registry.QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,42)]" in text("flt01_lookup")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text("src04_scan_table")
    for n in ("rec01_recommend", "jn03_match_by_containment", "jn11_expand_catalog", "agg14_group_bias", "sim01_similar_exact"):
        assert "CartesianProduct" not in text(n) and "BroadcastNestedLoopJoin" not in text(n)


def test_every_hot_group_is_split(spark):
    """600 groups beyond the limit, one of them far beyond 1,024 bands' worth."""
    d = spark.range(36_000 + 60_000).selectExpr("CASE WHEN id < 36000 THEN id % 600 ELSE 600 END AS g", "cast(pmod(xxhash64(id), 5000) AS double) AS v", "id")
    banded, split = prefix.with_band(d, ["g"], "v", "band", HOT)
    per = banded.groupBy("g").agg(F.countDistinct("band").alias("n")).groupBy().agg(F.count_if(F.col("n") > 1).alias("split"), F.max("n").alias("most")).first()
    assert split and per["split"] == 601 and per["most"] > 1024
    assert rows(prefix.row_numbers(d, ["g"], [("v", False), ("id", False)], hot_rows=HOT), "id", "row_number") == rows(prefix.row_numbers(d, ["g"], [("v", False), ("id", False)]), "id", "row_number")
