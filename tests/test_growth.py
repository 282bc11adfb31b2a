"""Plans and partial results that must not grow faster than their input."""

import random

import numpy as np
from pyspark.sql import Window, functions as F


from offerloom.operators import drift, prefix, recommend, similar, stages, train


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_counts_read_one_row_of_every_class(spark):
    """No signature is multiplied by the levels of prices, and none is broadcast."""
    rng = random.Random(8)
    offers = [(i, "A", "M", "x", rng.choice([None, 2.0, 3.0]), 6.0, 80.0, rng.choice([None, -3.0, 5.0, 9.99, 5e9])) for i in range(200)]
    profiles = [(i, rng.choice([None, 2.5]), None, None, rng.choice([None, 0.0, -5.0, 5.0, 9.98, 6e9]), rng.choice([None, "A", "B"]), None, None) for i in range(60)]
    o = spark.createDataFrame(offers, "offer_id int, country string, degree_level string, program_category string, gpa_min double, ielts_min double, toefl_min double, tuition double")
    p = spark.createDataFrame(profiles, "profile_id int, gpa double, ielts double, toefl double, budget double, country string, degree_level string, program_category string")
    sigs = recommend.signatures(p, "profile_id")
    counts = recommend._signature_counts(sigs, recommend.offer_index(o, recommend._used_masks(sigs), "offer_id", "tuition"))
    assert "Generate" not in plan(counts) and "BroadcastHashJoin" not in plan(counts)
    got = {r["profile_id"]: r["n_candidates"] for r in recommend.candidate_counts(p, o, "profile_id", "offer_id", "tuition").collect()}
    fits = lambda mine, theirs: not mine or (theirs is not None and theirs <= mine)
    assert got == {q[0]: sum(fits(q[1], x[4]) and fits(q[4], x[7]) and (not q[5] or q[5] == x[1]) for x in offers) for q in profiles}


def test_manifest_of_reordered_rows_has_no_fixed_partitions(spark, sf):
    from offerloom import plans, registry

    plans.load()
    text = plan(registry.QUERIES["snk09_dataset_manifest"](spark, sf))
    assert "REBALANCE_PARTITIONS_BY_COL" in text and "REPARTITION_BY_NUM" not in text


def test_folds_and_parts_move_no_other_columns(spark):
    d = spark.range(4000).selectExpr("id", "id % 2 AS label", "id % 1500 AS key", "concat('unused', id) AS wide")
    for f in (lambda hot: train.stratified_folds(d, "label", "key", hot_rows=hot).groupBy("label", "fold"), lambda hot: train.stratified_parts(d, "label", "key", hot_rows=hot).groupBy("label", "part")):
        split = f(100).count()
        assert "unused" not in plan(split) and "Scan parquet" not in plan(split)
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, f(10**6).count().collect()))


def test_baseline_sample_orders_few_rows(spark):
    d = spark.range(5000).selectExpr("cast(id % 700 AS double) AS a", "CASE WHEN id % 3 > 0 THEN cast(id AS double) END AS b", "id % 4900 AS k")
    _, drawn = drift.drift_baseline(d, ["a", "b"], sample=40)
    assert "shiftright" in plan(drawn)
    whole = prefix.unpivot(d.withColumn("_h", F.xxhash64("a", "b", "k", F.lit(42))), ["a", "b"], ["_h"]).filter("value IS NOT NULL")
    w = Window.partitionBy("feature").orderBy("_h", "value")
    assert rows(drawn, "feature", "value") == rows(whole.withColumn("n", F.row_number().over(w)).filter("n <= 40"), "feature", "value")
    assert drift.drift_baseline(d, ["a", "b"], sample=10**6)[1].count() == 5000 + 3333


def test_terms_of_equal_count_are_kept_by_name(spark):
    d = spark.createDataFrame([(["b", "a", "c"],), (["c", "d"],), (None,)], "t array<string>")
    model = stages.FrequentTerms(inputCol="t", outputCol="n", vocabSize=3).fit(d)
    assert model.vocabulary == ["c", "a", "b"]


def test_training_rows_get_partitions(spark):
    d = spark.range(1000).coalesce(1)
    assert train.spread(d, 100).rdd.getNumPartitions() == 10 and train.spread(d, 1000).rdd.getNumPartitions() == 1
    most = train.PARTITIONS_A_CORE * max(4, spark.sparkContext.defaultParallelism)
    assert train.spread(d, 1).rdd.getNumPartitions() == train.spread(spark.range(0, 1000, 1, 300), 1).rdd.getNumPartitions() == most
    assert train.spread(d, 100, 7).rdd.getNumPartitions() == 7 and train.spread(d, 1).count() == 1000


def test_the_best_of_a_block_are_picked_without_ordering_it(monkeypatch):
    import pandas as pd

    def no_sort(*_, **__):
        raise AssertionError("whole block ordered")

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, size=(60, 3)).astype(float)  # many ties
    items, queries = pd.DataFrame({"item_id": range(60), "v": list(v)}), pd.DataFrame({"query_id": range(60), "v": list(v)})
    monkeypatch.setattr(np, "argsort", no_sort)
    for metric in ("cosine", "l2"):
        got = similar._search(4, metric, True)(items, queries)
        for q in range(60):
            near = {i: v[q] @ v[i] if metric == "cosine" else -np.sqrt(((v[q] - v[i]) ** 2).sum()) for i in range(60) if i != q}
            assert list(got[got.query_id == q].item_id) == sorted(near, key=lambda i: (-round(near[i], 9), i))[:4]


def test_pairs_of_a_holdout_leave_the_join_as_they_are(spark, monkeypatch):
    """None is written or moved; blocks of any size, repeated and null items give the share that brute force gives."""
    monkeypatch.setattr(recommend, "BLOCK", 7)
    monkeypatch.setattr(recommend, "ITEMS", 11)
    rng = random.Random(4)
    offers = [(rng.choice([None, *range(90)]), "A", "M", "x", rng.choice([None, 2.0, 3.0]), 6.0, 80.0, rng.choice([None, -3.0, 5.0, 9.99])) for _ in range(200)]
    profiles = [(i % 50, rng.choice([None, 2.5, float("nan")]), None, None, rng.choice([None, 5.0, 9.99]), rng.choice([None, "A", "B"]), None, None) for i in range(60)]
    o = spark.createDataFrame(offers, "offer_id int, country string, degree_level string, program_category string, gpa_min double, ielts_min double, toefl_min double, tuition double")
    p = spark.createDataFrame(profiles, "profile_id int, gpa double, ielts double, toefl double, budget double, country string, degree_level string, program_category string")
    out = recommend.holdout_truth(p, o, 0.2, "profile_id", "offer_id")
    above = [part.split("SortMergeJoin")[0] for part in plan(out).split("AdaptiveSparkPlan")[1:2]]
    assert above and "Exchange" not in above[0] and "_rn" not in plan(out)
    u = {r["offer_id"]: r["u"] for r in o.select("offer_id", recommend._uniform(F.col("offer_id"), 42).alias("u")).distinct().collect()}
    top = lambda x: float("inf") if x is None else x
    want = []
    for q in profiles:
        fit = [x[0] for x in offers if (not q[1] or q[1] != q[1] or top(x[4]) <= q[1]) and (not q[4] or top(x[7]) <= q[4]) and (not q[5] or q[5] == x[1])]
        want += [(q[0], i) for i in sorted(fit, key=u.get)[: max(1, int(0.2 * len(fit))) if fit else 0]]
    key = lambda t: (t[0], t[1] is None, t[1] or 0)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


def test_fields_of_a_page_are_worked_out_once(spark):
    from offerloom.operators import pages

    d = spark.createDataFrame([("u", "<h1>A</h1><li class=detail-box><span class=value>2<li>3</li></span></li></li>4 PTE: 55 <!-- PTE: 66 -->")], "url string, html string")
    out = pages.extract_offer_fields(d)
    assert plan(out).count("pte\\s*") == 1
    assert out.select("program_name", "pte_score", "ielts_score").first() == ("A", "55+", None)


def test_a_unit_keeps_k_items_a_query_however_many_blocks(monkeypatch):
    """2,000 queries want half of 400 blocks: 5 items a query, not 5 of every block, are held (before: 48 MB of results besides the vectors)."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(6)
    monkeypatch.setattr(similar, "PAIRS", 1 << 14)
    v, w = rng.normal(size=(8000, 4)), rng.normal(size=(2000, 4))
    block, wants = np.arange(8000) % 400, rng.random((2000, 400)) < 0.5
    items = pd.DataFrame({"item_id": np.arange(8000), "v": list(v), "block": block * 3})
    queries = pd.DataFrame({"query_id": np.arange(2000), "v": list(w), "wants": [x.tobytes() for x in np.packbits(wants, axis=1)]})
    run = similar._search(5, "l2", False)
    tracemalloc.start()
    got = run(items, queries)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = np.where(wants[:, block], ((w[:, None, :] - v[None, :, :]) ** 2).sum(2), np.inf)
    best = np.argsort(far, axis=1)[:, :5]
    assert got["item_id"].to_numpy().reshape(2000, 5).tolist() == best.tolist()
    np.testing.assert_allclose(got["closeness"], -np.sqrt(np.take_along_axis(far, best, 1)).ravel(), atol=1e-8)
    assert most < 16e6
    least = got.groupby("query_id")["closeness"].min().to_numpy()
    assert run(items, queries.assign(least=least)).equals(got)  # a bound known before changes nothing
    assert len(run(items, queries.assign(least=least + 0.1))) < len(got)


def test_single_precision_loses_no_neighbour():
    """Far from the origin, over many scales, equal or not numbers: the best are those of plain distances."""
    import pandas as pd

    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 5))
    sets = {
        "far": base + 1e5, "scales": base * 10.0 ** rng.integers(-12, 12, size=(300, 1)), "groups": base * 1e-3 + rng.normal(size=(6, 5))[rng.integers(0, 6, 300)] * 1e4,
        "equal": np.repeat(base[:3], 100, axis=0), "tiny": base * 1e-30, "huge": base * 1e18,
    }
    for name, v in sets.items():
        for metric in ("cosine", "l2"):
            x = v / np.linalg.norm(v, axis=1)[:, None] if metric == "cosine" else v.copy()
            bad = np.vstack([x, [[np.nan] * 5, [np.inf] * 5]])
            items = pd.DataFrame({"item_id": range(302), "v": list(bad.copy()), "block": np.arange(302) % 4})
            got = similar._search(6, metric, True)(items, pd.DataFrame({"query_id": range(302), "v": list(bad.copy())}))
            near = x @ x.T if metric == "cosine" else -((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
            near = np.round(near, 12 if metric == "cosine" else 9)
            np.fill_diagonal(near, -np.inf)
            assert len(got) == 1800 and got["item_id"].max() < 300
            want = [int(i) for q in range(300) for i in sorted(range(300), key=lambda i: (-near[q, i], i))[:6]]
            differ = sum(a != b for a, b in zip(got["item_id"], want))
            found = near[np.repeat(np.arange(300), 6), got["item_id"]]
            best = near[np.repeat(np.arange(300), 6), want]
            assert differ == 0 or np.allclose(found, best, rtol=1e-9, atol=2e-9), name


def test_visits_are_bits_of_units(spark, monkeypatch):
    """A row for every query and unit, a bit for every block; bounds of any size meet what rows of query and block meet."""
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 3)))], "id int, embedding array<double>")
    i, q = (similar._prepared(items, "id", "embedding", c, "l2") for c in ("item_id", "query_id"))
    cells = similar.make_cells(i, similar.some_vectors(i, 40), "l2", 15)
    monkeypatch.setattr(similar, "UNITS", 3)
    visits = similar._visits(cells, q.withColumn("tau", F.lit(None).cast("double")), 4, 1.0)
    units = cells.told.units(15)[0]
    assert 600 < visits.count() <= 600 * len(set(units)) < 600 * len(units)
    assert visits.agg(F.max(F.length("wants"))).first()[0] == -(-np.bincount(units).max() // 8)
    for some in (visits, similar._visits(cells, q, 4, None)):
        wants = {(r["query_id"], r["unit"]): np.unpackbits(np.frombuffer(r["wants"], "uint8")) for r in some.collect()}
        pairs = [(a, *map(int, cells.told.blocks[b, :2])) for (a, u), bits in wants.items() for b, bit in zip(np.flatnonzero(units == u), bits) if bit]
        given = similar._meet(cells, q, spark.createDataFrame(pairs, "query_id int, cell int, ib int"), 4, True, 15)
        assert rows(given, "query_id", "item_id") == rows(similar._meet(cells, q, some, 4, True, 15), "query_id", "item_id")


def test_vectors_are_normalised_in_one_pass(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1e-9, 0.0]), (4, None), (5, [1.0, None])], "id int, v array<double>")
    out = similar.normalise(d, "v")
    assert "sqrt(aggregate" not in plan(out).lower()
    assert [r["v"] for r in out.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], [0.1, 0.0], None, [1.0 / 1e-8, None]]


def test_with_a_bound_no_block_is_partitioned(monkeypatch):
    """Once it is known how close a k-th item is, the others are compared with it in single precision and nothing else is done for them."""
    import pandas as pd

    rng = np.random.default_rng(11)
    v = rng.normal(size=(700, 6))
    frame = pd.DataFrame({"item_id": range(700), "v": list(v)})
    queries = frame.rename(columns={"item_id": "query_id"})
    for metric in ("l2", "cosine"):
        got = similar._search(5, metric, True)(frame, queries)
        bound = queries.assign(least=got.groupby("query_id")["closeness"].min().to_numpy())
        with monkeypatch.context() as m:
            m.setattr(np, "partition", None)
            assert similar._search(5, metric, True)(frame, bound).equals(got)
