"""Inputs that the benchmark tables do not hold: text ids, missing scores, repeated keys, null groups, ties."""

from offerloom.operators import evaluate, match, train
from offerloom.sources import sinks


def test_first_hit_on_text_ids_and_missing_scores(spark):
    preds = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.9), (1, "d", None)], "query_id int, item_id string, score double")
    truth = spark.createDataFrame([(1, "b"), (1, "d")], "query_id int, item_id string")
    assert evaluate.metrics_per_query(preds, truth).first()["mrr"] == 1 / 3


def test_joins_keep_row_counts(spark):
    df = spark.createDataFrame([("x", None), ("y", "z")], "name string, city string")
    names = spark.createDataFrame([("x", "q"), ("x", "p")], "a string, t string")
    assert sorted(r["name"] for r in match.alias_join(df, names, "name", "a", "t").collect()) == ["p", "y"]
    ref = spark.createDataFrame([("x", "c2"), ("x", "c1")], "k string, city string")
    assert sorted(map(tuple, match.fill_from_reference(df, ref, "name", "k", ["city"], []).collect())) == [("x", "c1"), ("y", "z")]


def test_null_groups_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "label string, v int")
    assert train.with_weights(df, "label").count() == 4
    assert {r["label"] for r in evaluate.sample_per_group(df, "label", "v", 0.5).collect()} == {"a", None}
    kept, expired = sinks.keep_latest_versions(spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("k", 1, 3), (None, 1, 4)], "key string, version int, x int"), "key", "version", 1)
    assert (kept.count(), expired.count()) == (2, 2)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.9)], "actual string, score double")
    assert train.roc_auc(df, "actual", {"a": "score"}).first()["auc"] is None


def test_null_scores_and_text_columns_in_row_numbers(spark):
    import random

    from offerloom.operators import evaluate, prefix

    r = random.Random(9)
    data = [(i, r.choice(["a", "b", None]), r.choice([None, 1.5, 2.5, -3.0]), r.choice(["", "x", "xy", "same start, end one", "same start, end two", None])) for i in range(600)]
    d = spark.createDataFrame(data, "id int, g string, score double, name string")
    by = lambda x, desc: (x is None) if desc else (x is not None)
    for order in ([("score", True), ("id", False)], [("name", False), ("score", True), ("id", False)], [("name", True), ("id", True)]):
        got = {x["id"]: x["rn"] for x in prefix.row_numbers(d, ["g"], order, "rn").collect()}
        assert {x["id"]: x["rn"] for x in prefix.row_numbers(d, ["g"], order, "rn", hot_rows=20).collect()} == got
        want = {}
        for g in ("a", "b", None):
            rows = [x for x in data if x[1] == g]
            for c, desc in reversed(order):
                k = ["id", "g", "score", "name"].index(c)
                rows.sort(key=lambda x: (x[k] is not None, x[k] if x[k] is not None else (0 if k != 3 else "")), reverse=desc)
            want.update({x[0]: n + 1 for n, x in enumerate(rows)})
        assert got == want
    p = evaluate.rank_in_query(spark.createDataFrame([("q", 1, None), ("q", 2, 0.5)], "q string, item int, s double"), "q", "item", "s")
    assert {x["item"]: x["position"] for x in p.collect()} == {2: 1, 1: 2}


def test_quantiles_by_selection(spark):
    import numpy as np

    from offerloom.operators import prefix

    d = spark.range(90_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('g', id % 2) END AS g",
        "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN double('NaN') WHEN id % 5 = 0 THEN 7.0D ELSE cast(pmod(xxhash64(id), 100000) AS double) END AS v")
    t = d.toPandas()
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in prefix.quantiles(d, ["g"], "v", probs, accuracy=1000).collect()}
    plain = {(r["g"], r["prob"]): r["quantile"] for r in prefix.quantiles_of(prefix.running_totals(prefix.value_counts(d, ["g"], "v"), ["g"], "v", ["cnt"]), ["g"], "v", probs).collect()}
    assert got == plain and len(got) == 4 * len(probs)
    for g in ("hot", "g0", "g1"):
        v = t[t.g == g].v.dropna()
        assert np.allclose([got[g, p] for p in probs], np.quantile(v, probs))
    assert prefix.quantiles(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,)], "v double"), [], "v", [0.5]).first()["quantile"] == 2.0


def test_nothing_is_lost_without_a_group_or_label(spark):
    from offerloom.operators import train

    d = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 23}", None if i % 4 == 0 else f"l{i % 3}") for i in range(400)], "id int, g string, l string")
    assert train.group_folds(d, "g").count() == train.stratified_parts(d, "l", "id").count() == 400
    f = train.stratified_folds(d, "l", "id")
    per = {(r["l"], r["fold"]): r["count"] for r in f.groupBy("l", "fold").count().collect()}
    assert f.count() == 400 and all(max(v) - min(v) <= 1 for v in ([n for (x, _), n in per.items() if x == l] for l in {x for x, _ in per}))
    g = train.stratified_group_folds(d, "g", "l")
    assert g.count() == 400 and g.select("g", "fold").distinct().count() == d.select("g").distinct().count() and g.select("fold").distinct().count() == 3


def test_repeated_keys_make_no_more_rows(spark):
    from offerloom.operators import match, pages, stats

    a = spark.createDataFrame([(1, "", "u"), (2, "y", "v")], "k int, city string, url string")
    b = spark.createDataFrame([(1, "p", "w"), (1, "q", "w"), (3, "r", None)], "k int, city string, url string")
    assert sorted(map(tuple, stats.enrich_empty(a, b, "k", ["city"]).collect())) == [(1, "p", "u"), (2, "y", "v")]
    assert sorted(map(tuple, pages.merge_over(a, b, "k").collect())) == [(1, "p", "w"), (2, "y", "v")]
    o = spark.createDataFrame([("u", "Other", "Masters")], "url string, category string, degree_level string")
    l = spark.createDataFrame([("u", "B", "PhD", 2), ("u", "C", "Grad", 1), ("u", "A", "A", 3)], "link string, category string, degree_level string, at int")
    assert [tuple(r) for r in match.backfill_from_discovery(o, l, "url", "link", "at").collect()] == [("u", "C", "Grad")]


def test_first_containing_text_against_brute_force(spark):
    import random

    from offerloom.operators import match

    rng = random.Random(4)
    words = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(160)]
    l, r = words[:80], [(w, i) for i, w in enumerate(words[80:])]
    got = {x["l"]: x["r"] for x in match.first_containing(spark.createDataFrame([(w,) for w in l], "l string"), spark.createDataFrame(r, "r string, o int")).collect()}
    assert got == {a: next(b for b, _ in r if a in b or b in a) for a in l if any(a in b or b in a for b, _ in r)}


def test_one_quoted_file_read_by_several_tasks(spark, tmp_path):
    import csv
    import random

    from offerloom.sources import readers

    r = random.Random(8)
    rows = [(i, r.choice(["plain", 'with "quotes"', "two\nlines", 'a\n\n"b", c\nd', "é, ö", "x" * 200]) * r.randint(1, 3), i / 4) for i in range(3000)]
    with open(tmp_path / "big.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["k", "text", "v"])
        w.writerows(rows)
    schema = spark.createDataFrame([], "k int, text string, v double").schema
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 10
        got = readers.read_split_csv(spark, f"file://{tmp_path}/big.csv", schema)
        assert sorted(map(tuple, got.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert rows == sorted(map(tuple, readers.read_catalog_csv(spark, [f"file://{tmp_path}/big.csv"], schema).collect()))
