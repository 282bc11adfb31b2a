"""Splits, features, classifier, metrics and importance on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import train as T
from offerloom.plans.aggregates import rounded
from offerloom.registry import query, table
from offerloom.session import scratch_path


_N = 64  # numbers of an embedding


def _labelled(spark, sf):
    """Embeddings as a classification table: all its numbers, one category, three tiers from the label."""
    return table(spark, sf, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(_N)], F.concat(F.lit("g"), F.col("vec_id") % 60).alias("grp"),
        F.concat(F.lit("c"), F.col("label") % 4).alias("cat"), F.when(F.col("label") < 3, "top").when(F.col("label") < 6, "good").otherwise("standard").alias("tier"))


_X = [f"x{i}" for i in range(_N)]


@query("ml01_group_split", """SELECT count(DISTINCT l_suppkey) AS n_groups, ceil(0.15::DOUBLE * count(DISTINCT l_suppkey))::BIGINT AS n_test_groups, count(*) AS n_rows, 0::BIGINT AS n_shared FROM lineitem""")
def ml01(spark, sf):
    train, test = T.group_split(table(spark, sf, "lineitem"), "l_suppkey", 0.15)
    per = train.groupBy("l_suppkey").agg(F.count("*").alias("n")).withColumn("side", F.lit(1)).unionByName(test.groupBy("l_suppkey").agg(F.count("*").alias("n")).withColumn("side", F.lit(2)))
    both = per.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum("side").alias("s"))
    return both.agg(F.count("*").alias("n_groups"), F.count_if(F.col("s") >= 2).alias("n_test_groups"), F.sum("n").alias("n_rows"), F.count_if(F.col("s") == 3).alias("n_shared"))


@query("ml01_stratified_parts", """WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, round(n * 0.7::DOUBLE)::BIGINT AS train, (round(n * 0.85::DOUBLE) - round(n * 0.7::DOUBLE))::BIGINT AS valid, (n - round(n * 0.85::DOUBLE))::BIGINT AS test FROM c""")
def ml01b(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
    p = T.stratified_parts(li, "l_returnflag", "k")
    return p.groupBy("l_returnflag").agg(*[F.count_if(F.col("part") == i).alias(n) for i, n in enumerate(["train", "valid", "test"])])


@query("ml02_group_folds", "SELECT count(DISTINCT l_suppkey) AS n_groups, count(*) AS n_rows, 3::BIGINT AS n_folds, 0::BIGINT AS n_shared, true AS balanced FROM lineitem")
def ml02(spark, sf):
    f = T.group_folds(table(spark, sf, "lineitem"), "l_suppkey", 3)
    per = f.groupBy("l_suppkey", "fold").agg(F.count("*").alias("n"))
    sizes = per.groupBy("fold").agg(F.sum("n").alias("n"))
    spread = sizes.agg(F.max("n") / F.min("n") < 1.5).scalar()
    return per.agg(F.countDistinct("l_suppkey").alias("n_groups"), F.sum("n").alias("n_rows"), F.countDistinct("fold").alias("n_folds"),
                   (F.count("*") - F.countDistinct("l_suppkey")).alias("n_shared")).withColumn("balanced", spread)


@query("ml03_numeric_features")
def ml03(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"))
    done = Pipeline(stages=T.numeric_stages(["a", "b"])).fit(x).transform(x)
    v = vector_to_array("num")
    return done.select("l_orderkey", "l_linenumber", F.round(F.get(v, F.lit(0)), 4).alias("a"), F.round(F.get(v, F.lit(1)), 4).alias("b"))


@query("ml04_pool_rare", """WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_name FROM c WHERE n >= 5 ORDER BY n DESC, p_name LIMIT 50) SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE '__other__' END AS p_name FROM part""")
def ml04(spark, sf):
    return T.pool_rare(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 5, 50)


@query("ml05_text_features")
def ml05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    from pyspark.ml.functions import vector_to_array

    return T.text_features(d, "text", 200, "tfidf").transform(d).select("doc_id", F.size(F.filter(vector_to_array("text__c"), lambda x: x > 0)).alias("n_terms"))


_WORDS = """w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]{2,}') AS w FROM part),
  t AS (SELECT p_partkey, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS t FROM w), c AS (SELECT p_partkey, t, count(*) AS tf FROM t GROUP BY ALL),
  f AS (SELECT t, count(*) AS df FROM c GROUP BY 1), x AS (SELECT p_partkey, tf * (ln(((SELECT count(*) FROM part) + 1) / (df + 1)::DOUBLE) + 1) AS x FROM c JOIN f USING (t))"""


@query("ml05_tfidf", f"WITH {_WORDS} SELECT p_partkey, count(*) AS n_terms, round(sum(x) / sqrt(sum(x * x)), 6) AS total, round(max(x) / sqrt(sum(x * x)), 6) AS largest FROM x GROUP BY 1")
def ml05b(spark, sf):
    from pyspark.ml.functions import vector_to_array

    d = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("words"))
    v = T.text_features(d, "words", 1 << 18, "tfidf").transform(d).withColumn("v", F.filter(vector_to_array("tfidf"), lambda x: x > 0))
    return rounded(v.select("p_partkey", F.size("v").cast("long").alias("n_terms"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("v").alias("largest")), 6)


@query("ml06_encode_target", "SELECT l_returnflag, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE AS label, count(*) AS n FROM lineitem GROUP BY 1")
def ml06(spark, sf):
    coded, labels = T.encode_target(table(spark, sf, "lineitem").select("l_returnflag"), "l_returnflag")
    back = T.decode_target(coded, labels, "label", "again").filter("again = l_returnflag")
    return back.groupBy("l_returnflag", "label").agg(F.count("*").alias("n"))


@query("ml07_class_weights", "SELECT l_returnflag, count(*) AS n, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*))::DOUBLE, 6) AS weight FROM lineitem GROUP BY 1")
def ml07(spark, sf):
    return rounded(T.class_weights(table(spark, sf, "lineitem"), "l_returnflag"), 6)


@query("ml08_train_classifier")
def ml08(spark, sf):
    data = _labelled(spark, sf)
    train, test = T.group_split(data, "grp", 0.2)
    model, labels = T.train_classifier(train, _X, ["cat"], "tier", numTrees=30, maxDepth=6)
    return T.score_catalog(model, labels, test, ["vec_id", "tier"])


@query("ml08_loaded_pipeline", """WITH c AS (SELECT p_name, count(*) AS n FROM part WHERE p_partkey % 5 > 0 GROUP BY 1), k AS (SELECT p_name FROM c WHERE n >= 5 ORDER BY n DESC, p_name LIMIT 50)
  SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE '__other__' END AS pooled, true AS scored, 1.0::DOUBLE AS text_length FROM part WHERE p_partkey % 5 = 0""")
def ml08c(spark, sf):
    """A pipeline with pooling and tf-idf inside it, saved, loaded and given raw rows that it has not seen."""
    from pyspark.ml.functions import vector_to_array

    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_retailprice", F.concat(F.lit("t"), F.col("p_size") % 3).alias("tier"))
    train, test = p.filter("p_partkey % 5 > 0"), p.filter("p_partkey % 5 = 0")
    model, labels = T.train_classifier(train, ["p_retailprice"], ["p_name"], "tier", text=["p_type"], numTrees=5, maxDepth=4)
    path = scratch_path(spark, "pipeline")
    T.save_model(model, path, T.describe(model, labels, train, test, ["p_retailprice", "p_name", "p_type"], "tier"))
    again, info = T.load_model(spark, path)
    done = T.decode_target(again.transform(test.drop("tier")), info["labels"])
    size = F.sqrt(F.aggregate(vector_to_array("p_type__tfidf"), F.lit(0.0), lambda s, x: s + x * x))
    return done.select("p_partkey", F.col("p_name__pool").alias("pooled"), F.col("predicted").isin(info["labels"]).alias("scored"), F.round(size, 6).alias("text_length"))


@query("ml08_train_boosted")
def ml08b(spark, sf):
    data = _labelled(spark, sf)
    train, test = T.group_split(data, "grp", 0.2)
    model, labels = T.train_classifier(train, _X, ["cat"], "tier", kind="boosted")
    return T.decode_target(model.transform(test), labels).select("vec_id", "tier", "predicted")


@query("ml09_random_search")
def ml09(spark, sf):
    train, _ = T.group_split(_labelled(spark, sf), "grp", 0.2)
    _, _, scores = T.random_search(train, _X, ["cat"], "tier", "grp", {"numTrees": [5, 10, 15], "maxDepth": [2, 4]}, n=3, folds=2)
    return spark.createDataFrame([(i, str(sorted(s.items())), float(f)) for i, (s, f) in enumerate(scores)], "trial int, setting string, f1_macro double")


# a rule that predicts the return flag, so that the metrics can be checked
_PRED = "x AS (SELECT l_returnflag AS y, CASE WHEN l_linenumber % 3 = 0 THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE l_returnflag END AS p, l_discount, l_tax FROM lineitem)"
_PCM = f"""{_PRED}, l AS (SELECT DISTINCT y AS label FROM x UNION SELECT DISTINCT p FROM x), m AS (SELECT label, (SELECT count(*) FROM x WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE p = label) AS pr, (SELECT count(*) FROM x WHERE y = label) AS support FROM l),
  q AS (SELECT label, tp, support, CASE WHEN pr > 0 THEN tp / pr::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall FROM m), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q)"""


def _predicted(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_returnflag AS y", "CASE WHEN l_linenumber % 3 = 0 THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE l_returnflag END AS p", "l_discount", "l_tax", "l_orderkey", "l_linenumber")


@query("ml10_per_class_metrics", f"WITH {_PCM} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def ml10(spark, sf):
    return rounded(T.per_class_metrics(_predicted(spark, sf), "y", "p").drop("tp"), 6)


@query("ml10_overall_metrics", f"WITH {_PCM} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, sum(support)::BIGINT AS n FROM f")
def ml10b(spark, sf):
    return rounded(T.overall_metrics(_predicted(spark, sf), "y", "p"), 6)


@query("ml10_confusion", f"WITH {_PRED}, c AS (SELECT y AS actual, p AS predicted, count(*) AS n FROM x GROUP BY ALL) SELECT *, round(n / (sum(n) OVER (PARTITION BY actual))::DOUBLE, 6) AS row_share FROM c")
def ml10c(spark, sf):
    return rounded(T.confusion(_predicted(spark, sf), "y", "p"), 6)


@query("ml10_roc_auc", f"""WITH {_PRED}, u AS (SELECT 'A' AS label, l_discount AS v, (y = 'A')::INT AS t FROM x UNION ALL SELECT 'N', l_tax, (y = 'N')::INT FROM x), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY v) + (count(*) OVER (PARTITION BY label, v) - 1) / 2::DOUBLE AS rk FROM u),
  g AS (SELECT label, sum(rk * t) AS rs, sum(t)::BIGINT AS n_pos, count(*) AS n FROM r GROUP BY 1) SELECT label, n_pos, round((rs - n_pos * (n_pos + 1) / 2::DOUBLE) / (n_pos::DOUBLE * (n - n_pos)), 6) AS auc FROM g""")
def ml10d(spark, sf):
    return rounded(T.roc_auc(_predicted(spark, sf), "y", {"A": "l_discount", "N": "l_tax"}), 6)


@query("ml11_majority_baseline", """WITH t AS (SELECT l_returnflag AS m FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1), x AS (SELECT l_returnflag = m AS hit FROM lineitem, t WHERE l_orderkey % 5 = 0)
  SELECT round(avg(hit::INT), 6) AS accuracy, count(*) AS n FROM x""")
def ml11(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(T.majority_baseline(li.filter("l_orderkey % 5 > 0"), li.filter("l_orderkey % 5 = 0"), "l_returnflag").select("accuracy", "n"), 6)


@query("ml11_baselines")
def ml11b(spark, sf):
    train, test = T.group_split(_labelled(spark, sf), "grp", 0.2)
    return T.baselines(train, test, _X, ["cat"], "tier")


@query("ml12_feature_importance")
def ml12(spark, sf):
    data = _labelled(spark, sf)
    model, _ = T.train_classifier(data, _X, ["cat"], "tier")
    return T.feature_importance(model, data)


@query("ml12_permutation_importance")
def ml12b(spark, sf):
    data = _labelled(spark, sf)
    coded, _ = T.encode_target(data, "tier")
    model, _ = T.train_classifier(data, _X, ["cat"], "tier")
    return T.permutation_importance(model, coded, ["cat", "x0"], "vec_id")


@query("ml13_error_sample", f"WITH {_PRED.replace('AS p, l_discount, l_tax', 'AS p, l_orderkey, l_linenumber, l_discount')} SELECT y, p, l_orderkey, l_linenumber FROM x WHERE y <> p ORDER BY l_orderkey, l_linenumber, y, p LIMIT 20")
def ml13(spark, sf):
    return T.error_sample(_predicted(spark, sf).select("y", "p", "l_orderkey", "l_linenumber"), "y", "p", ["l_orderkey", "l_linenumber", "y", "p"], 20)


@query("ml14_model_info")
def ml14(spark, sf):
    data = _labelled(spark, sf)
    model, labels = T.train_classifier(data, _X, ["cat"], "tier")
    path = scratch_path(spark, "model")
    T.save_model(model, path, T.describe(model, labels, data, data, [*_X, "cat"], "tier"))
    again, info = T.load_model(spark, path)
    scored = again.transform(data).groupBy("prediction").agg(F.count("*").alias("n"))
    meta = T.model_info(spark, path, "labels array<string>, n_train bigint, accuracy double, data_hash string, params map<string,string>")
    return scored.withColumn("labels", F.lit(",".join(info["labels"]))).crossJoin(meta.select("n_train", "accuracy", "data_hash", F.size("params").alias("n_params")))


@query("scr03_score_catalog")
def scr03(spark, sf):
    data = _labelled(spark, sf)
    model, labels = T.train_classifier(data, _X, ["cat"], "tier")
    return T.score_catalog(model, labels, data, ["vec_id"])


@query("ml02_stratified_folds", "SELECT l_returnflag, 3::BIGINT AS n_folds, count(*) AS n_rows, true AS even FROM lineitem GROUP BY 1")
def ml02b(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"))
    per = T.stratified_folds(li, "l_returnflag", "k").groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"))
    return per.groupBy("l_returnflag").agg(F.count("*").alias("n_folds"), F.sum("n").alias("n_rows"), (F.max("n") - F.min("n") <= 1).alias("even"))


@query("ml02_stratified_group_folds", """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, max(n) AS n FROM g GROUP BY 1)
  SELECT count(DISTINCT l_suppkey) AS n_groups, sum(n)::BIGINT AS n_rows, 3::BIGINT AS n_folds, 0::BIGINT AS n_split, true AS within_bound FROM g""")
def ml02c(spark, sf):
    f = T.stratified_group_folds(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag")
    per = f.groupBy("l_suppkey", "l_returnflag", "fold").agg(F.count("*").alias("n"))
    main = per.groupBy("l_suppkey", "fold").agg(F.max_by(F.struct("l_returnflag", "n"), F.struct("n", F.xxhash64("l_returnflag"))).alias("m"))
    dealt = main.groupBy("m.l_returnflag", "fold").agg(F.sum("m.n").alias("n"), F.max("m.n").alias("largest"))
    bound = dealt.groupBy("l_returnflag").agg((F.max("n") - F.min("n") <= F.max("largest")).alias("ok"), F.count("*").alias("folds")).filter("folds = 3").agg(F.bool_and("ok")).scalar()
    return per.agg(F.countDistinct("l_suppkey").alias("n_groups"), F.sum("n").alias("n_rows"), F.countDistinct("fold").alias("n_folds"),
                   (F.countDistinct("l_suppkey", "fold") - F.countDistinct("l_suppkey")).alias("n_split")).withColumn("within_bound", bound)


@query("ml10_weighted_auc", f"""WITH {_PRED}, u AS (SELECT 'A' AS label, l_discount AS v, (y = 'A')::INT AS t FROM x UNION ALL SELECT 'N', l_tax, (y = 'N')::INT FROM x), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY v) + (count(*) OVER (PARTITION BY label, v) - 1) / 2::DOUBLE AS rk FROM u),
  g AS (SELECT label, sum(rk * t) AS rs, sum(t)::BIGINT AS p, count(*) AS n FROM r GROUP BY 1), a AS (SELECT p, (rs - p * (p + 1) / 2::DOUBLE) / (p::DOUBLE * (n - p)) AS auc FROM g) SELECT round(sum(auc * p) / sum(p), 6) AS auc_weighted FROM a""")
def ml10e(spark, sf):
    return rounded(T.weighted_auc(T.roc_auc(_predicted(spark, sf), "y", {"A": "l_discount", "N": "l_tax"})), 6)


@query("rec01_default_scores", "SELECT p_partkey, 'unknown' AS predicted_tier, 0.5::DOUBLE AS match_score, 'low' AS confidence_band FROM part")
def rec01_default(spark, sf):
    return T.default_scores(table(spark, sf, "part"), ["p_partkey"])
