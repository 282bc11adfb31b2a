"""Tier classifier on Spark ML: splits, features, search, metrics, baselines, importance, storage."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    Imputer, IndexToString, OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from offerloom.functions import columns as C
from offerloom.operators import prefix
from offerloom.operators.stages import RareCategoryPooler, text_stages
from offerloom.session import materialise

SEED = 42


# --- splits ------------------------------------------------------------------------------------


def _group_order(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Distinct groups with a seeded hash that orders them and the row count of each."""
    return df.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.col(group), F.lit(seed)))


def group_split(df: DataFrame, group: str, test_share: float = 0.15, seed: int = SEED, hot_rows: int = prefix.HOT_ROWS):
    """(train, test) with whole groups: the ceil(share * groups) groups of smallest hash go to test."""
    by_hash = _group_order(df, group, seed).groupBy("h").agg(F.count("*").alias("g"))
    cum = prefix.running_totals(by_hash, [], "h", ["g"], hot_rows)
    edge = cum.filter(F.col("cum_g") <= F.ceil(F.col("total_g") * F.lit(test_share))).agg(F.max("h").alias("h"))
    marked = df.withColumn("_test", F.coalesce(F.xxhash64(F.col(group), F.lit(seed)) <= edge.scalar(), F.lit(False)))
    return marked.filter(~F.col("_test")).drop("_test"), marked.filter("_test").drop("_test")


def stratified_parts(df: DataFrame, label: str, key: str, shares=(0.70, 0.15, 0.15), seed: int = SEED, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Adds ``part`` 0, 1, 2...: exact shares within each class, by seeded hash order of the key. The frame is read several times."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)).cast("double")).withColumn("_k", F.xxhash64(F.col(key)))
    ranked = prefix.row_numbers(hashed, [label], [("_h", False), ("_k", False)], "_rn", hot_rows, reread=True)
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    at, part = 0.0, None
    for i, s in enumerate(shares[:-1]):
        at += s
        hit = F.col("_rn") <= F.round(F.col("_n") * at)
        part = F.when(hit, i) if part is None else part.when(hit, i)
    sizes = sizes.withColumnRenamed(label, "_l")
    return ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_l"))).withColumn("part", part.otherwise(len(shares) - 1)).select(*df.columns, "part")


def group_folds(df: DataFrame, group: str, folds: int = 3, seed: int = SEED, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Adds ``fold``: groups by size, dealt forth and back, so folds share no group and hold similar row counts."""
    sizes = _group_order(df, group, seed).withColumn("h", F.col("h").cast("double"))
    ranked = prefix.row_numbers(sizes, [], [("n", True), ("h", False)], "_rn", hot_rows)
    at = F.pmod(F.col("_rn") - 1, F.lit(2 * folds))
    fold = F.when(at < folds, at).otherwise(F.lit(2 * folds - 1) - at).cast("int")
    dealt = ranked.select(F.col(group).alias("_g"), fold.alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 3, seed: int = SEED, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Adds ``fold``: the rows of each class (null is one), in seeded hash order of the key, are dealt one after the other, so folds differ by one row
    of a class at most. The frame is read several times."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)).cast("double")).withColumn("_k", F.xxhash64(F.col(key)))
    ranked = prefix.row_numbers(hashed, [label], [("_h", False), ("_k", False)], "_rn", hot_rows, reread=True)
    return ranked.select(*df.columns, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int").alias("fold"))


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int = 3, seed: int = SEED, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Adds ``fold``: whole groups, balanced by their labels; null groups and labels are values like others.

    Every group counts for its most frequent label. The groups of a label, by falling number of rows with it, are dealt forth and back, so that
    of these rows two folds differ by those of the label's largest group at most.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    main = counts.groupBy(group).agg(F.max_by(F.struct(F.col(label).alias("l"), "n"), F.struct("n", F.xxhash64(label))).alias("m"))
    sizes = main.select(group, F.col("m.l").alias("l"), F.col("m.n").alias("n"), F.xxhash64(F.col(group), F.lit(seed)).cast("double").alias("h"))
    ranked = prefix.row_numbers(sizes, ["l"], [("n", True), ("h", False)], "_rn", hot_rows)
    at = F.pmod(F.col("_rn") - 1 + F.pmod(F.xxhash64("l"), F.lit(2)) * folds, F.lit(2 * folds))  # labels begin at either end
    fold = F.when(at < folds, at).otherwise(F.lit(2 * folds - 1) - at).cast("int")
    dealt = ranked.select(F.col(group).alias("_g"), fold.alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


# --- features --------------------------------------------------------------------------------------


def pool_rare(df: DataFrame, col: str, min_count: int = 5, max_categories: int = 50, pooled: str = "__other__") -> DataFrame:
    """Categories below ``min_count`` or beyond the most frequent ones become one pooled category; null is the mode."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    keep = counts.filter(F.col("n") >= min_count).orderBy(F.col("n").desc(), col).limit(max_categories)
    keep = keep.select(F.col(col).alias("_c"))
    mode = counts.agg(F.max_by(col, F.struct("n", F.col(col)))).scalar()
    filled = df.withColumn(col, F.coalesce(F.col(col), mode))
    return filled.join(keep, F.col(col) == F.col("_c"), "left").withColumn(col, F.coalesce("_c", F.lit(pooled))).drop("_c")


def numeric_stages(cols) -> list:
    mids = [f"{c}__imp" for c in cols]
    return [
        Imputer(strategy="median", inputCols=list(cols), outputCols=mids, relativeError=0.001),
        VectorAssembler(inputCols=mids, outputCol="num_raw"),
        RobustScaler(inputCol="num_raw", outputCol="num", withCentering=True, withScaling=True, relativeError=0.001),
    ]


def categorical_stages(cols) -> list:
    idx = [f"{c}__idx" for c in cols]
    return [
        StringIndexer(inputCols=list(cols), outputCols=idx, handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=idx, outputCols=[f"{c}__hot" for c in cols], handleInvalid="keep"),
    ]


def text_features(df: DataFrame, col: str, terms: int = 200, out: str = "text") -> PipelineModel:
    """Fitted tf-idf over words and word pairs: smoothed idf plus one, unit length."""
    return Pipeline(stages=text_stages(col, terms, out)).fit(df.select(col))


def encode_target(df: DataFrame, target: str):
    """(frame with ``label``, labels in alphabetical order)."""
    model = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def decode_target(df: DataFrame, labels, col: str = "prediction", out: str = "predicted") -> DataFrame:
    return IndexToString(inputCol=col, outputCol=out, labels=list(labels)).transform(df)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(class, n, weight): rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total, k = df.agg(F.count("*")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", total / (k * F.col("n")))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    w = class_weights(df, label).select(F.col(label).alias("_l"), "weight")
    return df.join(F.broadcast(w), df[label].eqNullSafe(w["_l"])).drop("_l")  # a row per class; the rows stay where they are


def assemble(numeric, categorical, text=(), min_count: int = 5, max_categories: int = 50, terms: int = 200) -> list:
    """Stages from raw columns to ``features``: scaled numbers, one-hot categories with the rare ones pooled, tf-idf of texts."""
    pooled = [f"{c}__pool" for c in categorical]
    parts = (["num"] if numeric else []) + [f"{c}__hot" for c in pooled] + [f"{c}__tfidf" for c in text]
    pool = [RareCategoryPooler(inputCols=list(categorical), outputCols=pooled, minCount=min_count, maxCategories=max_categories)] if categorical else []
    return [*(numeric_stages(numeric) if numeric else []), *pool, *(categorical_stages(pooled) if categorical else []),
            *[s for c in text for s in text_stages(c, terms, f"{c}__tfidf")], VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


# --- models ----------------------------------------------------------------------------------------------


def classifier(kind: str = "forest", weight: str | None = "weight", seed: int = SEED, **params):
    if kind == "boosted":
        gbt = GBTClassifier(seed=seed, maxIter=params.pop("maxIter", 20), maxDepth=params.pop("maxDepth", 4), **params)
        return OneVsRest(classifier=gbt, featuresCol="features", labelCol="label", **({"weightCol": weight} if weight else {}))
    extra = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, **extra, **params)


#: Most rows of a partition that a forest keeps in memory as binned features, while there are less than ``PARTITIONS_A_CORE`` of them a core.
PARTITION_ROWS = 25_000
#: Every level of every tree runs two tasks a partition and each tells the driver about itself; a larger partition that does not fit in memory is kept on disk.
PARTITIONS_A_CORE = 4


def spread(df: DataFrame, rows: int = PARTITION_ROWS, most: int | None = None) -> DataFrame:
    """As many partitions as the rows need, as files of few bytes may hold many rows, but ``most`` at most: a few for every core of the session,
    so that what training sends to the driver does not grow with the rows."""
    most = PARTITIONS_A_CORE * max(4, df.sparkSession.sparkContext.defaultParallelism) if most is None else most
    need, there = min(-(-df.count() // rows), most), df.rdd.getNumPartitions()
    return df.repartition(need) if need > there else df.coalesce(most) if there > most else df


def train_classifier(df: DataFrame, numeric, categorical, target: str, kind: str = "forest", text=(), **params):
    """(fitted pipeline, labels). Classes are weighted inversely to their size. The pipeline takes raw rows, also after it was saved and loaded."""
    coded, labels = encode_target(df, target)
    data = spread(with_weights(coded, "label"))
    model = Pipeline(stages=[*assemble(numeric, categorical, text), classifier(kind, **params)]).fit(data)
    return model, labels


def sampled_grid(estimator, space: dict, n: int = 20, seed: int = SEED) -> list:
    """``n`` distinct settings drawn from the full grid."""
    builder = ParamGridBuilder()
    for name, values in space.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    grid = builder.build()
    return random.Random(seed).sample(grid, min(n, len(grid)))


def random_search(df: DataFrame, numeric, categorical, target: str, group: str, space: dict, n: int = 20, folds: int = 3,
                  parallelism: int = 4, seed: int = SEED):
    """(best fitted pipeline, labels, [(setting, mean macro F1)]). Folds never share a group."""
    coded, labels = encode_target(df, target)
    data = group_folds(with_weights(coded, "label"), group, folds, seed)
    est = classifier("forest", seed=seed)
    grid = sampled_grid(est, space, n, seed)
    pipe = Pipeline(stages=[*assemble(numeric, categorical), est])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MacroF1(), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed)
    fitted = cv.fit(data)
    scores = [({p.name: v for p, v in g.items()}, s) for g, s in zip(grid, fitted.avgMetrics)]
    return fitted.bestModel, labels, scores


class MacroF1(MulticlassClassificationEvaluator):
    """Unweighted mean of the per-class F1 scores."""

    def _evaluate(self, dataset):
        row = overall_metrics(dataset.select(F.col("label"), F.col("prediction")), "label", "prediction").first()
        return float(row["f1_macro"])

    def isLargerBetter(self):
        return True


# --- scoring and metrics ------------------------------------------------------------------------------------


def default_scores(df: DataFrame, keep) -> DataFrame:
    """What is served when no model can score: a neutral score without tier or confidence."""
    return df.select(*keep, F.lit("unknown").alias("predicted_tier"), F.lit(0.5).alias("match_score"), F.lit("low").alias("confidence_band"))


def score_catalog(model: PipelineModel, labels, df: DataFrame, keep) -> DataFrame:
    """Predicted tier, class probabilities, match score and band, in score order of the reader's choice."""
    scored = model.transform(df)
    p = vector_to_array("probability")
    out = decode_target(scored, labels, "prediction", "predicted_tier").withColumn("_p", p)
    return out.select(*keep, "predicted_tier", *[F.get("_p", F.lit(i)).alias(f"p_{l}") for i, l in enumerate(labels)],
                      F.round(C.match_score("_p", labels), 4).alias("match_score"), C.confidence_band("_p").alias("confidence_band"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return cells.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def per_class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from one count of (actual, predicted)."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pre"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pre"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("s")).select("s.*")
    g = both.groupBy("label").agg(F.sum("sup").alias("support"), F.sum("pre").alias("predicted"), F.sum("tp").alias("tp"))
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    g = g.withColumn("precision", div(F.col("tp"), F.col("predicted"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    return g.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(
        "label", "precision", "recall", "f1", "support", "tp")


def overall_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return per_class_metrics(df, actual, predicted).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"), F.sum("support").alias("n"),
    )


def roc_auc(df: DataFrame, actual: str, scores: dict[str, str], hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """One-vs-rest area under the curve per class by rank sums; class-size weighting is a plain mean over ``n_pos``."""
    long = df.select(F.col(actual).alias("_a"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("label"), F.col(c).cast("double").alias("value")) for k, c in scores.items()])).alias("s")).select(
        F.col("s.label").alias("label"), F.col("s.value").alias("value"), (F.col("_a") == F.col("s.label")).cast("int").alias("y"))
    hist = long.groupBy("label", "value").agg(F.count("*").alias("cnt"), F.sum("y").alias("pos"))
    cum = prefix.running_totals(hist, ["label"], "value", ["cnt"], hot_rows)
    rank = F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2
    g = cum.groupBy("label").agg(F.sum(rank * F.col("pos")).alias("rs"), F.sum("pos").alias("n_pos"), F.max("total_cnt").alias("n"))
    p, q = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return g.select("label", "n_pos", F.try_divide(F.col("rs") - p * (p + 1) / 2, p * q).alias("auc"))


def weighted_auc(auc: DataFrame) -> DataFrame:
    return auc.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc_weighted"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by(label, F.struct("n", F.col(label)))).scalar()
    return overall_metrics(test.withColumn("_p", top), label, "_p")


def baselines(train: DataFrame, test: DataFrame, numeric, categorical, target: str) -> DataFrame:
    """(model, accuracy, f1_macro, f1_weighted) of the majority class, a logistic regression and a small tree."""
    coded, labels = encode_target(train, target)
    coded_test = test.join(train.sparkSession.createDataFrame([(l, float(i)) for i, l in enumerate(labels)], f"{target} string, label double"), target)
    rows = majority_baseline(coded, coded_test, "label").withColumn("model", F.lit("majority"))
    prep = Pipeline(stages=assemble(numeric, categorical)).fit(coded)
    a, b = prep.transform(coded), prep.transform(coded_test)
    for name, est in [("logistic", LogisticRegression(maxIter=50)), ("tree", DecisionTreeClassifier(maxDepth=5, seed=SEED))]:
        rows = rows.unionByName(overall_metrics(est.fit(a).transform(b), "label", "prediction").withColumn("model", F.lit(name)))
    return rows.select("model", "accuracy", "f1_macro", "f1_weighted")


# --- importance, errors, storage ---------------------------------------------------------------------------------


def feature_names(transformed: DataFrame, col: str = "features") -> list[str]:
    attrs = transformed.schema[col].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [n for _, n in named]


def feature_importance(model: PipelineModel, df: DataFrame, n: int = 20) -> DataFrame:
    spark = df.sparkSession
    head = PipelineModel(stages=model.stages[:-1]).transform(df.limit(1))
    names = feature_names(head)
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(n)


def shuffled(df: DataFrame, col: str, key: str, seed: int, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """The frame with one column permuted: rows and values are numbered in two hash orders and joined."""
    a = prefix.row_numbers(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)).cast("double")), [], [("_h", False)], "_rn", hot_rows)
    b = prefix.row_numbers(df.select(F.col(col).alias("_v"), F.xxhash64(F.col(key), F.lit(seed + 7919)).cast("double").alias("_h")), [], [("_h", False)], "_rn", hot_rows)
    return a.drop(col, "_h").join(b.select("_rn", F.col("_v").alias(col)), "_rn").select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, cols, key: str, label: str = "label", repeats: int = 5,
                           rows: int | None = None, seed: int = SEED) -> DataFrame:
    """Mean loss of macro F1 after permuting a column, on all rows, or on ``rows`` of them drawn by hash."""
    drawn = materialise(df if rows is None else df.orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(rows), "permuted")
    score = lambda d: float(overall_metrics(model.transform(d), label, "prediction").first()["f1_macro"])
    base = score(drawn)
    out = []
    for c in cols:
        drops = [base - score(shuffled(drawn, c, key, seed + r)) for r in range(repeats)]
        mean = sum(drops) / repeats
        out.append((c, mean, math.sqrt(sum((d - mean) ** 2 for d in drops) / repeats)))
    return df.sparkSession.createDataFrame(out, "feature string, importance double, spread double")


def error_sample(df: DataFrame, actual: str, predicted: str, order, n: int = 20) -> DataFrame:
    return df.filter(F.col(actual) != F.col(predicted)).orderBy(*order).limit(n)


def save_model(model: PipelineModel, path: str, info: dict) -> None:
    """Pipeline and its description (features, labels, params, metrics, data fingerprint) side by side."""
    model.write().overwrite().save(f"{path}/pipeline")
    SparkSession.active().createDataFrame([(json.dumps(info, sort_keys=True),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def describe(model: PipelineModel, labels, train: DataFrame, test: DataFrame, features, target: str) -> dict:
    """What is saved beside a model: features, labels, parameters of the classifier, metrics and baseline on the test rows, sizes, and a fingerprint
    of the training data that does not depend on the order of rows."""
    told = decode_target(model.transform(test), labels)
    m = overall_metrics(told, target, "predicted").first()
    base = majority_baseline(train, test, target).first()
    data = train.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*[F.col(c) for c in sorted({*features, target})])).alias("h")).first()
    head = model.stages[-1]
    return {
        "features": list(features), "labels": list(labels), "model": type(head).__name__, "params": {p.name: str(v) for p, v in sorted(head.extractParamMap().items(), key=lambda x: x[0].name)},
        "accuracy": m["accuracy"], "f1_macro": m["f1_macro"], "f1_weighted": m["f1_weighted"], "baseline_accuracy": base["accuracy"],
        "n_train": data["n"], "n_test": m["n"], "data_hash": f"{data['h'] & (2**64 - 1):016x}" if data["n"] else "0" * 16,
    }


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    info = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return PipelineModel.load(f"{path}/pipeline"), info


def model_info(spark, path: str, schema: str) -> DataFrame:
    return spark.read.text(f"{path}/metadata").select(F.from_json("value", schema).alias("i")).select("i.*")
