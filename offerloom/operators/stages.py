"""Pipeline stages that Spark ML lacks: pooling of rare categories and smoothed tf-idf. They are saved and loaded with their pipeline."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


class _PoolParams(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Shared by estimator and model."""

    pooled = Param(Params._dummy(), "pooled", "name of the pooled category", typeConverter=TypeConverters.toString)


class RareCategoryPooler(Estimator, _PoolParams):
    """Keeps the categories that occur ``minCount`` times, the ``maxCategories`` most frequent ones of them (ties by name)."""

    minCount = Param(Params._dummy(), "minCount", "least occurrences of a category", typeConverter=TypeConverters.toInt)
    maxCategories = Param(Params._dummy(), "maxCategories", "most categories kept", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, minCount=5, maxCategories=50, pooled="__other__"):
        super().__init__()
        self._setDefault(minCount=5, maxCategories=50, pooled="__other__")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RareCategoryModel":
        cols, k = self.getInputCols(), self.getOrDefault(self.maxCategories)
        seen = dataset.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "c", "v").filter("v IS NOT NULL").groupBy("c", "v").count()
        kept = []
        for c in cols:  # one row beyond the bound tells the mode, too
            top = seen.filter(F.col("c") == c).orderBy(F.desc("count"), "v").limit(k).collect()
            kept.append({"mode": top[0]["v"] if top else None, "kept": [r["v"] for r in top if r["count"] >= self.getOrDefault(self.minCount)]})
        return RareCategoryModel(inputCols=cols, outputCols=self.getOutputCols(), pooled=self.getOrDefault(self.pooled), kept=json.dumps(kept))


class RareCategoryModel(Model, _PoolParams):
    """The kept categories as they are, null as the most frequent one, all others as the pooled one."""

    kept = Param(Params._dummy(), "kept", "mode and kept categories of each column, as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, pooled="__other__", kept="[]"):
        super().__init__()
        self._setDefault(pooled="__other__", kept="[]")
        self._set(**self._input_kwargs)

    def categories(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.kept))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pooled, out = F.lit(self.getOrDefault(self.pooled)), dataset
        for c, to, told in zip(self.getInputCols(), self.getOutputCols(), self.categories()):
            v = F.coalesce(F.col(c).cast("string"), F.lit(told["mode"]))
            out = out.withColumn(to, F.when(v.isin(told["kept"]), v).otherwise(pooled) if told["kept"] else pooled)
        return out


class FrequentTerms(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts the ``vocabSize`` most frequent terms (ties by name). Terms are counted by a grouping that spills instead of a cache of
    all terms; its model is Spark's own."""

    vocabSize = Param(Params._dummy(), "vocabSize", "most terms kept", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, vocabSize=200):
        super().__init__()
        self._setDefault(vocabSize=200)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        seen = dataset.select(F.explode(self.getInputCol()).alias("t")).groupBy("t").count()
        terms = [r["t"] for r in seen.orderBy(F.desc("count"), "t").limit(self.getOrDefault(self.vocabSize)).collect()]
        if not terms:
            raise ValueError("no terms to count")
        return CountVectorizerModel.from_vocabulary(terms, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weighs term counts by the smoothed inverse document frequency plus one; its model is a plain product, which Spark saves itself."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.getInputCol(), outputCol="_idf").fit(dataset.select(self.getInputCol())).idf.toArray()
        return ElementwiseProduct(scalingVec=Vectors.dense([x + 1.0 for x in idf]), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def text_stages(col: str, terms: int = 200, out: str = "text") -> list:
    """Words and word pairs of a column to unit tf-idf vectors of its ``terms`` most frequent terms; null is an empty text."""
    return [
        SQLTransformer(statement=f"SELECT *, coalesce({col}, '') AS {col}__s FROM __THIS__"),
        RegexTokenizer(inputCol=f"{col}__s", outputCol=f"{col}__w", pattern=r"[\p{L}\p{N}]{2,}", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol=f"{col}__w", outputCol=f"{col}__f"), NGram(n=2, inputCol=f"{col}__f", outputCol=f"{col}__g"),
        SQLTransformer(statement=f"SELECT *, concat({col}__f, {col}__g) AS {col}__t FROM __THIS__"),
        FrequentTerms(inputCol=f"{col}__t", outputCol=f"{col}__c", vocabSize=terms), SmoothIdf(inputCol=f"{col}__c", outputCol=f"{col}__x"),
        Normalizer(inputCol=f"{col}__x", outputCol=out, p=2.0),
    ]
