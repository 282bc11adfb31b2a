"""From raw documents to packed training sequences: filter, line dedup, near-dedup, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import lines, minhash, mixing, packing, quality
from offerloom.llm.common import few_parts, keep
from offerloom.llm.queries import table, tokenizer


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where there is such a column, follows the text; a null text leaves it as it was."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars").cast("long")))
    return docs.select(*columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.judged(docs).filter("kept").select("doc.*")


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of three-line windows seen before; those of which only white space is left go."""
    out = lines.remove_repeated_lines(docs).filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return _measured(out.select("doc_id", F.col("kept").alias("text"), *[F.col("rest").getField(c).alias(c) for c in others]), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, 80, 5)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source in part, by DataFrame functions only."""
    return _measured(mixing.mix(docs, zip_texts=False), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return few_parts(packing.pack(docs, tokenizer(), 2048))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", fresh_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("mixing_sources", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: The label model, the permutations and the packing plan are no SQL; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
