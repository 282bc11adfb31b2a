"""Readers for landed files. Schemas are declared; inference is left to profiling jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from offerloom.functions import columns as C
from offerloom.session import materialise


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_catalog_csv(spark: SparkSession, paths, schema=None) -> DataFrame:
    """CSV with header from the first path that exists."""
    for path in paths:
        if _exists(spark, path):
            reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
            return (reader.schema(schema) if schema is not None else reader).csv(path)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def _line_counts(batches):
    """Per split of a file: quotes, and the records that start in it if it begins outside quotes and if it begins inside."""
    seen: dict[tuple, list] = {}
    for t in batches:
        for key, part in t.groupby(["file", "block"], sort=False):
            told = seen.setdefault(key, [0, 0, 0])
            before = told[0] + part["quotes"].cumsum() - part["quotes"]
            told[1] += int((before % 2 == 0).sum())
            told[2] += int((before % 2 == 1).sum())
            told[0] += int(part["quotes"].sum())
    yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["file", "block", "quotes", "outside", "inside"])


def _number_lines(batches):
    """Adds to the lines of each split their number there, that of their record, and whether they are a whole record; ``open`` tells whether the
    split begins inside quotes."""
    columns = ["file", "block", "value", "line", "record", "whole"]
    held: dict[tuple, list] = {}
    for t in batches:
        out = []
        for key, part in t.groupby(["file", "block"], sort=False):
            told = held.setdefault(key, [int(part["open"].iloc[0]), 0, 0])
            before = told[0] + part["quotes"].cumsum() - part["quotes"]
            starts = (before % 2 == 0).astype("int64")
            out.append(part.assign(line=told[1] + np.arange(len(part)), record=part["records"] + told[2] + starts.cumsum() - 1, whole=(starts == 1) & (part["quotes"] % 2 == 0)))
            told[0] += int(part["quotes"].sum())
            told[1] += len(part)
            told[2] += int(starts.sum())
        yield pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted CSV with a header, whose fields may hold line breaks, read by as many tasks as the files have splits.

    Whether a line break ends a record depends on the quotes before it in the file. A first scan counts the quotes of every split; their running
    sums say for each split whether it begins inside quotes and how many records start before it, so a second scan can number the records of
    every line. Records of one line are parsed where they are, only the lines of longer ones are brought together.
    Columns are taken by position, the first record of each file is its header. Records end with a line feed, a carriage return before it is dropped.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", quotes.cast("long").alias("quotes"))
    counts = materialise(lines.select("file", "block", "quotes").mapInPandas(_line_counts, "file string, block long, quotes long, outside long, inside long"), "splits")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    counts = counts.withColumn("open", F.coalesce(F.sum("quotes").over(w), F.lit(0)) % 2).withColumn("starts", F.when(F.col("open") == 1, F.col("inside")).otherwise(F.col("outside")))
    counts = materialise(counts.select("file", "block", "open", F.coalesce(F.sum("starts").over(w), F.lit(0)).alias("records")), "split_starts")
    numbered = lines.join(F.broadcast(counts), ["file", "block"])  # some 50 bytes for every 128 MB of input
    numbered = materialise(numbered.mapInPandas(_number_lines, "file string, block long, value string, line long, record long, whole boolean"), "lines")
    long = numbered.filter("NOT whole").groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    text = numbered.filter("whole").select("file", "record", "value").unionByName(long)
    text = text.filter((F.col("record") > 0) & (F.col("value") != "") & (F.col("value") != "\r"))
    options = {"escape": '"', "multiLine": "true", "lineSep": "\u0001"}
    return text.select(F.from_csv(F.regexp_replace("value", "\r$", ""), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """One document per line: (good rows, one-row account of read and failed lines)."""
    bad = "_bad_line"
    wide = T.StructType(schema.fields + [T.StructField(bad, T.StringType())])
    raw = spark.read.text(path).filter(F.length(C.strip("value")) > 0)
    parsed = raw.select(
        F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("d")
    ).select("d.*")
    account = parsed.agg(
        F.count("*").alias("n_lines"), F.count_if(F.col(bad).isNotNull()).alias("n_failed")
    )
    return parsed.filter(F.col(bad).isNull()).drop(bad), account


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_table(spark: SparkSession, path: str, columns=None, limit: int | None = None) -> DataFrame:
    """Parquet scan that only reads the named columns."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def read_ranking_sheet(raw: DataFrame, wanted: dict[str, list[str]], head: DataFrame | None = None) -> DataFrame:
    """Sheet with noisy headers to named columns.

    ``wanted`` maps a target name to texts looked for in the standardised header or in the first
    three rows of the column. ``rank`` and ``name`` must be found. Only rows whose rank begins with
    a digit or '=' are data.
    """
    rows = (head if head is not None else raw).withColumn("_at", F.monotonically_increasing_id())
    first = rows.orderBy("_at").limit(3).drop("_at").collect()
    texts = {
        c: [C.standard_name(c)] + [C.standard_name(r[c]) for r in first if r[c] is not None]
        for c in raw.columns
    }
    found, used = {}, set()
    for target, parts in wanted.items():
        for c in raw.columns:
            if c not in used and any(p in t for p in parts for t in texts[c]):
                found[target] = c
                used.add(c)
                break
    missing = [k for k in ("rank", "name") if k not in found]
    if missing:
        raise ValueError(f"no column found for {missing}")
    out = raw.select(*[F.col(f"`{c}`").cast("string").alias(t) for t, c in found.items()])
    return out.filter(F.col("rank").rlike(r"^[=#]?[0-9]"))


def read_run_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Run-log JSON documents with their file, newest first."""
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .withColumn("file", F.input_file_name())
        .orderBy(F.col("started_at").desc(), "run_name")
    )


PREDICTION_LOG = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("profile_hash", T.StringType()),
    T.StructField("profile_country", T.StringType()),
    T.StructField("profile_budget", T.DoubleType()),
    T.StructField("profile_gpa", T.DoubleType()),
    T.StructField("n_results", T.IntegerType()),
    T.StructField("top_score", T.DoubleType()),
    T.StructField("top_tier", T.StringType()),
    T.StructField("top_confidence", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("date", T.DateType()),
])


def read_prediction_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Daily JSON-lines log, as a batch or as a stream of new files."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PREDICTION_LOG).json(path)
