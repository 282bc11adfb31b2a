"""Structured Streaming jobs: prediction log, request rates, metrics, drift of served values, upserts, snapshots.

Event times must be TIMESTAMP (``withWatermark`` refuses TIMESTAMP_NTZ); see ``event_time``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from offerloom.operators import drift, prefix
from offerloom.session import scratch_path
from offerloom.sources.sinks import BucketedTable



def event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def run_to_table(stream: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "append") -> None:
    """Process what is there and stop. The checkpoint beside the output makes a restart exact."""
    writer = stream.writeStream.format(fmt).option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over the files present and read its output table back."""
    path = scratch_path(spark, name)
    run_to_table(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def closed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Windows that the watermark has passed, each once, as an append stream writes them. State lives from micro-batch to micro-batch; a row
    that comes after its window was closed is dropped, one that is only out of order counts."""
    return drain(spark, stream, name)


def finalised(spark: SparkSession, stream: DataFrame, name: str, keys) -> DataFrame:
    """As ``drain`` for windowed aggregates over a finite input: every window, including those the watermark
    has not passed, through update mode and the newest state per ``keys``. A replayed batch replaces itself."""
    path = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.parquet(f"{path}/data")
    row = F.struct(*stream.columns)
    return seen.groupBy(*keys).agg(F.max_by(row, F.col("_batch")).alias("r")).select("r.*")


# --- prediction log -------------------------------------------------------------------------------


def log_records(requests: DataFrame, profile_cols) -> DataFrame:
    """One log record per request: hash of the canonical profile, first country, result summary, date partition."""
    canonical = F.to_json(F.struct(*[F.col(c) for c in sorted(profile_cols)]))
    return requests.select(
        F.col("ts").alias("timestamp"), F.col("request_id").cast("string").alias("request_id"),
        F.substring(F.md5(canonical), 1, 12).alias("profile_hash"),
        F.get("preferred_countries", F.lit(0)).alias("profile_country"), F.col("budget").cast("double").alias("profile_budget"),
        F.col("gpa").cast("double").alias("profile_gpa"), F.coalesce(F.size("results"), F.lit(0)).alias("n_results"),
        F.get("results", F.lit(0))["match_score"].alias("top_score"), F.get("results", F.lit(0))["predicted_tier"].alias("top_tier"),
        F.get("results", F.lit(0))["confidence_band"].alias("top_confidence"), F.round("latency_ms", 1).alias("latency_ms"),
        "model_version", F.to_date("ts").alias("date"),
    )


def log_predictions(requests: DataFrame, path: str, profile_cols) -> None:
    run_to_table(log_records(requests, profile_cols), path, "json", ["date"])


# --- windows over requests --------------------------------------------------------------------------


def request_counts(stream: DataFrame, client: str, ts: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, f"{int(seconds)} seconds")
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), F.col(client).alias("client")).agg(F.count("*").alias("n_requests")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "client", "n_requests")


def rate_abuse(stream: DataFrame, client: str, ts: str, seconds: int = 60, max_requests: int = 20, late: str = "10 minutes") -> DataFrame:
    """Clients with more than ``max_requests`` in a window."""
    return request_counts(stream, client, ts, seconds, late).filter(F.col("n_requests") > max_requests)


def prediction_metrics(stream: DataFrame, ts: str = "timestamp", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window: requests, latency percentiles (sketch), mean top score and shares of the tiers."""
    tier = lambda t: F.avg((F.col("top_tier") == t).cast("int")).alias(f"share_{t}")
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(
        F.count("*").alias("n_requests"), F.percentile_approx("latency_ms", 0.5, 10000).alias("p50_latency"),
        F.percentile_approx("latency_ms", 0.95, 10000).alias("p95_latency"), F.avg("top_score").alias("mean_top_score"),
        tier("top"), tier("good"), tier("standard"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "n_requests", "p50_latency", "p95_latency", "mean_top_score", "share_top", "share_good", "share_standard")


# --- drift of served values ----------------------------------------------------------------------------


def served_bins(stream: DataFrame, edges: DataFrame, features, ts: str, window: str, late: str = "10 minutes") -> DataFrame:
    """Counts per (window, feature, bin). ``edges`` is one short array per feature."""
    long = prefix.unpivot(stream.withWatermark(ts, late), features, [ts])
    placed = long.join(edges, "feature").withColumn("bin", drift.bin_of(F.col("value"), F.col("edges"))).filter(F.col("bin").isNotNull())
    return placed.groupBy(F.window(ts, window).alias("w"), "feature", "bin").agg(F.count("*").alias("cnt")).select(
        F.col("w.start").alias("window_start"), "feature", "bin", "cnt")


def serving_drift(windowed: DataFrame, base_bins: DataFrame, edges: DataFrame, limit: float = 0.20) -> DataFrame:
    """Stability index per (window, feature) from served bin counts and the baseline's."""
    starts = windowed.select("window_start", "feature").distinct()
    grid = starts.join(edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - F.lit(2))).alias("bin")), "feature")
    j = grid.join(base_bins.withColumnRenamed("cnt", "e"), ["feature", "bin"], "left").join(
        windowed.withColumnRenamed("cnt", "a"), ["window_start", "feature", "bin"], "left").fillna(0, ["e", "a"])
    w = Window.partitionBy("window_start", "feature")
    clip = lambda c: F.least(F.greatest(c, F.lit(drift.EPS)), F.lit(1.0))
    e, a = clip(F.col("e") / (F.sum("e").over(w) + drift.EPS)), clip(F.col("a") / (F.sum("a").over(w) + drift.EPS))
    parts = j.withColumn("_e", e).withColumn("_a", a)
    return parts.groupBy("window_start", "feature").agg(
        F.sum((F.col("_a") - F.col("_e")) * F.log(F.col("_a") / F.col("_e"))).alias("psi"), F.sum("a").alias("n_served")
    ).withColumn("drifted", F.col("psi") > limit)


# --- continuous import ---------------------------------------------------------------------------------------


def streaming_upsert(stream: DataFrame, table: BucketedTable, checkpoint: str) -> None:
    """Every micro-batch replaces rows by key in the buckets it touches. A row that comes late, after a newer one of its key, changes
    nothing, whatever batch it is in; replaying a batch gives the same table."""

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(batch)

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()


def valid_snapshots(history: DataFrame, key: str, fetched: str, as_of, ttl_days: int = 7) -> DataFrame:
    """Newest snapshot per key, its row count, and whether its age is within the time to live."""
    per = history.groupBy(key, fetched).agg(F.count("*").alias("n_rows"))
    newest = per.groupBy(key).agg(F.max_by(F.struct(fetched, "n_rows"), fetched).alias("s"))
    return newest.select(key, F.col(f"s.{fetched}").alias(fetched), "s.n_rows",
                         (F.col(f"s.{fetched}") >= F.lit(as_of) - F.expr(f"INTERVAL {int(ttl_days)} DAYS")).alias("valid"))
