"""Streaming jobs over the events table as a file source; every query runs to the end of the files and reads back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from offerloom.functions import columns as C
from offerloom.operators import drift as D
from offerloom.plans.aggregates import rounded
from offerloom.registry import query, table
from offerloom.session import materialise, scratch_path
from offerloom.sources import readers as R
from offerloom.sources.sinks import BucketedTable
from offerloom.streaming import jobs as J


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return J.event_time(J.file_stream(spark, sf, "events.parquet", schema), "ts")


def _requests(stream):
    tier = F.when(F.col("value") > 20, "top").when(F.col("value") > 8, "good").otherwise("standard")
    best = F.struct((F.col("event_id") % 100 / 100.0).alias("match_score"), tier.alias("predicted_tier"), F.lit("high").alias("confidence_band"))
    none = F.array().cast("array<struct<match_score:double,predicted_tier:string,confidence_band:string>>")
    return stream.select(
        "ts", F.col("event_id").alias("request_id"), F.array("event_type").alias("preferred_countries"), (F.col("user_id") * 100).alias("budget"),
        (F.col("user_id") % 5).alias("gpa"), F.when(F.col("event_id") % 10 == 0, none).otherwise(F.array(best, best)).alias("results"),
        (F.col("value") * 3.337).alias("latency_ms"), F.lit("m1").alias("model_version"))


_LOG = """lg AS (SELECT ts, event_id::VARCHAR AS request_id, substr(md5('{"budget":' || user_id * 100 || ',"gpa":' || user_id % 5 || ',"preferred_countries":["' || event_type || '"]}'), 1, 12) AS profile_hash, event_type AS profile_country,
  (user_id * 100)::DOUBLE AS profile_budget, (user_id % 5)::DOUBLE AS profile_gpa, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 2 END AS n_results, CASE WHEN event_id % 10 <> 0 THEN (event_id % 100) / 100::DOUBLE END AS top_score,
  CASE WHEN event_id % 10 <> 0 THEN CASE WHEN value > 20 THEN 'top' WHEN value > 8 THEN 'good' ELSE 'standard' END END AS top_tier, strftime(ts, '%Y-%m-%d') AS date FROM events)"""


def _log(spark, sf):
    path = scratch_path(spark, "prediction-log")
    J.log_predictions(_requests(_events(spark, sf)), path, ["preferred_countries", "budget", "gpa"])
    return R.read_prediction_log(spark, f"{path}/data")


@query("st01_log_predictions", f"WITH {_LOG} SELECT request_id, profile_hash, profile_country, profile_budget, profile_gpa, n_results, top_score, top_tier, date FROM lg")
def st01(spark, sf):
    return _log(spark, sf).select("request_id", "profile_hash", "profile_country", "profile_budget", "profile_gpa", "n_results", "top_score", "top_tier", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("src07_read_prediction_log", f"WITH {_LOG} SELECT date, count(*) AS n, count(DISTINCT profile_hash) AS n_profiles, round(sum(top_score), 2) AS sum_score, count(top_score) AS n_scored FROM lg GROUP BY 1")
def src07(spark, sf):
    log = _log(spark, sf)
    per = log.groupBy("date", "profile_hash").agg(F.count("*").alias("n"), F.sum("top_score").alias("s"), F.count("top_score").alias("c"))
    return per.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(F.sum("n").alias("n"), F.count("*").alias("n_profiles"), C.round_to(F.sum("s"), 2).alias("sum_score"), F.sum("c").alias("n_scored"))


@query("st02_rate_abuse", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M') AS window_start, user_id AS client, count(*) AS n_requests FROM events GROUP BY ALL HAVING count(*) > 4""")
def st02(spark, sf):
    s = J.rate_abuse(_events(spark, sf), "user_id", "ts", 86400, 4, "1 day")
    d = J.finalised(spark, s, "rate-abuse", ["window_start", "client"])
    return d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "client", "n_requests")


@query("st03_prediction_metrics", """SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n_requests, round(avg(CASE WHEN event_id % 10 <> 0 THEN (event_id % 100) / 100::DOUBLE END), 6) AS mean_top_score,
  round(avg(CASE WHEN event_id % 10 <> 0 THEN (value > 20)::INT END), 6) AS share_top, round(avg(CASE WHEN event_id % 10 <> 0 THEN (value <= 8)::INT END), 6) AS share_standard FROM events GROUP BY 1""")
def st03(spark, sf):
    log = J.log_records(_requests(_events(spark, sf)), ["preferred_countries", "budget", "gpa"])
    d = J.finalised(spark, J.prediction_metrics(log, "timestamp", "12 hours", "1 day"), "prediction-metrics", ["window_start"])
    return rounded(d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n_requests", "mean_top_score", "share_top", "share_standard"), 6)


_SD = """b AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-10'), ed AS (SELECT list_sort(list_distinct(list(q))) AS edges FROM (SELECT unnest(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q FROM b)),
  pl AS (SELECT ws, least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2) AS bin FROM (SELECT time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '2024-01-03') AS ws, value FROM events UNION ALL SELECT NULL, value FROM b) s, ed WHERE value BETWEEN edges[1] AND edges[-1]),
  ws AS (SELECT DISTINCT ws FROM pl WHERE ws IS NOT NULL), gr AS (SELECT ws, bin FROM ws, (SELECT DISTINCT bin FROM pl WHERE ws IS NULL)), c AS (SELECT g.ws, g.bin, (SELECT count(*) FROM pl WHERE pl.ws IS NULL AND pl.bin = g.bin) AS e, (SELECT count(*) FROM pl WHERE pl.ws = g.ws AND pl.bin = g.bin) AS a FROM gr g),
  sh AS (SELECT ws, a AS raw, least(greatest(e / (sum(e) OVER (PARTITION BY ws) + 1e-4::DOUBLE), 1e-4::DOUBLE), 1) AS e, least(greatest(a / (sum(a) OVER (PARTITION BY ws) + 1e-4::DOUBLE), 1e-4::DOUBLE), 1) AS a FROM c)"""


@query("st04_serving_drift", f"WITH {_SD} SELECT strftime(ws, '%Y-%m-%d') AS window_start, 'value' AS feature, round(sum((a - e) * ln(a / e)), 6) AS psi, sum(raw)::BIGINT AS n_served, sum((a - e) * ln(a / e)) > 0.2 AS drifted FROM sh GROUP BY ws")
def st04(spark, sf):
    path = scratch_path(spark, "served-baseline")
    D.save_baseline(table(spark, sf, "events").filter("ts < TIMESTAMP_NTZ '2024-01-10'"), ["value"], path)
    _, edges, bins = D.load_baseline(spark, path)
    windowed = J.finalised(spark, J.served_bins(_events(spark, sf), edges, ["value"], "ts", "5 days", "1 day"), "served-bins", ["window_start", "feature", "bin"])
    return rounded(J.serving_drift(windowed, bins, edges).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), 6)


@query("st05_streaming_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def st05(spark, sf):
    t = BucketedTable(spark, scratch_path(spark, "users"), "user_id", "event_id", 8)
    J.streaming_upsert(_events(spark, sf).select("user_id", "event_id", "event_type", "value"), t, scratch_path(spark, "users-checkpoint"))
    return t.read()


# --- several micro-batches: every seventh event comes one file late, every 31st three files late ---

_FILES, _DAYS = 6, 5
_FILE = f"least(datediff('day', DATE '2024-01-01', ts::DATE) // {_DAYS} + CASE WHEN event_id % 31 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, {_FILES - 1})"
#: A micro-batch closes windows by the latest event of the files before it, less a day, and drops what belongs to a window that the one before it closed.
_IN_TIME = f"""f AS (SELECT *, {_FILE} AS file FROM events), wm AS (SELECT n.file, max(f.ts) - INTERVAL 1 DAY AS wm FROM range({_FILES}) n(file) LEFT JOIN f ON f.file < n.file - 1 GROUP BY 1),
  last AS (SELECT max(ts) - INTERVAL 1 DAY AS final FROM events)"""


def _files(spark, sf):
    """The events as files that arrive one after the other, a micro-batch each."""
    e = table(spark, sf, "events")
    late = F.when(F.col("event_id") % 31 == 0, 3).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    day = F.floor(F.datediff(F.col("ts").cast("date"), F.lit(dt.date(2024, 1, 1))) / _DAYS)
    e = materialise(e.withColumn("_file", F.least(day + late, F.lit(_FILES - 1)).cast("int")), "arrivals")
    folder = scratch_path(spark, "event-files")
    for n in range(_FILES):
        e.filter(F.col("_file") == n).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return J.event_time(J.file_stream(spark, folder, "*.parquet", table(spark, sf, "events").schema, files_per_batch=1), "ts")


@query("st02_rate_abuse_late_rows", f"""WITH {_IN_TIME}, w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS ws, user_id, file FROM f)
  SELECT strftime(ws, '%Y-%m-%d') AS window_start, user_id AS client, count(*) AS n_requests FROM w JOIN wm USING (file), last
  WHERE (wm IS NULL OR ws + INTERVAL 1 DAY > wm) AND ws + INTERVAL 1 DAY <= final GROUP BY ALL HAVING count(*) > 2""")
def st02_late(spark, sf):
    d = J.closed(spark, J.rate_abuse(_files(spark, sf), "user_id", "ts", 86400, 2, "1 day"), "rate-abuse")
    return d.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "client", "n_requests")


@query("st03_prediction_metrics_late_rows", f"""WITH {_IN_TIME}, w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') AS ws, file, round(value * 3.337, 1) AS lat, event_id, value FROM f),
  k AS (SELECT w.* FROM w JOIN wm USING (file), last WHERE (wm IS NULL OR ws + INTERVAL 12 HOUR > wm) AND ws + INTERVAL 12 HOUR <= final),
  r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY lat) AS i, count(*) OVER (PARTITION BY ws) AS n FROM k)
  SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n_requests, min(lat) FILTER (i >= 0.5 * n) AS p50_latency, min(lat) FILTER (i >= 0.95 * n) AS p95_latency,
  round(avg(CASE WHEN event_id % 10 <> 0 THEN (value > 20)::INT END), 6) AS share_top FROM r GROUP BY ws""")
def st03_late(spark, sf):
    log = J.log_records(_requests(_files(spark, sf)), ["preferred_countries", "budget", "gpa"])
    d = J.closed(spark, J.prediction_metrics(log, "timestamp", "12 hours", "1 day"), "prediction-metrics")
    return rounded(d.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n_requests", "p50_latency", "p95_latency", "share_top"), 6)


@query("st05_streaming_upsert_out_of_order", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def st05_late(spark, sf):
    t = BucketedTable(spark, scratch_path(spark, "users"), "user_id", "event_id", 8)
    J.streaming_upsert(_files(spark, sf).select("user_id", "event_id", "event_type", "value"), t, scratch_path(spark, "users-checkpoint"))
    return t.read()


@query("st06_valid_snapshots", """WITH p AS (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS fetched, arg_max(n, o_orderdate) AS n_rows, max(o_orderdate) >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY AS valid FROM p GROUP BY 1""")
def st06(spark, sf):
    d = J.valid_snapshots(table(spark, sf, "orders"), "o_custkey", "o_orderdate", dt.datetime(2001, 8, 1), 60)
    return d.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("fetched"), "n_rows", "valid")
