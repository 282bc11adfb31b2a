"""Sources and sinks on the benchmark tables. Files go through the shared scratch folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from offerloom.registry import query, table
from offerloom.session import scratch_path
from offerloom.sources import readers as R, sinks as S


@query("src01_read_catalog_csv", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def src01(spark, sf):
    path = scratch_path(spark, "catalog-csv")
    cols = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    S.export_csv(table(spark, sf, "part").select(*cols), path, cols)
    schema = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"
    return R.read_catalog_csv(spark, [path + "-missing", path], schema)


@query("src01_read_split_csv", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || '"' || p_brand || '", ' || chr(10) || 'x' ELSE p_name END AS p_name,
  CASE WHEN p_size % 4 <> 0 THEN p_brand END AS p_brand, p_retailprice FROM part""")
def src01b(spark, sf):
    path = scratch_path(spark, "lines-csv")
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", \nx'))).otherwise(F.col("p_name"))
    p = table(spark, sf, "part").select("p_partkey", name.alias("p_name"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("p_brand"), "p_retailprice")
    p.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return R.read_split_csv(spark, path, p.schema)


@query("src02_read_jsonl", """SELECT count(*) AS n_lines, count(*) FILTER (event_id % 100 = 7) AS n_failed,
  sum(CASE WHEN event_id % 100 <> 7 THEN json_extract(props, '$.k')::BIGINT END)::BIGINT AS sum_k FROM events""")
def src02(spark, sf):
    path = scratch_path(spark, "events-jsonl")
    e = table(spark, sf, "events")
    # a broken line in a hundred, and blank lines that do not count
    line = F.when(F.col("event_id") % 100 == 7, F.substring("props", 1, 4)).otherwise(F.col("props"))
    blank = F.when(F.col("event_id") % 50 == 3, F.array(line, F.lit("   "))).otherwise(F.array(line))
    e.select(F.explode(blank).alias("value")).write.text(path)
    good, account = R.read_jsonl(spark, path, T.StructType([T.StructField("k", T.LongType())]))
    return account.withColumn("sum_k", good.agg(F.sum("k")).scalar())


@query("src03_read_json_array", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src03(spark, sf):
    path = scratch_path(spark, "json-array")
    c = table(spark, sf, "customer").withColumn("chunk", F.floor(F.col("c_custkey") / 500))  # documents of 500 records
    docs = c.groupBy("chunk").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("value"))
    docs.repartition("chunk").write.partitionBy("chunk").text(path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType())])
    return R.read_json_array(spark, path, schema).select("c_custkey", "c_name", "c_mktsegment")


@query("src04_scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src04(spark, sf):
    return R.scan_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("src05_read_ranking_sheet", """SELECT '#' || (s_suppkey + 1) AS rank, s_name AS name, s_acctbal::VARCHAR AS overall
  FROM supplier WHERE s_suppkey % 10 <> 0""")
def src05(spark, sf):
    s = table(spark, sf, "supplier")
    label = F.when(F.col("s_suppkey") % 10 == 0, "Rank (as published)").otherwise(F.concat(F.lit("#"), F.col("s_suppkey") + 1))
    raw = s.select(F.col("s_nationkey").alias("Unnamed: 0"), label.alias("2026 RANK*"), F.col("s_name").alias("Institution  Name (EN)"),
                   F.col("s_acctbal").cast("string").alias("Overall-Score"))
    return R.read_ranking_sheet(raw, {"rank": ["rank"], "name": ["institution_name"], "overall": ["overall_score"]})


def _runs(spark, sf):
    li = table(spark, sf, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    return li.groupBy(month.alias("m")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).select(
        F.concat(F.lit("run-"), "m").alias("run_name"), F.concat("m", F.lit("-01T00:00:00")).alias("started_at"),
        F.map_from_arrays(F.array(F.lit("rows"), F.lit("quantity")), F.array(F.col("n").cast("double"), F.col("q"))).alias("metrics"))


@query("src06_read_run_log", """SELECT 'run-' || m AS run_name, m || '-01T00:00:00' AS started_at, n::DOUBLE AS n_rows, q AS quantity FROM (SELECT strftime(l_shipdate, '%Y-%m') AS m, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)""")
def src06(spark, sf):
    path = scratch_path(spark, "run-log")
    runs = _runs(spark, sf)
    runs.withColumn("part", F.col("run_name")).repartition("part").write.partitionBy("part").json(path)  # a document per run
    schema = T.StructType([T.StructField("run_name", T.StringType()), T.StructField("started_at", T.StringType()),
                           T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])
    log = R.read_run_log(spark, path, schema)
    return log.select("run_name", "started_at", F.col("metrics")["rows"].alias("n_rows"), F.col("metrics")["quantity"].alias("quantity"))


# --- upserts ------------------------------------------------------------------------------------------

_BATCH = """target AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 9),
  batch AS (SELECT CASE WHEN o_orderkey % 400 = 39 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, round(o_totalprice * v, 2) AS o_totalprice,
    o_orderstatus, v AS version FROM orders, (VALUES (2), (3)) t(v) WHERE o_orderkey % 5 = 4),
  last AS (SELECT * FROM batch WHERE o_orderkey IS NOT NULL AND version = 3)"""


def _target(spark, sf):
    return table(spark, sf, "orders").filter("o_orderkey % 10 <> 9").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _batch(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 5 = 4")
    return o.withColumn("version", F.explode(F.array(F.lit(2), F.lit(3)))).selectExpr(
        "CASE WHEN o_orderkey % 400 = 39 THEN NULL ELSE o_orderkey END AS o_orderkey", "o_custkey",
        "round(o_totalprice * version, 2) AS o_totalprice", "o_orderstatus", "version")


@query("snk01_upsert_replace", f"""WITH {_BATCH} SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM target
  WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM last""")
def snk01(spark, sf):
    t = S.VersionedTable(spark, scratch_path(spark, "orders-table"))
    t.write(_target(spark, sf))
    t.write(S.upsert_replace(t.read(), _batch(spark, sf), ["o_orderkey"], "version"))
    return t.read()


@query("snk01_upsert_counts", f"""WITH {_BATCH} SELECT count(*) FILTER (t.o_orderkey IS NULL) AS inserted, count(*) FILTER (t.o_orderkey IS NOT NULL) AS updated,
  (SELECT count(*) FROM batch WHERE o_orderkey IS NULL) AS failed FROM last l LEFT JOIN target t USING (o_orderkey)""")
def snk01c(spark, sf):
    return S.upsert_counts(_target(spark, sf), _batch(spark, sf), ["o_orderkey"], "version")


@query("snk02_upsert_merge", f"""WITH {_BATCH} SELECT o_orderkey, t.o_custkey, CASE WHEN l.o_orderkey IS NOT NULL THEN l.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
  CASE WHEN t.o_orderkey IS NULL THEN 'N' ELSE t.o_orderstatus END AS o_orderstatus FROM target t FULL JOIN last l USING (o_orderkey)""")
def snk02(spark, sf):
    return S.upsert_merge(_target(spark, sf), _batch(spark, sf), ["o_orderkey"], ["o_totalprice"], {"o_orderstatus": "N"}, "version")


@query("snk03_delete_by_key", f"WITH {_BATCH} SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last)")
def snk03(spark, sf):
    return S.delete_by_key(_target(spark, sf), _batch(spark, sf), ["o_orderkey"])


def _bucketed(spark, sf, name):
    t = S.BucketedTable(spark, scratch_path(spark, name), "o_orderkey", "version", 16)
    t.create(_target(spark, sf).withColumn("version", F.lit(1)))
    return t


@query("snk01_upsert_buckets", f"""WITH {_BATCH} SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM target
  WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM last""")
def snk01d(spark, sf):
    t = _bucketed(spark, sf, "orders-buckets")
    t.upsert(_batch(spark, sf))
    t.upsert(_target(spark, sf).withColumn("o_totalprice", F.lit(0.0)).withColumn("version", F.lit(0)))  # older rows change nothing
    return t.read().drop("version")


@query("snk02_upsert_merge_buckets", f"""WITH {_BATCH} SELECT o_orderkey, t.o_custkey, CASE WHEN l.o_orderkey IS NOT NULL THEN l.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
  CASE WHEN t.o_orderkey IS NULL THEN 'N' ELSE t.o_orderstatus END AS o_orderstatus FROM target t FULL JOIN last l USING (o_orderkey)""")
def snk02b(spark, sf):
    t = _bucketed(spark, sf, "orders-merged")
    t.merge(_batch(spark, sf), ["o_totalprice"], {"o_orderstatus": "N"})
    return t.read().drop("version")


@query("snk03_truncate", f"WITH {_BATCH} SELECT (SELECT count(*) FROM target) AS n_before, (SELECT count(*) FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last)) AS n_left, 0 AS n_after, (SELECT count(DISTINCT o_orderkey) FROM batch) AS n_again")
def snk03b(spark, sf):
    t = _bucketed(spark, sf, "orders-emptied")
    counts = [t.read().count()]
    t.delete(_batch(spark, sf))
    counts.append(t.read().count())
    t.truncate()
    counts.append(t.read().count())
    t.upsert(_batch(spark, sf))
    return t.read().agg(*[F.lit(n).alias(c) for n, c in zip(counts, ("n_before", "n_left", "n_after"))], F.count("*").alias("n_again"))


# --- exports ----------------------------------------------------------------------------------------------


@query("snk04_csv_ready", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority,
  '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS detail, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS tags FROM orders""")
def snk04(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderdate", F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("detail"), "o_orderkey")
    return S.csv_ready(o, ["o_orderkey"])


@query("snk05_export_json", "SELECT count(*) AS total_records, '2026-01-01T00:00:00' AS exported_at, sum(p_size)::BIGINT AS sum_size FROM part")
def snk05(spark, sf):
    path = scratch_path(spark, "export")
    S.export_all(table(spark, sf, "part"), path, "2026-01-01T00:00:00", ["p_partkey"])
    back = spark.read.schema("p_size bigint").json(f"{path}/json/records")
    meta = spark.read.schema("total_records bigint, exported_at string").json(f"{path}/json/metadata")
    return meta.withColumn("sum_size", back.agg(F.sum("p_size")).scalar())


@query("snk06_flatten", """SELECT l_orderkey, l_linenumber, l_quantity AS amounts_quantity, l_tax AS amounts_rates_tax, l_returnflag || ', ' || l_linestatus AS flags FROM lineitem""")
def snk06(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(F.col("l_quantity").alias("quantity"), F.struct(F.col("l_tax").alias("tax")).alias("rates")).alias("amounts"),
        F.array("l_returnflag", "l_linestatus").alias("flags"))
    return S.flatten(li)


@query("snk07_write_versioned", "SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey, 2 AS n_versions FROM nation")
def snk07(spark, sf):
    n = table(spark, sf, "nation")
    t = S.VersionedTable(spark, scratch_path(spark, "versioned"))
    t.write(n)
    t.write(t.read().withColumn("n_regionkey", F.col("n_regionkey") + 1))
    return t.read().withColumn("n_versions", F.lit(len(t.versions())))


@query("snk08_keep_latest_versions", """SELECT o_custkey, o_orderkey, rn <= 5 AS kept FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)""")
def snk08(spark, sf):
    kept, expired = S.keep_latest_versions(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)
    return kept.withColumn("kept", F.lit(True)).unionByName(expired.withColumn("kept", F.lit(False)))


@query("snk09_dataset_manifest", """SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey,
  true AS same_when_reordered FROM lineitem""")
def snk09(spark, sf):
    li = table(spark, sf, "lineitem")
    a = S.dataset_manifest(li, ["l_partkey", "l_suppkey"])
    b = S.dataset_manifest(li.hint("rebalance", "l_partkey").select(*reversed(li.columns)))  # partitions as many as the rows need
    same = F.col("fingerprint_xor") == b.select("fingerprint_xor").scalar()
    return a.select("n_rows", "n_l_partkey", "n_l_suppkey", same.alias("same_when_reordered"))
