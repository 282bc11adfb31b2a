"""Writers: keyed upserts with versioned tables, exports, flattening, retention, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from offerloom.session import materialise


# --- versioned tables --------------------------------------------------------------------


class VersionedTable:
    """Parquet table kept as ``<root>/v=<id>/`` folders and a pointer naming the current one.

    A write never touches the version being read, so a job that fails or loses executors half way
    leaves the table as it was. The pointer is a one-row Parquet folder per switch; the newest wins.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm

    def versions(self) -> list[str]:
        fs, jvm = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def exists(self) -> bool:
        return bool(self.versions())

    def path(self) -> str:
        names = self.versions()
        if not names:
            raise FileNotFoundError(f"no version under {self.root}")
        return f"{self.root}/v={names[-1]}"

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path())

    def write(self, df: DataFrame, partition_by=()) -> str:
        fs, jvm = self._fs()
        names = self.versions()
        number = int(names[-1].split("-")[0]) + 1 if names else 1
        name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/v={name}")
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current/{name}")).close()
        return name


class BucketedTable:
    """Parquet table in hash buckets of its key, changed by copying the buckets that a batch touches.

    A bucket's rows lie in ``<root>/v=<version>/bucket=<n>``; a manifest names the version of every bucket, so an upsert writes the
    touched buckets once more and all others stay where they are. Of a key, the row with the largest ``order`` stays, whichever
    batch brings it; of equals the later batch's. A commit is a file made under the next number, which only one writer can make;
    before it readers see the old manifest. Keys are unique, so buckets are even; ``buckets`` is to be set so that one fits a task.
    """

    def __init__(self, spark: SparkSession, root: str, keys, order, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.keys, self.order = [keys] if isinstance(keys, str) else list(keys), [order] if isinstance(order, str) else list(order)

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm

    def versions(self) -> list[str]:
        fs, jvm = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: str | None = None) -> dict[int, str]:
        """Version of each bucket that has rows; a row per bucket at most."""
        names = self.versions()
        if not names:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.root}/_manifest/{version or names[-1]}").collect() if r["version"]}

    def _paths(self, where: dict[int, str], only=None) -> list[str]:
        return [f"{self.root}/v={v}/bucket={b}" for b, v in sorted(where.items()) if only is None or b in only]

    def files(self) -> dict[int, list[str]]:
        """Data files of each bucket."""
        fs, jvm = self._fs()
        return {b: sorted(x.getPath().getName() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(p)) if x.getPath().getName().startswith("part-"))
                for b, p in zip(sorted(self.manifest()), self._paths(self.manifest()))}

    def _schema(self) -> T.StructType:
        text = self.spark.read.text(f"{self.root}/_schema", wholetext=True).first()
        return T.StructType.fromJson(json.loads(text["value"]))

    def _read(self, where: dict[int, str], only=None) -> DataFrame:
        paths = self._paths(where, only)
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame | None, touched) -> str:
        """Write ``rows``, the whole content of the touched buckets, and switch to it."""
        fs, jvm = self._fs()
        names, path = self.versions(), jvm.org.apache.hadoop.fs.Path
        number = int(names[-1].split("-")[0]) + 1 if names else 1
        name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        where = {b: v for b, v in self.manifest().items() if b not in touched}
        if rows is not None:
            out = f"{self.root}/v={name}"
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(out)
            where |= {int(s.getPath().getName().split("=")[1]): name for s in fs.listStatus(path(out)) if "=" in s.getPath().getName()}
        told = [(b, where.get(b)) for b in range(self.buckets)]
        self.spark.createDataFrame(told, "bucket int, version string").coalesce(1).write.parquet(f"{self.root}/_manifest/{name}")
        lock = path(f"{self.root}/_numbers/{number:08d}")
        fs.create(lock, False).close()  # fails if another writer has made this number
        fs.create(path(f"{self.root}/_commits/{name}"), False).close()
        return name

    def create(self, df: DataFrame) -> str:
        """First content: the last row of each key; rows with a null key are left out."""
        if self.exists():
            raise FileExistsError(self.root)
        fs, jvm = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.root}/_schema/schema.json"), False)
        out.write(bytearray(json.dumps(df.schema.jsonValue()).encode()))
        out.close()
        return self._commit(last_per_key(df, self.keys, self.order), set(range(self.buckets)))

    def change(self, batch: DataFrame, how) -> list[int]:
        """Replace the buckets that ``batch`` touches by ``how(rows of these buckets, batch)``; returns their numbers."""
        some = materialise(batch.filter(_all_set(self.keys)), "batch")
        touched = sorted(r["b"] for r in some.select(self._bucket().alias("b")).distinct().collect())  # ``buckets`` at most
        if touched:
            self._commit(how(self._read(self.manifest(), set(touched)), some), set(touched))
        return touched

    def upsert(self, batch: DataFrame) -> list[int]:
        """Whole rows by key. A row older than the one that is there changes nothing."""
        if not self.exists():
            self.create(batch.limit(0))

        def newest(rows: DataFrame, some: DataFrame) -> DataFrame:
            both = rows.withColumn("_later", F.lit(0)).unionByName(some.select(*rows.columns).withColumn("_later", F.lit(1)))
            return last_per_key(both, self.keys, [*self.order, "_later"]).drop("_later")

        return self.change(batch, newest)

    def merge(self, batch: DataFrame, set_cols, insert_only: dict) -> list[int]:
        """As ``upsert_merge``, on the touched buckets."""
        return self.change(batch, lambda rows, some: upsert_merge(rows, some, self.keys, set_cols, insert_only, self.order))

    def delete(self, gone: DataFrame) -> list[int]:
        return self.change(gone, lambda rows, some: delete_by_key(rows, some, self.keys))

    def truncate(self) -> None:
        """No rows from now on; the data of earlier versions stays until ``vacuum``."""
        self._commit(None, set(range(self.buckets)))

    def vacuum(self) -> int:
        """Remove bucket folders that the current manifest does not name; returns how many. Not while older versions are read."""
        fs, jvm = self._fs()
        path, kept = jvm.org.apache.hadoop.fs.Path, set(self._paths(self.manifest()))
        n = 0
        for v in fs.listStatus(path(self.root)):
            if v.getPath().getName().startswith("v="):
                for b in fs.listStatus(v.getPath()):
                    if "=" in b.getPath().getName() and f"{self.root}/{v.getPath().getName()}/{b.getPath().getName()}" not in kept:
                        fs.delete(b.getPath(), True)
                        n += 1
        return n


# --- upserts ------------------------------------------------------------------------------------


def last_per_key(batch: DataFrame, keys, order) -> DataFrame:
    """The last row of each key. ``max_by`` keeps one row per key and map task, whatever the key's size."""
    order = [order] if isinstance(order, str) else list(order)
    row = F.struct(*batch.columns)
    return (
        batch.filter(_all_set(keys))
        .groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row"))
        .select("row.*")
    )


def _all_set(keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def upsert_replace(target: DataFrame, batch: DataFrame, keys, order) -> DataFrame:
    """Target with whole rows replaced or inserted by key; rows with a null key are left out."""
    last = last_per_key(batch, keys, order).select(*target.columns)
    return target.join(last.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(last)


def upsert_counts(target: DataFrame, batch: DataFrame, keys, order) -> DataFrame:
    """inserted / updated / failed of an upsert, without writing it."""
    last = last_per_key(batch, keys, order).select(*keys)
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    failed = batch.filter(~_all_set(keys)).agg(F.count("*").alias("n"))
    return last.join(known, list(keys), "left").agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
    ).withColumn("failed", failed.scalar())


def upsert_merge(target: DataFrame, batch: DataFrame, keys, set_cols, insert_only: dict, order) -> DataFrame:
    """Update ``set_cols`` by key, insert new keys with defaults for ``insert_only``; other columns stay."""
    last = last_per_key(batch, keys, order)
    b = last.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in set_cols], F.lit(True).alias("_in_batch"))
    t = target.withColumn("_in_target", F.lit(True))
    joined = t.join(b, list(keys), "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in set_cols:
            out.append(F.when(F.col("_in_batch"), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c))
        elif c in insert_only:
            new = F.col("_in_target").isNull()
            out.append(F.when(new, F.lit(insert_only[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def delete_by_key(target: DataFrame, gone: DataFrame, keys) -> DataFrame:
    return target.join(gone.select(*keys), list(keys), "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


# --- exports -----------------------------------------------------------------------------------------


def ordered_columns(columns, priority) -> list[str]:
    first = [c for c in priority if c in columns]
    return first + sorted(c for c in columns if c not in first)


def csv_ready(df: DataFrame, priority=()) -> DataFrame:
    """Priority columns first, the rest by name; nested values as JSON, times as ISO text."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = []
    for c in ordered_columns(df.columns, priority):
        kind = types[c]
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(c))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def export_csv(df: DataFrame, path: str, priority=()) -> None:
    csv_ready(df, priority).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def export_envelope(df: DataFrame, exported_at: str) -> DataFrame:
    """One-row metadata of an export."""
    return df.agg(F.count("*").alias("total_records")).withColumn("exported_at", F.lit(exported_at))


def export_json(df: DataFrame, path: str, exported_at: str) -> None:
    """Records and their metadata, side by side."""
    df.write.mode("errorifexists").json(f"{path}/records")
    export_envelope(df, exported_at).coalesce(1).write.mode("errorifexists").json(f"{path}/metadata")


def export_all(df: DataFrame, path: str, exported_at: str, priority=()) -> None:
    """Several formats from one computation."""
    kept = df.persist()
    try:
        export_csv(kept, f"{path}/csv", priority)
        export_json(kept, f"{path}/json", exported_at)
        kept.write.mode("errorifexists").parquet(f"{path}/parquet")
    finally:
        kept.unpersist()


def flatten(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Struct fields to ``parent_child`` columns, lists to joined text, maps to JSON."""

    def walk(prefix: str, path: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f"{prefix}_{f.name}" if prefix else f.name,
                                f"{path}.`{f.name}`" if path else f"`{f.name}`", f.dataType)
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
                yield F.to_json(F.col(path)).alias(prefix)
            else:
                yield F.array_join(F.col(path).cast("array<string>"), sep).alias(prefix)
        elif isinstance(kind, T.MapType):
            yield F.to_json(F.col(path)).alias(prefix)
        else:
            yield F.col(path).alias(prefix)

    return df.select(*walk("", "", df.schema))


# --- retention and manifests ----------------------------------------------------------------------------


def keep_latest_versions(history: DataFrame, key: str, version: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): the newest n versions of each key, n at most where versions tie, and the rest."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.xxhash64(*history.columns))
    marked = history.withColumn("_rn", F.row_number().over(w))
    return marked.filter(F.col("_rn") <= n).drop("_rn"), marked.filter(F.col("_rn") > n).drop("_rn")


def dataset_manifest(df: DataFrame, distinct_cols=()) -> DataFrame:
    """Order-free fingerprint, row count and exact distinct counts, in one pass plus one per distinct column."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    aggs = [F.count("*").alias("n_rows"), F.bit_xor(row).alias("fingerprint_xor"),
            F.sum((row.bitwiseAND(F.lit(0xFFFFFFFF)))).alias("fingerprint_sum")]
    out = df.agg(*aggs)
    for c in distinct_cols:
        n = df.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count("*").alias("n"))
        out = out.withColumn(f"n_{c}", n.scalar())
    return out
