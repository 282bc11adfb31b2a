"""Helpers shared by the operators: written intermediate tables, joins that stand hot keys, words and their hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from offerloom.session import scratch_path

#: Rows in an Arrow batch that carries whole texts.
TEXT_ROWS = 500


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost nothing done before."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_parts(df: DataFrame) -> DataFrame:
    """Rows of a few numbers in at most four partitions for every core (32 at least), however many there were: every file that is written costs."""
    return df.coalesce(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def keep_light(df: DataFrame, name: str) -> DataFrame:
    """As ``keep``, of ``few_parts``."""
    return keep(few_parts(df), name)


def keep_bucketed(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """As ``keep``, in buckets of ``key``: later joins on it do not move these rows again."""
    keys = [key] if isinstance(key, str) else key
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(n, *keys).write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(n, *keys).saveAsTable(table)
    return spark.table(table)


def text_batches(spark) -> None:
    """Keep Arrow batches of texts small: some documents are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left", parts: int = 256) -> DataFrame:
    """Join a large ``left`` with ``right`` (one row per key) where a key may hold a third of all left rows.

    ``weight`` of ``right`` is the number of left rows of its key. Keys over 1/``parts`` of the total number at most
    ``parts``, so that side is broadcast; rows that found their key there are spread over all partitions in the second join.
    Null keys match nothing.
    """
    total = right.agg(F.sum(weight).alias("t")).first()["t"] or 0
    limit = max(1, total // parts)
    rest = F.struct(*[c for c in right.columns if c not in keys])
    hot = right.filter(F.col(weight) > limit).select(*keys, rest.alias("hot_v"))
    cold = right.filter(F.col(weight) <= limit).select(*keys, F.lit(0).cast("long").alias("spread"), rest.alias("cold_v"))
    salt = F.xxhash64(*left.columns).bitwiseOR(F.lit(1).cast("long"))
    out = left.join(F.broadcast(hot), keys, "left").withColumn("spread", F.when(F.col("hot_v").isNotNull(), salt).otherwise(F.lit(0).cast("long")))
    out = out.join(cold, [*keys, "spread"], "left").withColumn("v", F.coalesce("hot_v", "cold_v"))
    out = out if how == "left" else out.filter("v IS NOT NULL")
    return out.select(*left.columns, "v.*")


def meet_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, where=None, semi: bool = False, parts: int = 256) -> DataFrame:
    """The inner (or left semi) join of a written ``left`` with ``right`` (one row per key) where a key may hold a third of all left rows.

    ``weight`` of ``right`` is the number of left rows of its key. Keys over 1/``parts`` of the total number at most ``parts``; their
    hashes are literals of the plan, their rows meet a broadcast table, the others are joined by shuffle. ``where`` is a condition of the join,
    so that nothing else is made. Both sides are read twice.
    """
    total = right.agg(F.sum(weight).alias("t")).first()["t"] or 0
    hot = [r["h"] for r in right.filter(F.col(weight) > max(1, total // parts)).select(F.xxhash64(*keys).alias("h")).collect()]
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    kind = "left_semi" if semi else "inner"

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        out = a.join(b, keys, kind)
        return out if where is None or semi else out.filter(where)

    cold = joined(left.filter(~is_hot), right.filter(~is_hot))
    return cold if not hot else cold.unionByName(joined(left.filter(is_hot), F.broadcast(right.filter(is_hot))))


@F.arrow_udf(BinaryType())
def zipped(text: pa.Array) -> pa.Array:
    """Bytes compressed, null for null."""
    c = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else c.compress(t) for t in text.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def unzipped(z: pa.Array) -> pa.Array:
    """What ``zipped`` compressed."""
    d = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else d.decompress(t) for t in z.to_pylist()], pa.binary())


def documents_by_key(docs: DataFrame, name: str) -> DataFrame:
    """The documents as (k, dup, doc_id, z, given, rest) in buckets of k and dup.

    k is doc_id, the smallest long for null; dup is a number of the row, no other has it, and orders rows that share a k as the table does; z is
    the compressed text, empty for null, and given tells whether there was one; rest has all other columns, whatever their names.
    """
    text_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), rest.alias("rest"), F.monotonically_increasing_id().alias("dup"))

    def packed(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [c.compress((t or "").encode("utf-8", "surrogatepass")) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["doc_id"], pa.array(z, pa.binary()), b["text"].is_valid(), b["rest"], b["dup"]], names=["doc_id", "z", "given", "rest", "dup"])

    schema = StructType([StructField("doc_id", LongType()), StructField("z", BinaryType()), StructField("given", BooleanType()), rows.schema["rest"], StructField("dup", LongType())])
    rows = rows.mapInArrow(packed, schema).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    return keep_bucketed(rows.select("k", "dup", "doc_id", "z", "given", "rest"), ["k", "dup"], name)


def with_texts(d: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of (doc_id, z, given, rest) as documents again, in the order of ``columns``."""

    def unpacked(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            text = [unzip.decompress(z).decode("utf-8", "surrogatepass") if g else None for z, g in zip(b["z"].to_pylist(), b["given"].to_pylist())]
            yield pa.record_batch([b["doc_id"], pa.array(text, pa.string()), b["rest"]], names=["doc_id", "text", "rest"])

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), d.schema["rest"]])
    out = d.select("doc_id", "z", "given", "rest").mapInArrow(unpacked, schema)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns])


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixing of unsigned integers, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
