"""Exact dedup by distributed MSD radix partitioning: groups are split by successive bytes until they are single or ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import join_hot, keep

#: ASCII white space, which does not count when texts are compared.
SPACE = " \t\n\x0b\x0c\r"


def exact_groups(docs: DataFrame, first: int = 64, widen: int = 8) -> DataFrame:
    """Group rows whose texts are equal but for ASCII white space, and choose the row that stays of each group.

    The row with the most code points in its original text stays, of those the one with the smallest doc_id (null first).
    The first digit is the length and the first ``first`` bytes; every round takes ``widen`` times as many bytes further on,
    so even a text of a gigabyte takes about ten rounds. Rows alone in their group leave, and so do rows whose bytes have
    ended: they are equal. No digest decides. A round's groups are counts and minima, which stand any size of group; rows
    learn their group by a join that spreads hot groups.

    Returns (doc_id, keep_id, group_size, kept, normalised), one row per row of ``docs``. Null text counts as empty, and all
    empty texts are one group. Rows that share a doc_id stay separate rows; of rows that tie in everything one is kept.
    Other columns are not looked at.
    """
    norm = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, "")
    chars = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), norm.alias("normalised"), chars.alias("chars"))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "radix_rows")

    live = rows.select("row", "doc_id", "chars", F.col("normalised").cast("binary").alias("bytes"))
    live = live.withColumn("grp", F.octet_length("bytes").cast("long"))
    at, width, done = 1, first, None
    while True:
        live = live.withColumn("digit", F.substring("bytes", at, width))
        # the group's new name is its smallest row number, whatever its size
        groups = live.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.min("row").alias("name")).filter("n > 1")
        live = keep(join_hot(live, groups, ["grp", "digit"], "n", "inner").withColumn("grp", F.col("name")).drop("digit", "name"), "radix_round")
        at, width = at + width, width * widen
        ended = live.filter(F.octet_length("bytes") < at).select("row", "doc_id", "chars", "grp")
        done = ended if done is None else done.unionByName(ended)
        live = live.filter(F.octet_length("bytes") >= at).drop("n")
        if live.isEmpty():
            break
    best = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    told = done.groupBy("grp").agg(F.min(best).alias("b"), F.count("*").alias("group_size"))
    members = join_hot(done.select("row", "grp"), told.select("grp", "b", "group_size"), ["grp"], "group_size", "inner")
    members = members.select("row", F.col("b.d").alias("keep"), F.col("b.r").alias("keep_row"), "group_size")
    out = rows.select("row", "doc_id", "normalised").join(members, "row", "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"), "normalised")
