"""Mixing sources to target weights: exact block quotas, split among output shards by a hypergeometric tree. Only DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import join_hot, keep, keep_light, text_batches, unzipped, zipped

#: Tables of at most so many rows (sources), or so many and 250,000 more (blocks), of a few numbers each are broadcast.
MOST_BROADCAST = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(key, source, n, source_size, target) from (key, source, n, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all sizes; what a source is due over
    ``most`` times its size goes to the others by weight, until none is over. One row per source passes one task, for its number.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    due = keep(sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)), "sources")
    total = due.agg((F.sum("source_size") * share).alias("t")).first()["t"] or 0.0
    each, capped = -1.0, None
    while True:  # every round caps at least one more weight class of sources; two or three rounds are usual
        over = F.col("cap") <= F.col("w") * F.lit(each)
        r = due.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("c"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, each = r["n"], (total - (r["c"] or 0.0)) / r["w"]
    return due.select("key", "source", "n", "source_size", F.least("cap", F.col("w") * F.lit(each)).alias("target"))


def _uniform(*parts):
    """A number in [0, 1) that the parts determine."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, key, quota): how many of each source's blocks every shard gets, from (key, blocks) of all sources.

    At a node of the tree, the blocks of all sources, as counts, are drawn one by one without replacement to the left or the right
    half of the node's shards, source by source: the counts that go left are multivariate hypergeometric. Shards get equal numbers
    of blocks, give or take one. A node is one row with a count per source.
    """
    held = F.array_sort(F.collect_list(F.struct("key", "blocks")))
    node = quotas.select("key", F.col("blocks").cast("long").alias("blocks")).groupBy().agg(held.alias("held")).select(F.lit(0).alias("first"), F.lit(shards).alias("last"), "held")
    none = F.array().cast("array<bigint>")
    for level in range(math.ceil(math.log2(max(1, shards)))):
        total = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        node = node.withColumn("middle", ((F.col("first") + F.col("last")) / 2).cast("int")).withColumn("rest", total)
        node = node.withColumn("need", F.round(F.col("rest") * (F.col("middle") - F.col("first")) / (F.col("last") - F.col("first"))).cast("long"))

        def one(s, _):  # whether the next of the `rest` blocks is one of the `need` that go left
            left = _uniform(F.lit(seed), F.lit(level), F.col("first"), s["rest"]) * s["rest"] < s["need"]
            return F.struct((s["need"] - left.cast("long")).alias("need"), (s["rest"] - 1).alias("rest"), (s["got"] + left.cast("long")).alias("got"))

        def source(s, x):
            begin = F.struct(s["need"].alias("need"), s["rest"].alias("rest"), F.lit(0).cast("long").alias("got"))
            drawn = F.aggregate(F.when(x["blocks"] > 0, F.sequence(F.lit(1).cast("long"), x["blocks"])).otherwise(none), begin, one)
            return F.struct(drawn["need"].alias("need"), drawn["rest"].alias("rest"), F.concat(s["out"], F.array(drawn["got"])).alias("out"))

        drawn = F.aggregate("held", F.struct("need", "rest", none.alias("out")), source)["out"]
        node = keep(node.withColumn("drawn", F.when(F.col("last") - F.col("first") > 1, drawn)), "tree")
        left = F.zip_with("held", "drawn", lambda h, g: F.struct(h["key"].alias("key"), g.alias("blocks")))
        right = F.zip_with("held", "drawn", lambda h, g: F.struct(h["key"].alias("key"), (h["blocks"] - g).alias("blocks")))
        halves = F.array(F.struct("first", F.col("middle").alias("last"), left.alias("held")), F.struct(F.col("middle").alias("first"), "last", right.alias("held")))
        node = node.select(F.explode(F.when(F.col("drawn").isNotNull(), halves).otherwise(F.array(F.struct("first", "last", "held")))).alias("x")).select("x.*")
    return node.select(F.col("first").alias("shard"), F.explode("held").alias("h")).select("shard", "h.key", F.col("h.blocks").alias("quota"))


def plan_mix(docs: DataFrame, carry: list[str], weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 64, seed: int = 17, least_block: int = 20_000) -> DataFrame:
    """What a mix takes of every row of ``docs``.

    Sources, by code point and null last, weigh ``weights``, repeating, and share ``share`` of the words of all documents; a source's
    target stops at ``most`` times its words. A source's documents fall into blocks by a hash. Its blocks, in a permuted order, are
    taken as often as whole passes fit the target, once more until it is reached, and the block that crosses it, and the
    document that crosses it, in part: the words taken of a source are its target, rounded. The splitting tree of ``split_quotas``
    says how many blocks of a source each shard gets; shards draw them, in another permuted order, one after the other.

    Returns (doc, size, source, source_size, target, full, part, taken, shards, place), one row per row of ``docs``: doc is a struct of
    the columns ``carry``; the document is taken whole ``full`` times and once with its first ``part`` words; shards are those of these
    copies, the part last; place orders documents within a shard. Null text has no words and takes part with none; repeated rows
    fall into the same block and share what is taken of the one that crosses. An empty table: no rows. Reruns agree.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    source = F.col("source").cast("string")
    rows = docs.select(
        F.struct(*carry).alias("doc"), size.alias("size"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("place"))
    light = keep(rows.select("size", "source", "key", "place"), "mix_sizes")
    sizes = targets(light.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), list(weights), share, most)
    total = sizes.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    block_words = max(least_block, total // 250_000)  # the tree draws at most about half a million blocks at a node
    sizes = keep(sizes.withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)).cast("long")), "sources")
    def in_blocks(some: DataFrame) -> DataFrame:
        told = sizes.select("key", "n", "source_size", "target", "n_blocks")
        some = some.join(F.broadcast(told.drop("n")), "key") if few_sources else join_hot(some, told, ["key"], "n", "inner").drop("n")
        return some.withColumn("block", F.pmod("place", "n_blocks"))

    few_sources = sizes.count() <= MOST_BROADCAST
    light = in_blocks(light)

    # how often whole passes fit, and the words that are left for one more pass over the permuted blocks
    blocks = light.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block")
    blocks = blocks.withColumn("full", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) + 1e-9), F.lit(0)).cast("long"))
    blocks = blocks.withColumn("left", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long") - (F.sum("words").over(order) - F.col("words")))
    whole = (F.col("left") >= F.col("words")) & (F.col("words") > 0)
    blocks = blocks.select("key", "block", (F.col("full") + whole.cast("long")).alias("full"), F.when(~whole & (F.col("left") > 0), F.least("left", "words")).otherwise(0).alias("extra"))
    # in a block that is taken in part: the place of the document that crosses, and its words, shared by equal rows
    ties = light.groupBy("key", "block", "place").agg(F.sum("size").alias("words"), F.count("*").alias("m"))
    ties = ties.join(blocks.filter("extra > 0"), ["key", "block"])
    ties = ties.withColumn("before", F.sum("words").over(Window.partitionBy("key", "block").orderBy("place")) - F.col("words"))
    cut = ties.filter("before < extra AND before + words >= extra").select("key", "block", F.col("place").alias("cut_place"), F.floor((F.col("extra") - F.col("before")) / F.col("m")).alias("cut_part"))
    blocks = keep_light(blocks.join(cut, ["key", "block"], "left"), "blocks")

    # shards draw the copies of blocks
    copies = blocks.select("key", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("copy"), (F.col("full") + (F.col("extra") > 0).cast("long")).alias("n"))
    copies = copies.filter("copy <= n").withColumn("drawn", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 2), "key", "block", "copy"), "block", "copy")))
    quotas = split_quotas(copies.groupBy("key").agg(F.count("*").alias("blocks")), shards, seed).filter("quota > 0")
    until = F.sum("quota").over(Window.partitionBy("key").orderBy("shard"))
    turns = quotas.withColumn("until", until).select("key", "shard", F.explode(F.sequence(F.col("until") - F.col("quota") + 1, F.col("until"))).alias("drawn"))
    placed = copies.join(turns, ["key", "drawn"]).groupBy("key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))

    # about 250,000 blocks, and one per source, at most: rows do not move to learn theirs, unless there are more sources
    told = keep(blocks.drop("extra").join(placed, ["key", "block"], "left"), "told")
    out = in_blocks(rows).join(F.broadcast(told) if few_sources else told, ["key", "block"])
    part = F.when(F.col("place") < F.col("cut_place"), F.col("size")).when(F.col("place") == F.col("cut_place"), F.least("size", "cut_part"))
    out = out.withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))
    return out.select(
        "doc", "size", "source", "source_size", "target", "full", "part", (F.col("full") * F.col("size") + F.col("part")).alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"), "place")


def mix(docs: DataFrame, zip_texts: bool = True, **options) -> DataFrame:
    """The mixed documents: one row per copy taken, with the columns of ``docs``; of a part the text has the first words only.

    Rows lie by shard and, within it, in the order of a hash of copy and document. Documents without words are in the mix once if
    their block is. With ``zip_texts`` texts are compressed while they move to their shards, by Python on the executors; without, there are
    only DataFrame functions, and more is moved. The rows are the same.
    """
    if zip_texts:
        text_batches(docs.sparkSession)
    out = plan_mix(docs, docs.columns, **options)
    ends = F.transform("shards", lambda s, i: F.struct(s.alias("shard"), i.alias("copy"), (i < F.col("full")).alias("whole")))
    out = out.select("*", F.explode(ends).alias("c")).filter(F.col("c.whole") | (F.col("part") > 0))
    text = F.col("doc.text").cast("string")
    some = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lit(1), F.greatest("part", F.lit(1)).cast("int")), " ")
    taken = F.when(F.col("c.whole") | (F.col("part") == F.col("size")), text).otherwise(some)
    # nothing moves but what the result and its order need
    fields = [(zipped(taken.cast("binary")) if zip_texts else taken) if c == "text" else F.col("doc").getField(c) for c in docs.columns]
    out = out.select(F.col("c.shard").alias("shard"), F.xxhash64(F.lit(23), "place", "c.copy").alias("lie"), *[f.alias(f"f{i}") for i, f in enumerate(fields)])
    out = out.repartition("shard").sortWithinPartitions("shard", "lie")
    return out.select(*[(unzipped(f"f{i}").cast("string") if c == "text" and zip_texts else F.col(f"f{i}")).alias(c) for i, c in enumerate(docs.columns)])
