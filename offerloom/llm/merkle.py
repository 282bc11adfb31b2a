"""Merkle manifest of a dataset: one root for all rows, a proof for each, by cogrouped subtree exchange.

Rows are leaves, numbered per tree in their order. A superblock is a stretch of ``arity ** levels`` neighbours of a tree. Each
superblock reduces its own nodes; only its top goes on, as a node of the next stage, until a tree has one node left, its subroot.
The subroots are the leaves of one more tree, that of the root. On the way back every stage cogroups its nodes with the outer
nodes that their superblock needs (the siblings above its top, at most ``arity - 1`` a level), in one call a superblock: it
reduces once more, joins the proofs of its nodes, and at the leaves folds them. A task holds superblocks, never a tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import keep, keep_bucketed


@dataclass(frozen=True)
class Shape:
    """How many nodes make one node of the level above, and how many levels a superblock reduces at a time."""

    arity: int = 8
    levels: int = 4

    def block(self) -> Column:
        return F.expr(f"pos div {self.arity ** self.levels}")

    def reduced(self, n: int) -> int:
        """Levels that a superblock of a tree of ``n`` nodes reduces: ``levels``, or fewer if one node is left before."""
        up = 0
        while n > 1 and up < self.levels:
            n, up = -(-n // self.arity), up + 1
        return up

    def above(self, digests: list[str]) -> list[str]:
        return [_h("".join(digests[i : i + self.arity])) for i in range(0, len(digests), self.arity)]

    def siblings(self, digests: list[str], levels: int) -> tuple[list[list[str]], list[list[str]]]:
        """For each node, level by level, the digests of its run's others: those to its left and those to its right, concatenated."""
        left, right = [[] for _ in digests], [[] for _ in digests]
        step = 1
        for _ in range(levels):
            for i in range(len(left)):
                at = i // step
                begin = at - at % self.arity
                left[i].append("".join(digests[begin:at]))
                right[i].append("".join(digests[at + 1 : begin + self.arity]))
            digests, step = self.above(digests), step * self.arity
        return left, right


_NODE = "tree string, pos long, n long, digest string"
_OUTER = "tree string, pos long, left array<string>, right array<string>, subroot string, root string"


def _h(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 over the columns one after the other: ``-`` for null, else UTF-8 byte count, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _numbered(rows: DataFrame, order: list[str], shape: Shape, name: str) -> DataFrame:
    """``rows`` with pos (from 0, in ``order`` within ``tree``), n (rows of the tree) and block.

    Rows are range-partitioned and sorted; the place in a partition and the counts of the partitions before give the number, so that
    a tree of any size is spread. ``order`` ends with a column without repeats, which lets rows of one value be split too.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = keep(placed.withColumn("part", F.shiftright("at", 33)), f"{name}_sorted")
    first = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    tree = Window.partitionBy("tree")
    first = first.select("tree", "part", (F.sum("m").over(tree.orderBy("part")) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n"))
    out = placed.join(first, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    out = out.withColumn("block", shape.block()).drop("at", "part", "shift")
    return keep_bucketed(out, ["tree", "block"], name)


def _tops(nodes: DataFrame, shape: Shape, name: str) -> DataFrame:
    """The top of every superblock as a node of the next stage."""

    def reduce(key, t: pd.DataFrame) -> pd.DataFrame:
        n = int(t["n"].iloc[0])
        digests = t.sort_values("pos")["digest"].tolist()
        for _ in range(shape.reduced(n)):
            digests, n = shape.above(digests), -(-n // shape.arity)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [n], "digest": digests})

    return keep(nodes.select("tree", "block", "pos", "n", "digest").groupBy("tree", "block").applyInPandas(reduce, _NODE), name)


def _stages(nodes: DataFrame, shape: Shape, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes of each stage, trees that end with it as tree and digest)."""
    stages, ended = [nodes], []
    while True:
        tops = _tops(stages[-1], shape, f"{name}_tops")
        ended.append(tops.filter("n = 1").select("tree", "digest"))
        if tops.filter("n > 1").isEmpty():
            return stages, ended
        stages.append(tops.filter("n > 1").withColumn("block", shape.block()))


def _downwards(nodes: DataFrame, outer: DataFrame, shape: Shape, name: str) -> DataFrame:
    """The outer nodes that each node of a stage hands to the superblock below it."""

    def join(t: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        if not len(t):
            return pd.DataFrame(columns=["tree", "pos", "left", "right", "subroot", "root"])
        left, right = shape.siblings(t["digest"].tolist(), shape.reduced(int(t["n"].iloc[0])))
        o = o.iloc[0]
        return pd.DataFrame({"tree": t["tree"].to_list(), "pos": t["pos"].to_list(), "left": [x + list(o["left"]) for x in left], "right": [x + list(o["right"]) for x in right], "subroot": o["subroot"], "root": o["root"]})

    mine = nodes.select("tree", "block", "pos", "n", "digest").groupBy("tree", "block")
    return keep(mine.cogroup(outer.groupBy("tree", "pos")).applyInPandas(join, _OUTER), name)


def manifest(docs: DataFrame, columns: list[str], tree: str, order: str, given: Column | None = None, proofs: bool = False, shape: Shape = Shape()) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``, and whether what is given now still folds to the root.

    A row's leaf is the digest of ``columns``. Rows of one value of ``tree`` (null is a value, and the first) are leaves of one tree, in
    the order of ``order`` (null first; rows that share it in the order of their leaves, equal ones in any). Of every level, each
    ``shape.arity`` neighbours, at the end fewer or even one, become one node, until one is left, the subroot; a tree of one row is its leaf. Subroots, in the
    bytewise order of their trees, make the root in the same way.

    ``given`` is the digest of the row as it is given now, null where nothing has changed. The fold runs it, or the leaf, up the
    original siblings. Returns (``order``, tree, leaf, subroot, root, proof_sha256, folded_root, verified); proof_sha256 is the digest of the siblings,
    level by level, left to right, and with ``proofs`` they are a column ``proof`` of one string a level, too. No rows: no rows.
    Other columns of ``docs`` are not looked at. Null texts and values are ``-``, empty ones ``0:``.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    key = F.col(order)
    kind = docs.schema[order].dataType
    leaves = docs.select(name.alias("tree"), key.alias("key"), leaf_digest(*map(F.col, columns)).alias("digest"), (F.lit(None).cast("string") if given is None else given).alias("given"))
    leaves = _numbered(keep(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle_leaves"), ["key", "digest", "row"], shape, "merkle_nodes")
    stages, ended = _stages(leaves, shape, "merkle")
    every = ended[0]
    for e in ended[1:]:
        every = every.unionByName(e)
    subroots = _numbered(keep(every.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "merkle_subroots"), ["of"], shape, "merkle_trees")
    tops, last = _stages(subroots, shape, "merkle_trees")
    none = F.array().cast("array<string>")
    root = last[-1].select("tree", F.lit(0).cast("long").alias("pos"), none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(tops):
        root = _downwards(nodes, root, shape, "merkle_trees_outer")
    of_tree = keep(subroots.select("pos", "of", "digest").join(root, "pos").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("subroot"), "root"), "merkle_outer")
    outer = of_tree.join(ended[-1].select("tree"), "tree")
    for nodes, done in zip(reversed(stages[1:]), reversed(ended[:-1])):
        outer = _downwards(nodes, outer, shape, "merkle_outer").unionByName(of_tree.join(done.select("tree"), "tree"))

    def fold(t: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        if not len(t):
            return pd.DataFrame(columns=names)
        leaf = t["digest"].tolist()
        left, right = shape.siblings(leaf, shape.reduced(int(t["n"].iloc[0])))
        o = o.iloc[0]
        out = []
        for x, now, a, b in zip(leaf, t["given"], left, right):
            a, b = a + list(o["left"]), b + list(o["right"])
            levels = [l + r for l, r in zip(a, b)]
            at = now or x
            for l, r in zip(a, b):
                at = _h(l + at + r)
            out.append((_h("".join(levels)), at, at == o["root"], levels if proofs else None))
        proof, folded, same, levels = zip(*out)
        out = pd.DataFrame({"key": t["key"].to_list(), "tree": t["tree"].to_list(), "leaf": leaf, "subroot": o["subroot"], "root": o["root"], "proof_sha256": proof, "folded_root": folded, "verified": same})
        return out.assign(proof=levels) if proofs else out

    schema = "key string, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "")
    names = [x.split()[0] for x in schema.split(", ")]
    told = leaves.withColumn("key", F.col("key").cast("string"))  # pandas would make null integers floats
    out = told.groupBy("tree", "block").cogroup(outer.groupBy("tree", "pos")).applyInPandas(fold, schema)
    out = out.withColumn("tree", F.when(F.col("tree") != "", F.expr("substring(tree, 2)")))
    return out.select(F.col("key").cast(kind).alias(order), *names[1:])
