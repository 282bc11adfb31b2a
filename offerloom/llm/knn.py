"""Exact top-k search by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import keep

#: Most pivots: the tables of pivots, cells and bounds that reach every task stay under 256 x 256 numbers and 256 vectors.
PIVOTS = 256
#: Rows of a cell, and queries, that a task multiplies at a time.
BLOCK = 8192


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); vectors that are null, empty or hold null, NaN or infinity are left out."""
    v = F.col(vec_col).cast("array<double>")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    return whole.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2**53, else in integers."""
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def bounds(pivots: np.ndarray, reach: np.ndarray, sizes: np.ndarray, group_reach: np.ndarray, k: int) -> np.ndarray:
    """needed[g, c]: whether cell c may hold one of the k best of a query of cell g.

    With query q within ``group_reach`` of pivot g and row x within ``reach`` of pivot c, q.x is within
    |g| reach + |c| group_reach + reach group_reach of g.c. The k best of q cannot be below the lowest product of the cells that
    surely hold k rows besides the query, so a cell whose highest product is under that is not needed.
    """
    norm = np.sqrt((pivots**2).sum(axis=1))
    mid = pivots @ pivots.T
    slack = norm[:, None] * reach[None, :] + group_reach[:, None] * norm[None, :] + group_reach[:, None] * reach[None, :]
    slack = slack * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))
    needed = np.zeros(mid.shape, bool)
    for g in range(len(pivots)):
        order = np.argsort(-(mid[g] - slack[g]))
        enough = np.searchsorted(np.cumsum(sizes[order]), k + 1)
        least = (mid[g] - slack[g])[order[enough]] if enough < len(order) else -np.inf
        needed[g] = (mid[g] + slack[g] >= least) & (sizes > 0)
    return needed


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, per_task: int = 200_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k rows of highest inner product, all if there are fewer.

    ``rows`` and ``queries`` are (vec_id, v) as ``scaled`` gives them. A query's own row, any row of the same vec_id, is no
    candidate; ties go to the smaller vec_id. Vectors of other lengths than the query's have no score. Rows that repeat
    a vec_id are candidates each. An empty side gives an empty result.

    Pivots, a bounded sample, divide the space into cells. Counts and radii of the cells bound the products of each pair of cells;
    a cell goes only to the groups of queries that may need it, in pieces of bounded size, and is solved there. Groups join
    the queries of several cells, so that a cell is copied once per group, not once per query cell.
    """
    spark = rows.sparkSession
    names, schema = ["query_id", "rank", "vec_id", "score"], "query_id long, rank int, vec_id long, score long"
    out = None
    for (dim,) in sorted(queries.select(F.size("v")).distinct().collect()):
        data = rows.filter(F.size("v") == dim)
        n = data.count()
        pivots = np.array([r["v"] for r in data.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, math.isqrt(n) + 1)).collect()]).reshape(-1, dim)
        if not n:
            continue

        def nearest(batches, pivots=pivots):
            half = (pivots**2).sum(axis=1) / 2
            for b in batches:
                if b.num_rows:
                    x = _matrix(b["v"])
                    cell = np.argmin(half - x @ pivots.T, axis=1)
                    far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                    yield pa.record_batch([b["vec_id"], b["v"], pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

        placed = "vec_id long, v array<double>, cell int, far double"
        data = keep(data.select("vec_id", "v").mapInArrow(nearest, placed), "cells")
        asked = keep(queries.filter(F.size("v") == dim).select("vec_id", "v").mapInArrow(nearest, placed), "queries")
        m = len(pivots)
        reach, sizes, group_reach, asking = np.zeros(m), np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64)
        for r in data.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
            reach[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
        for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
            group_reach[r["cell"]], asking[r["cell"]] = r["far"], r["n"]
        needed = bounds(pivots, reach, sizes, group_reach, k)[asking > 0]

        # neighbouring query cells form a group, up to a block of queries; larger cells are cut into several groups
        groups: list[tuple[list[int], int, int]] = []
        cells = np.flatnonzero(asking)
        for c in cells[np.argsort(pivots[cells] @ pivots[cells[0]])].tolist():
            if asking[c] > BLOCK:
                groups.append(([c], int(asking[c]), -(-int(asking[c]) // BLOCK)))
            elif groups and groups[-1][1] + asking[c] <= BLOCK:
                groups[-1] = (groups[-1][0] + [c], groups[-1][1] + int(asking[c]), 1)
            else:
                groups.append(([c], int(asking[c]), 1))
        row_of = {int(c): i for i, c in enumerate(cells)}
        wanted = [(g, int(c), part) for g, (own, _, parts) in enumerate(groups) for c in np.flatnonzero(needed[[row_of[c] for c in own]].any(axis=0)) for part in range(parts)]
        pieces = {int(c): -(-int(sizes[c]) // BLOCK) for c in range(m)}
        # tasks of a group: whole cells together up to a number of rows, pieces of larger cells apart
        tasks, load = [], {}
        for g, c, part in wanted:
            for piece in range(pieces[c]):
                size = min(BLOCK, int(sizes[c]))
                at, held = load.get((g, part), (0, 0))
                if held and held + size > per_task:
                    at, held = at + 1, 0
                load[(g, part)] = (at, held + size)
                tasks.append((c, piece, g, part, at))
        owner = [(c, g, parts) for g, (own, _, parts) in enumerate(groups) for c in own]
        routes = spark.createDataFrame(tasks, "cell int, piece int, g int, part int, task int")
        owners = spark.createDataFrame(owner, "cell int, g int, parts int")
        n_pieces = spark.createDataFrame(list(pieces.items()), "cell int, pieces int")
        sent = data.join(F.broadcast(n_pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
        sent = sent.join(F.broadcast(routes), ["cell", "piece"]).select("g", "part", "task", "vec_id", "v")
        mine = asked.join(F.broadcast(owners), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        mine = mine.join(F.broadcast(routes.select("g", "part", "task").distinct()), ["g", "part"]).select(F.col("g").alias("qg"), F.col("part").alias("qpart"), F.col("task").alias("qtask"), "vec_id", "v")

        def solve(left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], pa.int32() if n == "rank" else pa.int64()) for n in names})
            q, x, qid, xid = _matrix(left["v"]), _matrix(right["v"]), left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            found = []
            for i in range(0, len(q), 256):
                top: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q[i : i + 256])
                for j in range(0, len(x), BLOCK):
                    s, part = _products(q[i : i + 256], x[j : j + BLOCK]), xid[j : j + BLOCK]
                    for a, row in enumerate(s):
                        other = np.flatnonzero(part != qid[i + a])
                        at = other[best(part[other], row[other], k)]
                        ids, scores = np.concatenate((top[a][0], part[at])), np.concatenate((top[a][1], row[at]))
                        first = best(ids, scores, k)
                        top[a] = ids[first], scores[first]
                found += [(qid[i + a], rank + 1, v, s) for a, t in enumerate(top) for rank, (v, s) in enumerate(zip(*t))]
            cols = list(zip(*found)) or [[]] * 4
            return pa.table([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, cols)], names=names)

        solved = mine.groupBy("qg", "qpart", "qtask").cogroup(sent.groupBy("g", "part", "task")).applyInArrow(solve, schema)
        out = solved if out is None else out.unionByName(solved)
    if out is None:
        return spark.createDataFrame([], schema)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", order).filter(F.col("rank") <= k).select(*names)
