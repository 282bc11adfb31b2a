"""Nearest items by vector: exact, or clustered with a calibrated bound; the caller chooses.

Items lie in blocks of bounded size around centres, and every block knows how near and how far from its centre its items are. A
query visits the nearest blocks first, which gives it k items and so a bound; after that only blocks that could hold anything
nearer, by the triangle inequality, are visited. Neighbouring blocks form a few units; a unit and its queries meet in one task, block by
block as two matrices, and only the k best per query are kept, so no pair of rows is ever written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from offerloom.session import materialise

BLOCK = 4096
#: Distances that a task holds at once.
PAIRS = 1 << 20
#: Units of neighbouring blocks that a query is sent to, at most, while a unit has less than ``UNIT`` items.
UNITS = 8
UNIT = 1 << 16


def normalise(df: DataFrame, vector: str) -> DataFrame:
    """Unit length, norm floored at 1e-8. The sum of squares is a variable of the last step: as a column it would be added up again for every number."""
    v = F.transform(vector, lambda x: x.cast("double"))
    unit = lambda s: F.transform(v, lambda x: x / F.greatest(F.sqrt(s), F.lit(1e-8)))
    return df.withColumn(vector, F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x, unit))


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class _Screen:
    """Scalar products of queries and items in single precision, and by how much one may be off: they only say which pairs are worth a closer look.

    For distances, vectors are taken from the middle of the items, and half the item's square is taken off, so that more is nearer.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str):
        self.far, self.a, self.b = metric != "cosine", a, b
        self.mid = a.mean(0) if self.far else np.zeros(a.shape[1])
        self.loss = 4e-15 * math.sqrt(max(_squares(a).max(), _squares(b).max(), self.mid @ self.mid)) if self.far else 0.0
        self.items, self.a2 = self._single(a, -0.5)
        self.queries, self.b2 = self._single(b, 0.0)
        self.fine = max(self.a2.max(), self.b2.max()) < 1e30  # else it may not fit single precision

    def _single(self, x: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in single precision, and their squares."""
        out, squares, step = np.ones((len(x), x.shape[1] + self.far), "float32"), np.empty(len(x)), max(1, PAIRS // x.shape[1])
        with np.errstate(over="ignore"):
            for at in range(0, len(x), step):
                part = x[at: at + step] - self.mid
                out[at: at + step, : x.shape[1]], squares[at: at + step] = part, _squares(part)
            if self.far and half:
                out[:, -1] = half * squares
        return out, squares

    def error(self, who: np.ndarray, at: np.ndarray, unit: float = 2.0 ** -23) -> np.ndarray:
        q, x = np.sqrt(self.b2[who]), math.sqrt(self.a2[at].max())
        return (self.a.shape[1] + 16) * unit * (q * x + self.far * x * x / 2) + self.loss * (q + x) + 1e-30

    def least(self, who: np.ndarray, close: np.ndarray) -> np.ndarray:
        """What a pair as close as ``close`` has here."""
        return (close + self.b2[who]) / 2 if self.far else close

    def double(self, who: np.ndarray, at: np.ndarray, digits: int) -> np.ndarray:
        """The closeness itself; by differences, number by number, where products are off in the last digit asked for."""
        if not self.far:
            return self.b[who] @ self.a[at].T
        if self.error(who, at, 2.0 ** -52).max() > 0.1 * 10.0 ** -digits:
            return np.stack([-_squares(self.a[at] - q) for q in self.b[who]])
        close = (self.b[who] - self.mid) @ (self.a[at] - self.mid).T
        close *= 2
        close -= self.a2[at][None, :]
        close -= self.b2[who][:, None]
        return close


def _firsts(near: np.ndarray, m: int) -> np.ndarray:
    """Places of the ``m`` largest of every row, and of some more if they are equal; of equal ones the first ``m``."""
    least = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m][:, None]
    same = near == least
    return np.flatnonzero((near > least) | (same & (np.cumsum(same, axis=1, dtype="int32") <= m)))


def _search(k: int, metric: str, drop_self: bool):
    """The k best items of every query. Items may lie in blocks (``block``), of which a query wants some (``wants``, a bit for each of them).

    Blocks are met one after the other. A query keeps its k best items so far, and at the start may know how close a k-th one is (``least``);
    single precision tells which others could be closer, and only these are worked out and ordered. So a task holds k items a query and
    ``PAIRS`` distances, however many blocks there are.
    """
    digits = 12 if metric == "cosine" else 9  # rounded, so that equal items are equally close in whichever block they lie

    def run(items: pd.DataFrame, queries: pd.DataFrame, a: np.ndarray | None = None, b: np.ndarray | None = None) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": queries["query_id"].iloc[:0], "item_id": items["item_id"].iloc[:0], "closeness": np.zeros(0)})
        if len(items) == 0 or len(queries) == 0:
            return none
        order = items["item_id"].reset_index(drop=True).sort_values(kind="stable", na_position="first").index.to_numpy()  # ties go to the smaller id
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        numbers = items["block"].to_numpy()[order] if "block" in items else np.zeros(len(order), int)
        blocks = [order[at] for _, at in sorted(pd.Series(numbers).groupby(numbers).indices.items())]
        wants = np.ones((len(queries), len(blocks)), bool)
        if "wants" in queries:
            bits = np.frombuffer(b"".join(queries["wants"]), "uint8").reshape(len(queries), -1)
            wants = np.unpackbits(bits, axis=1, count=len(blocks)).astype(bool)
        a, b = (np.stack(t["v"].to_numpy()) if x is None else x for t, x in ((items, a), (queries, b)))
        with np.errstate(over="ignore", invalid="ignore"):  # nothing is near what is not a number, or too large for one
            good, asks = np.isfinite(_squares(a)), np.isfinite(_squares(b))
        blocks = [at[good[at]] for at in blocks]
        wants &= asks[:, None]
        if not good.any() or not asks.any():
            return none
        a, b = (x if ok.all() else np.where(ok[:, None], x, 0.0) for x, ok in ((a, good), (b, asks)))
        screen = _Screen(a, b, metric)
        code, own, m = np.zeros(len(a), int), np.full(len(b), -1), k
        if drop_self:
            both = pd.factorize(pd.concat([items["item_id"], queries["query_id"]], ignore_index=True))[0]
            code, own = both[: len(a)], np.where(both[len(a):] < 0, -2, both[len(a):])
            m += int(np.bincount(code[code >= 0], minlength=1).max())  # as many may be the query itself
        known = np.full(len(b), -np.inf)
        if "least" in queries:
            least = queries["least"].to_numpy(dtype=float)
            known = np.where(np.isnan(least), -np.inf, least if metric == "cosine" else -least * least)
        close, place = np.full((len(b), k), -np.inf), np.full((len(b), k), len(a))

        def looked_at(row: np.ndarray, col: np.ndarray) -> np.ndarray:
            out, step = np.empty(len(row)), max(1, 2 * PAIRS // a.shape[1])
            for i in range(0, len(row), step):
                x, y = b[row[i: i + step]], a[col[i: i + step]]
                if metric != "cosine":
                    x -= y
                    y = x
                out[i: i + step] = np.einsum("ij,ij->i", x, y)
            return np.round(out if metric == "cosine" else -out, digits)

        def keep(row: np.ndarray, col: np.ndarray) -> None:
            """Rows are in order."""
            other = code[col] != own[row]
            row, col = row[other], col[other]
            near = looked_at(row, col)
            fit = np.isfinite(near) & (near >= close[row, k - 1])
            row, col, near = row[fit], col[fit], near[fit]
            if len(row) == 0:
                return
            new = np.r_[True, row[1:] != row[:-1]]
            who, r = row[new], np.cumsum(new) - 1
            n = np.bincount(r) + k
            r = np.concatenate([np.repeat(np.arange(len(who)), k), r])
            near, col = np.concatenate([close[who].ravel(), near]), np.concatenate([place[who].ravel(), rank[col]])
            by = np.lexsort((col, -near, r))
            best = by[np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < k]
            close[who], place[who] = near[best].reshape(-1, k), col[best].reshape(-1, k)

        for i, at in enumerate(blocks):
            visitors = np.flatnonzero(wants[:, i])
            if len(at) == 0:
                continue
            x, step = screen.items[at].T, max(1, PAIRS // len(at))
            for c in range(0, len(visitors), step):
                who = visitors[c: c + step]
                floor = np.maximum(close[who, k - 1], known[who])
                floor = floor - 2.0 * 10.0 ** -digits - 1e-12 * np.abs(floor)
                hit = None
                if screen.fine:
                    dots, off, bound = screen.queries[who] @ x, screen.error(who, at), screen.least(who, floor)
                    new = np.flatnonzero(bound == -np.inf)
                    if len(new) and len(at) > m:
                        bound[new] = np.partition(dots[new], len(at) - m, axis=1)[:, len(at) - m] - off[new] - 2.0 * 10.0 ** -digits
                    hit = np.flatnonzero(dots >= np.nextafter((bound - off).astype("float32"), np.float32(-np.inf))[:, None])
                if hit is None or len(hit) > len(who) * (2 * m + len(at) // 32):  # said too little, or many are equal
                    near = screen.double(who, at, digits)
                    near[np.isnan(near)] = -np.inf
                    hit = _firsts(np.round(near, digits, out=near), min(m, len(at)))
                    hit = hit[near.ravel()[hit] >= floor[hit // len(at)]]
                row, col = np.divmod(hit, len(at))
                keep(who[row], at[col])
        row, j = np.nonzero(close > -np.inf)
        found = close[row, j] if metric == "cosine" else -np.sqrt(np.maximum(-close[row, j], 0.0))
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "item_id": items["item_id"].to_numpy()[order[place[row, j]]], "closeness": found})

    return run


def _matrix(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors as they lie in Arrow's memory: not copied if they came in one piece."""
    v = v.combine_chunks()
    if len(set(np.diff(v.offsets.to_numpy()))) > 1:
        raise ValueError("vectors differ in length")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def _search_tables(k: int, metric: str, drop_self: bool):
    """``_search`` of Arrow tables."""
    search = _search(k, metric, drop_self)

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        found = search(items.drop_columns("v").to_pandas(), queries.drop_columns("v").to_pandas(), _matrix(items["v"]), _matrix(queries["v"]))
        kind = [("query_id", queries.schema.field("query_id").type), ("item_id", items.schema.field("item_id").type), ("closeness", pa.float64())]
        return pa.Table.from_pandas(found, pa.schema(kind), preserve_index=False)

    return run


def _written(items: DataFrame, queries: DataFrame | None, item_id: str, query_id: str, vector: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """(items, queries) prepared and written, since every step reads them; once if both are the same."""
    i = materialise(_prepared(items, item_id, vector, "item_id", metric), "items")
    if queries is None:
        return i, i.withColumnRenamed("item_id", "query_id")
    return i, materialise(_prepared(queries, query_id, vector, "query_id", metric), "queries")


def _prepared(df: DataFrame, id_col: str, vector: str, out_id: str, metric: str) -> DataFrame:
    d = df.select(F.col(id_col).alias(out_id), F.col(vector).alias("v")).filter(F.size("v") > 0)
    return normalise(d, "v") if metric == "cosine" else d.withColumn("v", F.col("v").cast("array<double>"))


@dataclass(frozen=True)
class Blocks:
    """What tasks know of the blocks: the centres, and of each block (cell, ib, items, nearest, farthest distance from the centre)."""

    centres: np.ndarray
    blocks: np.ndarray

    def first(self, d: np.ndarray, least: int) -> np.ndarray:
        """Which blocks a query visits first, given its distances to the centres: the nearest ones that hold ``least`` items together."""
        d = d[:, self.blocks[:, 0].astype(int)]
        out, nearest = np.zeros(d.shape, bool), d.argmin(1)
        out[np.arange(len(d)), nearest] = True
        more = np.flatnonzero(self.blocks[nearest, 2] < least)
        near = np.argsort(d[more], axis=1, kind="stable")
        n = self.blocks[:, 2][near]
        take = np.zeros(near.shape, bool)
        np.put_along_axis(take, near, np.cumsum(n, axis=1) - n < least, 1)
        out[more] = take
        return out

    def bounds(self, d: np.ndarray, slack: float = 1.0) -> np.ndarray:
        """The least distance an item of each block can have: the centre's, less the farthest item's or from the nearest item's.

        ``slack`` below 1 trusts that the farthest items do not lie towards the query.
        """
        c = d[:, self.blocks[:, 0].astype(int)]
        return np.maximum(np.maximum(c - slack * self.blocks[:, 4], self.blocks[:, 3] - c), 0.0)

    def units(self, block: int) -> tuple[np.ndarray, int]:
        """(the unit of each block, the most visitors that meet it at once). Units are runs of blocks along the line on which the centres differ most."""
        n = self.blocks[:, 2]
        size = max(block, min(UNIT, -(-int(n.sum()) // UNITS)))
        centres = np.nan_to_num(self.centres, posinf=0.0, neginf=0.0)
        line = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
        order = np.argsort((centres @ line)[self.blocks[:, 0].astype(int)], kind="stable")
        out = np.empty(len(n), int)
        out[order] = ((np.cumsum(n[order]) - n[order]) // size).astype(int)
        return out, size


@dataclass(frozen=True)
class Cells:
    """Items in blocks, rows (item_id, v, cell, ib), and what is known of the blocks."""

    items: DataFrame
    told: Blocks
    metric: str
    block: int = BLOCK


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), 0.0))


def make_cells(items: DataFrame, centres, metric: str, block: int = BLOCK) -> Cells:
    """Put prepared items (item_id, v) to their nearest centres; a cell of any size is cut into blocks by a hash of the item."""
    m = np.array(centres, dtype=float)

    @F.pandas_udf("cell int, far double")
    def near(v: pd.Series) -> pd.DataFrame:
        step, cell, far = max(1, PAIRS // len(m)), np.zeros(len(v), "int32"), np.zeros(len(v))
        for at in range(0, len(v), step):
            d = _distances(np.stack(v.iloc[at: at + step].to_numpy()), m)
            cell[at: at + step], far[at: at + step] = d.argmin(1), d.min(1)
        return pd.DataFrame({"cell": cell, "far": far})

    placed = materialise(items.select("item_id", "v", near("v").alias("at")).select("item_id", "v", "at.cell", "at.far"), "cells")
    cut = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))  # a row per centre
    placed = placed.join(cut, "cell").withColumn("ib", F.pmod(F.xxhash64("item_id"), F.col("nb")).cast("int")).drop("nb")
    told = placed.groupBy("cell", "ib").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).orderBy("cell", "ib").collect()
    return Cells(placed.drop("far"), Blocks(m, np.array([tuple(r) for r in told], dtype=float).reshape(-1, 5)), metric, block)


def _visits(cells: Cells, queries: DataFrame, k: int, slack: float | None) -> DataFrame:
    """(query_id, unit, wants): the first blocks of each query, or with ``slack`` the others that its bound ``tau`` does not rule out.

    ``wants`` has a bit for each block of the unit, in their order.
    """
    told = cells.told
    units = told.units(cells.block)[0]
    blocks, bits = [np.flatnonzero(units == u) for u in range(units.max() + 1)], np.bincount(units).max()

    def run(batches):
        for t in batches:
            step = max(1, PAIRS // max(1, len(told.blocks)))
            for at in range(0, len(t), step):
                part = t.iloc[at: at + step]
                d = _distances(np.stack(part["v"].to_numpy()), told.centres)
                want = told.first(d, k + 1)
                if slack is not None:
                    tau = part["tau"].to_numpy(dtype=float)
                    tau = np.where(np.isnan(tau), np.inf, np.sqrt(tau * tau * (1 + 1e-9) + 4e-9))  # rounding of the closeness included
                    want = ~want & (told.bounds(d, slack) <= tau[:, None])
                for u, of in enumerate(blocks):
                    q = np.flatnonzero(want[:, of].any(axis=1))
                    sent = np.zeros((len(q), bits), bool)
                    sent[:, : len(of)] = want[np.ix_(q, of)]
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "unit": np.full(len(q), u, "int32"), "wants": [w.tobytes() for w in np.packbits(sent, axis=1)]})

    kind = dict(queries.dtypes)["query_id"]
    return queries.mapInPandas(run, f"query_id {kind}, unit int, wants binary")


def _packed(bits: int):
    """The numbers of a list as bits."""

    @F.pandas_udf("binary")
    def pack(numbers: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(np.bincount(n, minlength=bits) > 0).tobytes() for n in numbers])

    return pack


def _meet(cells: Cells, queries: DataFrame, visits: DataFrame, k: int, drop_self: bool, block: int) -> DataFrame:
    """The k best items of every query in each unit it visits. A query is sent to a unit once, with the blocks it wants as bits (or given as
    rows (query_id, cell, ib)), and with the closeness ``least`` that it has k items of, if it is known; the visitors of a unit are cut by its size,
    too, so that vectors move as often as there are units, not blocks."""
    units, size = cells.told.units(block)
    place = [int(np.count_nonzero(units[:n] == u)) for n, u in enumerate(units)]
    told = [(int(c), int(i), n, int(u), p) for n, ((c, i), u, p) in enumerate(zip(cells.told.blocks[:, :2], units, place))]
    placed = F.broadcast(queries.sparkSession.createDataFrame(told, "cell int, ib int, block int, unit int, place int"))  # a row per block
    if "cell" in visits.columns:
        visits = visits.join(placed, ["cell", "ib"]).groupBy("query_id", "unit").agg(F.collect_list("place").alias("wants"))
        visits = visits.withColumn("wants", _packed(int(np.bincount(units).max()))("wants"))
    visits = materialise(visits, "visits")
    plan = F.broadcast(visits.groupBy("unit").agg(F.ceil(F.count("*") / size).cast("int").alias("nq")))  # a row per unit
    known = [c for c in queries.columns if c == "least"]
    q = visits.join(plan, "unit").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).drop("nq").join(queries.select("query_id", "v", *known), "query_id")
    i = cells.items.join(placed, ["cell", "ib"]).join(plan, "unit").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    kind = dict(cells.items.dtypes)["item_id"], dict(queries.dtypes)["query_id"]
    g = ["unit", "qb"]
    return i.select(*g, "block", "item_id", "v").groupBy(*g).cogroup(q.select(*g, "query_id", "v", "wants", *known).groupBy(*g)).applyInArrow(
        _search_tables(k, cells.metric, drop_self), f"query_id {kind[1]}, item_id {kind[0]}, closeness double"
    )


def _best(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("closeness").desc(), "item_id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_cells(cells: Cells, queries: DataFrame, k: int, drop_self: bool = True, slack: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, similarity, rank): the k nearest items of each prepared query (query_id, v); exact if ``slack`` is 1."""
    cells = replace(cells, block=block)
    first = materialise(_best(_meet(cells, queries, _visits(cells, queries, k, None), k, drop_self, block), k), "first_visits")
    tau = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("closeness")).alias("closeness"))
    far = F.sqrt(F.greatest(2 - 2 * F.col("closeness"), F.lit(0.0))) if cells.metric == "cosine" else -F.col("closeness")
    asked = queries.join(tau, "query_id", "left").select("query_id", "v", far.alias("tau"), F.col("closeness").alias("least"))
    more = _meet(cells, queries, _visits(cells, asked, k, slack), k, drop_self, block)
    top = _best(first.select("query_id", "item_id", "closeness").unionByName(more), k)
    sim = F.col("closeness") if cells.metric == "cosine" else F.lit(1.0) / (F.lit(1.0) - F.col("closeness"))
    return top.select("query_id", "item_id", F.round(sim, 4).alias("similarity"), "rank")


def some_vectors(items: DataFrame, n: int) -> np.ndarray:
    """The ``n`` items with the smallest hash of their id, as a matrix."""
    got = items.orderBy(F.xxhash64("item_id"), "item_id").limit(n).select("v").collect()
    return np.array([r["v"] for r in got], dtype=float)


def cell_count(n: int, block: int = BLOCK) -> int:
    """Centres of an exact search: one a block, the root of the number of items at most."""
    return max(1, min(-(-n // block), math.isqrt(n)))


def similar_to_vectors(items: DataFrame, queries: DataFrame | None, k: int, item_id: str, query_id: str, vector: str = "embedding",
                       metric: str = "cosine", drop_self: bool = False, block: int = BLOCK) -> DataFrame:
    """Exact k nearest items of each query vector (None: of each item's); ids are unique. Rows without a vector, or with an empty one, take no part.

    Blocks lie around items picked by hash. A task sees at most ``block`` items and ``block`` queries; blocks that cannot hold a
    nearer item than the k found already are not visited.
    """
    i, q = _written(items, queries, item_id, query_id, vector, metric)
    n = i.count()
    if n == 0:
        kind = dict(i.dtypes)["item_id"]
        return q.limit(0).select("query_id", F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank"))
    return search_cells(make_cells(i, some_vectors(i, cell_count(n, block)), metric, block), q, k, drop_self, block=block)


def similar_exact(items: DataFrame, k: int, item_id: str, vector: str = "embedding", metric: str = "cosine",
                  queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Exact k nearest other items of each item (or of the items in ``queries``)."""
    return similar_to_vectors(items, queries, k, item_id, item_id, vector, metric, True, block)


# --- clustered search --------------------------------------------------------------------------------------


def cluster_count(n: int, wanted: int | None = None) -> int:
    """As many clusters as the root of the number of items, or as many as wanted; ten items or more each."""
    return max(1, min(math.isqrt(n) if wanted is None else wanted, n // 10))


def train_clusters(items: DataFrame, vector: str, clusters: int, metric: str = "cosine", seed: int = 42, per_centre: int = 256, n: int | None = None) -> list[list[float]]:
    """Cluster centres from k-means on ``per_centre`` items a cluster, picked by a hash of the vector: as the clusters are the root
    of the items at most, its cost follows the number of items."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = items.select(F.col(vector).alias("v")).filter(F.size("v") > 0)
    n = d.count() if n is None else n
    share = min(1.0, per_centre * clusters / max(1, n))
    d = d.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else d
    d = normalise(d, "v") if metric == "cosine" else d
    data = d.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=clusters, seed=seed, maxIter=10).fit(data)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def calibrate(cells: Cells, k: int, target: float, sample: int = 400) -> float:
    """The slack with which a share ``target`` of the k nearest other items of ``sample`` items, picked by hash, is visited.

    The sample is searched exactly. A neighbour is visited if the query's distance to the block's centre, less slack times the farthest
    item's, is at most the distance of the query's k-th neighbour; the slack is the quantile of what the neighbours need.
    """
    q = cells.items.orderBy(F.xxhash64("item_id"), "item_id").limit(sample).select(F.col("item_id").alias("query_id"), "v")
    q = materialise(q, "calibration")
    found = search_cells(cells, q, k, True)
    at = found.join(cells.items.select("item_id", "cell", "ib", F.col("v").alias("w")), "item_id").join(q, "query_id").collect()  # sample * k rows
    if not at:
        return 1.0
    x, w = (np.array([r[c] for r in at], dtype=float) for c in ("v", "w"))
    cell = np.array([r["cell"] for r in at])
    ids = np.unique([str(r["query_id"]) for r in at], return_inverse=True)[1]
    near = np.sqrt(((x - w) ** 2).sum(1))
    tau = np.zeros(ids.max() + 1)
    np.maximum.at(tau, ids, near)
    far = {(int(b[0]), int(b[1])): b[4] for b in cells.told.blocks}
    radius = np.array([far[r["cell"], r["ib"]] for r in at])
    need = (np.sqrt(((x - cells.told.centres[cell]) ** 2).sum(1)) - tau[ids]) / np.maximum(radius, 1e-12)
    return float(np.clip(np.quantile(need, target, method="higher"), 0.0, 1.0))


def similar_ivf(items: DataFrame, k: int, item_id: str, vector: str = "embedding", clusters: int | None = None, target: float = 0.95,
                metric: str = "cosine", queries: DataFrame | None = None, slack: float | None = None) -> DataFrame:
    """k nearest other items over clusters. How many clusters a query visits follows from its own bound (``Blocks.bounds``).

    ``slack`` 1 rules out nothing that could be a neighbour. Without it, it is calibrated so that a share ``target`` is found.
    """
    i, q = _written(items, queries, item_id, item_id, vector, metric)
    n = i.count()
    if n == 0:
        return similar_exact(items, k, item_id, vector, metric, queries)
    cells = make_cells(i, train_clusters(i, "v", cluster_count(n, clusters), "l2", n=n), metric)
    return search_cells(cells, q, k, True, calibrate(cells, k, target) if slack is None else slack)


# --- stored index ---------------------------------------------------------------------------------------------


def write_index(items: DataFrame, path: str, item_id: str, vector: str = "embedding", clusters: int | None = None, metric: str = "cosine",
                k: int = 10, target: float = 0.95) -> None:
    """Items by cluster, the centres, and the blocks with their distances and the slack calibrated for ``k`` neighbours."""
    spark = items.sparkSession
    i = materialise(_prepared(items, item_id, vector, "item_id", metric), "items")
    n = i.count()
    cells = make_cells(i, train_clusters(i, "v", cluster_count(n, clusters), "l2", n=n), metric)
    cells.items.repartition("cell", "ib").write.partitionBy("cell").parquet(f"{path}/items")
    spark.createDataFrame([(j, [float(x) for x in c]) for j, c in enumerate(cells.told.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    slack = calibrate(cells, k, target)
    told = [(int(b[0]), int(b[1]), int(b[2]), float(b[3]), float(b[4]), slack, metric) for b in cells.told.blocks]
    spark.createDataFrame(told, "cell int, ib int, n long, near double, far double, slack double, metric string").coalesce(1).write.parquet(f"{path}/blocks")


def read_index(spark, path: str) -> tuple[Cells, float]:
    """(cells, slack) of a stored index, for ``search_cells``."""
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("cell", "ib").collect()
    items = spark.read.parquet(f"{path}/items").select("item_id", "v", F.col("cell").cast("int"), "ib")
    return Cells(items, Blocks(np.array(centres), np.array([tuple(b)[:5] for b in blocks], dtype=float)), blocks[0]["metric"]), blocks[0]["slack"]


def index_stats(items: DataFrame, vector: str = "v") -> DataFrame:
    """Items, dimensions and bytes of the stored vectors (four bytes per number)."""
    return items.agg(F.count("*").alias("n_items"), F.max(F.size(vector)).alias("dimensions"),
                     (F.sum(F.size(vector)) * 4).cast("bigint").alias("n_bytes"))
