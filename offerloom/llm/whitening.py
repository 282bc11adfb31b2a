"""Embedding whitening with eigenpairs by contour integration.

One pass sums the vectors, one their centred products; both leave a task as one block of the dimension's size. The spectrum of the
covariance is then cut into intervals by inertia counts (how many eigenvalues lie above a shift), every interval is a task that
projects a random block onto its eigenvectors by quadrature of complex shifted solves along a circle, and extracts them by
Rayleigh-Ritz; the inertia counts say how many there must be. Two more passes whiten the rows and measure the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import keep

#: Eigenvalues of an interval, as far as clusters allow; quadrature points of a half circle; rounds of projection.
SLICE, POINTS, ROUNDS = 8, 8, 30
#: Eigenvalues below this share of the largest are rounding, not variance.
LEAST = 1e-10


def integers(vectors: DataFrame, item: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(id, x): x is floor(scale * entry) + shift of every entry, as integers.

    Rows whose vector is null, empty or holds a null or non-finite entry, or one whose integer does not fit, are left out, and so are vectors of another
    length than the most frequent one (of equally frequent ones the longest).
    """
    v = F.col(vector).cast("array<double>")
    fits = lambda c: F.coalesce(F.abs(c) * scale < 2.0**62, F.lit(False))  # noqa: E731 (NaN counts as larger than any number)
    rows = vectors.select(F.col(item).alias("id"), v.alias("v")).filter(F.expr("size(v) > 0") & F.forall("v", fits))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift)
    return rows.filter(F.size("v") == (top["d"] if top else 0)).select("id", x.alias("x"))


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of their dimensions; a task hands on one number a dimension."""

    def run(batches):
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                m = _matrix(b["x"])
                low = m & 0xFFFFFFFF  # halves, so that no sum runs over
                part = [int(h) * 2**32 + int(l) for h, l in zip((m >> 32).sum(0), low.sum(0))]
                total = part if total is None else [a + c for a, c in zip(total, part)]
                n += b.num_rows
        if n:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(str, total)))], names=["i", "n", "s"])

    got = x.select("x").mapInArrow(run, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got]


def _products(rows: DataFrame, column: str, centre) -> np.ndarray:
    """Sum over rows of y y', y what ``centre`` makes of a batch's matrix; a task hands on one matrix, row by row."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                y = centre(_matrix(b[column]))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select(column).mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((r["i"] for r in got), default=-1)
    out = np.zeros((d, d))
    for r in got:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def covariance(x: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance with divisor n). Integers are centred exactly up to a fraction below one, so that their products lose nothing."""
    n, s = _sums(x)
    if not n:
        return 0, [], np.zeros((0, 0))
    whole, part = np.array([v // n for v in s]), np.array([(v % n) / n for v in s])
    return n, s, _products(x, "x", lambda m: (m - whole) - part) / n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of the symmetric ``a``, by reflections."""
    a = a.copy()
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size > 0:
            b = a[k + 1 :, k + 1 :]
            p = b @ v * (2 / size)
            w = p - v * (p @ v / size)
            b -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] -= v * (2 / size * (v @ a[k + 1 :, k]))
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Inertia: eigenvalues greater than ``shift``, the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny
    count, q = 0, 1.0
    for i, t in enumerate(diagonal):
        q = t - shift - (off[i - 1] ** 2 / q if i else 0.0)
        q = q if abs(q) > tiny else -tiny
        count += bool(q > 0)
    return count


def intervals(diagonal: np.ndarray, off: np.ndarray, most: int, size: int) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues in between) from the largest on, until ``most`` are covered or the rest is rounding.

    Bounds lie in gaps of at least 1e-7 of the largest eigenvalue, so a cluster closer than that stays in one interval,
    whatever its size. Intervals are cut at their widest gap until they hold ``size`` eigenvalues at most and are not much
    wider than the gaps beside them, which is what the projection's convergence depends on.
    """
    radius = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    top = float((diagonal + radius).max(initial=0.0))
    if top <= 0:
        return []
    gap = 1e-7 * top

    def place(j: int, high: float) -> float:
        low = 0.0
        while high - low > gap / 64:
            mid = (low + high) / 2
            low, high = (mid, high) if above(diagonal, off, mid) >= j else (low, mid)
        return low

    e: list[float] = []
    while True:
        at = place(len(e) + 1, e[-1] + gap if e else top + gap) if len(e) < len(diagonal) else 0.0
        if e and (at < LEAST * e[0] or (len(e) >= most and e[-1] - at > gap)):
            break
        e.append(at)
    gap = 1e-7 * e[0]
    bounds = [1.1 * e[0] + gap, *e, at]
    floor = LEAST * e[0]
    out, open_ = [], [(1, len(e) + 1)]
    while open_:
        i, j = open_.pop()
        before, after = bounds[i - 1] - bounds[i], bounds[j - 1] - bounds[j]
        inner = max(((bounds[k - 1] - bounds[k], k) for k in range(i + 1, j)), default=(0.0, 0))
        wide = j - i > size or bounds[i] - bounds[j - 1] > 8 * min(before, after)
        if wide and inner[0] > gap:
            open_ += [(inner[1], j), (i, inner[1])]
        else:
            margin = max(min(before, after) / 2, gap / 4)  # the same on both sides, so that the circle is not far wider than a gap
            left, right = max(bounds[j - 1] - margin, floor / 2), bounds[i] + margin
            out.append((left, right, above(diagonal, off, left) - above(diagonal, off, right)))
    if sum(n for _, _, n in out) != above(diagonal, off, min(x for x, _, _ in out)):
        raise ArithmeticError("the intervals miss an eigenvalue")
    return out


def project(a: np.ndarray, left: float, right: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``a`` between two bounds: contour quadrature, then Rayleigh-Ritz, until they are exact."""
    d = len(a)
    size = min(d, count + max(4, count // 2))
    y = np.random.Generator(np.random.Philox(seed)).standard_normal((d, size))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (left + right) / 2, (right - left) / 2
    around = np.exp(1j * np.pi / 2 * (nodes + 1))
    scale = np.abs(a).sum(axis=1).max()
    best = None
    for _ in range(ROUNDS):
        q = np.zeros((d, size))
        for turn, w in zip(around, weights):  # the lower half circle is the conjugate
            z = centre + radius * turn
            q += np.real(w / 2 * radius * turn * np.linalg.solve(z * np.eye(d) - a, y))
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, s > s[0] * 1e-14]
        e, r = np.linalg.eigh(u.T @ a @ u)
        x = u @ r
        inside = (e > left) & (e < right)
        if inside.sum() == count:
            error = np.abs(a @ x[:, inside] - x[:, inside] * e[inside]).max(initial=0.0)
            if best is None or error < best[0]:
                best = error, e[inside], x[:, inside]
            elif best[0] <= 1e-12 * scale:  # no further gain
                break
        y = x if x.shape[1] == size else np.hstack([x, y[:, : size - x.shape[1]]])
    if best is None or best[0] > 1e-9 * scale:
        raise ArithmeticError(f"{count} eigenvalues between {left} and {right}: not found by projection")
    return best[1][::-1], best[2][:, ::-1]


def components(spark, a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the ``most`` largest ones of a covariance, each interval of the spectrum a task.

    ``a`` goes to the tasks with their code: its size is the square of the vectors' dimension, whatever the number of rows.
    """
    slices = intervals(*tridiagonal(a), most, SLICE) if len(a) else []
    if not slices:
        return np.zeros(0), np.zeros((len(a), 0))

    def solve(batches):
        for b in batches:
            for i, left, right, n in zip(*(b[c].to_pylist() for c in ("i", "left", "right", "n"))):
                e, x = project(a, left, right, n, i)
                yield pa.record_batch([pa.array([i] * n, pa.int32()), pa.array(e), pa.array(x.T.tolist(), pa.list_(pa.float64()))], names=["i", "e", "x"])

    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(slices)], "i int, left double, right double, n int").repartition(len(slices), "i")
    got = sorted(rows.mapInArrow(solve, "i int, e double, x array<double>").collect(), key=lambda r: (r["i"], -r["e"]))
    if len(got) != sum(s[2] for s in slices):
        raise ArithmeticError("eigenvalues are missing")
    got = got[:most]
    return np.array([r["e"] for r in got]), np.array([r["x"] for r in got]).T


def whiten(vectors: DataFrame, item: str, vector: str, most: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of every vector of ``vectors`` on its ``most`` strongest components.

    ``integers`` says which rows take part and what x is. Components are unit eigenvectors of the covariance V of all x (divisor n),
    numbered from 1 by falling eigenvalue e. Returns (id, n, deviation, components): deviation is the exact sum over dimensions of (n x - S)^2, null
    where that exceeds a long; components lists (component, whitened, explained, identity_error) with whitened = (x - S/n) on the
    component over sqrt(e), explained = e / trace(V), and identity_error the largest absolute entry of the whitened rows' covariance
    minus the identity. Fewer components where V has a lower rank (all vectors equal, or one vector: none, the list is empty). Null ids and
    repeated rows are rows like others, other columns are not looked at, an empty table gives no rows.

    The driver holds matrices of the square of the dimension (8 bytes an entry), as every task does.
    """
    spark = vectors.sparkSession
    x = keep(integers(vectors, item, vector, scale, shift), "white_vectors")
    n, s, v = covariance(x)
    e, q = components(spark, v, most)
    whole, part = np.array([t // n for t in s] if n else [], np.int64), np.array([(t % n) / n for t in s] if n else [])
    rest = np.array([t % n for t in s] if n else [], np.int64)
    to = q / np.sqrt(e)
    told = e / np.trace(v) if len(e) else e
    k = len(e)
    kind = pa.list_(pa.float64())
    schema = "id " + x.schema["id"].dataType.simpleString() + ", n long, deviation long, w array<double>"

    def run(batches):
        for b in batches:
            m = _matrix(b["x"]) if b.num_rows else np.zeros((0, len(s)), np.int64)
            y = (m - whole) - part
            off = m - whole
            exact = (np.abs(off).max(initial=0) + 1) ** 2 * float(n) ** 2 * max(1, len(s)) < 2.0**62
            if exact:
                dev = ((n * off - rest) ** 2).sum(axis=1).tolist()
            else:
                dev = [sum((n * int(c) - int(r)) ** 2 for c, r in zip(row, rest)) for row in off]
                dev = [t if t < 2**63 else None for t in dev]
            w = y @ to
            yield pa.record_batch([b["id"], pa.array([n] * len(dev), pa.int64()), pa.array(dev, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(dev) + 1) * k, pa.int32()), pa.array(w.ravel())).cast(kind)], names=["id", "n", "deviation", "w"])

    out = keep(x.mapInArrow(run, schema), "white_rows")
    error = 0.0
    if k:
        mean = _means(out, k)
        error = float(np.abs(_products(out, "w", lambda m: m - mean) / n - np.eye(k)).max())
    entries = F.transform("w", lambda c, i: F.struct((i + 1).cast("int").alias("component"), c.alias("whitened"), F.element_at(F.array(*map(F.lit, told.tolist())) if k else F.array().cast("array<double>"), (i + 1).cast("int")).alias("explained"), F.lit(error).alias("identity_error")))
    return out.select("id", "n", "deviation", entries.alias("components"))


def _means(rows: DataFrame, k: int) -> np.ndarray:
    got = rows.select(F.posexplode("w").alias("j", "c")).groupBy("j").agg(F.avg("c").alias("c")).collect()
    out = np.zeros(k)
    for r in got:
        out[r["j"]] = r["c"]
    return out
