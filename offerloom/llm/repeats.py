"""Where strings of a fixed number of units (words or bytes) occur more than once in a corpus.

A window is ``size`` consecutive units of one document. Every window picks an anchor, the unit string of length ``seed`` with
the smallest hash inside it (the leftmost of equals). The choice depends on the window's content alone, so equal windows pick
equal anchors at equal offsets. Neighbouring windows mostly share their anchor: a run is the stretch of windows that do, and
runs, about two for every ``size - seed`` units, are what Spark shuffles instead of windows.

1. Rank runs by their anchor. An anchor that occurs once settles its whole run: none of its windows is repeated.
2. Rank the other runs by (anchor, all units that the run touches). Members of a class agree in every window.
3. Where an anchor has several classes, one run of each is resolved window by window: ranks of strings of 1, 2, 4 … units are paired at
   growing offsets until they span ``size`` units. Runs that share an anchor meet in one task; the few anchors with a large
   share of all these runs have their windows ranked by a shuffle of their own instead.

Each step names the windows that stay (those not repeated, or only the first of each class), never the members of a class, so
a group of any size is a count and a minimum. Ranks are 64-bit hashes, two independent ones together from step 2 on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import documents_by_key, join_hot, keep, keep_bucketed, mix64, word_hashes

U = np.uint64
_random = np.random.Generator(np.random.Philox(20240607))
_BYTE = _random.integers(0, 2**64, 256, dtype=U)
_BASE = U(int(_random.integers(2**62, 2**63)) | 5)


@dataclass(frozen=True)
class Unit:
    """What a document consists of, and how much of it a task holds."""

    name: str
    size: int
    seed: int
    #: Of equal windows the earliest is not a repeat.
    first_stays: bool
    #: Units hashed at a time; longer documents go in overlapping slices.
    slice: int = 1 << 20
    #: Unresolved runs that a task holds at once, but for those of one anchor.
    together: int = 4_000
    #: Anchors with more unresolved runs than this, and than 1/10,000 of all (so there are 10,000 at most), take the shuffled way.
    heavy: int = 2_000

    def of(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.name == "word" else text

    def ranks(self, units) -> np.ndarray:
        return word_hashes(units) if self.name == "word" else _BYTE[np.frombuffer(units, np.uint8)]


def _powers(base: U, n: int) -> np.ndarray:
    p = np.full(n + 1, base)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = _powers(_BASE, 1), _powers(U(pow(int(_BASE), -1, 2**64)), 1)


def _tables(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) <= n:
        _UP, _DOWN = _powers(_BASE, n), _powers(U(pow(int(_BASE), -1, 2**64)), n)


def runs_of(x: np.ndarray, ends: np.ndarray, size: int, seed: int):
    """(anchor rank, content rank, first window, number of windows, anchor position) of each run in ``x``.

    ``x`` holds unit hashes of several documents that end at ``ends``.
    """
    n, w = len(x), size - seed + 1
    if n < size:
        z = np.zeros(0, np.int64)
        return z.astype(U), z.astype(U), z, z, z
    _tables(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(x * _DOWN[:n], out=sums[1:])
    grams = mix64((sums[seed:] - sums[: n - seed + 1]) * _UP[: n - seed + 1])
    low = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    mark = np.zeros(n + 1, np.int64)
    counts = np.maximum(ends - starts - size + 1, 0)
    full = counts > 0
    np.add.at(mark, starts[full], 1)
    np.add.at(mark, starts[full] + counts[full], -1)
    ok = np.cumsum(mark)[: len(at)] > 0
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    new[starts[full]] = True
    first = np.flatnonzero(new & ok)
    stop = np.append(np.flatnonzero(new | ~ok), len(at))
    count = stop[np.searchsorted(stop, first, "right")] - first
    p = at[first]
    content = (sums[first + count + size - 1] - sums[first]) * _UP[first]
    content = mix64(content ^ mix64((p - first).astype(U) * U(512) + count.astype(U)))
    return grams[p], content, first, count, p


def _slices(units, size: int, step: int):
    """(offset, part) of a document such that every window lies in exactly one part."""
    if len(units) < size:
        return
    if len(units) <= step:
        yield 0, units
    else:
        for i in range(0, len(units) - size + 1, step):
            yield i, units[i : i + step + size - 1]


def _packed(lo, n):
    """Place of a run in its row in one long: the first window and, in 8 bits, the number of windows."""
    return (np.asarray(lo, np.int64) << 8) | (np.asarray(n, np.int64) - 1)


def _unpacked(pos: np.ndarray):
    return pos >> 8, (pos & 255) + 1


def _scan(unit: Unit, with_known: bool):
    """Runs of the documents of (k, dup, z[, known places]); runs at known places are left out."""

    def emit(parts):
        ends = np.cumsum([len(p[0]) for p in parts])
        h, u, first, count, _ = runs_of(np.concatenate([p[0] for p in parts]), ends, unit.size, unit.seed)
        d = np.searchsorted(ends, first, "right")
        off, dup, k = (np.array([p[i] for p in parts], np.int64) for i in (1, 2, 3))
        pos = _packed(first - np.concatenate(([0], ends[:-1]))[d] + off[d], count)
        if with_known:
            where = np.repeat(np.arange(len(parts)), [len(p[4]) for p in parts])
            code = np.unique(np.concatenate([pos, *[p[4] for p in parts]]), return_inverse=True)[1] * len(parts)
            new = ~np.isin(code[: len(pos)] + d, code[len(pos) :] + where)
            h, u, d, pos = h[new], u[new], d[new], pos[new]
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(u.view(np.int64)), pa.array(k[d]), pa.array(dup[d]), pa.array(pos)], names=["h", "u", "k", "dup", "pos"])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        parts, n = [], 0
        for b in batches:
            known = b["known"] if with_known else None
            for i, (k, dup, z) in enumerate(zip(b["k"].to_pylist(), b["dup"].to_pylist(), b["z"].to_pylist())):
                places = known[i].values.to_numpy() if known is not None and known[i].is_valid else np.zeros(0, np.int64)
                for off, part in _slices(unit.of(unzip.decompress(z)), unit.size, unit.slice):
                    parts.append((unit.ranks(part), off, dup, k, places))
                    n += len(part)
                    if n >= unit.slice:
                        yield emit(parts)
                        parts, n = [], 0
        if parts:
            yield emit(parts)

    return run


def _contexts(unit: Unit):
    """What the open runs of the documents of (k, dup, z, open) touch: (h, k, dup, pos, n, part); n runs are the same."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k, dup, z, listed in zip(*(b[c].to_pylist() for c in ("k", "dup", "z", "open"))):
                units = unit.of(unzip.decompress(z))
                for x in listed:
                    lo, n = _unpacked(np.int64(x["pos"]))
                    part = units[lo : lo + n + unit.size - 1]
                    out.append((x["h"], k, dup, x["pos"], x["n"], b" ".join(part) if unit.name == "word" else part))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], names=["h", "k", "dup", "pos", "n", "part"])

    return run


def _grown(r: np.ndarray, size: int) -> np.ndarray:
    """Ranks of all strings of ``size`` units from the ranks of single units: pairs of ranks at doubling offsets."""
    span = 1
    while span * 2 <= size:
        r = mix64(r[:-span] * _BASE + mix64(r[span:]))
        span *= 2
    return r if span == size else mix64(r[: len(r) - (size - span)] * _BASE + mix64(r[size - span :]))


def _windows(unit: Unit, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, row, first unit) of every window of the runs in a batch of contexts."""
    x = [unit.ranks(unit.of(p)) for p in b["part"].to_pylist()]
    lo, n = _unpacked(b["pos"].to_numpy())
    begin = np.concatenate(([0], np.cumsum([len(p) for p in x])[:-1]))
    row = np.repeat(np.arange(len(x)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return _grown(np.concatenate(x), unit.size)[begin[row] + i], row, lo[row] + i


def _resolve(unit: Unit):
    """From contexts in the order of their anchors: (k, dup, pos) of the stretches of windows that stay."""

    def solve(t):
        rank, row, at = _windows(unit, t)
        k, dup = t["k"].to_numpy()[row], t["dup"].to_numpy()[row]
        order = np.lexsort((at, dup, k, rank))
        new = np.ones(len(order), bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        if not unit.first_stays:
            new &= np.append(new[1:], True) & (t["n"].to_numpy()[row][order] == 1)
        stays = np.zeros(len(order), bool)
        stays[order[new]] = True
        head = stays.copy()
        head[1:] &= ~(stays[:-1] & (row[1:] == row[:-1]))
        i = np.flatnonzero(head)
        n = np.add.reduceat(stays, i).astype(np.int64) if len(i) else i
        return pa.record_batch([pa.array(k[i]), pa.array(dup[i]), pa.array(_packed(at[i], n))], names=["k", "dup", "pos"])

    def run(batches):
        held = None
        for b in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            if held.num_rows >= unit.together:
                h = held["h"].to_numpy()
                cut = int(np.flatnonzero(h == h[-1])[0])
                if cut:
                    yield solve(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return run


def _ranked(unit: Unit):
    """Every window of the contexts by two ranks: (h, rank, k, dup, pos, n)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                rank, row, at = _windows(unit, b)
                h, k, dup, n = (pa.array(b[c].to_numpy()[row]) for c in ("h", "k", "dup", "n"))
                yield pa.record_batch([h, pa.array(rank.view(np.int64)), k, dup, pa.array(_packed(at, 1)), n], names=["h", "rank", "k", "dup", "pos", "n"])

    return run


def staying_windows(docs: DataFrame, unit: Unit) -> DataFrame:
    """(k, dup, doc_id, z, stays) for every document; ``stays`` lists the places of runs whose windows are no repeats."""
    d = documents_by_key(docs, f"{unit.name}_documents")
    row = ["k", "dup"]
    run = "h long, u long, k long, dup long, pos long"
    seeds = d.select(*row, "z").mapInArrow(_scan(unit, False), run).groupBy("h").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in (*row, "pos")])
    once = keep_bucketed(seeds.filter("n = 1").groupBy(*row).agg(F.collect_list("pos").alias("known")), row, f"{unit.name}_once")

    shared = d.join(once, row, "left").select(*row, "z", "known").mapInArrow(_scan(unit, True), run)
    classes = shared.groupBy("h", "u").agg(F.count("*").alias("n"), F.min(F.struct(*row, "pos")).alias("f")).select("h", "n", "f.k", "f.dup", "f.pos")
    classes = keep(classes, f"{unit.name}_classes")
    told = join_hot(classes, classes.groupBy("h").agg(F.count("*").alias("m")), ["h"], "m")
    listed = told.filter("m > 1").groupBy(*row).agg(F.collect_list(F.struct("pos", "h", "n")).alias("open"))
    found = d.join(listed, row).select(*row, "z", "open").mapInArrow(_contexts(unit), "h long, k long, dup long, pos long, n long, part binary")
    parts = keep(found, f"{unit.name}_open")

    total = parts.count()
    heavy = parts.groupBy("h").count().filter(F.col("count") > max(unit.heavy, total // 10_000)).select("h")
    light = parts.join(F.broadcast(heavy), "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(_resolve(unit), "k long, dup long, pos long")
    big = parts.join(F.broadcast(heavy), "h", "left_semi").select("h", *row, "pos", "n", "part").mapInArrow(_ranked(unit), "h long, rank long, k long, dup long, pos long, n long")
    big = big.groupBy("h", "rank").agg(F.sum("n").alias("n"), F.min(F.struct(*row, "pos")).alias("f"))
    stays = light.unionByName((big if unit.first_stays else big.filter("n = 1")).select("f.k", "f.dup", "f.pos"))
    if unit.first_stays:  # of an anchor with one class all windows of the first member stay
        stays = stays.unionByName(told.filter("m = 1").select(*row, "pos"))
    stays = stays.groupBy(*row).agg(F.collect_list("pos").alias("more"))
    empty = F.array().cast("array<bigint>")
    return d.join(once, row, "left").join(stays, row, "left").select(*row, "doc_id", "z", F.concat(F.coalesce("known", empty), F.coalesce("more", empty)).alias("stays"))


def covered(n_units: int, stays: np.ndarray, size: int) -> np.ndarray:
    """Which units of a document lie in a window that does not stay."""
    n = n_units - size + 1
    if n <= 0:
        return np.zeros(n_units, bool)
    lo, count = _unpacked(stays)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + count, -1)
    gone = np.cumsum(edge)[:n] == 0
    edge = np.zeros(n_units + 1, np.int64)
    at = np.flatnonzero(gone)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge)[:n_units] > 0
