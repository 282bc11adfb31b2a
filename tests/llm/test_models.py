"""Manifest, whitening and language model against plain Python, on odd rows, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerloom.llm import maxent, merkle, whitening


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows, arity):
    """{row number: (leaf, subroot, root, proof)} of (key, tree, text) rows by building every tree whole."""

    def leaf(*values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def build(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            begin = i - i % arity
            out.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + arity])))
            i //= arity
        return out

    leaves = [leaf(*r) for r in rows]
    trees = defaultdict(list)
    for n, r in enumerate(rows):
        trees[r[1]].append(n)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in names:
        trees[t].sort(key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, leaves[n]))
        built[t] = build([leaves[n] for n in trees[t]])
    top = build([built[t][-1][0] for t in names])
    out = {}
    for j, t in enumerate(names):
        for i, n in enumerate(trees[t]):
            path = siblings(built[t], i) + siblings(top, j)
            out[n] = (leaves[n], built[t][-1][0], top[-1][0], path)
    return out


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest(spark, levels):
    shape = merkle.Shape(3, levels)
    r = random.Random(7)
    rows = [(i, r.choice(["a", "a", "a", "a", "B", "é", "", None, *map(str, range(12))]), r.choice(["", None, "x", "É y", "z" * 50_000]) if i % 3 else f"t{i}") for i in range(150)]
    rows += [(None, "a", "p"), (None, "a", "q"), (5, "a", "s"), (5, "a", "s"), (5, "a", "r"), (2**62, None, "t")]
    df = spark.createDataFrame(rows, "key long, lang string, text string").select("*", *[F.lit(1).alias(c) for c in ("tree", "pos", "n", "digest", "left", "root", "given", "block")])
    changed = F.when(F.col("key") % 4 == 0, merkle.leaf_digest(F.col("key"), F.col("lang"), F.concat("text", F.lit("!"))))
    out = merkle.manifest(df, ["key", "lang", "text"], "lang", "key", changed, True, shape)
    got = sorted(((g.key, g.tree, g.leaf, g.subroot, g.root, tuple(g.proof), g.proof_sha256, g.verified) for g in out.collect()), key=repr)
    want = []
    for n, (leaf, sub, root, path) in plain_manifest(rows, 3).items():
        proof = tuple(a + b for a, b in path)
        key, _, text = rows[n]
        want.append((key, rows[n][1], leaf, sub, root, proof, h("".join(proof)), not (key is not None and key % 4 == 0 and text is not None)))
    assert got == sorted(want, key=repr)
    assert all((g.folded_root == g.root) == g.verified for g in out.collect())
    assert merkle.manifest(df.limit(0), ["key", "text"], "lang", "key").count() == 0


def test_manifest_of_one_row_and_of_one_value(spark):
    one = merkle.manifest(spark.createDataFrame([(1, None, None)], "key long, lang string, text string"), ["key", "text"], "lang", "key").first()
    assert one.leaf == one.subroot == one.root == h("1:1-") and one.proof_sha256 == h("") and one.verified
    same = merkle.manifest(spark.createDataFrame([(None, "a", "t")] * 5000, "key long, lang string, text string"), ["key", "text"], "lang", "key")
    assert same.filter("verified").count() == 5000 and same.select("root").distinct().count() == 1


def whitened(df, **more):
    out = whitening.whiten(df, "vec_id", "embedding", **more)
    return [(r.id, r.n, r.deviation, r.components) for r in out.collect()]


def test_whitening(spark):
    r = np.random.Generator(np.random.Philox(3))
    m = r.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)
    x = [(i, [float(v) for v in row]) for i, row in enumerate(m)]
    x += [(300 + i, x[7][1]) for i in range(150)]  # a third are one vector
    bad = [(900, None), (901, [None] * 20), (902, [float("nan")] + [0.0] * 19), (903, [float("inf")] * 20), (904, [1.0, 2.0]), (905, []), (906, [1e300] * 20)]
    df = spark.createDataFrame([*x, (None, x[0][1]), *bad], "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "x", "v", "n", "w", "components")])
    ints = np.floor(64 * np.array([v for _, v in x] + [x[0][1]])).astype(np.int64) + 1_000_000
    n, s = len(ints), ints.sum(axis=0)
    y = ints - s / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    got = whitened(df, most=6)
    assert len(got) == n and {g[1] for g in got} == {n}
    w = np.array([[c.whitened for c in g[3]] for g in sorted(got, key=lambda g: (g[0] is None, g[0]))])
    want = y @ (q[:, :6] / np.sqrt(e[:6]))
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8
    dev = {i: int(v) for i, v in zip([*range(450), None], ((n * ints - s) ** 2).sum(axis=1))}
    assert all(dev[g[0]] == g[2] for g in got)
    assert [c.component for c in got[0][3]] == [1, 2, 3, 4, 5, 6]
    assert np.allclose([c.explained for c in got[0][3]], e[:6] / np.trace(cov)) and got[0][3][0].identity_error < 1e-9
    assert whitened(df.limit(0)) == [] and whitened(spark.createDataFrame(bad[:4], df.schema[:2])) == []
    same = whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], df.schema[:2]))
    assert same == [(1, 2, 0, []), (2, 2, 0, [])]
    line = whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], df.schema[:2]))
    assert {len(g[3]) for g in line} == {1}


@pytest.mark.parametrize("spectrum", [np.ones(12) * 3, np.repeat([9.0, 4.0, 1.0], 5), np.concatenate([[400.0], np.linspace(60, 65, 40)]), np.concatenate([np.linspace(1, 2, 6), np.zeros(9)]), np.array([2.5]), np.geomspace(1e-6, 1e3, 30)])
def test_projection_finds_every_eigenpair(spectrum):
    r = np.random.Generator(np.random.Philox(5))
    q = np.linalg.qr(r.normal(size=(len(spectrum), len(spectrum))))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    want = np.sort(spectrum[spectrum > 0])[::-1]
    found = [whitening.project(a, x, y, n, 1) for x, y, n in whitening.intervals(*whitening.tridiagonal(a), len(want), 4)]
    e, x = np.concatenate([f[0] for f in found]), np.hstack([f[1] for f in found])
    assert np.abs(e - want).max() < 1e-12 * want[0]
    assert np.abs(a @ x - x * e).max() < 1e-11 * want[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-6
    d, o = whitening.tridiagonal(a)
    for shift in (want[0] * 2, want[0] * 0.5123, want[-1] / 2):
        assert whitening.above(d, o, shift) == (want > shift).sum()


ODD = [(None, None), (None, ""), (-1, " \t\n"), (-2, "Ab aB " + "x" * 100), (-2, "Ab aB " + "x" * 100), (-3, "é É 日本"), (-4, "w1 " * 20_000)]


def sentences(n: int):
    """Texts in which a word tells the next one, mostly."""
    r = random.Random(11)
    follow = {i: [r.randrange(200) for _ in range(3)] for i in range(200)}
    for i in range(n):
        x, out = r.randrange(200), []
        for _ in range(r.randint(5, 120)):
            out.append(f"w{x}" if r.random() < 0.97 else f"rare{r.randrange(5000)}")
            x = r.choice(follow[x])
        yield i, " ".join(out).title()


def test_language_model(spark):
    rows = [*sentences(1500), *ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("row", "ids", "word", "n", "c", "part", "doc", "rare")])
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    column = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    cut = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in cut if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    want = sorted((repr(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 6)) for i, ws in cut)
    for limits in ({}, {"vocabulary": 100, "shared": 8, "places": 1 << 15, "rounds": 3, "rate": 0.3}):
        got = maxent.score(df, column, ["doc_id", "n"], **limits).collect()
        assert sorted((repr(g.doc.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
        assert all(g.doc.n == 1 and g.score < 0 for g in got)
        unseen = [g for g in got if g.held_out]
        assert sum(g.score for g in unseen) > 0.9 * sum(g.base_score for g in unseen)  # both negative: closer to nought is better
    assert maxent.score(df.limit(0), column, ["doc_id"]).count() == 0
    alone = maxent.score(df.limit(5), F.lit(True), ["doc_id"]).collect()
    assert {(g.n_known, g.train_tokens, g.base_score) for g in alone} == {(0, 0, 0.0)} and all(g.score < 0 for g in alone)


def test_probabilities_of_all_words_sum_to_one():
    r = np.random.Generator(np.random.Philox(6))
    mass = r.integers(1, 1000, 700).astype(float) ** 2
    classes = maxent.Classes.of(mass)
    weights = r.normal(size=256).astype(np.float32)
    before = np.array([3, 600, 41])
    for w in (np.zeros_like(weights), weights):
        leaf = np.concatenate([np.append(before, i) for i in range(700)])
        first = np.tile(np.arange(4), 700)
        p = 10 ** maxent.log_probability(classes, w, leaf, maxent.features(leaf, first))[3::4]
        assert p.sum() == pytest.approx(1, abs=1e-4)
        if not w.any():
            assert np.allclose(p, mass / mass.sum(), rtol=1e-4)


def test_words_of_a_batch_are_looked_up_together():
    texts = [None, "", " ", "a", "A  b\t\n c\x0b\x0cd\re ", "É é Ünd\n", "\x1c x\x85y z\xa0w", " lead a", "a a a"] * 3
    batches = [pa.record_batch([pa.array(texts[i : i + 4]), pa.array(range(len(texts[i : i + 4])))], names=["text", "i"]) for i in range(0, len(texts), 4)]
    (joined,) = maxent._gathered(batches)
    word, at, n = maxent._words(joined["text"])
    assert len(set(word.to_pylist())) == len(word)
    assert [word.take(pa.array(x)).to_pylist() for x in np.split(at, np.cumsum(n)[:-1])] == [[*maxent.words_of(t), maxent.END] for t in texts]
    assert list(maxent._gathered([])) == []


def test_gradient_steps_agree_with_plain_ones():
    r = np.random.Generator(np.random.Philox(8))
    classes = maxent.Classes.of(r.integers(1, 50, 40).astype(float))
    leaf, first = r.integers(0, 40, 60), np.arange(60)
    told = maxent.features(leaf, first)
    w, size, seen = np.zeros(64, np.float32), np.ones(64, np.float32), np.zeros(64, np.int64)
    want, sizes, touched = np.zeros(64), np.ones(64), np.zeros(64, int)
    for begin in (0, 20, 40):
        step = np.zeros(64)
        for i in range(begin, begin + 20):
            x = leaf[i]
            for s in classes.path[classes.start[x] : classes.start[x] + classes.depth[x]]:
                alone = maxent.Classes(np.array([0]), np.array([1]), np.array([s]), classes.bias, np.zeros(1))
                at = [int(p[0]) for p in maxent._steps(alone, np.array([0]), told[:, i : i + 1], w)[2]]
                p = 1 / (1 + np.exp(-(classes.bias[s >> 1] + want[at].sum())))
                for a in at:
                    step[a] += p - (s & 1)
        sizes += step**2
        want -= 0.3 * step / np.sqrt(sizes)
        touched += step != 0
    maxent.descend(classes, w, size, seen, leaf, told, 0.3, batch=20)
    assert classes.depth.max() <= maxent._CONTEXT
    assert np.allclose(w, want, atol=1e-4) and np.allclose(size, sizes, rtol=1e-3) and (np.abs(seen - touched) <= 1).all()
