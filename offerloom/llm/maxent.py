"""Language-model scoring by a hashed maximum-entropy model.

The vocabulary is counted over all training documents. Its most frequent words, up to a bound, are leaves of their own; the others
share leaves by ending and length, within which a word has the share of its count. Leaves are factored into classes, each of which
falls into two of about equal mass: the probability of a word is the product of a softmax over the two halves of every class on the
way to its leaf. A softmax adds up the class's own log odds and the weights of hashed n-gram and skip features of the words before.

Training goes in rounds over disjoint parts of the training documents: every task makes gradient steps on its documents from the
weights of the round before and hands on the changes of the weights it touched, which are averaged weight by weight. Scoring runs in
numpy batches over whole documents; words that are no leaf get their counts by a join.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructType

from offerloom.llm.common import join_hot, keep, text_batches

U = np.uint64
#: What stands for the end of a text; no word has white space.
END = b"\n"
#: Longest word, in bytes, that is a leaf of its own.
LONGEST = 64
#: Weights that tasks hand on together.
_BLOCK = 1 << 15
#: Steps a factor of two of counts is divided into when the most frequent words are chosen.
_STEPS = 8
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)
_MIX, _NODE, _LAST = U(0xFF51AFD7ED558CCD), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
#: Classes on the way to a leaf that look at the context: below them, a class holds a few thousandths of all tokens at most.
_CONTEXT = 8
#: Bytes of text whose words are looked up together.
_TEXT_BYTES = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (A to Z only) of a text, without its end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``words_of`` a batch of texts, each with its end: (the distinct tokens, the place there of every token, the number of tokens of each text)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    n, words = np.diff(parts.offsets.to_numpy()), parts.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at the ends leaves empty parts
    if not full.all():
        words, n = words.filter(pa.array(full)), np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
    told = words.cast(pa.binary()).dictionary_encode()
    at = np.insert(told.indices.to_numpy(), np.cumsum(n), len(told.dictionary))
    return pa.concat_arrays([told.dictionary, pa.array([END], pa.binary())]), at, n + 1


def _gathered(batches):
    """Batches of (text, ...) joined until they have ``_TEXT_BYTES`` of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b["text"].nbytes
        if size >= _TEXT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def shared_leaf(word: bytes, leaves: int) -> int:
    """The shared leaf of a word that has none of its own: by its last two bytes and its length."""
    return zlib.crc32(b"%d %s" % (min(len(word), 30), word[-2:])) % leaves


def _shared_leaf(word: str, leaves: int) -> Column:
    w = F.col(word)
    told = F.concat(F.least(F.octet_length(w), F.lit(30)).cast("string").cast("binary"), F.lit(b" "), F.expr(f"substring({word}, -2, 2)"))
    return F.crc32(F.when(F.octet_length(w) < 2, F.concat(F.octet_length(w).cast("string").cast("binary"), F.lit(b" "), w)).otherwise(told)) % leaves


@dataclass
class Classes:
    """The factored leaves. Every class falls into two of about equal mass: ``path`` has, for each leaf from ``start`` on, the classes on its way and
    which half it takes (twice the class, plus one for the second half), ``bias`` the log odds of the second half in each class, and ``rest`` for each
    leaf the log10 of its share below the classes that look at the context."""

    start: np.ndarray
    depth: np.ndarray
    path: np.ndarray
    bias: np.ndarray
    rest: np.ndarray

    @cached_property
    def ways(self) -> np.ndarray:
        """The first ``_CONTEXT`` steps of every leaf's path, -1 after its end."""
        level = np.arange(_CONTEXT)
        at = np.minimum(self.start[:, None] + level, max(0, len(self.path) - 1))
        return np.where(level < self.depth[:, None], self.path[at] if len(self.path) else -1, -1).astype(np.int32)

    @classmethod
    def of(cls, mass: np.ndarray) -> Classes:
        order = np.argsort(-mass, kind="stable")
        total = np.concatenate(([0.0], np.cumsum(mass[order])))
        a, b = np.array([0]), np.array([len(mass)])
        levels, bias, nodes = [], [], 0
        while True:
            open_ = b - a > 1
            a, b = a[open_], b[open_]
            if not len(a):
                break
            cut = np.clip(np.searchsorted(total, (total[a] + total[b]) / 2), a + 1, b - 1)
            bias.append(np.log((total[b] - total[cut]) / (total[cut] - total[a])))
            node = 2 * (nodes + np.arange(len(a)))
            nodes += len(a)
            a, b = np.stack([a, cut], axis=1).ravel(), np.stack([cut, b], axis=1).ravel()
            n = b - a
            leaf = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            levels.append((leaf, np.repeat(np.stack([node, node + 1], axis=1).ravel(), n)))
        depth = np.zeros(len(mass), np.int64)
        for leaf, _ in levels:
            depth[leaf] += 1
        start = np.cumsum(depth) - depth
        path = np.zeros(depth.sum(), np.int32)
        for level, (leaf, step) in enumerate(levels):
            path[start[leaf] + level] = step
        bias = np.concatenate(bias or [np.zeros(0)])
        level = np.arange(len(path)) - np.repeat(start, depth)
        odds = np.where(path & 1, -bias[path >> 1], bias[path >> 1])
        rest = np.bincount(np.repeat(np.arange(len(mass)), depth), np.where(level < _CONTEXT, 0.0, np.logaddexp(0, odds)), len(mass)) / -np.log(10)
        back = np.empty(len(mass), np.int64)
        back[order] = np.arange(len(mass))
        return cls(start[back], depth[back], path, bias.astype(np.float32), rest[back])


def features(leaf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of what stands before each token: the last word, the last two, and the one before the last.

    ``first`` has the number of each token in its document; before the first there is nothing.
    """
    one, two = (np.where(first >= k, np.concatenate((np.zeros(k, np.int64), leaf[:-k] if k < len(leaf) else leaf[:0]))[: len(leaf)] + 1, 0).astype(U) for k in (1, 2))
    told = (np.stack([one, one * _SALT[1] + two, two]) + _SALT[:, None]) * _MIX
    told ^= told >> U(29)
    return ((told * _MIX) >> U(32)).astype(np.uint32)


def _shift(weights: np.ndarray) -> np.uint32:
    return np.uint32(32 - len(weights).bit_length() + 1)


def _places(at: np.ndarray, shift: np.uint32) -> np.ndarray:
    """Places of the weights of hashes (feature, class); changes ``at``."""
    at *= _LAST
    at ^= at >> np.uint32(15)
    at *= _NODE
    at >>= shift
    return at.astype(np.int64)


def _steps(classes: Classes, leaf: np.ndarray, told: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The first ``_CONTEXT`` classes on the ways of a batch: (token, half taken, places of the weights by feature, log odds of the second half)."""
    n = np.minimum(classes.depth[leaf], _CONTEXT)
    token = np.repeat(np.arange(len(leaf)), n)
    step = classes.path[np.repeat(classes.start[leaf] - (np.cumsum(n) - n), n) + np.arange(len(token))]
    node = step >> 1
    z = classes.bias[node]
    code = node.astype(np.uint32) * _NODE
    places = []
    for t in told:
        at = np.repeat(t, n)
        at ^= code
        places.append(_places(at, _shift(weights)))
        z += weights[places[-1]]
    return token, step & 1, places, z


def log_probability(classes: Classes, weights: np.ndarray, leaf: np.ndarray, told: np.ndarray, batch: int = 4096) -> np.ndarray:
    """log10 of the probability of each token's leaf."""
    out = np.zeros(len(leaf))
    if not len(classes.bias):
        return out + classes.rest[leaf]
    shift = _shift(weights)
    for i in range(0, len(leaf), batch):
        step = classes.ways[leaf[i : i + batch]]
        node = step >> 1
        z = classes.bias[node]
        code = node.astype(np.uint32) * _NODE
        for t in told[:, i : i + batch]:
            z += weights[_places(t[:, None] ^ code, shift)]
        z = np.where(step & 1, -z, z)
        np.minimum(z, 60, out=z)
        z[step < 0] = -np.inf
        np.exp(z, out=z)
        np.log1p(z, out=z)
        out[i : i + batch] = z.sum(axis=1, dtype=np.float64) / -np.log(10)
    return out + classes.rest[leaf]


def descend(classes: Classes, weights: np.ndarray, size: np.ndarray, seen: np.ndarray, leaf: np.ndarray, told: np.ndarray, rate: float, batch: int = 1 << 15) -> None:
    """Adaptive gradient steps on the tokens, in place; ``size`` sums squared gradients of a weight, ``seen`` counts its steps."""
    for i in range(0, len(leaf), batch):
        _, second, places, z = _steps(classes, leaf[i : i + batch], told[:, i : i + batch], weights)
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - second
        g = np.bincount(np.concatenate(places), np.tile(off, len(places)), len(weights)).astype(np.float32)
        seen += g != 0
        size += g * g
        g *= rate
        g /= np.sqrt(size)
        weights -= g


def _tokens(b, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves, number of each in its document, document of each) of a batch of lists."""
    n = np.diff(b[column].offsets.to_numpy())
    begin = b[column].offsets[0].as_py()
    leaf = b[column].values.to_numpy()[begin : begin + int(n.sum())].astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    return leaf, np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n), doc


def frequent(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], DataFrame]:
    """(the most frequent words with their counts, the table of the others). Frequent are all words of at most ``LONGEST`` bytes whose count
    reaches a bound, a power of two in ``_STEPS`` steps, set so that ``most`` words reach it at most."""
    step = F.when(F.octet_length("word") <= LONGEST, F.floor(F.log2("c") * _STEPS).cast("int"))
    short = counts.withColumn("step", step).filter("step IS NOT NULL")
    total, least = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # 64 * _STEPS rows at most
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return [], counts
    got = short.filter(F.col("step") >= least).select("word", "c").collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in got), key=lambda x: (-x[1], x[0])), counts.filter(F.coalesce(step < least, F.lit(True)))


def _train(ids: DataFrame, model, places: int, rounds: int, rate: float) -> np.ndarray:
    """Weights after all rounds; a round's changes are averaged by how often each task touched a weight."""
    spark = ids.sparkSession
    weights, size = np.zeros(places, np.float32), np.full(places, 1.0, np.float32)
    for k in range(rounds):
        now = spark.sparkContext.broadcast((weights, size))

        def steps(batches):
            classes = model()
            start, sizes = now.value
            w, s, seen = start.copy(), sizes.copy(), np.zeros(places, np.int64)
            for b in batches:
                if b.num_rows:
                    leaf, first, _ = _tokens(b, "ids")
                    descend(classes, w, s, seen, leaf, features(leaf, first), rate)
            for i in range(0, places, _BLOCK):
                n = seen[i : i + _BLOCK]
                if n.any():
                    told = np.concatenate([n, (w[i : i + _BLOCK] - start[i : i + _BLOCK]) * n, s[i : i + _BLOCK] - sizes[i : i + _BLOCK]]).astype(np.float32)
                    yield pa.record_batch([pa.array([i // _BLOCK], pa.int32()), pa.array([told.tobytes()], pa.binary())], names=["block", "told"])

        def total(batches):
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for block, told in zip(b["block"].to_pylist(), b["told"].to_pylist()):
                    x = np.frombuffer(told, np.float32).astype(np.float64)
                    out[block] = out[block] + x if block in out else x
            yield pa.record_batch([pa.array(list(out), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in out.values()], pa.binary())], names=["block", "told"])

        told = ids.filter((F.col("part") == k) & ~F.col("held_out")).select("ids").mapInArrow(steps, "block int, told binary")
        for r in told.repartition("block").mapInArrow(total, "block int, told binary").toLocalIterator():
            n, change, more = np.frombuffer(r["told"], np.float32).reshape(3, -1)
            at = slice(r["block"] * _BLOCK, r["block"] * _BLOCK + len(n))
            weights[at] += change / np.maximum(n, 1)
            size[at] += more
        now.unpersist()
    return weights


def score(docs: DataFrame, held_out: Column, columns: list[str], vocabulary: int = 1 << 18, shared: int = 1024, places: int = 1 << 19, rounds: int = 2, rate: float = 0.1) -> DataFrame:
    """Score every whole text with a model learned from the documents for which ``held_out`` is not true.

    Tokens are ``words_of`` and one end. ``vocabulary`` bounds the words with leaves of their own, ``shared`` is the number of
    shared leaves, ``places`` that of hashed weights (a power of two); these bound what is broadcast. Counts cover all training documents and words, however many there are, and are never gathered in one place.

    Returns (doc, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``, ``doc`` a struct of
    ``columns``. base_score is the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))), score that of the model; n_known counts tokens with c > 0. A
    null or empty text is one end. Null ``held_out`` is false. Equal texts get equal scores, up to rounding. No rows: no rows.
    Without training documents N and V are 0, all words are unknown and score spreads evenly over the shared leaves.
    """
    spark = docs.sparkSession
    text_batches(spark)
    some = docs.select(F.struct(*columns).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def count(batches):
        def summed():
            t = pa.table({"word": pa.concat_arrays(words), "c": np.concatenate(numbers)}).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return pa.record_batch([t["word"].combine_chunks(), t["c_sum"].combine_chunks()], names=["word", "c"])

        words, numbers = [], []
        for b in _gathered(batches):
            word, at, _ = _words(b["text"])
            words.append(word)
            numbers.append(np.bincount(at, minlength=len(word)))
            if sum(map(len, numbers)) > 1_000_000:
                got = summed()
                if got.num_rows > 300_000:
                    yield got
                    words, numbers = [], []
                else:
                    words, numbers = [got["word"]], [got["c"].to_numpy()]
        if words:
            yield summed()

    counts = some.filter(~F.col("held_out")).select("text").mapInArrow(count, "word binary, c long")
    counts = keep(counts.groupBy("word").agg(F.sum("c").alias("c")), "lm_counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    top, rare = frequent(counts, vocabulary)
    told = spark.sparkContext.broadcast([w for w, _ in top])
    rare = rare.withColumn("place", _shared_leaf("word", shared))
    buckets = {r["place"]: (r["c"], r["v"]) for r in rare.groupBy("place").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    spread = np.array([buckets.get(i, (0, 0)) for i in range(shared)], np.float64)
    spread = spread[:, 0] + 0.5 * (spread[:, 1] + 1)
    own = np.array([c for _, c in top], np.float64)
    mass = spark.sparkContext.broadcast((uuid.uuid4().hex, np.concatenate((spread, own + 0.5))))
    ids = keep(_encoded(some, told, shared, rounds), "lm_tokens")
    weights = spark.sparkContext.broadcast(_train(ids, lambda: _classes(mass), places, rounds, rate))
    base = np.log10(n + 0.5 * (v + 1))
    known = np.concatenate((np.full(shared, np.nan), np.log10(own + 0.5) - base))

    def judge(batches):
        classes = _classes(mass)
        for b in batches:
            if not b.num_rows:
                continue
            leaf, first, doc = _tokens(b, "ids")
            p = log_probability(classes, weights.value, leaf, features(leaf, first))
            here = leaf >= shared
            sums = [np.bincount(doc, x, b.num_rows) for x in (np.where(here, known[leaf], 0.0), p)]
            yield pa.record_batch([b["row"], b["doc"], b["held_out"], pa.array(np.bincount(doc, minlength=b.num_rows)), pa.array(np.bincount(doc, here, b.num_rows).astype(np.int64)), *map(pa.array, sums)], names=["row", "doc", "held_out", "n_tokens", "n_own", "own_base", "own_score"])

    schema = ids.select("row", "doc", "held_out").schema
    for name, kind in (("n_tokens", LongType()), ("n_own", LongType()), ("own_base", DoubleType()), ("own_score", DoubleType())):
        schema = schema.add(name, kind)
    whole = ids.select("row", "doc", "held_out", "ids").mapInArrow(judge, schema)
    asked = ids.select("row", F.inline("rare")).select("row", F.col("word"), F.col("n").cast("long").alias("n"))
    met = join_hot(asked, rare.withColumn("weight", F.col("c")), ["word"], "weight").select("row", "word", "n", F.coalesce("c", F.lit(0)).alias("c"))
    bucket = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(spread)]), (_shared_leaf("word", shared) + 1).cast("int"))
    held = F.log10(F.col("c") + 0.5)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"), F.sum(F.col("n") * (held - F.lit(float(base)))).alias("rare_base"), F.sum(F.col("n") * (held - bucket)).alias("rare_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.join(sums, "row", "left").select("doc", "held_out", "n_tokens", (F.col("n_own") + zero("n_rare")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("own_base") + zero("rare_base")).alias("base_score"), (F.col("own_score") + zero("rare_score")).alias("score"))


_held: dict[str, Classes] = {}


def _classes(mass) -> Classes:
    """The factored leaves, made once a worker."""
    name, *told = mass.value
    if name not in _held:
        _held.clear()
        _held[name] = Classes.of(*told)
    return _held[name]


def _encoded(some: DataFrame, told, shared: int, rounds: int) -> DataFrame:
    """(row, part, doc, held_out, ids, rare): leaves of all tokens, and the words that have none of their own with their numbers."""
    texts = some.withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        own = pa.array(told.value, pa.binary())
        for b in _gathered(batches):
            word, at, n = _words(b["text"])
            leaf = pc.fill_null(pc.index_in(word, value_set=own), -1 - shared).to_numpy() + shared
            lacking = leaf < 0
            rare = np.flatnonzero(lacking[at])
            of, numbers = np.unique(np.repeat(np.arange(len(n)), n)[rare] * len(word) + at[rare], return_counts=True)
            leaf[lacking] = [shared_leaf(w, shared) for w in word.filter(pa.array(lacking)).to_pylist()]
            ids, ends = leaf[at].astype(np.int32), np.concatenate(([0], np.cumsum(n)))
            cuts = np.searchsorted(of // len(word), np.arange(len(n) + 1))
            listed = pa.StructArray.from_arrays([word.take(pa.array(of % len(word))), pa.array(numbers.astype(np.int32))], names=["word", "n"])
            yield pa.record_batch([b["row"], b["doc"], b["held_out"], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), listed)], names=["row", "doc", "held_out", "ids", "rare"])

    schema = texts.select("row", "doc", "held_out").schema
    rare = StructType().add("word", BinaryType()).add("n", IntegerType())
    out = texts.select("row", "doc", "held_out", "text").mapInArrow(run, schema.add("ids", ArrayType(IntegerType())).add("rare", ArrayType(rare)))
    return out.withColumn("part", (F.pmod(F.xxhash64("row"), F.lit(rounds))).cast("int"))
