"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from offerloom.llm.common import keep, text_batches, word_hashes

#: Features of the linear scorer, and the last of them for properties of the whole text.
DIMENSIONS, WHOLE = 1 << 16, 64
_LETTERS = np.array([chr(i).isalpha() or i >= 0x80 for i in range(256)])
_UPPER = np.array([0x41 <= i <= 0x5A for i in range(256)])
_DIGIT = np.array([0x30 <= i <= 0x39 for i in range(256)])
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_PLAIN = _LETTERS | _DIGIT | _SPACE | np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]


class _Words(dict):
    """Numbers of the words a worker has seen, and what is asked of each: its feature, whether it ends a sentence, whether it is a lone sign."""

    most = 500_000

    def __init__(self):
        super().__init__()
        self.told = np.zeros((1024, 3), np.int32)
        self.hash = np.zeros(1024, np.uint64)

    def __missing__(self, w: bytes) -> int:
        i = len(self)
        if i == len(self.told):
            self.told = np.concatenate((self.told, np.zeros_like(self.told)))
            self.hash = np.concatenate((self.hash, np.zeros_like(self.hash)))
        self.hash[i] = word_hashes([w])[0]
        shape = w
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        place = int(word_hashes([shape])[0] % np.uint64(DIMENSIONS - WHOLE))
        self.told[i] = place, w[-1:] in (b".", b"!", b"?"), len(w) == 1 and not _LETTERS[w[0]] and not _DIGIT[w[0]]
        self[w] = i
        return i

    def of(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))


_words = _Words()


def _read(t: str | None) -> tuple[np.ndarray, dict[str, float]]:
    """(features of the words, shares that the labellers judge) of a whole text."""
    text = (t or "").encode("utf-8", "surrogatepass")
    ids = _words.of(text.split())
    place, ends, bare = _words.told[ids].T
    n, n_words = max(1, len(text)), max(1, len(ids))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(c[_LETTERS].sum()))
    h = _words.hash[ids]
    triples = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(ids) > 2 else h[:0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    return place, {
        "words": len(ids),
        "odd": 1 - c[_PLAIN].sum() / n,
        "upper": c[_UPPER].sum() / letters,
        "digits": c[_DIGIT].sum() / n,
        "other": 1 - letters / n,
        "length": (len(text) - c[_SPACE].sum()) / n_words,
        "again": (ids[1:] == ids[:-1]).sum() / n_words,
        "apart": 1 - len(np.unique(triples)) / max(1, len(triples)) if len(triples) else 0.0,
        "lines_again": 1 - len(set(lines)) / max(1, len(lines)),
        "ends": ends.sum() / n_words,
        "bare": bare.sum() / n_words,
        "marks": (c[33] + c[63]) / n_words,
    }


#: (name, measure, from where on): each says "poor" or nothing.
LABELLERS = [
    ("odd signs", "odd", 0.08), ("capitals", "upper", 0.5), ("digits", "digits", 0.25), ("word after itself", "again", 0.2), ("phrases again", "apart", 0.4),
    ("lines again", "lines_again", 0.4), ("lone signs", "bare", 0.15), ("exclamations", "marks", 0.4), ("few letters", "other", 0.4),
]
#: Votes of each text: those of the labellers, then three that say "good" or nothing.
VOTES = len(LABELLERS) + 3
#: A labeller that says "poor" of more than this share of good texts is set wrong; the label model keeps it to that.
FALSE_ALARMS = 0.003


def votes(m: dict[str, float]) -> list[int]:
    """1 for each labeller that speaks. Texts of fewer than four words get no votes."""
    if m["words"] < 4:
        return [0] * VOTES
    good = [
        m["odd"] <= 0.02 and m["upper"] <= 0.15 and m["other"] <= 0.25,  # plain writing
        0.01 <= m["ends"] <= 0.4 and m["bare"] <= 0.02 and 3 <= m["length"] <= 15,  # sentences
        m["words"] >= 20 and m["apart"] <= 0.1 and m["again"] <= 0.02,  # varied words
    ]
    return [int(m[k] >= least) for _, k, least in LABELLERS] + [int(g) for g in good]


def pattern(v: list[int]) -> int:
    return sum(x << i for i, x in enumerate(v))


def fit_label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """Expectation-maximisation over vote patterns: P(good), P(a labeller speaks | class), and P(good | pattern) of each pattern.

    Labellers are independent given the class. ``FALSE_ALARMS`` bounds how often one says "poor" of good texts, and one that says
    "good" does so of good texts at least as often as of poor ones; this fixes which class is which, and lets several kinds of poor
    texts, each found by labellers of its own, be one class.
    """
    v = (codes[:, None] >> np.arange(VOTES)) & 1
    n = len(LABELLERS)
    speaks = np.array([[0.25] * n + [0.4] * 3, [FALSE_ALARMS] * n + [0.9] * 3])
    good = 0.85
    p = np.full(len(codes), good)
    for _ in range(rounds):
        like = (np.log(speaks)[:, None] * v[None] + np.log(1 - speaks)[:, None] * (1 - v)[None]).sum(axis=2)
        p = 1 / (1 + np.exp(-np.clip(like[1] - like[0] + np.log(good / (1 - good)), -500, 500)))
        weight = np.stack([counts * (1 - p), counts * p])
        good = float(np.clip(weight[1].sum() / max(1, counts.sum()), 0.01, 0.99))
        speaks = np.clip((weight @ v + 0.5) / (weight.sum(axis=1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
        speaks[1, :n] = np.minimum(speaks[1, :n], FALSE_ALARMS)
        speaks[0, :n] = np.maximum(speaks[0, :n], 0.02)
        speaks[1, n:] = np.maximum(speaks[1, n:], speaks[0, n:])
    return good, speaks, p


def features(place: np.ndarray, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: (places, values) of the shares of word shapes, and of the measures in four steps each."""
    at, n = np.unique(place, return_counts=True)
    x = np.sqrt(n / max(1, len(place)))
    steps = [i * 4 + min(3, int(m[k] / least * 2)) for i, (_, k, least) in enumerate(LABELLERS)]
    return np.append(at, DIMENSIONS - WHOLE + np.array(steps)), np.append(x, np.full(len(steps), 0.5))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Weights, the last for the constant, of a logistic regression on soft targets, by adaptive gradient steps."""
    w, g2 = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    order = np.random.Generator(np.random.Philox(3))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            d = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))) - target[i]
            for where, g in ((at, d * x), (np.array([DIMENSIONS]), np.array([d]))):
                g2[where] += g * g
                w[where] -= rate * g / np.sqrt(g2[where])
    return w


def judged(docs: DataFrame, columns: list[str] | None = None, sample: int = 10_000, least: float = 0.05) -> DataFrame:
    """Score every document and decide which stay.

    Every whole text is read once, into its labellers' votes and its features. The counts of the vote patterns, at most 4,096 rows, are what
    the label model is fitted on. The scorer is trained on the posterior labels of ``sample`` documents, those with the smallest hash of doc_id
    and text; with it every document gets its score, the probability of good quality. A document stays if that is ``least`` or more.

    Returns (doc, score, kept): doc is a struct with ``columns`` of the row (all, by default), whatever their names. Null and empty texts, and
    texts of fewer than four words, get no votes on style and are judged by the rest. Repeated rows get equal scores. An empty table: no rows.
    """
    text_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    order = F.xxhash64(F.col("doc_id").cast("string"), text)
    whole = docs.select(F.struct(*(columns or docs.columns)).alias("doc"), order.alias("o"), text.alias("text"))

    def read(batches):
        for b in batches:
            codes, at, x, ends = [], [], [], [0]
            for t in b["text"].to_pylist():
                place, m = _read(t)
                codes.append(pattern(votes(m)))
                p, v = features(place, m)
                at.append(p)
                x.append(v)
                ends.append(ends[-1] + len(p))
            ends = pa.array(ends, pa.int32())
            at, x = (np.concatenate(z) if z else np.zeros(0) for z in (at, x))
            yield pa.record_batch([b["doc"], b["o"], pa.array(codes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float32)))], names=["doc", "o", "code", "at", "x"])

    schema = StructType([whole.schema["doc"], StructField("o", LongType()), StructField("code", LongType()), StructField("at", ArrayType(IntegerType())), StructField("x", ArrayType(FloatType()))])
    told = keep(whole.mapInArrow(read, schema), "quality_features")
    seen = told.groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r["code"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.float64)
    posterior = dict(zip(codes.tolist(), fit_label_model(codes, counts)[2].tolist())) if len(seen) else {}
    share = min(1.0, 1.2 * sample / max(1.0, float(counts.sum())))
    some = told.filter(F.pmod("o", F.lit(1_000_000)) < share * 1_000_000).select("o", "code", "at", "x").orderBy("o").limit(sample)

    def fitted(batches):
        rows, target = [], []
        for b in batches:
            rows += _rows(b)
            target += [posterior[c] for c in b["code"].to_pylist()]
        yield pa.record_batch([pa.array([train(rows, np.array(target)).tolist()], pa.list_(pa.float64()))], names=["w"])

    model = some.coalesce(1).mapInArrow(fitted, "w array<double>").collect()
    w = np.array(model[0]["w"]) if model else np.zeros(DIMENSIONS + 1)

    def scored(batches):
        for b in batches:
            s = [float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))) for at, x in _rows(b)]
            yield pa.record_batch([b["doc"], pa.array(s, pa.float64()), pa.array([v >= least for v in s], pa.bool_())], names=["doc", "score", "kept"])

    return told.select("doc", "at", "x").mapInArrow(scored, StructType([whole.schema["doc"], StructField("score", DoubleType()), StructField("kept", BooleanType())]))


def _rows(b) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of the features of each row of a batch."""
    ends = b["at"].offsets.to_numpy()
    at, x = b["at"].values.to_numpy(), b["x"].values.to_numpy().astype(np.float64)
    return [(at[i:j], x[i:j]) for i, j in zip(ends[:-1], ends[1:])]
