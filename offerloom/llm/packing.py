"""Best-fit packing of documents into sequences by exact-complement hashing."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import keep, text_batches

#: Characters up to here are letters, digits and marks whose classes no Unicode version has changed; for texts of them alone
#: the ranks of the same vocabulary give the ids of the tokenizer file, several times as fast.
SETTLED = 0x2AF
_codecs: dict = {}


def _codec(tokenizer_json: str):
    """(ids of a list of texts) for a byte-level BPE file; loaded once in a worker."""
    if tokenizer_json not in _codecs:
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        exact = Tokenizer.from_file(tokenizer_json)
        with open(tokenizer_json, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _bytes_of_signs(ByteLevel.alphabet())
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _codecs[tokenizer_json] = exact, fast, tuple(special)
    return _codecs[tokenizer_json]


def _bytes_of_signs(alphabet: list[str]) -> dict[str, int]:
    """The sign that byte-level BPE writes for each byte: printable Latin-1 is itself, the rest follows from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in own}
    signs.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))})
    if set(signs) != set(alphabet):
        raise ValueError("not a byte-level vocabulary")
    return signs


def token_ids(texts: list[str], tokenizer_json: str) -> list[np.ndarray]:
    """Ids of each text, as ``Tokenizer.from_file(...).encode(text, add_special_tokens=False)`` gives them."""
    exact, fast, special = _codec(tokenizer_json)
    out: list = [None] * len(texts)
    rest = []
    for i, t in enumerate(texts):
        if t and (t.isascii() or ord(max(t)) <= SETTLED) and not any(s in t for s in special):
            out[i] = fast.encode_to_numpy(t, disallowed_special=())
        else:
            rest.append(i)
    for i in rest:  # one by one: a batch would use threads of its own
        out[i] = np.array(exact.encode(texts[i], add_special_tokens=False).ids, np.uint32)
    return out


def pieces_of(docs: DataFrame, tokenizer_json: str, size: int, end_id: int = 0) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): documents as ids plus ``end_id``, the longer ones cut so that only the first piece is shorter."""
    text_batches(docs.sparkSession)

    def cut(batches):
        import zlib

        for b in batches:
            out = []
            for row, d, ids in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), token_ids([t or "" for t in b["text"].to_pylist()], tokenizer_json)):
                ids = np.append(ids, end_id).astype("<u4")
                edges = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                out += [(row, d, p, x, y - x, zlib.crc32(ids[x:y].tobytes())) for p, (x, y) in enumerate(zip(edges, edges[1:]))]
            cols = list(zip(*out)) or [[]] * 6
            yield pa.record_batch([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Available lengths: counts, and one bit per length for the sums of two."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.n, self.bits, self.mirror = size, dict(counts), 0, 0
        for x, c in counts.items():
            if c:
                self._flip(x)

    def _flip(self, x: int) -> None:
        self.bits ^= 1 << x
        self.mirror ^= 1 << (self.size - x)

    def take(self, x: int, k: int) -> None:
        self.n[x] -= k
        if not self.n[x]:
            self._flip(x)

    def largest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def enough(self, combination) -> bool:
        return all(self.n.get(x, 0) >= k for x, k in Counter(combination).items())

    def pair(self, total: int, used: tuple) -> tuple | None:
        """The available pair of this sum with the largest member, looked up by complement: bit x of the shifted mirror is length total - x."""
        shift = self.size - total
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        both &= (1 << total) - 1
        while both:
            x = both.bit_length() - 1
            if 2 * x < total:
                return None
            if self.enough((*used, x, total - x)):
                return x, total - x
            both ^= 1 << x
        return None

    def exact(self, gap: int, used: tuple) -> tuple | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.enough((*used, gap)):
            return (gap,)
        if (two := self.pair(gap, used)) is not None:
            return two
        x = self.largest(gap - 2)
        while x * 3 >= gap:
            if self.enough((*used, x)) and (two := self.pair(gap - x, (*used, x))) is not None:
                return x, *two
            x = self.largest(x - 1)
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] for the counts of the lengths 1 … size.

    The largest length opens a sequence. If one, two or three available lengths fill the gap exactly, they are taken, as often
    as the counts allow; else the largest that fits goes in and the smaller gap is tried. Every entry uses a length up, so there
    are at most ``size`` entries, whatever the number of pieces.
    """
    stock, out = _Stock(counts, size), []
    while stock.bits:
        used, gap = (top := stock.largest(size),), size - top
        while gap:
            if (rest := stock.exact(gap, used)) is not None:
                used, gap = (*used, *rest), 0
                break
            x = stock.largest(gap)
            while x > 0 and not stock.enough((*used, x)):
                x = stock.largest(x - 1)
            if x <= 0:
                break
            used, gap = (*used, x), gap - x
        per = Counter(used)
        times = min(stock.n[x] // k for x, k in per.items())
        for x, k in per.items():
            stock.take(x, k * times)
        out.append((used, times))
    return out


def pack(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 0, rows_per_bucket: int = 50_000) -> DataFrame:
    """Pack all documents into few sequences of at most ``size`` tokens.

    A document is its ids by the tokenizer plus ``end_id``; only longer ones are cut, and only their first piece may be shorter
    than ``size``. Null text counts as empty: one piece of length 1. Documents of an empty table make no pieces. Rows that share a
    doc_id, or have none, are packed as documents of their own. Other columns are not looked at.

    The plan needs only how many pieces there are of each length, at most ``size`` numbers. Pieces are then numbered within their
    length, in buckets so that no length, however frequent, is numbered in one task, and look their place up in the plan.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
    """
    pieces = keep(pieces_of(docs, tokenizer_json, size, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n_buckets = max(1, sum(counts.values()) // rows_per_bucket)
    order = F.xxhash64("row", "piece")
    numbered = pieces.withColumn("bucket", F.pmod(order, F.lit(n_buckets)))
    before = numbered.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1
    numbered = numbered.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    # per length: from which number on, in sequences from where on, so many in each, at which offset
    spans: dict[int, list] = {x: [] for x in counts}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, size):
        offset = 0
        for x, k in Counter(lengths).items():
            spans[x].append((taken[x], sequence, k, offset))
            taken[x] += k * times
            offset += k * x
        sequence += times
    table = {x: np.array(v, np.int64) for x, v in spans.items()}

    def place(batches):
        for b in batches:
            length, rank_ = b["length"].to_numpy(), b["rank"].to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                i = np.flatnonzero(length == x)
                t = table[int(x)]
                s = t[np.searchsorted(t[:, 0], rank_[i], "right") - 1]
                n = rank_[i] - s[:, 0]
                seq[i], off[i] = s[:, 1] + n // s[:, 2], s[:, 3] + n % s[:, 2] * x
            yield pa.record_batch([b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
