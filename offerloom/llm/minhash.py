"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import documents_by_key, join_hot, keep, keep_light, meet_hot, mix64, with_texts, word_hashes

U = np.uint64
#: Size of the permuted range that shingles are hashed to, coordinates of a signature, and coordinates in a band.
RANGE, COORDINATES, ROWS = 1 << 20, 128, 4
#: A shingle is on a short list if so many documents have it at most.
FEW = 8
#: Members of a star that one task compares with its centre.
STAR = 500


def _permutation(seed: int) -> np.ndarray:
    p = np.random.Generator(np.random.Philox(seed)).permutation(RANGE).astype(np.uint32)
    return np.concatenate((p, p[:COORDINATES]))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z in lower case. Of fewer words, all are one shingle."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    s = np.zeros(max(1, len(h) - width + 1), U)
    for i in range(min(width, len(h))):
        s = mix64(s + U(i + 1)) + h[i : i + len(s)]
    return np.unique(mix64(s))


def signature(s: np.ndarray, circle: np.ndarray) -> np.ndarray:
    """The first permutation, a hash, puts each shingle at a place of the circle; coordinate j is the least value of the second
    permutation at these places, shifted by j."""
    at = (s >> U(44)).astype(np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(low, shifted[at[i : i + 2048]].min(axis=0), out=low)
    return low


def _signatures(width: int):
    def run(batches):
        unzip, circle = zstandard.ZstdDecompressor(), _permutation(11)
        band = np.arange(COORDINATES // ROWS, dtype=U)
        for b in batches:
            n, first, second, bands, sig = [], [], [], [], []
            for z in b["z"].to_pylist():
                s = shingles(unzip.decompress(z), width)
                n.append(len(s))
                first.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
                second.append(int(mix64(s + U(7)).sum().view(np.int64)) if len(s) else 0)
                if not len(s):
                    bands.append([])
                    sig.append(b"")
                    continue
                low = signature(s, circle).astype(U).reshape(-1, ROWS)
                key = mix64(band + U(1))
                for i in range(ROWS):
                    key = mix64(key ^ low[:, i]) + U(i)
                bands.append(key.view(np.int64).tolist())
                sig.append(low.astype(np.uint8).tobytes())
            yield pa.record_batch(
                [b["k"], b["dup"], b["doc_id"], pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["k", "dup", "doc_id", "n", "a", "b", "bands", "sig"])

    return run


def _compare(width: int, percent: int):
    """From rows (centre, salt, row, z) with the centre's own text first in its group: the rows linked with it."""

    def run(batches):
        unzip, now, centre = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            out = []
            for c, salt, row, z in zip(*(b[x].to_pylist() for x in ("centre", "salt", "row", "z"))):
                s = shingles(unzip.decompress(z), width)
                if row is None:
                    now, centre = (c, salt), s
                    continue
                if now != (c, salt):
                    raise RuntimeError("a star without its centre")
                both = int(np.isin(s, centre, assume_unique=True).sum())
                if 100 * both >= percent * (len(s) + len(centre) - both):
                    out.append((c, row))
            cols = list(zip(*out)) or [[], []]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], names=["centre", "row"])

    return run


def _links(d: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (centre, row) those whose full shingle sets are similar enough."""
    pairs = keep_light(pairs, "pairs")
    size = pairs.groupBy("centre").agg(F.count("*").alias("size"))
    salted = meet_hot(pairs, size, ["centre"], "size").withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / STAR)))
    who = reps.select(F.col("row").alias("who"), "k", "dup")
    heads = salted.select("centre", "salt").distinct().join(who, F.col("centre") == F.col("who")).select("centre", "salt", F.lit(None).cast("long").alias("row"), "k", "dup")
    rest = salted.join(who, F.col("row") == F.col("who")).select("centre", "salt", "row", "k", "dup")
    texts = heads.unionByName(rest).join(d.select("k", "dup", "z"), ["k", "dup"]).select("centre", "salt", "row", "z")
    texts = texts.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("row").asc_nulls_first())
    return keep(texts.mapInArrow(_compare(width, percent), "centre long, row long"), "links")


def _rare_shingles(d: DataFrame, some: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (key, row, n, alone): between them, linked documents of ``some`` share a row's key, and ``possible`` holds.

    Sets are read from their rarest shingle on; two linked ones share one of the first few. The first table has shingles that up to
    ``FEW`` of these documents have: short lists. The second is for pairs that share none of those, which then count as ``alone``,
    as do those of one document: they are in no intersection, and that bounds the similarity.
    """

    def each(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            x = [shingles(unzip.decompress(z), width) for z in b["z"].to_pylist()]
            row = np.repeat(b["row"].to_numpy(), [len(v) for v in x])
            yield pa.record_batch([pa.array(row), pa.array((np.concatenate(x) if x else np.zeros(0, U)).view(np.int64))], names=["row", "key"])

    every = keep(d.select("k", "dup", "z").join(some.select("row", "k", "dup"), ["k", "dup"]).select("row", "z").mapInArrow(each, "row long, key long"), "shingles")
    often = keep_light(every.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    common = meet_hot(every, often, ["key"], "often")
    own = Window.partitionBy("row")
    common = common.withColumn("place", F.row_number().over(own.orderBy("often", "key"))).withColumn("shared", F.count("*").over(own))
    common = common.withColumn("few", F.count_if(F.col("often") <= FEW).over(own)).join(some.select("row", "n"), "row").withColumn("alone", F.col("n") - F.col("shared"))
    common = common.filter(F.col("place") + F.col("alone") <= F.expr(f"n - ceil(n * {percent} / 100) + 1"))
    common = keep_light(common.filter(F.expr(f"100 * (n - alone) >= {percent} * n")), "prefixes")
    short = common.filter(F.col("often") <= FEW).select("key", "row", "n", "alone")
    return short, common.filter(F.col("often") > FEW).select("key", "row", "n", (F.col("alone") + F.col("few")).alias("alone"))


def _merged(labels: DataFrame, links: DataFrame, rounds: int = 2) -> DataFrame:
    """(row, c) after smaller labels have gone along the links ``rounds`` times: enough to make each star one component."""
    both = links.select(F.col("centre").alias("x"), F.col("row").alias("y")).unionByName(links.select(F.col("row").alias("x"), F.col("centre").alias("y")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("row", "y"), "y").groupBy(F.col("x").alias("row")).agg(F.min("c").alias("m"))
        labels = labels.join(near, "row", "left").select("row", F.least("c", "m").alias("c"))
    return keep_light(labels, "labels")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(row, c): c is the smallest row that links lead to. Labels go along links and then jump to the label's own label."""
    both = keep_light(links.select(F.col("centre").alias("x"), F.col("row").alias("y")).unionByName(links.select(F.col("row").alias("x"), F.col("centre").alias("y"))), "both")
    c = both.groupBy(F.col("x").alias("row")).agg(F.min("y").alias("y")).select("row", F.least("row", "y").alias("c"))
    while True:
        c = keep_light(c, "labels")
        near = both.join(c.withColumnRenamed("row", "y"), "y").groupBy(F.col("x").alias("row")).agg(F.min("c").alias("m"), F.max("c").alias("most"))
        step = keep_light(c.join(near, "row").select("row", F.least("c", "m").alias("c"), ((F.col("m") != F.col("c")) | (F.col("most") != F.col("c"))).alias("uneven")), "labels")
        if step.filter("uneven").isEmpty():
            break
        up = step.select(F.col("row").alias("c"), F.col("c").alias("up"))
        hot = step.groupBy("c").agg(F.count("*").alias("size")).join(up, "c")
        c = join_hot(step.select("row", "c"), hot, ["c"], "size", "inner").select("row", F.col("up").alias("c"))
    return nodes.select("row").join(c.withColumnRenamed("c", "l"), "row", "left").select("row", F.coalesce("l", "row").alias("c"))


def near_groups(docs: DataFrame, percent: int = 85, width: int = 5, stars: int = 2) -> DataFrame:
    """Group documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more, and what links with them.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. Documents of the same set are one class,
    and only one of a class is compared. Classes meet in bands of their signatures. In a band, a centre is compared with the
    others, on whole sets; after ``stars`` rounds with different centres, most groups are one component. Documents of bands that
    still hold several components then meet by their rarest shingles instead, again with centres first and at last pair by
    pair, but never within a component. A pair at 80% shares none of the 32 bands of four coordinates with probability 5e-8,
    one at 85% with 6e-11; all that follows is exact.

    Returns (doc_id, n_shingles, component_id, kept), one row per row of ``docs``; kept marks one row per component, that of the
    smallest doc_id. Null or empty text or white space alone: no shingles, a component of its own. Null doc_id is the smallest.
    Rows that share a doc_id are documents of their own. Other columns are not looked at.
    """
    out = _grouped(documents_by_key(docs, "near_documents"), percent, width, stars)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, stars: int = 2) -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps, with all their columns."""
    d = documents_by_key(docs, "near_documents")
    kept = _grouped(d, percent, width, stars).filter("kept").select("k", "dup")
    return with_texts(d.join(kept, ["k", "dup"]), docs.columns)


def _grouped(d: DataFrame, percent: int, width: int, stars: int) -> DataFrame:
    """(k, dup, doc_id, n_shingles, component_id, kept) of the documents by key."""
    schema = "k long, dup long, doc_id long, n long, a long, b long, bands array<long>, sig binary"
    s = d.select("k", "dup", "doc_id", "z").mapInArrow(_signatures(width), schema).withColumn("row", F.monotonically_increasing_id())
    s = keep(s, "signatures")
    classes = s.filter("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("k", "dup", "row")).alias("f"), F.count("*").alias("size"))
    classes = keep_light(classes.select("a", "b", "n", F.col("f.row").alias("rep"), "size"), "classes")
    of_classes = s.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    reps = keep_light(of_classes.select("row", "k", "dup", "n"), "representatives")  # signatures and bands stay where they are

    banded = of_classes.select("row", "n", F.explode("bands").alias("band"))
    shared = keep_light(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "shared_bands")
    banded = keep_light(meet_hot(banded, shared, ["band"], "size", semi=True).select("band", "row", "n"), "bands")
    keyed = banded.select(F.col("band").alias("key"), "row", "n", F.lit(0).cast("long").alias("alone"))
    # no more can be shared than what is not alone in either
    possible = F.expr(f"(100 + {percent}) * least(n - alone, other_n - other_alone) >= {percent} * (n + other_n)")
    links, labels = None, reps.select("row", F.col("row").alias("c"))

    def add(pairs):
        nonlocal links
        found = _links(d, reps, pairs, width, percent)
        links = found if links is None else links.unionByName(found)
        return found

    def mixed(keyed, t):
        """Documents by key with their component, and per key that has several components its centre."""
        told = keep_light(keyed.join(labels, "row"), "told")
        first = F.min(F.struct("alone", F.xxhash64("row", F.lit(t)).alias("o"), "row", "n", "c")).alias("f")
        heads = told.groupBy("key").agg(first, F.count("*").alias("size"), F.min("c").alias("l"), F.max("c").alias("g")).filter("l < g")
        return told, keep_light(heads.select("key", F.col("f.row").alias("centre"), F.col("f.n").alias("other_n"), F.col("f.alone").alias("other_alone"), F.col("f.c").alias("other_c"), "size"), "mixed")

    for t in range(stars):
        told, heads = mixed(keyed, t)
        labels = _merged(labels, add(meet_hot(told, heads, ["key"], "size", (F.col("c") != F.col("other_c")) & possible).select("centre", "row").distinct()))
    told, heads = mixed(keyed, stars)
    left = keep_light(meet_hot(told, heads, ["key"], "size", semi=True).select("row").distinct().join(reps.select("row", "k", "dup", "n"), "row"), "left")
    short, long_ = _rare_shingles(d, left, width, percent)
    for t in range(stars):
        told, heads = mixed(long_, t)
        labels = _merged(labels, add(meet_hot(told, heads, ["key"], "size", (F.col("c") != F.col("other_c")) & possible).select("centre", "row").distinct()))
    labels = keep_light(_components(reps, links), "components")

    # what is left, pair by pair; a linked pair's signatures agree in fewer coordinates than this with a chance of about 1e-8
    p = percent / 100
    agree = int(COORDINATES * p - 6 * (COORDINATES * p * (1 - p)) ** 0.5)

    def agreeing(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sig", "other_sig"))
            yield b.select(["other_row", "row"]).filter(pa.array((x == y).sum(axis=1) >= agree)).rename_columns(["centre", "row"])

    rest = None
    for keyed in (short, long_):
        told, heads = mixed(keyed, 0)
        told = keep(meet_hot(told, heads.select("key", "size"), ["key"], "size", semi=True).join(s.select("row", "sig"), "row"), "rest")
        other = told.select("key", *[F.col(x).alias(f"other_{x}") for x in ("row", "n", "alone", "c", "sig")])
        pairs = told.join(other, "key").filter((F.col("row") < F.col("other_row")) & (F.col("c") != F.col("other_c")) & possible)
        pairs = pairs.select("row", "other_row", "sig", "other_sig").mapInArrow(agreeing, "centre long, row long")
        rest = pairs if rest is None else rest.unionByName(pairs)
    add(rest.distinct())
    labels = keep_light(_components(reps, links), "components")

    named = classes.join(labels.withColumnRenamed("row", "rep"), "rep")
    of_row = join_hot(s.select("row", "k", "dup", "doc_id", "a", "b", "n"), named.select("a", "b", "n", "c", "size"), ["a", "b", "n"], "size")
    of_row = keep_light(of_row.withColumn("c", F.coalesce("c", -1 - F.col("row"))), "members")
    first = of_row.groupBy("c").agg(F.min(F.struct("k", "dup", "doc_id", "row")).alias("f"), F.count("*").alias("members"))
    out = join_hot(of_row.select("c", "k", "dup", "doc_id", "n", "row"), first, ["c"], "members", "inner")
    return out.select("k", "dup", "doc_id", F.col("n").alias("n_shingles"), F.col("f.doc_id").alias("component_id"), (F.col("row") == F.col("f.row")).alias("kept"))
