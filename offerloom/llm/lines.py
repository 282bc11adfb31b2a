"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from offerloom.llm.common import documents_by_key


def _windows(lines: list[bytes], width: int):
    """(start, digest) of every window of consecutive lines that is not blank throughout."""
    for i in range(len(lines) - width + 1):
        part = lines[i : i + width]
        if any(x.strip() for x in part):
            yield i, hashlib.blake2b(b"\n".join(part), digest_size=16).digest()


def remove_repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Remove every line that a window of ``width`` consecutive lines covers which occurs earlier in the corpus.

    Earlier: in a document of smaller doc_id, or before in the same one. Lines end at line feeds and are compared as they are, by
    128-bit digests of the window. Windows are judged on the input and may overlap; windows of white space alone do not count.
    Of each window's occurrences only the earliest is named, a count-free minimum that stands any number of them; a document
    then removes what its other windows cover.

    Returns (doc_id, n_lines, n_removed, kept, rest) for every row of ``docs``; kept has the lines left, joined by line feeds, and
    rest is a struct of the columns that are not looked at. Null text: no lines, kept is null. Empty text: one empty line. Null
    doc_id is the smallest; rows that share a doc_id come one after the other, in the order of the table.
    """
    known = documents_by_key(docs, "line_documents")

    def emit(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k, dup, z in zip(b["k"].to_pylist(), b["dup"].to_pylist(), b["z"].to_pylist()):
                out += [(d, k, dup, i) for i, d in _windows(unzip.decompress(z).split(b"\n"), width)]
            d, *places = list(zip(*out)) or ([], [], [], [])
            yield pa.record_batch([pa.array(d, pa.binary()), *[pa.array(x, pa.int64()) for x in places]], names=["window", "k", "dup", "pos"])

    first = known.select("k", "dup", "z").mapInArrow(emit, "window binary, k long, dup long, pos long").groupBy("window").agg(F.min(F.struct("k", "dup", "pos")).alias("f"))
    first = first.select("f.k", "f.dup", "f.pos").groupBy("k", "dup").agg(F.collect_list("pos").alias("stays"))

    def rest(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            n, m, kept = [], [], []
            for i, (z, given) in enumerate(zip(b["z"].to_pylist(), b["given"].to_pylist())):
                lines = unzip.decompress(z).split(b"\n")
                stays = set(b["stays"][i].as_py() or ())
                gone = np.zeros(len(lines), bool)
                for at, _ in _windows(lines, width):
                    if at not in stays:
                        gone[at : at + width] = True
                n.append(len(lines) if given else 0)
                m.append(int(gone.sum()))
                kept.append(b"\n".join(x for x, g in zip(lines, gone) if not g).decode("utf-8", "surrogatepass") if given else None)
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string()), b["rest"]], names=["doc_id", "n_lines", "n_removed", "kept", "rest"])

    schema = StructType([StructField("doc_id", LongType()), StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()), known.schema["rest"]])
    return known.join(first, ["k", "dup"], "left").select("doc_id", "z", "given", "rest", "stays").mapInArrow(rest, schema)
