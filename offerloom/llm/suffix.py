"""Suffix-array dedup: repeated byte strings, by prefix doubling.

Positions are ranked by the string that starts there, and ranks are made anew for longer and longer strings until a position
is unique or past the threshold. All bytes of a corpus as rows would be many times its size, so positions go in runs (see
``repeats``): 73 bytes at anchors first, then all bytes the run touches, at least the threshold, and for the runs left pairs
of ranks at offsets 1, 2, 4 … up to the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from offerloom.llm.repeats import Unit, covered, staying_windows


def remove_repeated_bytes(docs: DataFrame, size: int = 200, seed: int = 73, **limits: int) -> DataFrame:
    """Remove every byte covered by a string of ``size`` bytes that starts anywhere else too, in whichever document.

    All occurrences go, the first one too; occurrences may overlap; strings are judged on the input and do not cross
    documents. Texts count as their UTF-8 bytes.

    Returns (doc_id, n_bytes, n_removed, spans, kept), one row per row of ``docs``: spans are the maximal removed runs as
    (start, stop) in bytes, kept the bytes left (they may split a character). Null or empty text: no bytes. Null doc_ids and
    rows that repeat a doc_id are documents like others. Other columns are not looked at.
    """
    unit = Unit("byte", size, seed, False, **limits)

    def rest(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            n, m, spans, kept = [], [], [], []
            for i, z in enumerate(b["z"].to_pylist()):
                text = unzip.decompress(z)
                gone = covered(len(text), b["stays"][i].values.to_numpy(), size)
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                n.append(len(text))
                m.append(int(gone.sum()))
                spans.append([{"start": x, "stop": y} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if edge else text)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"
    return staying_windows(docs, unit).select("doc_id", "z", "stays").mapInArrow(rest, schema)
