"""Substring dedup: repeated word windows, by seed and extend.

Documents meet on winnowed anchors (five words with the smallest hash of a window). From an anchor the match is extended to
both sides, as far as the windows that picked it reach, and compared as a whole; windows that agree in part only are compared
one by one. Neighbouring repeated windows join into maximal repeats of at least ``size`` words. See ``repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from offerloom.llm.repeats import Unit, covered, staying_windows


def remove_repeated_words(docs: DataFrame, size: int = 20, seed: int = 5, **limits: int) -> DataFrame:
    """Remove every word covered by a window of ``size`` words that also starts earlier in the corpus.

    Earlier: in a document of smaller doc_id, or before in the same one. Windows are judged on the input. Words are runs of
    characters other than ASCII white space, unchanged.

    Returns (doc_id, n_words, n_removed, kept), one row per row of ``docs``; kept has the words left, joined by one space.
    Null or empty text: no words, nothing removed, kept is empty. Null doc_id counts as the smallest. Rows that share a
    doc_id are further documents that come after the first, in the order of the table. Other columns are not looked at.
    """
    unit = Unit("word", size, seed, True, **limits)

    def rest(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, z in enumerate(b["z"].to_pylist()):
                ws = unit.of(unzip.decompress(z))
                gone = covered(len(ws), b["stays"][i].values.to_numpy(), size)
                out.append((len(ws), int(gone.sum()), b" ".join(np.array(ws, object)[~gone]) if len(ws) else b""))
            n, m, text = list(zip(*out)) or ([], [], [])
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in text], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return staying_windows(docs, unit).select("doc_id", "z", "stays").mapInArrow(rest, "doc_id long, n_words long, n_removed long, kept string")
