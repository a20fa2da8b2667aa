"""Chunks of documents within a budget of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..settings import Chunking

#: Documents that are cut before their chunks are handed on.
DOCUMENTS = 256


def windows(words: list[str], size: int, step: int) -> list[str]:
    """Windows of ``size`` words, one every ``step``, until one reaches the end; none without words."""
    return [" ".join(words[i : i + size]) for i in range(0, max(len(words) - size, 0) + step, step)] if words else []


def packed(lengths: np.ndarray, size: int, overlap: int) -> list[int]:
    """Begin and end of each chunk, one after the other, in words: units of these lengths packed as ``recursive`` says.

    With the words before each unit summed up, the last unit of a chunk is
    found by bisection, so that a chunk takes one step however long it is.
    """
    ends = np.cumsum(lengths)
    out: list[int] = []
    begin, unit = 0, 0
    while unit < len(ends):
        # the units that end within size words from here; one at least
        unit = max(unit + 1, int(np.searchsorted(ends, begin + size, "right")))
        end = int(ends[unit - 1])
        out += (begin, end)
        begin = max(begin, end - overlap)
    return out


def units(words: list[str], size: int) -> np.ndarray:
    """Lengths of the sentences, longer ones in windows of ``size``; a word that ends in ``.``, ``!`` or ``?`` ends one, as white space comes after it."""
    ends = np.flatnonzero([w[-1] in ".!?" for w in words]) + 1
    lengths = np.diff(np.unique(np.append(ends, len(words))), prepend=0)
    n = -(-lengths // size)
    out = np.full(n.sum(), size)
    out[np.cumsum(n) - 1] = lengths - (n - 1) * size
    return out


def recursive(words: list[str], size: int, overlap: int) -> list[str]:
    """Sentences packed until the next would pass ``size``; a chunk after the first begins with the last ``overlap`` words.

    Longer sentences are cut into windows of ``size``.  The words carried over
    aren't counted before they are put in front, so a chunk may hold up to
    ``size + overlap`` words.  A chunk is a stretch of the text's words, so
    only lengths are packed; time grows with the text.
    """
    if not words:
        return []
    at = packed(units(words, size), size, overlap)
    return [" ".join(words[b:e]) for b, e in zip(at[::2], at[1::2])]


def chunk(docs: DataFrame, how: Chunking) -> DataFrame:
    """``chunk_id, doc_id, ordinal, title, text, metadata, doc_seq``; ids are ``doc#ordinal``, words are joined by one space.

    Blank documents have no chunks.  Strategy ``semantic`` is declared but not there.
    """
    if how.strategy == "semantic":
        raise NotImplementedError("semantic chunking is not there; use fixed or recursive")
    rows = docs.select("doc_id", "title", "metadata", "doc_seq", "text")
    size, overlap, fixed = how.chunk_size, how.chunk_overlap, how.strategy == "fixed"

    def cut(text: str | None) -> list[str]:  # str.split knows the white space of functions.text.SPACE
        words = (text or "").split()
        return windows(words, size, size - overlap) if fixed else recursive(words, size, overlap)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(start, DOCUMENTS)
                made = pa.array([cut(x.as_py()) for x in batch.column(4)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], made], names=[*batch.schema.names[:4], "made"])

    rows = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:4], T.StructField("made", T.ArrayType(T.StringType()))]))
    rows = rows.select("doc_id", "title", "metadata", "doc_seq", F.posexplode_outer("made").alias("ordinal", "text")).where("ordinal is not null")
    return rows.select(F.concat_ws("#", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "ordinal", "title", "text", "metadata", "doc_seq")
