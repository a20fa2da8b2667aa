"""Signed feature hashing of tokens into vectors."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import coded_tokens, tokens

_TOKEN = re.compile("[a-z0-9]+")
#: Components that a task sums up at once.
SUMS = 1 << 22


@functools.lru_cache(1 << 18)
def _place(token: str, dim: int) -> tuple[int, float]:
    """Bucket and sign: blake2b of 8 bytes, big-endian; the top bit is the sign."""
    h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
    return h % dim, 1.0 if h >> 63 else -1.0


@functools.lru_cache(1 << 18)
def _md5_place(token: str, dim: int) -> tuple[int, float]:
    """Bucket and sign from md5, as ``embed_md5`` has them."""
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:15], 16) % dim, 1.0 if h[15] >= "8" else -1.0


def embed_one(text: str | None, dim: int, place=_place, kind=np.float32) -> np.ndarray:
    out = np.zeros(dim, kind)
    found = [place(t, dim) for t in _TOKEN.findall((text or "").lower())]
    if found:
        bucket, sign = zip(*found)
        np.add.at(out, np.array(bucket), np.array(sign, kind))
        norm = float(np.linalg.norm(out))
        if norm > 0:
            out /= norm
    return out


def matrix(texts: list[str | None], dim: int) -> np.ndarray:
    """A row of ``embed_one`` for each text, to the last bit; a token is hashed once for all texts."""
    owner, code, known = coded_tokens(texts)
    made = b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in known.to_numpy(zero_copy_only=False))
    hashes = np.frombuffer(made, ">u8").astype(np.uint64)
    bucket, sign = (hashes % dim).astype(np.int64), np.where(hashes >> 63, 1.0, -1.0)
    sums = np.bincount(owner * dim + bucket[code], sign[code], len(texts) * dim).reshape(len(texts), dim)
    squares = (sums * sums).sum(1)
    norm = np.sqrt(squares.astype(np.float32))
    out = sums.astype(np.float32) / np.where(norm > 0, norm, np.float32(1))[:, None]
    for i in np.flatnonzero(squares >= 1 << 24):  # single precision rounds the sums themselves there, as they come
        out[i] = embed_one(texts[i], dim)
    return out


def md5_matrix(texts: list[str | None], dim: int) -> np.ndarray:
    """A row of ``embed_md5`` for each text, in double precision; a token is hashed once for all texts."""
    owner, code, known = coded_tokens(texts)
    bucket, sign = (np.array(x) for x in zip(*(_md5_place(t, dim) for t in known.to_pylist()))) if len(known) else (np.zeros(0, int), np.zeros(0))
    sums = np.bincount(owner * dim + bucket[code], sign[code], len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))  # of whole numbers, so exact
    return sums / np.where(norm > 0, norm, 1.0)


def embed(text: Column, dim: int) -> Column:
    """Unit vector of a text (zero without tokens); blake2b isn't among the built-in functions."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        step = max(1, SUMS // dim)
        made = [matrix(texts.slice(i, step).to_pylist(), dim).ravel() for i in range(0, len(texts), step)]
        flat = np.concatenate(made) if made else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(flat, pa.float32()))

    return run(text)


def embed_md5(texts: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """The same embedding on md5 with built-in functions only, sparse: ``(id, bucket, weight)``.

    Buckets that sum to zero are left out; weights are normalised per id.
    """
    h = F.conv(F.substr(F.md5("token"), F.lit(1), F.lit(15)), 16, 10).cast("long")
    sign = F.when(F.substr(F.md5("token"), F.lit(16), F.lit(1)) >= "8", 1).otherwise(-1)
    parts = texts.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("token"))
    # hash each token of a text once
    counted = parts.groupBy("id", "token").agg(F.count("*").alias("n"))
    sums = counted.groupBy("id", (h % dim).alias("bucket")).agg(F.sum(sign * F.col("n")).alias("s")).where("s <> 0")
    norm = sums.groupBy("id").agg(F.sqrt(F.sum((F.col("s") * F.col("s")).cast("double"))).alias("norm"))
    return sums.join(norm, "id").select("id", "bucket", (F.col("s") / F.col("norm")).alias("weight"))
