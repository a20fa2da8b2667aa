"""Words and word shingles of whole texts as 64-bit hashes, batch by batch.

Text is handled as UTF-8 bytes: ``bytes.lower`` changes A-Z only and
``bytes.split`` cuts at exactly space and 0x09-0x0D, so words are runs of
``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


class _Hashes(dict):
    """Word to hash; emptied when full, so its memory is bounded."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def digest(data: bytes) -> bytes:
    """128 bits of a text or of numbered words."""
    return xxhash.xxh128_digest(data)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_lower(text: bytes) -> list[bytes]:
    return text.lower().split()


def split_alnum(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def hashed(texts: list[bytes], split=split_lower) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and the number of words of each text."""
    words: list[bytes] = []
    lens = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = split(text)
        lens[i] = len(own)
        words += own
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), lens


def windows(flat: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and position of every run of ``k`` words that lies inside one text."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + flat[j : j + n]
    doc = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    inside = np.flatnonzero(pos[:n] + k <= lens[doc[:n]])
    return mix(h[inside]), doc[inside], pos[inside]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles: hashes ascending within each text, their text numbers, and set sizes.

    A text of one to ``k - 1`` words has its whole sequence as its only
    shingle; a text without words has the empty set.
    """
    flat, lens = hashed(texts)
    h, doc, _ = windows(flat, lens, k)
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        starts = np.cumsum(lens) - lens
        own = np.array(
            [xxhash.xxh64_intdigest(flat[starts[i] : starts[i] + lens[i]].tobytes(), seed=k) for i in short], np.uint64
        )
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, doc, np.bincount(doc, minlength=len(texts))


def frugal(run):
    """A function on batches that gives memory back to the system when its task ends; workers live on and share an executor's memory."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in parts of about ``limit`` bytes of text (a longer text is a part by itself), with the texts as bytes; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0)), dtype=np.int64)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start).cast(pa.binary()).fill_null(b"").to_pylist()
        start = stop


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
