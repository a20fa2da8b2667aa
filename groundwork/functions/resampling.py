"""Bootstrap with numpy's generator, in parts that can be drawn anywhere; rank statistics.

numpy draws ``integers(0, n)`` from a stream of 32-bit words and throws some
words away, so the place of a draw in the stream isn't known beforehand.  The
stream is counted in blocks: which words of a block are kept follows from the
words alone, and the sums of the counts before a block tell which draw it
begins with.  A task sets the generator to the block in which its first draw
lies and goes on from there; its draws are those of one generator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Words of the stream that are counted at once.
WORDS = 1 << 22
#: Messages that are hashed at once, so that all words of a step stay in a core's cache.
HASHED = 1 << 13


def kept_words(seed: int, n: int, block: int, words: int = WORDS) -> int:
    """How many words of a block become draws below ``n``."""
    bits = np.random.PCG64(seed)
    bits.advance(block * (words // 2))
    low = (bits.random_raw(words // 2).view("<u4").astype(np.uint64) * np.uint64(n)) & np.uint64(0xFFFFFFFF)
    return int(np.count_nonzero(low >= np.uint64(((1 << 32) - n) % n)))


def generator_at(seed: int, draw: int, n: int, before: list[int], words: int = WORDS) -> np.random.Generator:
    """A generator whose next ``integers(0, n)`` is draw number ``draw``; ``before`` holds the draws that stand before each counted block, from block 0."""
    block = max(0, int(np.searchsorted(before, draw, "right")) - 1)
    bits = np.random.PCG64(seed)
    bits.advance(block * (words // 2))
    generator = np.random.Generator(bits)
    skip = draw - (before[block] if before else 0)
    while skip:
        now = min(skip, words)
        generator.integers(0, n, size=now)
        skip -= now
    return generator


def resampled_means(x: np.ndarray, first: int, count: int, seed: int, before: list[int], words: int = WORDS) -> np.ndarray:
    """Means of the resamples ``first`` to ``first + count - 1`` of all values, as one generator would draw them."""
    n = len(x)
    generator = generator_at(seed, first * n, n, before, words)
    at_once = max(1, words // n)
    parts = [x[generator.integers(0, n, size=(min(at_once, count - i), n))].mean(axis=1) for i in range(0, count, at_once)]
    return np.concatenate(parts) if parts else np.zeros(0)


_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]


def md5_draws(messages: np.ndarray) -> np.ndarray:
    """The first 15 hexadecimal digits of the md5 of each row of bytes (RFC 1321), as numbers; a step is taken for all rows at once."""
    count, length = messages.shape
    padded = np.zeros((count, 64 * ((length + 8) // 64 + 1)), np.uint8)
    padded[:, :length], padded[:, length] = messages, 128
    padded[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    message = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(count, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    f, t = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for block in range(0, len(message), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:  # d ^ (b & (c ^ d))
                g = i
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:  # c ^ (d & (b ^ c))
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:  # b ^ c ^ d
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:  # c ^ (b | ~d)
                g = 7 * i % 16
                np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            shift = _SHIFTS[i // 16][i % 4]
            np.add(f, a, out=f), np.add(f, _SINES[i], out=f), np.add(f, message[block + g], out=f)
            np.left_shift(f, np.uint32(shift), out=t), np.right_shift(f, np.uint32(32 - shift), out=f), np.bitwise_or(f, t, out=f)
            a, d, c = d, c, b
            b = f + c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    high, low = (x.byteswap().astype(np.uint64) for x in state[:2])
    return ((high << np.uint64(32)) | low) >> np.uint64(4)


def _of_one_length(first: int, end: int) -> Iterator[tuple[int, int]]:
    """The numbers from ``first`` to ``end - 1`` in stretches of as many digits."""
    while first < end:
        stop = min(end, 10 ** len(str(first)))
        yield first, stop
        first = stop


def _digits(first: int, end: int) -> np.ndarray:
    """A row of ASCII digits for each of these numbers of one length."""
    powers = 10 ** np.arange(len(str(first)) - 1, -1, -1, dtype=np.int64)
    return (np.arange(first, end, dtype=np.int64)[:, None] // powers % 10 + 48).astype(np.uint8)


def hashed_means(x: np.ndarray, first: int, count: int, salt: str) -> np.ndarray:
    """Means of the resamples ``first`` to ``first + count - 1``; draw d of resample b is the value numbered md5("salt:b:d") mod n."""
    n, sums = len(x), np.zeros(count)
    start, colon = (np.frombuffer(t.encode(), np.uint8) for t in (f"{salt}:", ":"))
    for b0, b1 in _of_one_length(first, first + count):
        for d0, d1 in _of_one_length(0, n):
            each = max(1, HASHED // (d1 - d0))
            for b in range(b0, b1, each):
                named = _digits(b, min(b + each, b1))
                for d in range(d0, d1, HASHED):
                    drawn = _digits(d, min(d + HASHED, d1))
                    parts = (start, named[:, None, :], colon, drawn[None, :, :])
                    rows = np.concatenate([np.broadcast_to(p, (len(named), len(drawn), p.shape[-1])) for p in parts], axis=2)
                    at = md5_draws(rows.reshape(-1, rows.shape[2])) % np.uint64(n)
                    sums[b - first : b - first + len(named)] += x[at.astype(np.int64)].reshape(len(named), -1).sum(axis=1)
    return sums / n


def interval(means: np.ndarray, confidence: float) -> tuple[float, float]:
    tail = (1.0 - confidence) / 2.0
    low, high = np.quantile(means, [tail, 1.0 - tail])
    return float(low), float(high)


def two_sided(means: np.ndarray) -> float:
    """Twice the smaller tail beyond zero."""
    return min(1.0, 2.0 * min(float((means <= 0).mean()), float((means >= 0).mean())))


def mean_interval(values: np.ndarray, iterations: int, confidence: float, seed: int) -> tuple[float | None, float | None, float | None, int]:
    """Mean and percentile bootstrap interval; undefined values are left out."""
    x = np.asarray(values, float)
    x = x[~np.isnan(x)]
    if not len(x):
        return None, None, None, 0
    if len(x) == 1:
        return float(x[0]), float(x[0]), float(x[0]), 1
    return float(x.mean()), *interval(resampled_means(x, 0, iterations, seed, []), confidence), len(x)


def paired_test(diff: np.ndarray, iterations: int = 10_000, seed: int = 0) -> tuple[float | None, float | None, int]:
    """Mean difference and two-sided p-value of the bootstrap."""
    d = np.asarray(diff, float)
    if not len(d):
        return None, None, 0
    return float(d.mean()), two_sided(resampled_means(d, 0, iterations, seed, [])), len(d)


def normal_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))
