"""Phrase collocations by truncated suffixes (suffix-sigma, Berberich and Bedathur, 2013).

Every word of a piece begins a suffix of at most five words.  Suffixes are
summed up where they arise, dealt by language and first word, sorted in
reverse lexicographic order, and one stack counts all their prefixes.  The
parts of the phrases that are frequent are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .words import frugal, mix, slices

LONGEST = 5
#: Lower-cases A-Z and makes every separator a full stop, which no word can hold.
STOPS = bytes(46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Pairs of words fall into 2^28 counters; they only tell which pairs can't be frequent.
BITS, PART_BITS = 28, 18
#: First words with more than this share of all words are dealt further, by the words after them.
HOT, SALTS = 1 / 1024, 64
#: Bytes of text that are handled at once; longer texts are parted at separators.
AT_ONCE = 12 << 20
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: In a sorted suffix a byte below all others stands between words; the two bytes that it could be taken for are written as two.
CODES = ((b"\x01", b"\x01\x03"), (b"\x00", b"\x01\x02"))


class _Ids(dict):
    """Word to number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _segments(text: bytes) -> Iterator[bytes]:
    """A prepared text in parts of about AT_ONCE bytes, cut at separators."""
    start = 0
    while len(text) - start > AT_ONCE:
        cut = text.rfind(b".", start, start + AT_ONCE)
        if cut < 0:
            cut = text.find(b".", start + AT_ONCE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def _numbered(batches) -> Iterator[tuple[str, _Ids, np.ndarray, np.ndarray]]:
    """For texts of one language: the language, the numbers of its words, the number of every word in order (0 is a separator), and the words' hashes."""
    for batch in batches:
        for own, texts in slices(batch, limit=AT_ONCE):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(own.column("lang").to_pylist(), texts):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                for segment in _segments(b".".join(some).translate(STOPS)):
                    ids = _Ids({b".": 0})
                    words = segment.replace(b".", b" . ").split()
                    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                    del words
                    seed = xxhash.xxh32_intdigest(lang.encode())
                    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in ids), np.uint64, len(ids))
                    yield lang, ids, at, hashes


def _pairs(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter of each neighbouring pair, and whether both are words."""
    a, b = at[:-1], at[1:]
    return mix(hashes[a] * PAIR + hashes[b]) >> np.uint64(64 - BITS), (a > 0) & (b > 0)


def _coded(word: bytes) -> bytes:
    for plain, code in CODES:
        word = word.replace(plain, code)
    return word


def _plain(word: bytes) -> str:
    for plain, code in reversed(CODES):
        word = word.replace(code, plain)
    return word.decode()


@frugal
def _count_pairs(batches):
    """Rows of ``part, counts``: the counters of pairs in these texts, as numbers within the part and counts up to 255; of ``lang, word, n`` for words that are common here; and ``lang, n`` for all of them."""
    for lang, ids, at, hashes in _numbered(batches):
        bucket, ok = _pairs(at, hashes)
        words, often = list(ids), np.bincount(at, minlength=len(ids))
        often[0] = 0
        found, n = np.unique(bucket[ok], return_counts=True)
        part = (found >> np.uint64(PART_BITS)).astype(np.int32)
        inside = (found & np.uint64((1 << PART_BITS) - 1)).astype("<u4")
        n = np.minimum(n, 255).astype(np.uint8)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2)) if len(part) else np.zeros(1, np.int64)
        blobs = [inside[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])]
        total = int(often.sum())
        common = [(words[i].decode(), int(often[i])) for i in np.flatnonzero(often * 2048 >= max(total, 1))]
        k, m = len(blobs), len(common) + 1
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([*part[edges[:-1]].tolist(), *[None] * m], pa.int32()),
                "counts": pa.array([*blobs, *[None] * m], pa.binary()),
                "lang": pa.array([*[None] * k, *[lang] * m], pa.string()),
                "word": pa.array([*[None] * k, *(w for w, _ in common), None], pa.string()),
                "n": pa.array([*[None] * k, *(c for _, c in common), total], pa.int64()),
            }
        )


def _sum_pairs(least: int):
    """Rows of ``part, bits``: which counters of a part reach ``least``; one part's counters are held at a time."""

    @frugal
    def run(batches):
        now, sums = None, None

        def out():
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(sums >= least).tobytes()], pa.binary())})

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                if part != now:
                    if now is not None:
                        yield out()
                    now, sums = part, np.zeros(1 << PART_BITS, np.int32)
                k = len(blob) // 5
                at = np.frombuffer(blob, "<u4", k)
                n = np.frombuffer(blob, np.uint8, k, 4 * k)
                sums[at] = np.minimum(sums[at] + np.where(n == 255, least, n), least)
        if now is not None:
            yield out()

    return run


def _suffixes(frequent, hot: dict[str, list[bytes]]):
    """Rows of ``lang, key, suffix, n``: suffixes that end before the first pair that can't be frequent, summed up within the texts at hand."""

    @frugal
    def run(batches):
        bits = np.frombuffer(frequent.value, np.uint8)
        for lang, ids, at, hashes in _numbered(batches):
            bucket, ok = _pairs(at, hashes)
            ok &= (bits[(bucket >> np.uint64(3)).astype(np.int64)] >> (7 - (bucket & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            ok = np.concatenate([ok, np.zeros(LONGEST, bool)])
            more = np.zeros(len(at), np.int8)
            run_ = np.ones(len(at), bool)
            for j in range(LONGEST - 1):
                run_ &= ok[j : j + len(at)]
                more += run_
            alone = np.bincount(at[more == 0], minlength=len(ids))
            alone[0] = 0
            first = np.flatnonzero(alone)
            start = np.flatnonzero(more)
            grid = np.zeros((len(start), LONGEST), np.int64)
            for j in range(LONGEST):
                has = more[start] >= j
                grid[has, j] = at[start[has] + j]
            keys = (grid[:, 4], grid[:, 2] << 32 | grid[:, 3], grid[:, 0] << 32 | grid[:, 1])
            order = np.lexsort(keys)
            grid = grid[order]
            new = np.ones(len(grid), bool)
            new[1:] = (grid[1:] != grid[:-1]).any(axis=1)
            edges = np.flatnonzero(new)
            n = np.diff(np.append(edges, len(grid)))
            grid = np.concatenate([grid[edges], np.column_stack([first, *[np.zeros_like(first)] * (LONGEST - 1)])])
            n = np.concatenate([n, alone[first]])
            often = np.zeros(len(ids), bool)
            often[[ids[w] for w in hot.get(lang, ()) if w in ids]] = True
            rest = np.zeros(len(grid), np.uint64)
            for j in range(1, LONGEST):
                rest = mix(rest * PAIR + np.where(grid[:, j] > 0, hashes[grid[:, j]], np.uint64(0)))
            salt = np.where(often[grid[:, 0]], rest % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
            key = mix(hashes[grid[:, 0]] + salt * PAIR)
            text = pa.array([_coded(w) for w in ids], pa.binary())
            for a in range(0, len(grid), 100_000):
                some = grid[a : a + 100_000]
                columns = [text.take(pa.array(some[:, j], mask=some[:, j] == 0)) for j in range(LONGEST)]
                suffix = pa.compute.binary_join_element_wise(*columns, b"\x00", null_handling="skip")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(key[a : a + 100_000].view(np.int64)), suffix, pa.array(n[a : a + 100_000], pa.int64())],
                    names=["lang", "key", "suffix", "n"],
                )

    return run


def _prefixes(least: int, hot: dict[str, list[bytes]]):
    """Rows of ``lang, phrase, k, n``: every prefix of the sorted suffixes with its count.

    One stack holds the words of the open prefix with a count for each
    length.  A suffix first closes what it doesn't share with the one before;
    a closed prefix hands its count on to the one that is a word shorter.
    Suffixes of a first word that wasn't dealt further are all here, so its
    counts are only handed on from ``least``.
    """

    @frugal
    def run(batches):
        path: list[str] = []
        counts: list[int] = []
        lang, partial = "", False
        before: list[bytes] = []
        out: list[tuple[str, str, int, int]] = []

        def close(depth: int) -> None:
            while len(counts) > depth:
                n = counts.pop()
                if counts:
                    counts[-1] += n
                if partial or n >= least:
                    out.append((lang, " ".join(path), len(path), n))
                path.pop()

        dealt = {(name, word.decode()) for name, some in hot.items() for word in some}
        for batch in batches:
            langs, n = batch.column("lang").to_pylist(), batch.column("n").to_pylist()
            for name, suffix, count in zip(langs, batch.column("suffix").to_pylist(), n):
                words = suffix.split(b"\x00")
                depth = 0
                if name == lang:
                    for x, y in zip(words, before):
                        if x != y:
                            break
                        depth += 1
                close(depth)
                for word in words[depth:]:
                    path.append(_plain(word) if b"\x01" in word else word.decode())
                    counts.append(0)
                lang, before = name, words
                if not depth:
                    partial = (lang, path[0]) in dealt
                counts[-1] += count
            if out:
                yield _counted(out)
                out.clear()
        close(0)
        if out:
            yield _counted(out)

    return run


def _counted(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    lang, phrase, k, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "k", "n"])


def phrase_counts(docs: DataFrame, least: int = 100) -> DataFrame:
    """``lang, phrase, k, n``: phrases of 1 to 5 words that occur ``least`` times or more, and all words of a language as ``k`` 0.

    A phrase of two words or more is only frequent if all its pairs are.  A
    first pass puts pairs into 2^28 counters of fixed size, whose counts are
    never too small, so suffixes may end before a pair whose counter stays
    below ``least``: counts stay exact.  Past some 20 billion words the
    counters rule little out; then more suffixes are dealt, of at most five
    words for each word of the corpus.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "phrases")
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), "text")
    seen = tables.save(rows.mapInArrow(_count_pairs, "part int, counts binary, lang string, word string, n long"), batch=2_000)
    bits = seen.where("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part")
    bits = tables.save(bits.mapInArrow(_sum_pairs(min(least, 1 << 20)), "part int, bits binary"))
    pieces = {r["part"]: bytes(r["bits"]) for r in bits.collect()}  # 32 MB at most
    empty = bytes((1 << PART_BITS) // 8)
    frequent = spark.sparkContext.broadcast(b"".join(pieces.get(i, empty) for i in range(1 << (BITS - PART_BITS))))
    total = seen.where("part is null and word is null").agg(F.sum("n")).first()[0] or 0
    common = seen.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") > total * HOT).select("lang", "word").collect()  # 1,024 at most
    whole = tables.save(seen.where("part is null and word is null").groupBy("lang").agg(F.sum("n").alias("n")))
    tables.drop(seen, bits)
    hot: dict[str, list[bytes]] = {}
    for r in common:
        hot.setdefault(r["lang"], []).append(r["word"].encode())
    dealt = rows.mapInArrow(_suffixes(frequent, hot), "lang string, key long, suffix binary, n long")
    dealt = dealt.repartition("key").sortWithinPartitions(F.desc("key"), F.desc("lang"), F.desc("suffix"))
    counts = dealt.mapInArrow(_prefixes(least, hot), "lang string, phrase string, k int, n long")
    counts = counts.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return tables.save(counts.unionByName(whole.select("lang", F.lit("").alias("phrase"), F.lit(0).alias("k"), "n")))


def collocations(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """The ``first`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts a phrase of two to five words, ``n`` all words of the
    language; the cut after k words that scores lowest counts (ties: smallest
    k), with ``l`` and ``r`` the counts of its parts and ``score``
    floor(1000 a n / (l r)), all exact.  Phrases inside a longer one that is
    as frequent are left out.  Ties: larger ``a``, then the phrase in UTF-8
    order.

    ``docs`` has ``text`` and ``lang``; other columns don't matter.  Null
    texts are empty, a null language is ``und``; equal rows count each; an
    empty table gives no rows.  Texts of any length are read whole, in parts
    cut at separators.
    """
    counts = phrase_counts(docs, least)
    c = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    # a phrase inside any longer one that is as frequent is inside one that is a word longer and as frequent
    split = F.split("phrase", " ")
    wider = c.where("k >= 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice(split, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    wider = wider.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = c.join(wider, ["lang", "phrase"], "left").where("within is null or within < a").drop("within")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(split, F.lit(1), F.col("cut")), " "), "right": F.array_join(F.slice(split, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    parts = counts.where("k >= 1")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    words = counts.where("k = 0").select("lang", "n")
    whole = "decimal(38,0)"
    scored = cuts.join(words, "lang").withColumn("score", F.expr(f"cast(1000 * a as {whole}) * n div (cast(l as {whole}) * r)").cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "n", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within shares of a language, so that no task sorts a language alone
    near = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= first)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
