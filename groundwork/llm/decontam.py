"""Benchmark decontamination by spaced seeds: fixed masks that ignore some word positions.

Hashes of the masked words of test items and training texts are joined;
around each hit the two texts are aligned and the overlaps that tolerate
substituted words are measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .rows import keyed
from .scratch import Scratch
from .sizes import sized

#: 1: the word counts, 0: it is ignored.
MASKS = ("11111111", "1101011011", "1011101101", "1110010111")
#: Bits of the filter of test hashes, whatever the number of items.
FILTER = 24
#: Words kept on either side of a hit.
AROUND = 64


#: Items of so many words at most have masks of their own length too.
SHORT = 12


def own_masks(n: int) -> list[tuple[int, int, str]]:
    """Salt, first word and mask of an item of ``n`` words: all of it, or, from five words, all but one, whichever that is."""
    if n < 5:
        return [(16 * n, 0, "1" * n)]
    made = ["1" * p + "0" + "1" * (n - 1 - p) for p in range(n)]
    return [(16 * n + p, int(p == 0), mask.strip("0")) for p, mask in enumerate(made)]


def _masked(flat: np.ndarray, lens: np.ndarray, salt: int, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first position of every place where a mask lies inside a text."""
    n = len(flat) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = np.full(n, salt, np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            h = h * words.BASE + flat[at : at + n]
    inside = np.flatnonzero(pos[:n] + len(mask) <= lens[doc[:n]])
    return words.mix(h[inside]), doc[inside], pos[inside]


def seeds(flat: np.ndarray, lens: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of all masks, and of those of items of ``short`` words."""
    for number, mask in enumerate(MASKS):
        yield _masked(flat, lens, number + 1, mask)
    for n in short:
        for salt, _, mask in own_masks(n):
            yield _masked(flat, lens, salt, mask)


def _of_items(flat: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of all masks, and of its own masks in each short item."""
    yield from seeds(flat, lens)
    for n in range(1, SHORT + 1):
        if (lens == n).any():
            for salt, first, mask in own_masks(n):
                h, doc, pos = _masked(flat, lens, salt, mask)
                own = (lens[doc] == n) & (pos == first)
                yield h[own], doc[own], pos[own]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in words.slices(batch):
            for h, doc, pos in _of_items(*words.hashed(texts, words.split_alnum)):
                yield pa.RecordBatch.from_arrays([words.int64(h), part.column(0).take(pa.array(doc)), pa.array(pos.astype(np.int32))], ["seed", "item", "ipos"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in words.slices(batch):
            flat, lens = words.hashed(texts, words.split_alnum)
            offsets = pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, words.int64(flat))], ["item", "iwords"])


def _filter_bits(items: DataFrame) -> np.ndarray:
    """Bits of all test hashes, gathered as at most 2**FILTER / 64 numbers."""
    bit = F.explode(F.array(F.shiftrightunsigned("seed", 64 - FILTER), F.shiftrightunsigned("seed", 16).bitwiseAND((1 << FILTER) - 1)))
    rows = (
        items.select(bit.alias("i"))
        .groupBy(F.shiftright("i", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (FILTER - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["bits"]
    return out


def _hits(bits, short: tuple[int, ...]):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value.view(np.uint8), bitorder="little").view(bool)
        low = np.uint64((1 << FILTER) - 1)
        for batch in batches:
            for part, texts in words.slices(batch):
                flat, lens = words.hashed(texts, words.split_alnum)
                found = []
                for h, doc, pos in seeds(flat, lens, short):
                    at = np.flatnonzero(table[(h >> np.uint64(64 - FILTER)).astype(np.int64)])
                    at = at[table[(h[at] >> np.uint64(16) & low).astype(np.int64)]]
                    found.append((h[at], doc[at], pos[at]))
                if not found or not sum(len(x[0]) for x in found):
                    continue
                h, doc, pos = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((pos, doc))
                h, doc, pos = h[order].view(np.int64), doc[order], pos[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(pos) > 2 * AROUND)])
                ends = np.cumsum(lens)
                rows = []
                for a, b in zip(first, np.r_[first[1:], len(h)]):
                    d = doc[a]
                    lo, hi = max(0, pos[a] - AROUND), min(lens[d], pos[b - 1] + AROUND)
                    start = ends[d] - lens[d]
                    rows.append((d, lo, flat[start + lo : start + hi].view(np.int64), h[a:b], pos[a:b]))
                d, lo, cut, seed, place = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), pa.array(lo, pa.int64()), pa.array(cut, pa.list_(pa.int64())), pa.array(seed, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.int64()))],
                    ["doc", "lo", "dwords", "seeds", "places"],
                )

    return run


def overlap(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and number of equal words of the best stretch, where an equal word counts 1 and another -2."""
    if not len(same):
        return 0, 0, 0
    total = np.r_[0, np.cumsum(np.where(same, 1, -2))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def stretches(same: np.ndarray, least: int, identity: float) -> Iterator[tuple[int, int, int]]:
    """The best stretch and, as long as they have ``least`` equal words and ``identity`` of theirs equal, the best on either side of one found."""
    parts = [(0, len(same))]
    while parts:
        lo, hi = parts.pop()
        s, e, n = overlap(same[lo:hi])
        if e > s and n >= least and n >= identity * (e - s):
            yield lo + s, lo + e, n
            parts += [(lo, lo + s), (lo + e, hi)]


def _verify(least: int, identity: float):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            ours, theirs = get("dwords"), get("iwords")
            rows = []
            for i, (doc, item, shift, lo) in enumerate(zip(*(get(c).to_pylist() for c in ("doc", "item", "shift", "lo")))):
                a, b = ours[i].values.to_numpy(), theirs[i].values.to_numpy()
                start, stop = max(lo, shift), min(lo + len(a), shift + len(b))
                for s, e, n in stretches(a[start - lo : stop - lo] == b[start - shift : stop - shift], min(least, math.ceil(identity * len(b))), identity):
                    rows.append((doc, item, start + s, start + s - shift, e - s, n))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that hold part of a test item: ``(doc_id, item_id, doc_start, item_start, n_words, n_equal)``.

    Words are letters and digits, lower-cased in A-Z; other ASCII characters
    only part them.  A row is a stretch of ``n_words`` aligned words of which
    ``n_equal`` are equal: at least ``least`` (or ``identity`` of a shorter
    item) and at least ``identity`` of the stretch, with at least one mask's
    worth of equal words in place.  Stretches are looked for within AROUND
    words of a hit.  Items of up to SHORT words are found whole or, from five
    words, with any one word another; shorter items only as they are.  Texts
    of any length are read whole.  Null and empty texts and null ids give no
    rows, nor does an empty table; repeated rows and ids give equal rows once.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "decontam")
    items = benchmark.selectExpr("cast(item_id as long) as item", "text").where("item is not null")
    texts = docs.selectExpr(f"cast(`{id_col}` as long) as doc", f"`{text_col}` as text").where("doc is not null")
    planted = tables.save(items.mapInArrow(_item_seeds, "seed long, item long, ipos int").distinct())
    bits = spark.sparkContext.broadcast(_filter_bits(planted))
    item_words = items.mapInArrow(_item_words, "item long, iwords array<long>")
    size = F.size("iwords")
    short = tuple(sorted(r["n"] for r in item_words.where(size.between(1, SHORT)).select(size.alias("n")).distinct().collect()))  # SHORT at most
    hits = tables.save(texts.mapInArrow(_hits(bits, short), "doc long, lo long, dwords array<long>, seeds array<long>, places array<long>"), 4_000)
    pairs = (
        hits.select("doc", "lo", F.explode(F.arrays_zip("seeds", "places")).alias("x"))
        .select("doc", "lo", F.col("x.seeds").alias("seed"), F.col("x.places").alias("pos"))
        .join(planted, "seed")
        .select("doc", "lo", "item", (F.col("pos") - F.col("ipos")).alias("shift"))
        .distinct()
    )
    both = pairs.join(hits.select("doc", "lo", "dwords"), ["doc", "lo"]).join(item_words, "item").select("doc", "item", "shift", "lo", "dwords", "iwords")
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
    return both.mapInArrow(_verify(least, identity), schema).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id`` and ``text`` among them) without texts that hold part of a test item.

    Rows without an id and rows that share one are each judged by their own
    text; null and empty texts stay; equal rows go or stay together.
    """
    rows, key = keyed(docs)
    hit = overlaps(rows, benchmark, id_col=key, **how).select(F.col("doc_id").alias("__hit")).distinct()
    return rows.join(sized(hit), rows[key] == F.col("__hit"), "left_anti").select(*(rows[c] for c in docs.columns))
