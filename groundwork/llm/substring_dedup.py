"""Substring dedup: paragraph MinHash banding, verification, and clusters of removals by components.

A paragraph is a window of words that starts at an anchor chosen from the
words themselves (the least shingle hash among its neighbours), so every
passage of ``min_words`` words contains a whole paragraph wherever it stands
and however a text is broken into lines.  MinHash bands of a paragraph's
shingles are joined; where paragraphs collide, all runs of ``min_words`` words
around them, as they are and with any one word left out, are joined by their
hashes.  A run is compared with the smallest text that has it, so the work
grows with the text and not with the square of a group.  What meets is
verified word by word by the exact Jaccard similarity of aligned runs.

Texts are read once: words become 32-bit numbers in a table of their own.
Places are ``text << PLACE | word << 1 | open``, texts are numbered in the order
of their ids; a place is open until a passage holds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .components import connected_components
from .scratch import Scratch

SHINGLE = 5
#: Bits of a place that number the words of a text, and one more.
PLACE = 27
#: Rows with passages that are broadcast, at most, each passage counted.
WANTED = 250_000
#: Rows with texts or word lists that are handed to Python at once.
BATCH = 500


def tune(threshold: float, recall: float) -> tuple[int, int]:
    """Bands and rows per band: the fewest bands that find a pair at ``threshold`` with probability ``recall``, then the most rows."""
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), -r) for r in range(1, 9)]
    bands, rows = min(fits)
    return bands, -rows


class Lengths:
    """What follows from ``min_words``: paragraphs, and the runs that a passage with one substituted word must hold exactly."""

    def __init__(self, min_words: int, threshold: float):
        self.run = min_words
        shingles = max(1, min_words - SHINGLE + 1)
        #: Equal shingles of a run that reaches the threshold.
        self.need = math.ceil(2 * threshold / (1 + threshold) * shingles - 1e-9)
        #: A passage of min_words words holds a paragraph: gap and paragraph add up to it.
        self.gap = max(1, min_words * 22 // 50)
        self.paragraph = max(SHINGLE, min_words - self.gap)
        #: Of a run with one word substituted, the longer part has half the rest; it holds one of ``near`` neighbouring seeds.
        self.half = min_words // 2
        self.seed = max(SHINGLE, self.half - SHINGLE)
        self.near = max(1, self.half - self.seed + 1)
        #: Whether one substituted word leaves a run above the threshold.
        self.loose = shingles - self.need >= SHINGLE and min_words >= 4 * SHINGLE


def _smallest(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Position of the smallest of ``n`` values from each position in ``at``; the first of equals."""
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 15):
        some = at[i : i + (1 << 15)]
        out[i : i + (1 << 15)] = some + x[some[:, None] + np.arange(n)].argmin(1)
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as 32-bit numbers, and two hashes of them all."""
    for batch in batches:
        for part, texts in words.slices(batch):
            flat, lens = words.hashed(texts)
            flat = flat.astype(np.uint32)
            ends = 4 * np.cumsum(lens)
            data = flat.tobytes()
            own = [data[b - 4 * n : b] for b, n in zip(ends.tolist(), lens.tolist())]
            keys = [words.digest(x) for x in own]
            get = lambda c: part.column(part.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays([get("row"), get("id"), get("h"), pa.array(keys, pa.binary()), pa.array(lens), pa.array(own, pa.binary())], ["row", "id", "h", "key", "n", "w"])


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, all words one text after the other, and the number of words of each text, from columns ``doc`` and ``w``."""
    w = part.column(part.schema.get_field_index("w"))
    offsets = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64)
    data = np.frombuffer(w.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(w) and w.buffers()[2] else np.empty(0, np.uint8)
    return np.asarray(part.column(part.schema.get_field_index("doc"))), words.mix(np.frombuffer(data.tobytes(), "<u4").astype(np.uint64) + np.uint64(1)), np.diff(offsets) // 4


def _parts(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``limit`` bytes of column ``w``."""
    for batch in batches:
        size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(batch.schema.get_field_index("w")))), dtype=np.int64)
        start = 0
        while start < len(batch):
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _places(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, open_=1) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words.int64(key), pa.array(doc << PLACE | pos << 1 | open_)], ["key", "at"])


def band_keys(flat: np.ndarray, lens: np.ndarray, size: Lengths, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band key, text number and word position for the paragraphs of all texts, each combination once."""
    h, doc, pos = words.windows(flat, lens, SHINGLE)
    n = size.paragraph - SHINGLE + 1
    inside = np.flatnonzero((doc[: max(0, len(h) - size.gap + 1)] == doc[size.gap - 1 :]) & (lens[doc[: max(0, len(h) - size.gap + 1)]] >= size.run))
    anchors = np.unique(_smallest(words.mix(h + words.BASE), inside, size.gap))
    anchors = anchors[anchors + n <= len(h)]
    anchors = anchors[doc[anchors] == doc[anchors + n - 1]]
    keys, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for band in range(bands):
        key, first = np.full(len(anchors), band, np.uint64), None
        for row in range(rows):
            own = words.mix(h ^ words.mix(np.array([band * rows + row + 1], np.uint64)))
            least = _smallest(own, anchors, n)
            key = words.mix(key + own[least])
            first = least if first is None else first
        order = np.lexsort((key, first))
        k, f = key[order], first[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])][: len(k)]
        keys.append(k[new])
        at.append(f[new])
    at = np.concatenate(at)
    return np.concatenate(keys), doc[at], pos[at]


def _bands(size: Lengths, bands: int, rows: int):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids, flat, lens = _flat(part)
            key, doc, pos = band_keys(flat, lens, size, bands, rows)
            yield _places(key, ids[doc], pos)

    return run


def _listed(part: pa.RecordBatch, lens: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and word of each place in the column, and whether it's open."""
    lists = part.column(part.schema.get_field_index(column))
    at = lists.flatten().to_numpy(zero_copy_only=False) & ((1 << PLACE) - 1)
    return np.repeat(np.arange(len(lens)), np.asarray(lists.value_lengths().fill_null(0))), at >> 1, at & 1


def _around(part: pa.RecordBatch, lens: np.ndarray, column: str, before: int, after: int) -> np.ndarray:
    """Whether a word of all texts lies from ``before`` places before to ``after`` places after one in the column."""
    row, at, _ = _listed(part, lens, column)
    start = np.cumsum(lens) - lens
    mark = np.zeros(int(lens.sum()) + 1, np.int64)
    np.add.at(mark, start[row] + np.maximum(at - before, 0), 1)
    np.add.at(mark, start[row] + np.minimum(at + after + 1, lens[row]), -1)
    return np.cumsum(mark)[:-1] > 0


def _seeds(size: Lengths):
    """Selected runs of ``seed`` words near the places in ``near``: among ``size.near`` neighbours, the least hash."""

    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids, flat, lens = _flat(part)
            h, doc, pos = words.windows(flat, lens, size.seed)
            inside = np.flatnonzero(doc[: max(0, len(h) - size.near + 1)] == doc[size.near - 1 :])
            near = _around(part, lens, "places", size.seed, SHINGLE)
            start = np.cumsum(lens) - lens
            inside = inside[near[start[doc[inside]] + pos[inside]] | near[start[doc[inside]] + pos[inside] + size.near - 1]]
            at = np.unique(_smallest(h, inside, size.near))
            yield _places(h[at], ids[doc[at]], pos[at])

    return run


class _Ranges:
    """Hashes of ranges of words in constant time each, equal wherever the words stand."""

    def __init__(self, flat: np.ndarray):
        n = len(flat) + 1
        inverse = np.uint64(pow(int(words.BASE), -1, 1 << 64))
        power = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)
        self.total = np.r_[np.uint64(0), np.cumsum(flat * power(words.BASE)[:-1], dtype=np.uint64)]
        self.back = power(inverse)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return words.mix((self.total[b] - self.total[a]) * self.back[a])

    def without(self, a: np.ndarray, s: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words from ``a`` to ``b`` but for those from ``s`` to ``t``."""
        return words.mix(self(a, s) * words.BASE + words.mix(self(t, b) + (s - a).astype(np.uint64)))


def _runs(size: Lengths):
    """All runs of ``run`` words that hold a seed in ``places``."""

    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            ids, flat, lens = _flat(part)
            h, doc, pos = words.windows(flat, lens, size.run)
            near = _around(part, lens, "places", size.run - size.seed, 0)
            at = np.flatnonzero(near[(np.cumsum(lens) - lens)[doc] + pos])
            yield _places(h[at], ids[doc[at]], pos[at])

    return run


def _coarse(size: Lengths, step: int) -> list[tuple[int, int, int, int]]:
    """Windows around a seed and a chunk of each to leave out (start, end, chunk's start and end): two runs that hold the seed and differ in one word agree in one of them."""
    rest = size.run - size.seed
    wide = size.run - step
    out = []
    for back in sorted({min(b, wide - size.seed) for b in range(0, rest + 1, step)}):
        # a substituted word has a whole shingle on either side, so it's none of the window's ends
        edge = max(0, SHINGLE - step)
        spare = np.array([i for i in range(edge - back, wide - back - edge) if not 0 <= i < size.seed])
        for part in np.array_split(spare, -(-len(spare) // SHINGLE)):
            # a chunk that the seed parts in two is two chunks
            for chunk in np.split(part, np.flatnonzero(np.diff(part) > 1) + 1):
                s, t = int(chunk[0]), int(chunk[-1]) + 1
                # the word next to a chunk of at most a shingle is in the shingle next to the substituted word
                out.append((min(-back, s - 1), max(wide - back, t + 1), s, t))
    return out


def _first(part: pa.RecordBatch, lens: np.ndarray, size: Lengths):
    """Whether the words from ``a`` to ``b`` (in all texts) lie in no run that a smaller text has: that text stands for them."""
    row, at, _ = _listed(part, lens, "held")
    mark = np.zeros(int(lens.sum()) + 1, np.int64)
    mark[(np.cumsum(lens) - lens)[row] + at] = 1
    total = np.r_[0, np.cumsum(mark)]
    return lambda row, a, b: total[a + 1] == total[np.minimum(a, np.maximum((np.cumsum(lens) - lens)[row], b - size.run))]


def _follows(size: Lengths, step: int, before: int) -> np.ndarray:
    """For each window of the step ``before`` the bits of those of ``step`` that the same substituted word may leave alike."""

    def may(x, y) -> bool:
        (a, b, s, t), (c, d, u, v) = x, y
        return max(b, d) - min(a, c) <= size.run and (max(s, u) < min(t, v) or u < a or v > b)

    return np.array([sum(1 << i for i, y in enumerate(_coarse(size, step)) if may(x, y)) for x in _coarse(size, before)], np.uint64)


def _coarse_keys(size: Lengths, step: int, before: int | None = None):
    """Windows around the seeds in ``places``; after the step ``before``, only those that its windows in ``numbers`` leave."""
    windows = _coarse(size, step)
    assert len(windows) < 64
    follows = _follows(size, step, before) if before else None

    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1 << 20):
            ids, flat, lens = _flat(part)
            row, at, open_ = _listed(part, lens, "places")
            start, ranges, first = np.cumsum(lens) - lens, _Ranges(flat), _first(part, lens, size)
            bits = np.full(len(at), (1 << len(windows)) - 1, np.uint64)
            if follows is not None and len(at):
                order = np.lexsort((open_, at, row))
                row, at, open_ = row[order], at[order], open_[order]
                own = follows[part.column(part.schema.get_field_index("numbers")).flatten().to_numpy(zero_copy_only=False)[order]]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]) | (open_[1:] != open_[:-1])])
                row, at, open_, bits = row[new], at[new], open_[new], np.bitwise_or.reduceat(own, new)
            for number, (a, b, s, t) in enumerate(windows):
                ok = np.flatnonzero((at + a >= 0) & (at + b <= lens[row]) & (bits >> np.uint64(number) & np.uint64(1)).astype(bool))
                o = (start[row] + at)[ok]
                new = first(row[ok], o + a, o + b)
                ok, o = ok[new], o[new]
                key = words.mix(ranges.without(o + a, o + s, o + t, o + b) + np.uint64(number))
                yield pa.RecordBatch.from_arrays([*_places(key, ids[row[ok]], at[ok], open_[ok]).columns, pa.array(np.full(len(ok), number, np.int32))], ["key", "at", "number"])

    return run


def _loose_keys(size: Lengths, step: int):
    """Every run around the windows numbered in ``numbers`` without one word of the window's chunk."""
    windows = _coarse(size, step)
    edge = size.run - SHINGLE

    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1 << 20):
            ids, flat, lens = _flat(part)
            rows, places, open_ = _listed(part, lens, "places")
            numbers = part.column(part.schema.get_field_index("numbers")).flatten().to_numpy(zero_copy_only=False)
            start, ranges, first = np.cumsum(lens) - lens, _Ranges(flat), _first(part, lens, size)
            each = [np.empty(0, np.int64)]
            for number in np.unique(numbers).tolist():
                a, b, s, t = windows[number]
                dx, ds = (x.ravel() for x in np.meshgrid(np.arange(b - size.run, a + 1), np.arange(s, t), indexing="ij"))
                dx, ds = dx[(ds - dx >= SHINGLE) & (ds - dx < edge)], ds[(ds - dx >= SHINGLE) & (ds - dx < edge)]
                own = np.flatnonzero(numbers == number)
                row, at = np.repeat(rows[own], len(dx)), (places[own][:, None] + dx).ravel()
                gap, flag = np.tile(ds - dx, len(own)), np.repeat(open_[own], len(dx))
                ok = (at >= 0) & (at + size.run <= lens[row])
                each.append(np.unique(((start[row[ok]] + at[ok]) * size.run + gap[ok]) * 2 + flag[ok]))
            each = np.unique(np.concatenate(each))
            for i in range(0, len(each), 1 << 17):
                both, own = each[i : i + (1 << 17)] // 2, each[i : i + (1 << 17)] % 2
                x, gap = both // size.run, both % size.run
                row = np.searchsorted(start, x, "right") - 1
                new = first(row, x, x + size.run)
                x, gap, row, own = x[new], gap[new], row[new], own[new]
                key = ranges.without(x, x + gap, x + gap + 1, x + size.run)
                yield _places(key, ids[row], x - start[row], own)

    return run


def runs_alike(same: np.ndarray, size: Lengths) -> list[tuple[int, int]]:
    """Stretches of aligned words in which every word lies in a run of ``size.run`` words that begins and ends with equal shingles and reaches the threshold, and the equal words next to them."""
    n = len(same) - size.run + 1
    if n <= 0:
        return []
    total = np.r_[0, np.cumsum(same)]
    match = total[SHINGLE:] - total[:-SHINGLE] == SHINGLE
    count = np.r_[0, np.cumsum(match)]
    wide = size.run - SHINGLE + 1
    good = (count[wide:] - count[:-wide] >= size.need) & match[:n] & match[wide - 1 :]
    at = np.flatnonzero(good)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > size.run)
    start, end = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + size.run
    other = np.r_[-1, np.flatnonzero(~same), len(same)]
    start, end = other[np.searchsorted(other, start) - 1] + 1, other[np.searchsorted(other, end)]
    keep = np.r_[True, start[1:] != start[:-1]]
    return list(zip(start[keep].tolist(), end[np.r_[np.flatnonzero(keep)[1:] - 1, len(end) - 1]].tolist()))


def _verify(size: Lengths):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            mine, theirs = get("wa").to_pylist(), get("wb").to_pylist()
            rows = []
            for a, b, doc, kept, shift, lo, klo in zip(mine, theirs, *(get(c).to_pylist() for c in ("doc", "kept", "shift", "lo", "klo"))):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                start, stop = max(lo, klo + shift), min(lo + len(a), klo + shift + len(b))
                if stop - start >= size.run:
                    same = a[start - lo : stop - lo] == b[start - shift - klo : stop - shift - klo]
                    rows += [(doc, start + s, start + e, kept, start + s - shift, start + e - shift) for s, e in runs_alike(same, size)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start_word", "end_word", "kept", "kept_start_word", "kept_end_word"])

    return run




def _doc(place: str = "at"):
    return F.shiftright(place, PLACE)


def _pos(place: str = "at"):
    return F.shiftright(F.col(place).bitwiseAND((1 << PLACE) - 1), 1)


_FOUND = "doc long, start_word long, end_word long, kept long, kept_start_word long, kept_end_word long"


def _shared(tables: Scratch, rows: DataFrame) -> DataFrame:
    """Keys of an open place that a smaller text has too, with their smallest place.  A key's rows are summed up before they move, so it may hold any share of them."""
    open_ = F.when(F.col("at").bitwiseAND(1) == 1, F.col("at"))
    kinds = rows.groupBy("key").agg(F.min("at").alias("low"), F.max(open_).alias("high"))
    return tables.save(kinds.where(_doc("low") < _doc("high")).select("key", "low")).hint("shuffle_hash")  # far fewer than the rows, which need no sorting then


def _by_text(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_doc().alias("doc")).agg(F.collect_list("at").alias("places"))


def _met(tables: Scratch, rows: DataFrame) -> DataFrame:
    """Each open place with the smallest text that has its key."""
    return rows.where(F.col("at").bitwiseAND(1) == 1).join(_shared(tables, rows), "key").select("at", "low").where(_doc("low") < _doc())


def numbered(docs: DataFrame, tables: Scratch, id_col: str, text_col: str, least: int) -> tuple[Texts, DataFrame]:
    """Texts as numbers, one for all texts of the same words, and ``(doc, id, h, n, first_id, first)`` for every row of at least ``least`` words.

    ``doc`` counts from 0 in the order of the smallest id (null ids last), then of the words; ``h`` is the hash of the text as it is, ``first`` says that the row stands for its text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= 2 * least - 1)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("text").alias("h"), "text")
    given = tables.save(rows.mapInArrow(_number, "row long, id long, h long, key binary, n long, w binary").where(F.col("n") >= least), BATCH, "row")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "row", "h")
    kinds = given.groupBy("key").agg(F.min(order).alias("o")).select("key", F.col("o.id").alias("first_id"), F.col("o.row").alias("row"), F.col("o.h").alias("first_h"))
    kinds = tables.save(kinds.orderBy(F.col("first_id").asc_nulls_last(), "key").select("*", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33).cast("int")
    counts = {r["p"]: r["n"] for r in kinds.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each partition
    base, before = {}, 0
    for p in sorted(counts):
        base[p], before = before, before + counts[p]
    if before >= 1 << 63 - PLACE:
        raise ValueError("too many texts")
    offset = F.element_at(F.create_map(*(F.lit(x) for p in sorted(base) for x in (p, base[p]))), part) if base else F.lit(0)
    kinds = tables.save(kinds.select("key", "first_id", "first_h", "row", (F.col("m").bitwiseAND((1 << 33) - 1) + offset).cast("long").alias("doc")))
    members = given.select("id", "h", "key", "n").join(kinds.select("key", "doc", "first_id", "first_h"), "key").distinct()
    members = tables.save(members.select("doc", "id", "h", "n", "first_id", (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))).alias("first")))
    return Texts(tables, given.select("row", "w"), kinds.select("doc", "row")), members


class Texts:
    """Texts in buckets by row, so that what is known of some can be joined without moving a text."""

    def __init__(self, tables: Scratch, words_: DataFrame, rows: DataFrame):
        self.tables, self.words, self.rows = tables, words_, rows

    def join(self, some: DataFrame) -> DataFrame:
        """Rows of ``some`` (column ``doc``) with the words ``w`` of their texts."""
        return self.words.join(some.join(self.rows, "doc").hint("merge"), "row").drop("row")

    def read(self, some: DataFrame, work, schema: str = "key long, at long") -> DataFrame:
        """``work`` on the texts of ``some``."""
        return self.tables.save(self.join(some).mapInArrow(work, schema), BATCH)


def repeated_passages(docs: DataFrame, min_words: int = 50, threshold: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that a text of a smaller id also has: ``(doc_id, start_word, end_word, kept_doc_id, kept_start_word, cluster_id, text_hash)``.

    Words are lower-cased in A-Z only and cut at space and 0x09-0x0D; both
    ends count words from 0, the end exclusive.  Each word of a row lies in a
    run of ``min_words`` words whose shingles, aligned with the kept text's,
    have the Jaccard similarity ``threshold``, or follows such runs equal word by
    word.  Every run that a smaller text
    has word by word is in a row; so is one with a substituted word, where the
    threshold allows it, if paragraphs in it collide (with probability
    ``recall`` for each of similarity ``threshold``).  ``cluster_id`` names the
    component of passages that all verified pairs connect; passages inside
    another of the same text are left out.

    Texts of the same words are one; all rows but one (the smallest id, of
    equal ids the first) have a row for the whole text.  A row that repeats
    both id and text of a kept row is that row.  Rows that repeat an id with
    another text are texts of their own, told apart by ``text_hash`` (xxhash64
    of the text as it is).  Null ids count as larger than all others.  Null,
    empty and short texts have no passages; repeats inside one text are left
    alone; other columns are ignored; an empty table gives no rows.
    """
    tables = Scratch(docs.sparkSession, "substring")
    size = Lengths(min_words, threshold)
    texts, members = numbered(docs, tables, id_col, text_col, min_words)
    keys = texts.read(texts.rows.select("doc"), _bands(size, *tune(threshold, recall)))
    live = keys.join(_shared(tables, keys), "key", "left_semi")
    seeds = texts.read(_by_text(live), _seeds(size))
    tables.drop(keys)
    live = tables.save(seeds.join(_shared(tables, seeds), "key", "left_semi"))
    tables.drop(seeds)
    runs = texts.read(_by_text(live), _runs(size))
    met = tables.save(_met(tables, runs))
    tables.drop(runs)
    found = _verified(tables, texts, met, size)
    if size.loose:
        live = _flagged(tables, live, found, size)
        held = tables.save(_by_text(met).withColumnRenamed("places", "held"))
        wide, narrow = size.run // 5, max(1, min(SHINGLE - 1, size.run // 12))
        asked = _by_text(live.join(_shared(tables, live), "key", "left_semi"))
        for step, before in ((wide, None), (narrow, wide)):
            live = texts.read(asked.join(held, "doc", "left"), _coarse_keys(size, step, before), "key long, at long, number int")
            asked = live.join(_shared(tables, live), "key", "left_semi").groupBy(_doc().alias("doc")).agg(F.collect_list("at").alias("places"), F.collect_list("number").alias("numbers"))
        runs = texts.read(asked.join(held, "doc", "left"), _loose_keys(size, narrow))
        found = tables.save(found.unionByName(_verified(tables, texts, tables.save(_met(tables, runs)), size)).distinct())
        tables.drop(runs)
    tables.drop(live)
    return _clustered(found, members, tables)


def _flag(size: Lengths):
    """Seeds are open if not all runs that may hold them are in one of the passages found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for places, spans in zip(batch.column(0), batch.column(1)):
                key, at = (places.values.field(i).to_numpy() for i in (0, 1))
                if spans.is_valid:
                    start, end = (spans.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.r_[-1, np.maximum.accumulate(end[order])]
                    pos = (at & ((1 << PLACE) - 1)) >> 1
                    first = np.maximum(pos - (size.run - size.seed), 0)
                    at = at - (reach[np.searchsorted(start, first, "right")] >= pos + size.run)
                keys.append(key)
                ats.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ats))], ["key", "at"])

    return run


def _flagged(tables: Scratch, places: DataFrame, found: DataFrame, size: Lengths) -> DataFrame:
    spans = found.groupBy("doc").agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("spans"))
    rows = places.groupBy(_doc().alias("doc")).agg(F.collect_list(F.struct("key", "at")).alias("places")).join(spans, "doc", "left")
    return tables.save(rows.select("places", "spans").mapInArrow(_flag(size), "key long, at long"), BATCH)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(_doc().alias("doc"), _doc("low").alias("kept"), (_pos() - _pos("low")).alias("shift"), _pos().alias("pos"))


def _islands(met: DataFrame, size: Lengths) -> DataFrame:
    """What runs met make up: those that follow each other, or are near with the same shift.  Where words repeat over and over, shifts vary, and ``shift`` is null."""
    order = Window.partitionBy("doc", "kept").orderBy("pos", "shift")
    before = F.lag(F.struct("pos", "shift")).over(order)
    step = F.col("pos") - before["pos"]
    rows = _pairs(met).withColumn("new", F.coalesce((step > 1) & ((step > size.run) | (before["shift"] != F.col("shift"))), F.lit(True)))
    rows = rows.withColumn("island", F.count(F.when(F.col("new"), 1)).over(order)).groupBy("doc", "kept", "island")
    rows = rows.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min(F.col("pos") - F.col("shift")).alias("kfirst"), F.max(F.col("pos") - F.col("shift")).alias("klast"), F.min("shift").alias("least"), F.max("shift").alias("most"))
    return rows.select("doc", "kept", "first", "last", "kfirst", "klast", F.when(F.col("least") == F.col("most"), F.col("least")).alias("shift"))


def _verified(tables: Scratch, texts: Texts, met: DataFrame, size: Lengths) -> DataFrame:
    """The passages around runs that met: as they are, or where one shift holds, all aligned words that are alike."""
    islands = tables.save(_islands(met, size))
    whole = islands.where("shift is null").select("doc", F.col("first").alias("start_word"), (F.col("last") + size.run).alias("end_word"), "kept", F.col("kfirst").alias("kept_start_word"), (F.col("klast") + size.run).alias("kept_end_word"))
    chains = islands.where("shift is not null").groupBy("doc", "kept", "shift").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    margin = size.run
    chains = tables.save(
        chains.select(
            "doc",
            "kept",
            "shift",
            F.greatest(F.col("first") - margin, F.lit(0)).alias("lo"),
            (F.col("last") + size.run + margin).alias("hi"),
            F.greatest(F.col("first") - F.col("shift") - margin, F.lit(0)).alias("klo"),
            (F.col("last") - F.col("shift") + size.run + margin).alias("khi"),
        )
    )

    cut = lambda lo, hi: F.substring("w", F.col(lo).cast("int") * 4 + 1, (F.col(hi) - F.col(lo)).cast("int") * 4)
    both = texts.join(chains).withColumn("wa", cut("lo", "hi")).drop("w", "hi")
    both = texts.join(both.withColumnsRenamed({"doc": "own", "kept": "doc"})).withColumn("wb", cut("klo", "khi")).drop("w", "khi").withColumnsRenamed({"doc": "kept", "own": "doc"})
    alike = both.select("doc", "kept", "shift", "lo", "klo", "wa", "wb").mapInArrow(_verify(size), _FOUND)
    found = tables.save(alike.unionByName(whole), 4 * BATCH)
    tables.drop(chains, islands)
    return found


def _clustered(found: DataFrame, members: DataFrame, tables: Scratch) -> DataFrame:
    """Overlapping passages of a text are one; the removals between them connect.  Copies of a text go whole."""
    copies = tables.save(members.where("not first"))
    ends = found.select(F.col("doc").alias("d"), F.col("start_word").alias("s"), F.col("end_word").alias("e")).unionByName(
        found.selectExpr("kept as d", "kept_start_word as s", "kept_end_word as e")
    )
    ends = ends.unionByName(copies.selectExpr("doc as d", "0L as s", "n as e")).distinct()
    order = Window.partitionBy("d").orderBy("s", "e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = tables.save(
        ends.withColumn("new", F.coalesce(F.col("s") >= F.max("e").over(before), F.lit(True)))
        .withColumn("start", F.max(F.when(F.col("new"), F.col("s"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("d", "s", "e", F.xxhash64("d", "start").alias("passage"))
    )
    mine = whole.select(F.col("d").alias("doc"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("passage").alias("x"))
    kept = whole.select(F.col("d").alias("kept"), F.col("s").alias("kept_start_word"), F.col("e").alias("kept_end_word"), F.col("passage").alias("y"))
    linked = tables.save(found.join(mine, ["doc", "start_word", "end_word"]).join(kept, ["kept", "kept_start_word", "kept_end_word"]).drop("kept_end_word"))
    tables.drop(found)
    cluster = connected_components(linked, "x", "y").select(F.col("id").alias("x"), "component")
    # a passage inside another of the same text adds nothing to what can go; its link is in the cluster
    order = Window.partitionBy("doc").orderBy("start_word", F.desc("end_word"), "kept", "kept_start_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = linked.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("end_word") > F.col("reach")))
    named = tables.save(members.where("first").select("doc", F.col("id").alias("doc_id"), F.col("h").alias("text_hash")))
    smaller = named.select(F.col("doc").alias("kept"), F.col("doc_id").alias("kept_doc_id"))
    rows = rows.select("doc", "start_word", "end_word", "kept", "kept_start_word", "x").join(named, "doc").join(smaller, "kept").drop("doc", "kept")
    again = copies.select(F.col("doc").alias("d"), F.col("n").alias("e"), F.lit(0).cast("long").alias("s"), "id", "h", "first_id").join(whole, ["d", "s", "e"])
    again = again.select(F.col("id").alias("doc_id"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("first_id").alias("kept_doc_id"), F.col("s").alias("kept_start_word"), F.col("h").alias("text_hash"), F.col("passage").alias("x"))
    rows = rows.unionByName(again).join(cluster, "x", "left").withColumn("cluster_id", F.coalesce("component", "x"))
    return rows.select("doc_id", "start_word", "end_word", "kept_doc_id", "kept_start_word", "cluster_id", "text_hash")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; one break stays where words went."""
    drop: list[list[int]] = []
    for s, e in sorted(spans):
        if drop and s <= drop[-1][1]:
            drop[-1][1] = max(drop[-1][1], e)
        else:
            drop.append([s, e])
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for s, e in drop:
        if s >= len(at):
            break
        out.append(text[done : at[s][0]])
        done = at[e][0] if e < len(at) else at[-1][1]
    return b"".join(out) + text[done:]


def _cut(text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            new = [t if not s else cut_words((t or "").encode(), [(x["s"], x["e"]) for x in s]).decode() for t, s in zip(get(text).to_pylist(), get(spans).to_pylist())]
            names = [n for n in batch.schema.names if n != spans]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else get(n) for n in names], names)

    return run


def remove_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns ``doc_id`` and ``text`` among them) without the passages; rows without any stay as they are.

    A row is known by its id and the hash of its text, so rows that repeat an id with another text keep theirs, and rows without an id lose theirs.
    """
    new = "__span"
    while any(c.lower().startswith(new) for c in docs.columns):
        new += "_"
    n = passages.count()
    spans = passages.groupBy(F.col("doc_id").alias(f"{new}_id"), F.col("text_hash").alias(f"{new}_hash")).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias(f"{new}s"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{new}_id")) & (F.xxhash64(docs["text"]) == F.col(f"{new}_hash"))
    rows = docs.join(F.broadcast(spans) if n <= WANTED else spans.hint("merge"), same, "left").drop(f"{new}_id", f"{new}_hash")
    return rows.mapInArrow(_cut("text", f"{new}s"), docs.schema)
