"""Best-fit packing by patterns: non-negative least squares over the length histogram (Krell et al., 2021).

Documents become pieces of at most ``size`` tokens.  Patterns of a few lengths
that fill a sequence are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what remains is
packed best fit, longest first, on counts of equal pieces.  The plan depends
on the histogram alone (``size`` numbers), so the driver's part doesn't grow
with the corpus.
"""

from __future__ import annotations

import bisect
import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .scratch import Scratch

#: Words whose ids a worker keeps.
KEPT = 500_000
#: Bytes of text whose words are looked up at once.
SLICE = 8 << 20
#: For each first length of a three-document pattern, so many second lengths are tried.
SECOND = 24
ROUNDS = 300
#: Pieces of one length that are numbered in one task, at most about this many.
NUMBERED = 2_000


#: Punctuation that ends a word after such a letter or an ASCII digit is tokenized by itself in any case.
_TAIL = b",.;:!?#%&$*|"
_ENDS = re.compile(rb"(?:[a-zA-Z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: Words of such letters alone are one pre-token each, with one end-of-word token at its end.
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def spread(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, the number of each word one text after the other, and where each text ends.

    The tokenizer drops white space and no token spans it, so the token ids of
    a text are those of its words; it lower-cases, so the case of ASCII texts
    can go where they hold no special string.
    """
    plain = [t.lower() if t.isascii() and b"<|" not in t else t for t in texts]
    offsets = np.r_[0, np.cumsum([len(t) for t in plain])].astype(np.int32)
    array = pa.StringArray.from_buffers(len(plain), pa.py_buffer(offsets), pa.py_buffer(b"".join(plain)))
    split = pa.compute.ascii_split_whitespace(array)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), np.asarray(coded.indices), np.asarray(split.offsets)[1:]


def stem(word: bytes) -> bytes:
    """The word without the punctuation at its end, where the ids of both one after the other are the whole's."""
    own = word.rstrip(_TAIL)
    return own if len(own) < len(word) and _ENDS.search(own) and b"<|" not in word else word


class WordIds:
    """Token ids of single words as little-endian bytes.  A worker keeps up to KEPT words; beyond, those that came again stay."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[bytes, bytes] = {b"": b""}
        self.again: set[bytes] = set()

    def learn(self, found: list[bytes]) -> None:
        """Make sure that all of these are in ``words``."""
        words_ = self.words
        if len(words_) > KEPT:
            words_ = self.words = {w: words_[w] for w in self.again} if len(self.again) < KEPT // 2 else {}
            words_[b""] = b""
            self.again = set()
        new = [w for w in found if w not in words_]
        self.again.update(found)
        self.again.difference_update(new)
        stems = list(map(stem, new))
        tails = [w[len(x) :] for w, x in zip(new, stems)]
        whole = [w for w in {*stems, *tails} if w not in words_]
        self._joined([w for w in whole if _LETTERS.fullmatch(w.decode())])
        self._each([w for w in whole if w not in words_])
        for w, x, tail in zip(new, stems, tails):
            words_[w] = words_[x] + words_[tail]

    def _joined(self, whole: list[bytes]) -> None:
        for at in range(0, len(whole), 512):
            some = whole[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                data, stops = ids.tobytes(), (4 * ends).tolist()
                self.words.update(zip(some, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))))

    def _each(self, whole: list[bytes]) -> None:
        for at in range(0, len(whole), 512):
            some = whole[at : at + 512]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.words[w] = np.array(e.ids, "<u4").tobytes()


@functools.lru_cache(1)
def _word_ids(file: str) -> WordIds:
    return WordIds(file)


def _pieces(file: str, size: int, end_id: int, with_ids: bool):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _word_ids(file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, texts in words.slices(batch, limit=SLICE):
                found, place, ends = spread(texts)
                ids_of.learn(found)
                own = [ids_of.words[w] for w in found]
                n = np.fromiter(map(len, own), np.int64, len(own)) // 4
                each = n[place]
                total = np.r_[0, np.cumsum(each)]
                # the ids of all words, gathered from those of the distinct ones
                at = np.repeat((np.cumsum(n) - n)[place] - total[:-1], each) + np.arange(total[-1])
                all_ = np.frombuffer(b"".join(own), "<u4")[at].tobytes()
                row, piece, start, length, crc, data = [], [], [], [], [], []
                last = 0
                for i, stop in enumerate((4 * total[ends]).tolist()):
                    ids, last = all_[last:stop] + end, stop
                    for p, at in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[at : at + 4 * size]
                        row.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            data.append(np.frombuffer(cut, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = columns + [pa.array(data, pa.list_(pa.int32()))], names + ["ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def patterns(hist: dict[int, int], size: int) -> np.ndarray:
    """Patterns of one to three lengths of the histogram that leave no room or little; zero stands for no document."""
    have = np.array(sorted(hist))
    count = np.array([hist[x] for x in have])
    room = max(1, size // 256)

    def fit(space: np.ndarray) -> np.ndarray:
        """The largest length there is in each space, or 0 if none leaves at most ``room``."""
        at = np.searchsorted(have, space, "right") - 1
        best = np.where(at >= 0, have[np.maximum(at, 0)], 0)
        return np.where((best > 0) & (space - best <= room), best, 0)

    if not len(have):
        return np.empty((0, 3), np.int64)
    two = np.c_[have, fit(size - have), np.zeros(len(have), np.int64)]
    second = np.unique(np.interp(np.linspace(0, 1, SECOND), np.cumsum(count) / count.sum(), have, left=have[0]).astype(np.int64))
    second = np.unique(have[np.minimum(np.searchsorted(have, second), len(have) - 1)])
    a, b = (x.ravel() for x in np.meshgrid(have, second))
    c = np.where(size - a - b > 0, fit(np.maximum(size - a - b, 0)), 0)
    three = np.c_[a, b, c][c > 0]
    full = np.c_[have, np.zeros((len(have), 2), np.int64)][size - have <= room]
    return np.unique(np.sort(np.concatenate([full, two[two[:, 1] > 0], three]), axis=1)[:, ::-1], axis=0)


def repeats(found: np.ndarray, hist: dict[int, int], size: int) -> np.ndarray:
    """Non-negative least squares by multiplicative updates, then rounded down within what the histogram has."""
    if not len(found):
        return np.empty(0, np.int64)
    h = np.zeros(size + 1)
    for length, n in hist.items():
        h[length] = n
    used = found > 0
    gather = lambda v: np.where(used, v[found], 0).sum(1)
    spread = lambda x: np.bincount(found[used], np.repeat(x, used.sum(1)), minlength=size + 1)
    top = gather(h)
    x = top / np.maximum(1e-9, gather(spread(np.ones(len(found)))))
    for _ in range(ROUNDS):
        x *= top / np.maximum(1e-9, gather(spread(x)))
    left, out = h.astype(np.int64), np.zeros(len(found), np.int64)
    for i in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(found[i][used[i]], return_counts=True)
        n = min(int(x[i]), int((left[lengths] // times).min()))
        if n > 0:
            out[i] = n
            left[lengths] -= n * times
    return out


def plan(hist: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Rows ``(length, first rank, first sequence, offset)`` sorted by length and rank, and the number of sequences.

    The pieces of a length have ranks 0, 1, ...; those from a row's first rank
    up to the next row's go to consecutive sequences at the same offset.
    """
    found = patterns(hist, size)
    groups: list[tuple[int, int, tuple[int, ...]]] = []  # first sequence, how many, their lengths
    left, sequences = dict(hist), 0
    for row, n in zip(found, repeats(found, hist, size)):
        if n:
            lengths = tuple(int(x) for x in row if x)
            groups.append((sequences, int(n), lengths))
            sequences += int(n)
            for x in lengths:
                left[x] -= int(n)
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}

    def put(group: tuple[int, int, tuple[int, ...]]) -> None:
        space = size - sum(group[2])
        if space not in open_:
            bisect.insort(spaces, space)
        open_.setdefault(space, []).append(group)

    for group in groups:
        put(group)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                first, many, lengths = open_[spaces[at]].pop()
                if not open_[spaces[at]]:
                    del open_[spaces.pop(at)]
                took = min(n, many)
                put((first, took, (*lengths, length)))
                if took < many:
                    put((first + took, many - took, lengths))
                n -= took
            else:
                each = size // length
                took, each = (n // each, each) if n >= each else (1, n)
                put((sequences, took, (length,) * each))
                sequences += took
                n -= took * each
    rank: dict[int, int] = {}
    rows = []
    for group in sorted(g for gs in open_.values() for g in gs):
        first, many, lengths = group
        offset = 0
        for length in lengths:
            rows.append((length, rank.get(length, 0), first, offset))
            rank[length] = rank.get(length, 0) + many
            offset += length
    assert rank == {k: v for k, v in hist.items() if v}
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequences


def _place(table, step: int):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        key = rows[:, 0] * step + rows[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (np.asarray(batch.column(names.index(c))) for c in ("length", "rank"))
            at = np.searchsorted(key, length * step + rank, "right") - 1
            kept = [c for c in names if c != "rank"]
            columns = [batch.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], [*kept, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 4096, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``: one row per piece, gapless in each sequence.

    A document is its token ids and then ``end_id``; null and empty texts are
    that one token.  Only longer documents are cut, into pieces of ``size``.
    Repeated rows and null ids are packed like any row; other columns are
    ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "packing")
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = tables.save(rows.mapInArrow(_pieces(tokenizer_file, size, end_id, with_ids), schema), 4_000)
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned, _ = plan(hist, size)
    # ranks within a length: within a salted part, after the parts before it
    parts = math.ceil(max(hist.values(), default=1) / NUMBERED)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["length", "part"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long")).drop("base", "part")
    out = ranked.select(*pieces.columns, "rank")
    step = max([1, *hist.values()]) + 1
    table = spark.sparkContext.broadcast(planned)
    return out.mapInArrow(_place(table, step), schema + ", sequence_id long, offset long")
