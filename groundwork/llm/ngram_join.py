"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sets whose sizes may reach the threshold share one of two neighbouring size
bands.  In a band, a set of a elements differs from any similar one in at most
h(a) elements.  The domain is partitioned by hash into parts of which one has
at most one difference; each part is partitioned again into two, and the
subsets of one sub-partition are enumerated, so that of N sub-partitions at
least N - h(a) agree and similar sets share a signature.

Sub-partitions with few elements would put unrelated sets that share a common
line into one group.  N is chosen so that a set has fewer of these than
N - h(a): then one that agrees isn't among them, and they need not be emitted.
A set that has more of them emits them all, so no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .components import connected_components
from .scratch import Scratch
from .sizes import sized

#: Members of a signature's group up to which all its pairs are emitted; above, pairs with one member, then the exact rest.
SMALL = 6
#: Rows that are handed to Python at once.
BATCH = 4_000
#: Rows of one signature held at once.
HELD = 1 << 16
#: Buckets of the sketch that rules pairs out before whole sets are moved.
SKETCH = 128
#: Members of a group whose sketches are compared at once, about half.
RUN = 256
#: Sets compared at once in the exact rest.
BLOCK = 256


class Bands:
    """Size bands (low to low * den / num) and for each band its N and the number of elements below which a sub-partition is thin."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.high: list[int] = [0]
        self.parts: list[int] = [1]
        self.thin: list[int] = [1]

    def differences(self, size: np.ndarray, band: np.ndarray, high: np.ndarray) -> np.ndarray:
        """h(a): the most elements in which a set differs from a similar one, where neither is above the band."""
        partner = np.minimum(size * self.den // self.num, high[band])
        return (size + partner) * (self.den - self.num) // (self.den + self.num)

    def grow(self, size: int) -> None:
        while len(self.high) < 3 or self.high[-2] < size:
            low = self.high[-1] + 1
            high = low * self.den // self.num
            self.high.append(high)
            least = max(1, -(-low * self.num // self.den))
            sizes = np.unique(np.linspace(least, high, 16).astype(np.int64))
            need = self.differences(sizes, np.zeros(len(sizes), np.int64), np.array([high])) + 1
            fewest = 2 * math.ceil(int(need.max()) / 2) if need.max() > 1 else 1
            parts, thin = fewest, 1
            for few in range(1, 6):
                n = next((n for n in range(fewest, 2 * fewest + 4) if self._enough(n, sizes, need, few)), None)
                if n is not None and (few == 1 or n <= 1.7 * fewest):
                    parts, thin = n, few
            self.parts.append(parts)
            self.thin.append(thin)

    @staticmethod
    def _enough(n: int, sizes: np.ndarray, need: np.ndarray, few: int) -> bool:
        """Whether of n sub-partitions so many that aren't thin are expected, less a standard deviation."""
        mean = sizes / n
        thin = sum(np.exp(-mean) * mean**i / math.factorial(i) for i in range(few))
        return bool((n * (1 - thin) - np.sqrt(n * thin * (1 - thin)) >= need).all())


def signatures(h: np.ndarray, doc: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets (sorted as ``words.shingle_sets`` gives them) and the number of the set of each."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    bands.grow(int(sizes.max()))
    high = np.array(bands.high)
    own = np.searchsorted(high, sizes)
    sigs, docs = [], []
    for step in (0, 1):
        band = own + step
        parts, thin = np.array(bands.parts)[band], np.array(bands.thin)[band]
        part = ((h >> np.uint64(32)) * parts[doc].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        total, d, p = np.add.reduceat(h, at), doc[at], part[at]
        full = np.diff(np.r_[at, len(h)]) >= thin[d]
        short = parts - np.bincount(d[full], minlength=len(sizes)) >= parts - bands.differences(sizes, band, high)
        full |= short[d]
        sigs.append(_signature(total[full], band[d[full]], p[full]))
        docs.append(d[full])
        for i in np.flatnonzero(short & (sizes > 0)):
            rest = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), p[d == i])
            sigs.append(_signature(np.zeros(len(rest), np.uint64), np.full(len(rest), band[i]), rest))
            docs.append(np.full(len(rest), i))
    return np.concatenate(sigs), np.concatenate(docs)


def _signature(total: np.ndarray, band: np.ndarray, part: np.ndarray) -> np.ndarray:
    return words.mix(total + words.mix(band.astype(np.uint64) << np.uint64(32) | part))


def _emit(k: int, num: int, den: int):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            for part, texts in words.slices(batch):
                ids = part.column(0)
                h, doc, sizes = words.shingle_sets(texts, k)
                known = np.asarray(ids.is_valid())
                id_ = np.asarray(ids.fill_null(0))
                sig, d = signatures(h, doc, sizes, bands)
                sig, d = sig[known[d]], d[known[d]]
                ends = np.cumsum(sizes)
                sums = [np.r_[np.uint64(0), np.cumsum(x)] for x in (h, words.mix(h))]
                same = words.mix(sums[0][ends] - sums[0][ends - sizes] + words.BASE) ^ (sums[1][ends] - sums[1][ends - sizes])
                spread = np.where(sizes > 0, same, words.mix(np.arange(len(texts), dtype=np.uint64) + words.BASE))
                yield pa.RecordBatch.from_arrays(
                    [
                        words.int64(np.concatenate([sig, spread])),
                        pa.array(np.concatenate([id_[d], id_]), mask=np.concatenate([np.zeros(len(d), bool), ~known])),
                        pa.array(np.concatenate([np.full(len(d), -1), sizes]).astype(np.int32)),
                    ],
                    ["sig", "id", "size"],
                )

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature: kind 0 candidate pairs, kind 1 members of large groups with their signature, kind 2 ids with set sizes and set hashes."""

    def table(kind: int, a, b, c=None) -> pa.RecordBatch:
        arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *arrays, pa.nulls(len(a), pa.int64()) if c is None else pa.array(c)], ["kind", "a", "b", "c"])

    def work(sig: np.ndarray, ids: np.ndarray, large: bool) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.r_[at, len(sig)])
        size = np.repeat(n, n)
        if large:
            size[: n[0]] = SMALL + 1
        keep = size > 1
        if not keep.any():
            return
        low = np.repeat(np.minimum.reduceat(ids, at), n)
        big = size > SMALL
        a, b = [ids[big]], [low[big]]
        run = np.repeat(np.arange(len(n)), n)
        for off in range(1, SMALL):
            i = np.flatnonzero((run[off:] == run[:-off]) & ~big[off:])
            a.append(ids[i])
            b.append(ids[i + off])
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = (a != b) & np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        if new.any():
            yield table(0, a[new], b[new])
        if big.any():
            yield table(1, ids[big], sig[big])

    sig, ids, large = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        size = np.asarray(batch.column(2))
        counts = np.flatnonzero(size >= 0)
        if len(counts):
            yield table(2, batch.column(1).take(pa.array(counts)), size[counts].astype(np.int64), np.asarray(batch.column(0))[counts])
        rows = size < 0
        sig = np.concatenate([sig, np.asarray(batch.column(0))[rows]])
        ids = np.concatenate([ids, np.asarray(batch.column(1).fill_null(0))[rows]])
        if not len(sig):
            continue
        last = int(np.searchsorted(sig, sig[-1]))
        if last:
            yield from work(sig[:last], ids[:last], large)
            sig, ids, large = sig[last:], ids[last:], False
        if len(sig) > HELD:
            yield from work(sig, ids, True)
            sig, ids, large = sig[:1], ids.min(keepdims=True), True
    if len(sig):
        yield from work(sig, ids, large)


def _sets(k: int):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in words.slices(batch):
                h, doc, sizes = words.shingle_sets(texts, k)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                counts = np.bincount(doc * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), minlength=len(texts) * SKETCH)
                sketch = np.minimum(counts, 255).astype(np.uint8).tobytes()
                sketches = [sketch[i : i + SKETCH] for i in range(0, len(sketch), SKETCH)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, words.int64(h)), pa.array(sketches, pa.binary())], ["id", "grams", "sketch"])

    return run


def _possible(num: int, den: int):
    """Pairs that their sketches don't rule out: counts per bucket differ by no more than the sets do."""

    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b, na, nb = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 2, 3))
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for i in (4, 5))
            differ = np.abs(one - two).sum(1, dtype=np.int64)
            keep = differ * (den + num) <= (na + nb) * (den - num)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def similar(num: int, den: int):
    """Whether the sets in columns ``ga`` and ``gb`` reach the threshold, in whole numbers."""
    both = F.size(F.array_intersect("ga", "gb"))
    return both * den >= (F.size("ga") + F.size("gb") - both) * num


def _may_link(num: int, den: int):
    """From rows sorted by group: pairs of components of which the sketches of some sets allow a link, thinned to a spanning forest per group."""

    def links(component: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> set[tuple[int, int]]:
        names, own = np.unique(component, return_inverse=True)
        if len(names) < 2:
            return set()
        met = np.zeros((len(names), len(names)), bool)
        for at in range(0, len(n), 64):
            differ = np.abs(sketch[at : at + 64, None] - sketch[None]).sum(2, dtype=np.int64)
            i, j = np.nonzero(differ * (den + num) <= (n[at : at + 64, None] + n[None]) * (den - num))
            met[own[i + at], own[j]] = True
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = set()
        for i, j in zip(*np.nonzero(np.triu(met, 1))):
            x, y = find(int(i)), find(int(j))
            if x != y:
                root[y] = x
                out.add((int(names[i]), int(names[j])))
        return out

    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = [np.asarray(batch.column(i)).astype(np.int64) for i in range(5)]
            new.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            key = np.stack(held[:3])
            at = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            out = set().union(*(links(*(x[a:b] for x in held[3:])) for a, b in zip(at, at[1:])))
            held = [x[at[-1] :] for x in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
        if held is not None and (out := links(*held[3:])):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return run


def _rest(num: int, den: int):
    def run(key, frame):
        """The number of links of each set in one pair of blocks, and a link for each pair of components that some connect."""
        import pandas as pd

        grams = [np.asarray(g) for g in frame["grams"]]
        n = np.array([len(g) for g in grams])
        code, inv = np.unique(np.concatenate(grams), return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        used = np.bincount(inv, minlength=len(code)) > 1
        column = (np.cumsum(used) - 1)[inv]
        keep = used[inv]
        row, column = row[keep], column[keep]
        both = np.zeros((len(n), len(n)), np.float32)
        for start in range(0, int(used.sum()), 4096):
            m = np.zeros((len(n), 4096), np.float32)
            at = (column >= start) & (column < start + 4096)
            m[row[at], column[at] - start] = 1
            both += m @ m.T
        link = both * den >= (n[:, None] + n[None] - both) * num
        if frame["i"].iat[0] != frame["j"].iat[0]:  # pairs within a block come once, from the block by itself
            blk = frame["blk"].to_numpy()
            link &= blk[:, None] != blk[None]
        np.fill_diagonal(link, False)
        ids, comp = frame["id"].to_numpy(), frame["component"].to_numpy()
        counts = pd.DataFrame({"a": ids, "b": ids, "n": link.sum(1, dtype=np.int64)})
        i, j = np.nonzero(np.triu(link & (comp[:, None] != comp[None])))
        out = pd.DataFrame({"a": ids[i], "b": ids[j], "n": 0, "x": np.minimum(comp[i], comp[j]), "y": np.maximum(comp[i], comp[j])})
        return pd.concat([counts[counts["n"] > 0], out.drop_duplicates(["x", "y"])[["a", "b", "n"]]])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of all texts: ``(id, n_shingles, component, n_links)``, one row per input row.

    Words are runs of other characters than space and 0x09-0x0D, lower-cased
    in A-Z only; a text's set holds its distinct ``k``-word shingles (a shorter
    text: its whole sequence as one).  Two texts link when
    den * intersection >= num * union; ``component`` is the smallest id that
    links reach.  Null and empty texts have size 0 and link with nothing; a
    null id has a null component; rows that repeat an id are one text each but
    stand for the same id.  ``n_links`` counts all verified links of the row's
    set to other sets; equal texts are one set.  Other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = texts.mapInArrow(_emit(k, num, den), "sig long, id long, size int")
    hits = tables.save(sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(_pairs, "kind byte, a long, b long, c long"), BATCH)

    # Equal sets link without a comparison; the smallest id stands for them.
    sizes = hits.where("kind = 2").select(F.col("a").alias("id"), F.col("b").alias("n_shingles"), F.col("c").alias("hash"))
    equal = sizes.where("id is not null and n_shingles > 0").groupBy("n_shingles", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = tables.save(sizes.join(equal, ["n_shingles", "hash"]).where("id <> first").select("id", "first").distinct())

    def stand(df: DataFrame, column: str) -> DataFrame:
        named = copies.select(F.col("id").alias(column), F.col("first").alias("__first"))
        return df.join(named, column, "left").withColumn(column, F.coalesce("__first", column)).drop("__first")

    pairs = stand(stand(hits.where("kind = 0").select("a", "b"), "a"), "b").where("a <> b")
    pairs = tables.save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    large = stand(hits.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("sig")), "id").distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = tables.save(texts.join(sized(ends), "id", "left_semi").mapInArrow(_sets(k), "id long, grams array<long>, sketch binary"), BATCH)
    small = sets.select("id", F.size("grams").alias("n"), "sketch")
    left, right = (small.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "na", "nb", "sa", "sb")
    possible = tables.save(both.mapInArrow(_possible(num, den), "a long, b long"), BATCH)
    left, right = (sets.join(sized(possible.select(F.col(x).alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    links = tables.save(possible.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(similar(num, den)).select("a", "b"))
    near = connected_components(links, "a", "b")

    # The exact rest: all pairs of large groups' members within a component, or within several that meet.
    labelled = large.join(near, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / RUN).alias("n")).where("low < high")
    meet = tables.save(labelled.join(mixed.select("sig", F.col("n").alias("blocks")), "sig"))
    rows = _block_pairs(meet, "blocks").join(small, "id").select("sig", "i", "j", "component", "n", "sketch")
    may = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_may_link(num, den), "a long, b long")
    may = tables.save(may.distinct(), BATCH)
    group = connected_components(may, "a", "b").select(F.col("id").alias("component"), F.col("component").alias("group"))
    members = labelled.select("id", "component").distinct().join(group, "component", "left").select("id", "component", F.coalesce("group", "component").alias("sig"))
    members = tables.save(members)
    count = members.groupBy("sig").agg(F.count("*").alias("n"), F.ceil(F.count("*") / (BLOCK // 2)).alias("blocks")).where("n > 1").drop("n")
    blocks = _block_pairs(members.join(count, "sig"), "blocks")
    more = blocks.join(sets.drop("sketch"), "id").groupBy("sig", "i", "j").applyInPandas(_rest(num, den), "a long, b long, n long")
    more = tables.save(more)
    near = connected_components(links.unionByName(more.where("n = 0").select("a", "b")), "a", "b")
    # links between two members of a group are counted there
    left, right = (members.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    links = links.join(left, "a", "left").join(right, "b", "left").where("sa is null or sb is null or sa <> sb").select("a", "b")
    tables.drop(sets, pairs, possible, meet, may)
    degree = links.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n")).unionByName(more.where("n > 0").select(F.col("a").alias("id"), "n"))
    degree = degree.groupBy("id").agg(F.sum("n").alias("n_links"))
    group = near.join(degree, "id", "left").select(F.col("id").alias("__rep"), "component", "n_links")
    return (
        stand(sizes.select("id", "n_shingles", F.col("id").alias("__rep")), "__rep")
        .join(group, "__rep", "left")
        .select("id", "n_shingles", F.coalesce("component", "__rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def _block_pairs(members: DataFrame, blocks: str) -> DataFrame:
    """Rows with ``id`` and ``sig`` dealt into as many blocks as the column says, and every pair of blocks ``i, j`` once, so that a task holds two blocks at most."""
    rows = members.withColumn("blk", F.pmod(F.xxhash64("id"), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return rows.withColumn("o", other).withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).drop("o", blocks)
