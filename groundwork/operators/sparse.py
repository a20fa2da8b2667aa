"""BM25 over an inverted index.

A stored index keeps lists: a row holds one term's postings in one block of
neighbouring chunks, with the largest count and the shortest length, which
bound what the term can add to any chunk of the block (block-max indexes, Ding
and Suel, 2011).  Lists hold counts, not weights, so they stay right when the
corpus and its statistics grow.

A search reads the lists of asked terms only and deals them by block.  A task
scores a block for all questions at once and keeps its own first k of each, so
no pair of a question and a chunk is ever a row of a shuffle; a block whose
bound can't reach a question's k-th score is not scored for it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import coded_tokens, runs, tokens
from .ranking import DIGITS, by_score, top_k

# Fixed values of Okapi BM25; a negative idf becomes EPSILON times the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25

#: Chunks of a block.
BLOCK = 128
#: Chunks whose terms are counted at once.
TALLIED = 4096
#: Questions that a task scores at once.
QUESTIONS = 1024
#: Pairs of a posting and a question that are worked on at once.
PAIRS = 1 << 21
#: Up to so many asked terms are handed to the reader by name; more are joined.
NAMED = 500
#: The same for lists that are made for one search only.
LISTED = 100_000
#: Up to so many asked terms are broadcast.
BROADCAST = 1_000_000
#: Chunks of a part in which stored postings meet their chunks; smaller parts where these are fewer than cores.
PART, SMALL = 16_384, 1_024
#: Postings of a stored index that are dealt, and that meet their chunks, at once.
DEALT = 1 << 20
_CHUNK = ("chunk_id", "doc_id", "doc_seq", "ordinal")


def frequencies(chunks: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, doc_seq, ordinal, dl, term, tf``; runs of the sorted tokens are counted within the row, so nothing is shuffled."""
    rows = chunks.select(*_CHUNK, tokens("text").alias("t"))
    # explode_outer: for explode, the optimizer would put a filter on the runs below it, and so count twice
    found = rows.select(*_CHUNK, F.size("t").alias("dl"), F.explode_outer(runs(F.col("t"))).alias("r")).where("r is not null")
    return found.select(*_CHUNK, "dl", F.col("r.token").alias("term"), F.col("r.n").cast("long").alias("tf"))


_POSTING = pa.struct([("chunk_id", pa.string()), ("doc_seq", pa.int64()), ("ordinal", pa.int32()), ("tf", pa.int64()), ("dl", pa.int32())])
LISTS = "term string, block long, n long, words long, max_tf long, min_dl int, postings array<struct<chunk_id:string,doc_seq:long,ordinal:int,tf:long,dl:int>>"


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Tokens of each text; for each pair of a term and a text that has it, by term: the term's code, the text's place, the count; the terms."""
    text, code, known = coded_tokens(texts)
    pairs, tf = np.unique(code * len(texts) + text, return_counts=True)
    return np.bincount(text, minlength=len(texts)), pairs // max(1, len(texts)), pairs % max(1, len(texts)), tf, known


def _lists(batches, only: pa.Array | None = None, by_term: bool = False):
    """Lists of the blocks of one partition; a block is up to BLOCK of its chunks, in order. With ``only``, those of these terms.

    About TALLIED chunks are counted at once.  Their lists come block by block, or ``by_term`` sorted by term and block.
    """
    first, most = TaskContext.get().partitionId() << 32, max(1, TALLIED // BLOCK) * BLOCK
    for whole in batches:
        for start in range(0, whole.num_rows, most):
            batch = whole.slice(start, most)
            n_blocks = -(-batch.num_rows // BLOCK)
            text, code, known = coded_tokens(batch.column("text").to_pylist())
            dl = np.bincount(text, minlength=batch.num_rows)
            if only is not None:
                kept = np.asarray(pc.is_in(known, only).to_numpy(zero_copy_only=False), bool)[code]
                text, code = text[kept], code[kept]
            if by_term:
                order = np.asarray(pc.array_sort_indices(known)).astype(np.int64)
                known, code = known.take(pa.array(order)), np.argsort(order)[code]
            key = code * n_blocks + text // BLOCK if by_term else text // BLOCK * len(known) + code
            pairs, tf = np.unique(key * BLOCK + text % BLOCK, return_counts=True)
            begins = np.flatnonzero(np.diff(pairs // BLOCK, prepend=-1))
            if len(begins):
                key = pairs // BLOCK
                code, block = (key // n_blocks, key % n_blocks) if by_term else (key % len(known), key // len(known))
                chunk = block * BLOCK + pairs % BLOCK
                at = pa.array(chunk)
                parts = [batch.column(c).take(at) for c in ("chunk_id", "doc_seq", "ordinal")] + [pa.array(tf.astype(np.int64)), pa.array(dl[chunk].astype(np.int32))]
                postings = pa.ListArray.from_arrays(pa.array(np.append(begins, len(pairs)), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_POSTING)))
                sums = [np.diff(np.append(begins, len(pairs))), np.add.reduceat(tf, begins), np.maximum.reduceat(tf, begins), np.minimum.reduceat(dl[chunk], begins)]
                n, words, max_tf, min_dl = (pa.array(x.astype(np.int64)) for x in sums)
                yield pa.RecordBatch.from_arrays(
                    [known.take(pa.array(code[begins])), pa.array(first + block[begins]), n, words, max_tf, min_dl.cast(pa.int32()), postings],
                    names=["term", "block", "n", "words", "max_tf", "min_dl", "postings"],
                )
            first += n_blocks


def lists(chunks: DataFrame, only: list[str] | None = None, by_term: bool = False) -> DataFrame:
    """``term, block, n, words, max_tf, min_dl, postings``: a row for each term of a block, or for those of ``only``.

    Blocks lie within partitions, so a partition's rows hold whole lists;
    ``chunks`` must be rows whose partitions stay as they are.  ``by_term``
    brings them in sorted runs, which are soon merged.
    """
    terms = None if only is None else pa.array(only, pa.string())
    return chunks.select("chunk_id", "doc_seq", "ordinal", "text").mapInArrow(lambda batches: _lists(batches, terms, by_term), LISTS)


def _strips(batches):
    """``term, postings``: what ``lists`` holds of TALLIED chunks at a time, as columns of numbers; a chunk is its document's id and its place there."""
    for whole in batches:
        for start in range(0, whole.num_rows, TALLIED):
            batch = whole.slice(start, TALLIED)
            dl, code, chunk, tf, known = _counts(batch.column("text").to_pylist())
            begins = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)).astype(np.int32)
            at = pa.array(chunk)
            columns = [batch.column("doc_id").take(at), batch.column("ordinal").take(at), pa.array(tf.astype(np.int32)), pa.array(dl[chunk].astype(np.int32))]
            made = [pa.ListArray.from_arrays(pa.array(begins), c) for c in columns]
            yield pa.RecordBatch.from_arrays([known.take(pa.array(code[begins[:-1]])), *made], names=["term", "doc", "ordinal", "tf", "dl"])


def postings(chunks: DataFrame, tally: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, weight`` of all chunks, for chunks named ``doc#ordinal``: strips of many chunks meet their term's idf, and only then become rows."""
    own = counted(tally)
    strips = chunks.select("doc_id", "ordinal", "text").mapInArrow(_strips, "term string, doc array<string>, ordinal array<int>, tf array<int>, dl array<int>")
    # hashed, so that strips aren't sorted
    met = strips.join(own["term_stats"].select("term", "idf").hint("shuffle_hash"), "term").crossJoin(F.broadcast(own["corpus_stats"].select("avgdl")))  # one row
    rows = met.select("term", "idf", "avgdl", F.explode(F.arrays_zip("doc", "ordinal", "tf", "dl")).alias("p")).select("term", "idf", "avgdl", "p.*")
    return rows.select("term", F.concat_ws("#", "doc", "ordinal").alias("chunk_id"), F.col("tf").cast("long").alias("tf"), (F.col("idf") * saturation("tf", "dl", F.col("avgdl"))).alias("weight"))


def _tallies(batches):
    """``term, df`` of some chunks at a time, and a row without a term with their number and their tokens."""
    for whole in batches:
        for start in range(0, whole.num_rows, TALLIED):
            dl, code, _, _, known = _counts(whole.column(0).slice(start, TALLIED).to_pylist())
            yield pa.RecordBatch.from_arrays([known, pa.array(np.bincount(code, minlength=len(known)).astype(np.int64)), pa.nulls(len(known), pa.int64())], names=["term", "n", "words"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([len(dl)], pa.int64()), pa.array([int(dl.sum())], pa.int64())], names=["term", "n", "words"])


def tallies(chunks: DataFrame) -> DataFrame:
    """``term, n, words``: in how many chunks a term is; in the one row without a term (none without chunks), how many chunks and tokens there are. Only sums move."""
    return chunks.select("text").mapInArrow(_tallies, "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def counted(tally: DataFrame) -> dict[str, DataFrame]:
    """``term_stats`` and ``corpus_stats`` from ``tallies``."""
    whole = tally.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))
    stats, corpus = statistics(tally.where("term is not null").select("term", F.col("n").alias("df")), whole)
    return {"term_stats": stats, "corpus_stats": corpus}


def statistics(df: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term_stats`` and the one row of ``corpus_stats`` from ``term, df`` and the one row ``n, avgdl``."""
    raw = df.crossJoin(F.broadcast(whole)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # whole is one row
    mean = raw.agg(F.avg("raw").alias("avg_idf"))
    stats = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw")).alias("idf"))
    return stats, whole.crossJoin(F.broadcast(mean))


def saturation(tf: str, dl: str, avgdl: Column) -> Column:
    """Grows with the count and falls with the length."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / avgdl))


def weighted(tf: DataFrame, stats: DataFrame, whole: DataFrame) -> DataFrame:
    """``postings``: each term's weight in its chunk."""
    return _weights(tf.join(stats.select("term", "idf"), "term"), whole)


def _weights(met: DataFrame, whole: DataFrame) -> DataFrame:
    """Postings with their ``idf``, weighted."""
    rows = met.crossJoin(F.broadcast(whole.select("avgdl")))  # one row
    return rows.select("term", "chunk_id", "doc_seq", "ordinal", "tf", (F.col("idf") * saturation("tf", "dl", F.col("avgdl"))).alias("weight"))


def build(chunks: DataFrame) -> dict[str, DataFrame]:
    """Lazy tables: ``frequencies``, ``postings``, ``term_stats``, ``corpus_stats``."""
    whole = chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens("text"))).alias("avgdl"))
    tf = frequencies(chunks)
    stats, corpus = statistics(tf.groupBy("term").agg(F.count("*").alias("df")), whole)
    return {"frequencies": tf, "postings": weighted(tf, stats, whole), "term_stats": stats, "corpus_stats": corpus}


def stored(found: DataFrame, df: DataFrame, sizes: DataFrame) -> dict[str, DataFrame]:
    """The same tables from stored ``lists``, ``term, df`` and ``n, words``, which may come in parts (a growing index)."""
    whole = sizes.agg(F.sum("n").alias("n"), (F.sum("words") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))
    stats, corpus = statistics(df.groupBy("term").agg(F.sum("df").alias("df")), whole)
    # lists meet their term's idf, not single postings; hashed, so that they aren't sorted
    met = found.select("term", "postings").join(stats.select("term", "idf").hint("shuffle_hash"), "term")
    flat = met.select("term", "idf", F.explode_outer("postings").alias("p")).select("term", "idf", "p.*")  # a list is never empty
    return {"lists": found, "postings": _weights(flat, whole), "term_stats": stats, "corpus_stats": corpus}


class _Parts:
    """Into which part a chunk is dealt: stretches of the corpus order with about as many chunks each; a place in it that many chunks share is dealt further by their ids."""

    def __init__(self, chunks: DataFrame):
        n = chunks.count()
        count = max(-(-n // PART), min(chunks.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL)), 1)
        at = [i / count for i in range(1, count)]
        found = chunks.agg(F.percentile_approx(F.coalesce("doc_seq", F.lit(0)), at, 10_000).alias("p")).first()["p"] if at else []
        self.cuts = np.array(found or [], np.int64)
        self.count, self.tied = len(self.cuts) + 1, len(np.unique(self.cuts)) < len(self.cuts)

    def of(self, doc_seq: np.ndarray, chunk_id: pa.Array | None) -> np.ndarray:
        """``chunk_id`` is only needed where cuts are ``tied``."""
        part = np.searchsorted(self.cuts, doc_seq, "right")
        if self.tied:
            spread = part - np.searchsorted(self.cuts, doc_seq, "left")
            for i in np.flatnonzero(spread > 1):
                part[i] -= zlib.crc32(chunk_id[int(i)].as_py().encode()) % int(spread[i])
        return part


def _gathered(batches):
    """Batches put together until they have DEALT postings or more; the second column is lists."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(1).flatten())
        if n >= DEALT:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in column.chunks])


def _by_part(table: pa.Table, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """An order of all postings by part and term, their terms' codes, and what codes stand for."""
    coded = pc.dictionary_encode(table.column(0).combine_chunks())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    n = np.asarray(pc.list_value_length(table.column(1)).combine_chunks()).astype(np.int64)
    term = np.repeat(np.asarray(coded.indices).astype(np.int64), n)
    return np.argsort(part * len(coded.dictionary) + term, kind="stable"), term, coded.dictionary


def _dealt_terms(parts: _Parts):
    """``part, term`` from ``term``, the lists ``doc_seq`` and, where cuts are tied, ``chunk_id``."""

    def run(batches):
        for table in _gathered(batches):
            doc_seq = np.asarray(_flat(table.column("doc_seq")).fill_null(0))
            part = parts.of(doc_seq, _flat(table.column("chunk_id")) if parts.tied else None)
            order, term, known = _by_part(table, part)
            part, term = part[order], term[order]
            new = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(term, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int32)), known.take(pa.array(term[new]))], names=["part", "term"])

    return run


_STRIP = "struct<terms:array<string>,sizes:array<int>,chunks:array<string>,dl:array<int>,at:array<int>,tf:array<int>>"


def _dealt_strips(parts: _Parts):
    """``part, strip``: postings of many lists in one part as columns of numbers. ``sizes`` has a term's postings, ``at`` their chunk among ``chunks``, whose lengths are ``dl``."""

    def run(batches):
        for table in _gathered(batches):
            coded = _flat(table.column("chunk_id")).dictionary_encode()
            chunk, known_chunks = np.asarray(coded.indices).astype(np.int64), coded.dictionary
            tf, where = np.asarray(_flat(table.column("tf"))), np.zeros(len(known_chunks), np.int64)
            where[chunk] = np.arange(len(chunk))
            dl = np.asarray(_flat(table.column("dl")))[where]
            part = parts.of(np.asarray(_flat(table.column("doc_seq")).fill_null(0))[where], known_chunks)[chunk]
            order, term, known = _by_part(table, part)
            part, term, chunk, tf = part[order], term[order], chunk[order], tf[order]
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            for b, e in zip(edges, edges[1:]):
                begins = np.flatnonzero(np.diff(term[b:e], prepend=-1))
                own, at = np.unique(chunk[b:e], return_inverse=True)
                sizes = np.diff(np.append(begins, e - b))
                fields = [known.take(pa.array(term[b:e][begins])), sizes, known_chunks.take(pa.array(own)), dl[own], at, tf[b:e]]
                fields = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)) for x in fields]
                lists_ = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in fields]
                strip = pa.StructArray.from_arrays(lists_, names=["terms", "sizes", "chunks", "dl", "at", "tf"])
                yield pa.RecordBatch.from_arrays([pa.array([int(part[b])], pa.int32()), strip], names=["part", "strip"])

    return run


def _packed(part, names: list[str]):
    """``part`` and, of up to DEALT rows that lie in it, the columns ``names`` as lists; single rows beside strips would be slow to hand over."""

    def run(batches):
        held, n = [], 0

        def pack():
            table = pa.Table.from_batches(held).combine_chunks()
            at = part(table)
            order = np.argsort(at, kind="stable")
            columns = [table.column(c).combine_chunks().take(pa.array(order)) for c in names]
            edges = np.append(np.flatnonzero(np.diff(at[order], prepend=-1)), n)
            lists_ = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(at[order][edges[:-1]].astype(np.int32)), *lists_], names=["part", *names])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= DEALT:
                yield pack()
                held, n = [], 0
        if n:
            yield pack()

    return run


def _met(fields: list[str]):
    """Rows of one part after the other: its chunks, its terms, then its strips; every posting with its idf and its chunk's ``fields``."""

    def joined(strips: list, name: str) -> pa.Array:
        return pa.concat_arrays([s.field(name).flatten() for s in strips])

    def meet(strips: list, chunks: dict, terms: dict):
        lengths = [len(s.field("chunks").flatten()) for s in strips]
        at = np.asarray(joined(strips, "at")).astype(np.int64) + np.repeat(np.cumsum(lengths) - lengths, [len(s.field("at").flatten()) for s in strips])
        known_terms, known_chunks, tf, dl = (joined(strips, x) for x in ("terms", "chunks", "tf", "dl"))
        term = np.repeat(np.arange(len(known_terms)), np.asarray(joined(strips, "sizes")))
        place, known = pc.index_in(known_chunks, chunks["name"]), pc.index_in(known_terms, terms["name"])
        if place.null_count or known.null_count:
            raise ValueError("a posting's chunk or term is missing from the index")
        idf = terms["idf"].take(known)
        for i in range(0, len(term), DEALT // 8):
            a, t = pa.array(at[i : i + DEALT // 8]), pa.array(term[i : i + DEALT // 8])
            own = chunks["chunk"].take(place.take(a))
            arrays = [known_terms.take(t), known_chunks.take(a), tf.slice(i, DEALT // 8).cast(pa.int64()), dl.take(a), idf.take(t), *[own.field(f) for f in fields]]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "chunk_id", "tf", "dl", "idf", *fields])

    def run(batches):
        now, held, strips, n = None, None, [], 0
        for batch in batches:
            for i in range(len(batch)):
                part, kind = batch.column("part")[i].as_py(), batch.column("kind")[i].as_py()
                if part != now or (kind == 2 and n >= DEALT):
                    if strips:
                        yield from meet(strips, *held)
                    strips, n = [], 0
                if part != now:
                    now, held = part, ([], [])
                if kind < 2:
                    held[kind].append({c: batch.column(c).slice(i, 1).flatten() for c in ("name", ("chunk", "idf")[kind])})
                    continue
                if not strips:  # all chunks and terms of the part have come
                    held = tuple({c: pa.concat_arrays([x[c] for x in h]) for c in h[0]} if isinstance(h, list) else h for h in held)
                strips.append(batch.column("strip").slice(i, 1))
                n += len(strips[-1].field("at").flatten())
        if strips:
            yield from meet(strips, *held)

    return run


def with_chunks(index: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, weight`` of all stored postings, and what else ``chunks`` (``chunk_id, doc_seq, ...``) has of their chunks.

    Postings move once, as strips, to the part of the corpus that their chunk
    is in; chunks and the idf of a part's terms come there too, so that no
    posting is a row before it has met both.
    """
    fields = [f for f in chunks.columns if f not in ("chunk_id", "doc_seq")]
    parts = _Parts(chunks)
    stored_ = [F.col(f"postings.{x}").alias(x) for x in ("doc_seq", "chunk_id", "tf", "dl")]
    lists_ = index["lists"].select("term", *stored_)
    dealt = lists_.select("term", "doc_seq", *["chunk_id"] * parts.tied).mapInArrow(_dealt_terms(parts), "part int, term string")
    # hashed, so that terms aren't sorted
    terms = dealt.join(index["term_stats"].select("term", "idf").hint("shuffle_hash"), "term").select("part", F.col("term").alias("name"), "idf")
    terms = terms.mapInArrow(_packed(lambda t: np.asarray(t.column("part")), ["name", "idf"]), "part int, name array<string>, idf array<double>")

    def place(t: pa.Table) -> np.ndarray:
        return parts.of(np.asarray(t.column("doc_seq")), t.column("name"))

    own = F.struct(*fields) if fields else F.struct(F.lit(0).alias("_"))
    of_chunks = chunks.select(F.coalesce("doc_seq", F.lit(0)).alias("doc_seq"), F.col("chunk_id").alias("name"), own.alias("chunk"))
    kept = f"array<{of_chunks.schema['chunk'].dataType.simpleString()}>"
    of_chunks = of_chunks.mapInArrow(_packed(place, ["name", "chunk"]), f"part int, name array<string>, chunk {kept}")
    strips = lists_.mapInArrow(_dealt_strips(parts), f"part int, strip {_STRIP}")
    none = {"name": "array<string>", "chunk": kept, "idf": "array<double>", "strip": _STRIP}

    def laid(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("part", F.lit(kind).alias("kind"), *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    every = laid(of_chunks, 0).unionByName(laid(terms, 1)).unionByName(laid(strips, 2))
    # twice as many, as hashes put some parts together
    every = every.repartition(2 * parts.count, "part").sortWithinPartitions("part", "kind")
    types = ", ".join(f"`{f}` {chunks.schema[f].dataType.simpleString()}" for f in fields)
    rows = every.mapInArrow(_met(fields), "term string, chunk_id string, tf long, dl int, idf double" + (f", {types}" if fields else ""))
    met = rows.crossJoin(F.broadcast(index["corpus_stats"].select("avgdl")))  # one row
    return met.select("term", "chunk_id", "tf", (F.col("idf") * saturation("tf", "dl", F.col("avgdl"))).alias("weight"), *fields)


def _terms(questions: DataFrame) -> tuple[DataFrame, bool]:
    """``question_id, term, qtf``, and whether they are few; then they are broadcast, so that postings don't move."""
    terms = questions.select("question_id", F.explode(tokens("question")).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))
    few = terms.count() <= BROADCAST
    return (F.broadcast(terms) if few else terms), few


def _summed(met: DataFrame, avgdl: Column) -> DataFrame:
    return met.groupBy("question_id", "chunk_id", "doc_seq", "ordinal").agg(F.sum(F.col("weight") * saturation("tf", "dl", avgdl)).alias("score"))


class _First:
    """The first ``k`` of each question so far, for the questions that a task works on."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, {}, {}

    def add(self, question: str, score: np.ndarray, chunk: np.ndarray, doc_seq: np.ndarray, ordinal: np.ndarray) -> None:
        had = self.rows.get(question)
        if had is not None:
            score, chunk, doc_seq, ordinal = (np.concatenate(p) for p in zip(had, (score, chunk, doc_seq, ordinal)))
        order = np.lexsort((ordinal, doc_seq, -np.round(score, DIGITS)))[: self.k]
        self.rows[question] = tuple(x[order] for x in (score, chunk, doc_seq, ordinal))
        if len(order) == self.k:
            self.floor[question] = float(score[order[-1]])

    def out(self) -> pa.RecordBatch:
        ids = [q for q, r in self.rows.items() for _ in r[0]]
        score, chunk, doc_seq, ordinal = (np.concatenate(x) for x in zip(*self.rows.values()))
        self.rows, self.floor = {}, {}
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(chunk.tolist(), pa.string()), pa.array(doc_seq), pa.array(ordinal.astype(np.int32)), pa.array(score)], names=["question_id", "chunk_id", "doc_seq", "ordinal", "score"]
        )


def _score_block(lists_: pa.Table, first: _First, avgdl: float) -> int:
    """Score one block for the questions that its lists are asked by; how many pairs of a posting and a question that took.

    A row has a list and the questions that have its term, with their weights.
    Questions whose floor is above their bound on this block are left out.
    """
    asked = lists_.column("asked").combine_chunks()
    m = np.asarray(asked.value_lengths()).astype(np.int64)
    flat = asked.flatten()
    coded = flat.field("question_id").dictionary_encode()
    names, q, w = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), np.asarray(flat.field("weight"))
    row = np.repeat(np.arange(len(m)), m)

    def saturated(tf, dl):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    peak = saturated(lists_.column("max_tf").to_numpy(), lists_.column("min_dl").to_numpy())
    bound = np.bincount(q, w * peak[row], minlength=len(names))
    # scores that differ by less than 1e-9 tie, and sums differ in their last digits
    wanted = bound >= np.array([first.floor.get(x, -np.inf) for x in names]) - 1e-6
    keep = wanted[q]
    q, w, row = q[keep], w[keep], row[keep]
    m = np.bincount(row, minlength=len(m))
    postings = lists_.column("postings").combine_chunks()
    n = np.asarray(postings.value_lengths()).astype(np.int64)
    flat = postings.flatten()
    ids = flat.field("chunk_id").dictionary_encode()
    chunk = np.asarray(ids.indices).astype(np.int64)
    s = saturated(np.asarray(flat.field("tf")), np.asarray(flat.field("dl")))
    total, n_chunks = np.zeros(len(names) * len(ids.dictionary)), len(ids.dictionary)
    p0, q0, pairs = np.cumsum(n) - n, np.cumsum(m) - m, n * m
    edges = np.concatenate([[0], np.cumsum(pairs)])
    start = 0
    while start < len(m):
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + PAIRS, "right")) - 1)
        r = np.repeat(np.arange(start, stop), pairs[start:stop])
        at = np.arange(len(r)) + edges[start] - edges[r]
        p, a = p0[r] + at // np.maximum(m[r], 1), q0[r] + at % np.maximum(m[r], 1)
        total += np.bincount(q[a] * n_chunks + chunk[p], s[p] * w[a], minlength=len(total))
        start = stop
    where = np.zeros(n_chunks, np.int64)
    where[chunk] = np.arange(len(chunk))
    doc_seq, ordinal = np.asarray(flat.field("doc_seq"))[where], np.asarray(flat.field("ordinal"))[where]
    chunk_ids = np.array(ids.dictionary.to_pylist(), object)
    total = total.reshape(len(names), n_chunks)
    for i in np.flatnonzero(wanted):
        found = np.flatnonzero(total[i] > max(first.floor.get(names[i], 0.0) - 1e-6, 0.0))
        if len(found):
            first.add(names[i], total[i][found], chunk_ids[found], doc_seq[found], ordinal[found])
    return int(edges[-1])


def _scorer(k: int, avgdl: float):
    def run(batches):
        first, group, now = _First(k), [], None

        def finish():
            if group:
                _score_block(pa.Table.from_batches(group), first, avgdl)
                group.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "delta", "block"))))
            begins = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for i, j in zip(begins, begins[1:] + [len(keys)]):
                if keys[i] != now:
                    finish()
                    if now is not None and keys[i][0] != now[0] and first.rows:
                        yield first.out()
                    now = keys[i]
                group.append(batch.slice(i, j - i))
        finish()
        if first.rows:
            yield first.out()

    return run


def _terms(questions: DataFrame) -> tuple[DataFrame, bool]:
    """``question_id, term, qtf``, and whether they are few; then they are broadcast, so that postings don't move."""
    terms = questions.select("question_id", F.explode(tokens("question")).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))
    few = terms.count() <= BROADCAST
    return (F.broadcast(terms) if few else terms), few


def _asked(terms: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """``question_id, term, weight`` of known terms: idf, times how often a question has the term."""
    return index["term_stats"].select("term", "idf").join(terms, "term").select("question_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def _nearest(questions: DataFrame, index: dict[str, DataFrame], avgdl: float, k: int) -> DataFrame:
    """``question_id, chunk_id, doc_seq, ordinal, score`` from stored lists: at least each question's first ``k`` that score above 0."""
    terms, few = _terms(questions)
    parts = max(1, -(-questions.count() // QUESTIONS))
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts)).cast("int")
    asked = _asked(terms, index).groupBy("term", part.alias("part")).agg(F.collect_list(F.struct("question_id", "weight")).alias("asked"))
    made, most = "lists" not in index, LISTED if "lists" not in index else NAMED
    names = [r["term"] for r in terms.select("term").distinct().limit(most + 1).collect()]
    if made:  # while chunks are read; each task has whole blocks then
        found = lists(index["chunks"], names if len(names) <= most else None).withColumn("delta", F.lit(0))
    else:
        found = index["lists"].where(F.col("term").isin(names)) if len(names) <= most else index["lists"]
    rows = found.select("term", "delta", "block", "max_tf", "min_dl", "postings").join(F.broadcast(asked) if few else asked, "term")
    dealt = rows.drop("term") if made and few else rows.drop("term").repartition("part", "delta", "block")
    if not (made and few and parts == 1):  # there blocks come one after the other
        dealt = dealt.sortWithinPartitions("part", "delta", "block")
    return dealt.mapInArrow(_scorer(k, avgdl), "question_id string, chunk_id string, doc_seq long, ordinal int, score double")


def scores(questions: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """``question_id, chunk_id, doc_seq, ordinal, score`` of all chunks that share a term; a repeated question term counts each time."""
    terms, _ = _terms(questions)
    if "lists" in index:
        tf = index["lists"].select("term", F.explode("postings").alias("p")).select("term", "p.*")
    else:
        tf = index["frequencies"] if "frequencies" in index else frequencies(index["chunks"])
    met = tf.join(terms.select("term").distinct(), "term", "left_semi").join(_asked(terms, index), "term")
    met = met.crossJoin(F.broadcast(index["corpus_stats"].select("avgdl")))  # one row
    return met.groupBy("question_id", "chunk_id", "doc_seq", "ordinal").agg(F.sum(F.col("weight") * saturation("tf", "dl", F.col("avgdl"))).alias("score"))


def search(questions: DataFrame, index: dict[str, DataFrame], k: int) -> DataFrame:
    """``question_id, chunk_id, rank, score, source``: every chunk is ranked, those without a common term with 0; ties in corpus order.

    Where fewer than ``k`` chunks score above 0, the rest come from the first
    chunks of the corpus: 2k of them hold enough unless scores can be negative
    (a mean idf below 0, as in corpora of a few chunks); then all do.  ``first``
    may hold the first chunks.  An index without ``lists`` and ``frequencies``
    is searched while its chunks are read: only each task's first ``k`` move.
    """
    corpus = index["corpus_stats"].first()
    negative = corpus["avg_idf"] is not None and corpus["avg_idf"] < 0
    found = _nearest(questions, index, corpus["avgdl"] or 1.0, k) if "frequencies" not in index and not negative and k > 0 else scores(questions, index)
    first = index.get("first", index["chunks"]).select("chunk_id", "doc_seq", "ordinal").orderBy("doc_seq", "ordinal")
    first = index["chunks"].select(*first.columns) if negative else first.limit(2 * max(k, 0))
    pads = questions.select("question_id").join(F.broadcast(first) if not negative else first, F.lit(True)).withColumn("score", F.lit(None).cast("double"))
    # a chunk that is found keeps its score, one that isn't has none: 0
    both = found.unionByName(pads).groupBy("question_id", "chunk_id", "doc_seq", "ordinal").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    ranked = top_k(both, ["question_id"], by_score("doc_seq", "ordinal"), k)
    return ranked.select("question_id", "chunk_id", "rank", "score", F.lit("bm25").alias("source"))
