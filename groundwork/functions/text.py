"""Text functions as Column expressions; all stay in the JVM.

Tokens are runs of a-z and 0-9 after lower-casing, so accented letters part
words.  Words are what white space parts; chunk budgets count words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Function words that content tokens leave out.
STOPWORDS = (
    "a an the this that these those of in on at to for from by with about as into over after is are was were be been "
    "being am do does did has have had can could will would shall should may might must and or but if then than so not "
    "no nor too very s t it its it's what which who whom whose when where why how you i we they he she them his her "
    "their our your"
).split()

#: White space as Python's str methods see it (fixed values of Unicode, and four separators); written out, as Java's class for it is several times slower.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CITATION = r"\[(\d+)\]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


_OTHER = bytes(x for x in range(256) if chr(x) not in "abcdefghijklmnopqrstuvwxyz0123456789")
_IS_TOKEN = np.isin(np.arange(256), list(_OTHER), invert=True)


def coded_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """The ``tokens`` of many texts inside a task: for each token its text's place and its code, and what codes stand for."""
    plain = [(t or "").lower().encode("ascii", "replace") for t in texts]
    joined = b" ".join([b"", *plain, b""])
    edges = np.flatnonzero(np.diff(_IS_TOKEN[np.frombuffer(joined, np.uint8)])) + 1
    begins, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, _OTHER))).dictionary_encode()
    stops = np.cumsum([len(x) + 1 for x in plain]) if plain else np.zeros(0, int)
    return np.repeat(np.arange(len(plain)), np.diff(np.searchsorted(begins, stops), prepend=0)), np.asarray(found.indices).astype(np.int64), found.dictionary


def content_tokens(text: Column | str) -> Column:
    """Tokens without function words, in order and with repeats."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))


def words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), f"{SPACE}+"), lambda w: w != "")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column | str) -> Column:
    """Parts between white space that follows ``.``, ``!`` or ``?``; no empty ones."""
    return F.filter(F.split(strip(text), f"(?<=[.!?]){SPACE}+"), lambda s: s != "")


def strip_citations(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\[\d+\]", " ")


def citations(text: Column | str, sources: Column | int) -> Column:
    """Cited numbers from 1 to ``sources``, each once, in the order of their first appearance."""
    numbers = F.transform(F.regexp_extract_all(_c(text), F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int"))
    limit = F.lit(sources) if isinstance(sources, int) else sources
    return F.array_distinct(F.filter(numbers, lambda n: n.between(1, limit)))


def cited(text: Column | str, ids: Column | str) -> Column:
    """The ids at the cited places of an array."""
    ids = _c(ids)
    return F.transform(citations(text, F.size(ids)), lambda n: F.element_at(ids, n))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def runs(tokens: Column) -> Column:
    """``token, n`` of each distinct token, sorted; time grows as for sorting."""

    def cut(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        made = let(begins, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("n"))))
        return F.when(F.size(s) > 0, made).otherwise(F.array().cast("array<struct<token:string,n:int>>"))

    return let(F.array_sort(tokens), cut)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of tokens without ``#``: equal tokens are numbered, and the numbered ones intersected as sets."""

    def numbered(tokens: Column) -> Column:
        return F.flatten(F.transform(runs(tokens), lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda i: F.concat_ws("#", r["token"], i.cast("string")))))

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def token_f1(predicted: Column, reference: Column) -> Column:
    """F1 of two token multisets: 1 if both are empty, 0 if one is or nothing is shared."""

    def score(n: Column, np: Column, nr: Column) -> Column:
        p, r = n / np, n / nr
        return F.when((np == 0) & (nr == 0), 1.0).when((np == 0) | (nr == 0), 0.0).when(n == 0, 0.0).otherwise(2 * p * r / (p + r))

    counts = let(F.struct(predicted.alias("p"), reference.alias("r")), lambda x: F.struct(overlap(x["p"], x["r"]).cast("double").alias("n"), F.size(x["p"]).alias("np"), F.size(x["r"]).alias("nr")))
    return let(counts, lambda c: score(c["n"], c["np"], c["nr"]))


def grounding(answer: Column | str, context: Column | str) -> Column:
    """Share of the answer's content tokens that the context has; 1 without any.

    Tokens of both are sorted together, the context's first among equals, and
    counted in one pass.
    """
    mark = lambda tokens, last: F.transform(tokens, lambda t: F.concat(t, F.lit(last)))

    def share(a: Column) -> Column:
        both = F.array_sort(F.concat(mark(a, "#2"), mark(F.array_distinct(content_tokens(context)), "#1")))
        start = F.struct(F.lit("").alias("had"), F.lit(0).alias("n"))

        def add(state: Column, t: Column) -> Column:
            token, first = F.substring_index(t, "#", 1), F.endswith(t, F.lit("#1"))
            return F.struct(F.when(first, token).otherwise(state["had"]).alias("had"), (state["n"] + F.when(~first & (token == state["had"]), 1).otherwise(0)).alias("n"))

        return F.when(F.size(a) == 0, 1.0).otherwise(F.aggregate(both, start, add, lambda s: s["n"]) / F.size(a))

    return let(content_tokens(strip_citations(answer)), share)


def interval(mean: Column, low: Column, high: Column, n: Column) -> Column:
    """``mean [low, high]`` with three decimals, ``n/a`` without values."""
    return F.when(n == 0, "n/a").otherwise(F.format_string("%.3f [%.3f, %.3f]", mean, low, high))
