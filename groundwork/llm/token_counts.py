"""Token counts by rank-synchronous merging of batched pre-tokens in numpy arrays.

Each text is cut where no piece of the vocabulary can reach across, distinct
pre-tokens are laid end to end as one ragged array of symbols, and in every
round each pre-token merges its own lowest-rank pair, all pre-tokens at once.
Characters that no piece has side by side part pre-tokens further, so long
strings of junk are many short sequences.
The surviving symbols are the tokens.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Equal ranks of a sequence that must take turns, from which on a heap merges it.
LONG = 64
#: Pre-tokens whose counts a worker keeps.
KEPT = 300_000


class PairTable:
    """Open-addressed numpy hash table from a pair of symbols to the merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(left))))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = left.astype(np.int64) << 32 | right
        left_over, self.probes = np.arange(len(keys)), 0
        while len(left_over):
            at = self._slot(keys[left_over], self.probes)
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            took = left_over[free][first]
            self.keys[at[free][first]], self.values[at[free][first]] = keys[took], merged[took]
            left_over = np.setdiff1d(left_over, took)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * words.BASE) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            at = self._slot(keys[todo], probe)
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
        return out


class Merger:
    """The merges of a byte-fallback BPE vocabulary: pieces with scores, a higher score first, the leftmost of equals first."""

    def __init__(self, pieces: dict[str, float]):
        names = list(pieces)
        ids = {p: i for i, p in enumerate(names)}
        self.n = len(names)
        self.rank = np.unique(-np.array([pieces[p] for p in names]), return_inverse=True)[1].astype(np.int32)
        found = [(ids[p[:i]], ids[p[i:]], n) for n, p in enumerate(names) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        left, right, merged = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        # After merging such a piece, a pair with it may come before its other
        # occurrences, so they are merged one by one.
        self.alone = np.zeros(self.n, bool)
        for part in (left, right):
            self.alone[part[self.rank[merged] <= self.rank[part]]] = True
        self.alone |= np.bincount(self.rank)[self.rank] > 1
        # A character outside the vocabulary stands for its UTF-8 bytes.
        code = np.arange(0x110000)
        self.char = (self.n + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # Characters that no piece has next to each other part a pre-token into sequences that merge each by itself.
        letters = sorted({c for p in names for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        self.next = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in names:
            for a, b in zip(p, p[1:]):
                self.next[self.letter[ord(a)], self.letter[ord(b)]] = True
        self.splits = not any(a != SPACE and b == SPACE for p in names for a, b in zip(p, p[1:]))

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        code = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        s, letter = self.char[code], self.letter[code]
        token = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        new = np.r_[True, (token[1:] != token[:-1]) | ~self.next[letter[:-1], letter[1:]]][: len(code)]
        token, q = token[new], np.cumsum(new) - 1
        return np.bincount(token, self._merged(s, q, len(token)), len(tokens)).astype(np.int64)

    def _merged(self, s: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """Number of tokens of each of ``n`` sequences of symbols."""
        out = np.zeros(n, np.int64)
        m, r = self._look(s, q, np.arange(len(s)))
        while len(s):
            at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            n = np.diff(np.r_[at, len(q)])
            best = np.repeat(np.minimum.reduceat(r, at), n)
            done = best == NONE
            if done.any():
                weight = np.where(s[done] < self.n, 1, s[done] - self.n)
                np.add.at(out, q[done], weight)
                s, q, m, r, best = s[~done], q[~done], m[~done], r[~done], best[~done]
                if not len(s):
                    break
            hit = r == best
            if (lonely := hit & self.alone[np.maximum(m, 0)]).any():
                n = np.bincount(q[np.flatnonzero(lonely)], minlength=len(out))
                if (n[q] > LONG).any():
                    apart = n[q] > LONG
                    for k in np.flatnonzero(n > LONG):
                        out[k] = self._one_by_one(s[q == k])
                    s, q, m, r = s[~apart], q[~apart], m[~apart], r[~apart]
                    continue
                i = np.flatnonzero(lonely)
                hit[i[np.r_[False, q[i[1:]] == q[i[:-1]]]]] = False
            i = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(i) > 1])
            inside = np.arange(len(i)) - np.repeat(run, np.diff(np.r_[run, len(i)]))
            i = i[inside % 2 == 0]
            keep = np.ones(len(s), bool)
            keep[i + 1] = False
            s[i] = m[i]
            at = (np.cumsum(keep) - 1)[i]
            s, q, m, r = s[keep], q[keep], m[keep], r[keep]
            at = np.unique(np.r_[at, at[at > 0] - 1])
            m[at], r[at] = self._look(s, q, at)
        return out

    def _one_by_one(self, s: np.ndarray) -> int:
        """Number of tokens of one sequence, merged from a heap: for long ones in which equal ranks must take turns from the left."""
        _, rank = self._look(s, np.zeros(len(s), np.int64), np.arange(len(s)))
        heap = [(a, i) for i, a in enumerate(rank.tolist()) if a != NONE]
        heapq.heapify(heap)
        merged, ranks, n = self.dictionary, self.rank.tolist(), len(s)
        s, right, left = s.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            a, i = heapq.heappop(heap)
            j = right[i]
            if s[i] < 0 or j >= n or (x := merged.get(s[i] << 32 | s[j])) is None or ranks[x] != a:
                continue  # one of the two has been merged since
            s[i], s[j], right[i] = x, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (x := merged.get(s[k] << 32 | s[right[k]])) is not None:
                    heapq.heappush(heap, (ranks[x], k))
        return sum(1 if x < self.n else x - self.n for x in s if x >= 0)

    @functools.cached_property
    def dictionary(self) -> dict[int, int]:
        there = self.pairs.keys >= 0
        return dict(zip(self.pairs.keys[there].tolist(), self.pairs.values[there].tolist()))

    def _look(self, s: np.ndarray, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbol and rank of the pairs that start at ``at``."""
        m, r = np.full(len(at), -1, np.int32), np.full(len(at), NONE, np.int32)
        inner = np.flatnonzero(at + 1 < len(s))
        inner = inner[q[at[inner]] == q[at[inner] + 1]]
        found = self.pairs.find(s[at[inner]], s[at[inner] + 1])
        m[inner] = found
        r[inner] = np.where(found >= 0, self.rank[np.maximum(found, 0)], NONE)
        return m, r


@functools.lru_cache(2)
def load(model_file: str) -> Merger:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return Merger({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)})


def pre_tokens(text: str, splits: bool = True) -> list[str]:
    """Parts of a text that no merge crosses: a run of spaces with what follows it."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if not splits:
        return [text]
    parts = text.split(SPACE)[1:]
    if all(parts):
        return [SPACE + p for p in parts]
    return re.findall(f"{SPACE}+[^{SPACE}]*", text)


def _count(model_file: str, limit: int):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, known = load(model_file), {}
        for batch in batches:
            for part, texts in words.slices(batch):
                tokens: list[str] = []
                lens = np.empty(len(texts), np.int64)
                for i, text in enumerate(texts):
                    own = pre_tokens(text.decode(), merger.splits)
                    lens[i] = len(own)
                    tokens += own
                if len(known) > KEPT:
                    known.clear()
                if new := [t for t in set(tokens) if t not in known]:
                    known.update(zip(new, merger.counts(new).tolist()))
                total = np.r_[0, np.cumsum(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))]
                ends = np.cumsum(lens)
                n = total[ends] - total[ends - lens]
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: one row per input row, tokens as the vocabulary file's library gives them.

    Null and empty texts have no bytes and no tokens; a null id stays null;
    repeated rows are counted each; other columns are ignored.  Nothing is
    shuffled.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(_count(model_file, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
