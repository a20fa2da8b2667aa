import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from groundwork.llm.packing import pack_documents, plan

from .helpers import EDGES, docs

FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(FILE)


def check(rows, got, size):
    want = defaultdict(list)
    for i, t in rows:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), size)):
            want[i, p].append((at, ids[at : at + size]))
    assert sorted(((r["doc_id"], r["piece"]) for r in got), key=repr) == sorted((k for k, v in want.items() for _ in v), key=repr)
    places = defaultdict(list)
    for r in got:
        at, ids = want[r["doc_id"], r["piece"]][0]
        assert (r["start"], r["length"], list(r["ids"])) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places), sum(len(ids) for v in want.values() for _, ids in v)


def test_pieces_and_places(spark):
    rng = random.Random(5)
    words = ["moron", "don't", "Élan", "x1y22", "a--b!!", "<|endoftext|>", "pre<|endoftext|>post", "naïve\u0301", "中文", "it's", "\u00a0", "a\u2003b", "\x1c"]
    rows = EDGES + [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(300)))) for i in range(200)]
    got = pack_documents(docs(spark, rows), FILE, size=128).collect()
    n, total = check(rows, got, 128)
    assert n <= 1.06 * total / 128 + 1
    assert pack_documents(docs(spark, []), FILE).collect() == []


def test_plan_covers_the_histogram_and_wastes_little():
    rng = random.Random(1)
    for size, n in ((64, 1), (64, 50), (512, 20_000), (4096, 30_000)):
        hist = defaultdict(int)
        for _ in range(n):
            hist[min(size, max(1, int(rng.lognormvariate(np.log(size / 6), 1))))] += 1
        rows, sequences = plan(dict(hist), size)
        least = sum(k * v for k, v in hist.items()) / size
        assert least <= sequences <= 1.02 * least + 2
        assert len(rows) <= 30 * size


def test_words_of_hard_texts():
    from groundwork.llm.packing import WordIds, spread

    rng = random.Random(15)
    parts = list("aBcÉéßİıΣσ12.,;:!?#%&$*|<>'-_/\\ \t\n") + ["<|endoftext|>", "<|EndOfText|>", "it's", "don't.", "!!", "...", "\u0301", "\u0307", "H\u0331", "ﬁ", "日本", "\u2028", "\xa0", "é.", "Ünï,", "word|", "a<|b"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(3000)] + ["", " ", "<|startoftext|>."]
    ids_of = WordIds(FILE)
    for some in (texts[:1500], texts[1500:], texts[:700]):
        found, place, ends = spread([t.encode() for t in some])
        ids_of.learn(found)
        last = 0
        for text, end in zip(some, ends.tolist()):
            got = np.frombuffer(b"".join(ids_of.words[found[i]] for i in place[last:end]), "<u4").tolist()
            last = end
            assert got == TOKENIZER.encode(text, add_special_tokens=False).ids, text
