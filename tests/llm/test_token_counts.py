import base64
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from groundwork.llm.token_counts import load, pre_tokens, token_counts

from .helpers import EDGES, docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def count(text):
    merger = load(MODEL)
    parts = pre_tokens(text, merger.splits)
    return int(merger.counts(parts).sum()) if parts else 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab ▁e\n<s>/é中\U0001f600"), st.text("aeinrst ", max_size=60)))
def test_counts_match_the_library(text):
    assert count(text) == len(SP.encode(text))


def test_long_runs_and_words():
    rng = random.Random(1)
    junk = base64.b64encode(rng.randbytes(300_000)).decode()
    for text in (junk, " " * 60_000, "x" + " " * 9_000 + "y  " * 3_000, "=-" * 20_000, "a" * 50_000, " " * 3_001, "ab" * 20_000, "".join(rng.choice("etaoinshr") for _ in range(30_000)), "<s></s><unk> \u2581x"):
        assert count(text) == len(SP.encode(text))


def test_whole_table(spark):
    rng = random.Random(2)
    rows = EDGES + [(10 + i, " ".join("".join(rng.choice("etaoinü.") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(400)))) for i in range(60)]
    got = sorted(map(tuple, token_counts(docs(spark, rows), MODEL, limit=100).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 100) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert token_counts(docs(spark, []), MODEL).collect() == []
