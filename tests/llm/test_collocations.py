import random
import re
from collections import Counter, defaultdict

import pytest

from groundwork.llm import collocations as module
from groundwork.llm.collocations import collocations


def brute(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in c.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= own[p[i:j]]}
        rows_ = []
        for p, a in c.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:first], 1)]
    return sorted(out)


def texts(seed, count):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "é", "Ä", "a\x01b", "x\x00", "old", "hall"]
    out = []
    for _ in range(count):
        own = []
        for _ in range(rng.randrange(60)):
            own.append(rng.choice(words) if rng.random() < 0.7 else "new york city hall")
            own.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", " ", " "]))
        out.append(("".join(own), rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("least,first", [(3, 2000), (20, 7), (100, 2000)])
def test_brute_force(spark, monkeypatch, least, first):
    rows = texts(least, 250) + [(None, "en"), ("", "fr"), (" \t", "de"), ("one", "it")] + [("same line of words again", "en")] * 120
    df = spark.createDataFrame([(t, g, 1, "k") for t, g in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = collocations(df, least, first).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, first)
    # every first word dealt further, texts parted at separators
    monkeypatch.setattr(module, "HOT", 1e-9)
    assert sorted(map(tuple, collocations(df, least, first).collect())) == brute(rows, least, first)


def test_small_batches_and_long_texts(spark):
    rng = random.Random(5)
    long_ = " ".join(rng.choice(["a", "b", "c", "d.", "e"]) for _ in range(200_000))
    rows = [(long_, "en"), ("a b c " * 50_000, "de"), ("x" * 300_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, collocations(df).collect())) == brute(rows, 100, 2000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_segments(monkeypatch):
    monkeypatch.setattr(module, "AT_ONCE", 10)
    for text in (b"aaa.bb.cccccc.d.eeeeeeeeeeeeeeeee.f", b"x" * 50, b"", b"." * 40, b"y" * 30 + b".z"):
        parts = list(module._segments(text))
        assert b".".join(parts) == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(df).collect() == []
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
