import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from groundwork.functions import text as T

ALPHABET = "aB1 .!?\n\t é[]2İ\x1c_-"


def gathered(strategy, n=200):
    out = []

    @settings(max_examples=n, deadline=None)
    @given(strategy)
    def run(x):
        out.append(x)

    run()
    return out


def sentences(text):
    return [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]


def test_tokens_words_sentences(spark):
    texts = gathered(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=20)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.tokens("t").alias("k"), T.words("t").alias("w"), T.sentences("t").alias("s"), T.content_tokens("t").alias("c")).collect()
    for r in got:
        tokens = re.findall("[a-z0-9]+", r["t"].lower())
        assert r["k"] == tokens
        assert r["c"] == [t for t in tokens if t not in T.STOPWORDS]
        assert r["w"] == r["t"].split()
        assert r["s"] == sentences(r["t"])
    assert len(set(T.STOPWORDS)) == 82


def test_citations(spark):
    rows = [("Tides follow the moon [2], storms the sun [1][2]; see also [7].", [2, 1]), ("", []), ("[0][3][99999999999999999999]", []), ("[2] [1]", [2, 1])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").withColumn("ids", F.array(F.lit("x"), F.lit("y")))
    got = df.select(T.citations("t", 2).alias("n"), T.cited("t", "ids").alias("c"), T.strip_citations("t").alias("p")).collect()
    assert [r["n"] for r in got] == [n for _, n in rows]
    assert got[3]["c"] == ["y", "x"] and got[0]["p"].count("[") == 0


def f1(p, r):
    if not p and not r:
        return 1.0
    n = sum((Counter(p) & Counter(r)).values())
    return 2 * n / (len(p) + len(r)) if n else 0.0


def test_f1_and_grounding(spark):
    pairs = gathered(st.tuples(st.text("ab c", max_size=12), st.text("ab c", max_size=12)), 100)
    df = spark.createDataFrame(pairs, "a string, b string").select(F.filter(F.split("a", " "), lambda x: x != "").alias("a"), F.filter(F.split("b", " "), lambda x: x != "").alias("b"))
    for r in df.select("a", "b", T.token_f1(F.col("a"), F.col("b")).alias("f")).collect():
        assert abs(r["f"] - f1(r["a"], r["b"])) < 1e-12
    g = spark.createDataFrame([("moons phobos [1] rome", "mars moons Phobos"), ("the of", "x")], "a string, c string").select(T.grounding("a", "c").alias("g")).collect()
    assert [round(r["g"], 6) for r in g] == [0.666667, 1.0]


def test_overlap_of_long_and_odd_tokens(spark):
    import random
    from collections import Counter

    rng = random.Random(2)
    rows = [([rng.choice("abcdefg") for _ in range(rng.randrange(30))], [rng.choice("cdefghi") for _ in range(rng.randrange(30))]) for _ in range(60)]
    rows += [(["x"] * 20_000 + [str(i) for i in range(20_000)], ["x"] * 15_000 + [str(i) for i in range(0, 40_000, 2)]), (["1", "11"], ["11", "1", "1"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["n"] for r in df.select("i", T.overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert all(got[i] == sum((Counter(a) & Counter(b)).values()) for i, (a, b) in enumerate(rows))
    counted = {r["i"]: r["r"] for r in df.select("i", T.runs(F.col("a")).alias("r")).collect()}
    assert all([tuple(x) for x in counted[i]] == sorted(Counter(a).items()) for i, (a, _) in enumerate(rows))


def test_grounding_of_long_texts(spark):
    answer, context = " ".join(f"w{i % 5000}" for i in range(30_000)), " ".join(f"w{i}" for i in range(0, 20_000, 2))
    df = spark.createDataFrame([(answer, context), ("w1 w1 w2", ""), ("", "w1"), (None, "w1")], "a string, c string")
    assert [r["g"] for r in df.select(T.grounding("a", "c").alias("g")).collect()] == [0.5, 0.0, 1.0, None]


def test_all_white_space(spark):
    """Every code point that Python's str.split takes for white space, and some that it doesn't."""
    import sys

    space = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    other = ["\u200b", "\u180e", "\u2060", "\ufeff", "\x1b", "\x21", "\x84"]
    rows = [(f"{c}a.{c}b{c}{c}c{c}",) for c in space + other]
    for (t,), r in zip(rows, spark.createDataFrame(rows, "t string").coalesce(1).select(T.words("t").alias("w"), T.strip("t").alias("s"), T.sentences("t").alias("z")).collect()):
        assert r["w"] == t.split() and r["s"] == t.strip() and r["z"] == [x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x]
