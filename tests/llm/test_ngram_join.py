import random

from pyspark.sql import types as T

from groundwork.llm.ngram_join import jaccard_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sig", T.StringType())])


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []

    def add(words):
        rows.append((len(rows) + 5, " ".join(words)))

    for size in (1, 2, 3, 4, 8, 12, 20, 33, 60, 150, 400):
        base = [rng.choice(vocab) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            new = list(base)
            for _ in range(min(edits, size)):
                new[rng.randrange(size)] = rng.choice(vocab)
            add(new)
    base = [rng.choice(vocab) for _ in range(120)]
    for n in range(60):  # one large group of near copies around the threshold
        new = list(base)
        for _ in range(n % 4):
            new[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        add(new)
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d"), (4, "É É Word word"), (0, "É É word WORD")]


def test_same_groups_as_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    for k, num, den in ((3, 90, 100), (5, 8, 10)):
        got = jaccard_components(df, k, num, den).collect()
        assert len(got) == len(rows)
        assert {r["id"]: (r["n_shingles"], r["component"]) for r in got if r["id"] is not None} == brute(rows, k, num, den)


def brute_links(rows, k, num, den):
    """For each id the number of other distinct sets that its set links with."""
    own = {i: frozenset(shingle_set(t, k)) for i, t in rows if i is not None}
    sets = set(own.values())
    near = {s: sum(s != o and den * len(s & o) >= num * len(s | o) for o in sets) if s else 0 for s in sets}
    return {i: near[s] for i, s in own.items()}


def test_links_in_large_groups_are_all_counted(spark):
    base = [f"b{n}" for n in range(150)]

    def edit(*at):
        return " ".join(f"e{n}" if n in at else w for n, w in enumerate(base))

    rows = [(n, edit()) for n in range(9)] + [(20, edit(0)), (21, edit(149)), (22, edit(0, 149))]  # copies beside different near texts
    rows += [(100 + n, edit(n, 149 - n % 3)) for n in range(0, 140, 2)]
    for k, num, den in ((3, 90, 100), (5, 8, 10)):
        got = jaccard_components(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), k, num, den).collect()
        assert {r["id"]: r["n_links"] for r in got} == brute_links(rows, k, num, den)
    rows = corpus()
    got = jaccard_components(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), 5, 8, 10).collect()
    assert {r["id"]: r["n_links"] for r in got if r["id"] is not None} == brute_links(rows, 5, 8, 10)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, "a b c d e f g", "x")] * 3 + [(9, "A b c d e f g", "y")]
    got = sorted((r["id"], r["component"]) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(7, 7)] * 3 + [(9, 7)]


def test_all_copies_and_long_text(spark):
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    rows = [(i, "one two three four five six", "x") for i in range(200)] + [(500, long, "x"), (501, long + " z", "x")]
    got = {r["id"]: r["component"] for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500}
