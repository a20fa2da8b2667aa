import random

from groundwork.llm.decontam import decontaminate, overlaps

from .helpers import EDGES, docs


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n)]


def brute(texts, items, least, identity):
    """Pairs with an aligned stretch that the best-overlap rule accepts, over every alignment."""
    out = set()
    for i, t in texts:
        for j, b in items:
            for shift in range(-len(b) + 1, len(t)):
                best = total = n = length = 0
                top = (0, 0, 0)
                for k in range(len(b)):
                    if 0 <= shift + k < len(t):
                        same = t[shift + k] == b[k]
                        total, n, length = (total, n, length) if total > 0 else (0, 0, 0)
                        total, n, length = total + (1 if same else -2), n + same, length + 1
                        if total > best:
                            best, top = total, (total, n, length)
                need = min(least, -(-len(b) * 8 // 10))
                if best and top[1] >= need and top[1] >= identity * top[2]:
                    out.add((i, j))
    return out


def test_planted_items_are_found_and_clean_texts_stay(spark):
    rng = random.Random(8)
    items = [(j, prose(rng, n)) for j, n in enumerate((10, 15, 20, 30, 55, 120))]
    texts = []
    for i in range(90):
        w = prose(rng, rng.randrange(20, 120))
        if i % 3 == 1:
            p = list(items[i % 6][1])
            for _ in range(len(p) // 12):
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = p
        elif i % 3 == 2:  # too little of an item
            w[3:3] = items[3 + i % 3][1][:9]
        texts.append((i, w))
    rows = [(i, " ".join(w).upper().replace(" ", ", ", 7)) for i, w in texts] + [(None, "x")]
    rows += [(1000 + n, t) for n, (_, t) in enumerate(EDGES)]
    bench = spark.createDataFrame([(j, " ".join(b)) for j, b in items] + [(77, None), (78, ""), (None, "no id at all here or there")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in overlaps(docs(spark, rows), bench).collect()}
    assert got == brute(texts, items, 13, 0.8)
    assert {i for i, _ in got} == {i for i, _ in texts if i % 3 == 1}
    kept = {r["doc_id"] for r in decontaminate(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert overlaps(docs(spark, [(1, "a b c")]), none).collect() == []
    assert overlaps(docs(spark, []), none).collect() == []
    assert decontaminate(docs(spark, [(1, "a b c")]), none).count() == 1


def test_every_stretch_of_an_alignment(spark):
    rng = random.Random(18)
    item = prose(rng, 110)
    text = prose(rng, 20) + item[:40] + prose(rng, 40) + item[80:] + prose(rng, 15)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = overlaps(docs(spark, [(5, " ".join(text))]), bench).collect()
    assert sorted((r["doc_start"], r["item_start"], r["n_words"], r["n_equal"]) for r in found) == [(20, 0, 40, 40), (100, 80, 30, 30)]


def test_repeated_ids_long_texts_and_clashing_names(spark):
    rng = random.Random(19)
    item, clean = prose(rng, 30), " ".join(prose(rng, 50_000))
    leak = " ".join(prose(rng, 10) + item)
    rows = [(3, leak), (3, clean), (None, leak), (None, "no leak"), (4, clean + " " + leak), (5, None), (6, ""), (3, leak)]
    df = spark.createDataFrame([(i, t, 0, "y") for i, t in rows], "doc_id long, text string, seed int, __key string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item))], "item_id long, text string")
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, clean), (None, "no leak"), (5, None), (6, "")], key=repr)


def test_short_items(spark):
    """Items of 1 to 12 words, whole or with one word another, against brute force."""
    rng = random.Random(28)
    items = [(n, prose(rng, n)) for n in range(1, 13)]
    texts = []
    for n, item in items:
        for at in (None, *range(n)):
            own = [w if i != at else "another" for i, w in enumerate(item)]
            texts.append((len(texts), prose(rng, rng.randrange(4)) + own + prose(rng, rng.randrange(4))))
    texts += [(1000 + i, prose(rng, 30)) for i in range(20)] + [(2000, items[6][1]), (2001, items[6][1][:6]), (2002, items[8][1][:4] + ["x"] + items[8][1][5:])]
    bench = spark.createDataFrame([(j, " ".join(b)) for j, b in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in overlaps(docs(spark, [(i, " ".join(w)) for i, w in texts]), bench).collect()}
    assert got == brute(texts, items, 13, 0.8)
    assert {(2000, 7), (2002, 9)} <= got and not any(1000 <= i < 2000 for i, _ in got)
