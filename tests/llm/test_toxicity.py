import math
import random
import zlib

import numpy as np

from groundwork.llm.toxicity import Model, Settings, drop_toxic, fit, risks, scores, train

from .helpers import EDGES, docs


def test_held_out_texts_are_told_apart(spark):
    rng = random.Random(6)
    vocab = [f"word{n}" for n in range(3000)]
    rows, label = list(EDGES), []
    for i in range(10, 2010):
        toxic = i % 9 == 0
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 300))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["IDIOT!", "trash,", "scum"])
        rows.append((i, " ".join(w)))
        if i % 2:
            label.append((i, int(toxic)))
    labels = spark.createDataFrame(label + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = fit(docs(spark, rows), labels)
    got = scores(docs(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], r["doc_id"] % 9 == 0) for r in got if r["doc_id"] and r["doc_id"] >= 10 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((s >= 0.5) == t for s, t in held) / len(held)
    assert right > 0.97
    kept = drop_toxic(docs(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "key"] and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}


def test_without_examples(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit(docs(spark, EDGES), labels) == Model()
    assert {r["score"] for r in scores(docs(spark, EDGES), Model()).collect()} == {0.0}
    assert scores(docs(spark, []), Model()).collect() == []


def examples():
    rng = random.Random(8)
    rows = [(True, sorted({0} | set(rng.sample(range(2, 40), 5)))) for _ in range(60)]
    return rows + [(False, sorted(({0} if n % 8 == 0 else {1}) | set(rng.sample(range(2, 40), 5)))) for n in range(400)]


def test_risk_against_brute_force():
    rows = examples()
    rng = random.Random(9)
    weights, prior = [rng.uniform(-2, 2) for _ in range(40)], 0.125
    f = np.array([sum(weights[i] for i in x) - 0.3 for _, x in rows])
    loss = lambda z: math.log(1 + math.exp(-z))
    mean = lambda x: sum(x) / len(x)
    p, u = [z for z, (k, _) in zip(f, rows) if k], [z for z, (k, _) in zip(f, rows) if not k]
    want = prior * mean([loss(z) for z in p]), mean([loss(-z) for z in u]) - prior * mean([loss(-z) for z in p])
    assert np.allclose(risks(f, np.array([k for k, _ in rows]), prior), want)


def test_the_negative_risk_is_corrected():
    rows, prior = examples(), 0.125
    positive = np.array([k for k, _ in rows])
    weights, bias, corrected = train(rows, 40, prior, Settings())
    assert 10 < corrected < Settings().rounds
    f = np.array([sum(weights[i] for i in x) + bias for _, x in rows])
    assert (f[positive] >= 0).mean() == 1 and abs((f[~positive] >= 0).mean() - prior) < 0.06
    # a negative risk that stays far above zero is never corrected
    assert train(rows, 40, prior, Settings(rounds=3))[2] == 0
    assert risks(f, positive, prior)[1] > -prior


def test_hard_rows(spark):
    rng = random.Random(10)
    words = [f"w{n}" for n in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=20) + (["scum"] if i % 5 == 0 else []))) for i in range(600)]
    rows += rows[:50] + [(700, None), (701, ""), (None, "scum"), (702, " ".join(rng.choices(words, k=60_000)))]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, positive int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)] * 2 + [(None, 1), (700, None)], "doc_id long, toxic int")
    model = fit(df, labels)
    got = scores(df, model).collect()
    assert len(got) == len(rows) and all((r["score"] >= 0.5) == (r["doc_id"] is None or r["doc_id"] < 700 and r["doc_id"] % 5 == 0) for r in got)
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 for i, t in rows if not (i is None or i < 700 and i % 5 == 0))
