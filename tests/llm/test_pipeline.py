import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from groundwork.llm.toxicity import fit, scores

from .test_ngram_join import shingle_set


def tables(spark, root):
    rng = random.Random(11)

    def prose(n):
        return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(n)]

    docs, labels = [], []
    items = [prose(n) for n in (15, 30, 50)]
    passage = prose(60)
    clean = []
    for i in range(400):
        w = prose(rng.randrange(60, 200))
        kind = i % 8
        if kind == 1:
            w[5:5] = [rng.choice(["idiot", "scum", "trash"])]
        elif kind == 2:
            w = list(clean[-1])
            w[3] = "edited"
        elif kind == 3:
            w[20:20] = passage
        elif kind == 4:
            w[9:9] = items[i % 3]
        else:
            clean.append(w)
        docs.append((i, " ".join(w), "en", f"s{i % 3}", None))
        labels.append((i, 1, int(kind == 1)))
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "two words", None, None, 9), (None, "a text without an id that stays", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return docs, passage, items


def test_every_stage_against_brute_force(spark, tmp_path):
    root = str(tmp_path)
    rows, passage, items = tables(spark, root)
    df = spark.read.parquet(f"{root}/documents.parquet")
    columns, texts = df.columns, {i: t for i, t, *_ in rows}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    def step(name, df):
        made = stages[name](spark, df, root)
        assert made.columns == columns
        made.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    model = fit(df, spark.read.parquet(f"{root}/labels.parquet"))
    bad = {r["doc_id"] for r in scores(df, model).collect() if r["score"] >= 0.5}
    assert bad == {i for i in range(400) if i % 8 == 1}
    df = step("toxicity", df)
    left = {r["doc_id"]: r["text"] for r in df.collect()}
    assert left == {i: t for i, t in texts.items() if i not in bad}

    df = step("ngram_jaccard_join", df)
    kept, want = {r["doc_id"] for r in df.collect()}, set()
    sets = {i: shingle_set(t, 5) for i, t in left.items()}
    parent = {i: i for i in sets}
    for a in [x for x in sets if x is not None]:
        for b in [x for x in sets if x is not None and x < a]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                parent[a] = min(parent[a], b)
    want = {i for i in sets if parent[i] == i}
    assert kept == want and None in kept and {900, 901} <= kept

    df = step("substring_dedup", df)
    now = {r["doc_id"]: r for r in df.collect()}
    assert now.keys() == want
    assert sum(" ".join(passage) in (r["text"] or "") for r in now.values()) == 1
    for i, r in now.items():
        if i is None or i % 8 not in (3, 4) or i >= 400:
            assert r["text"] == texts[i]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))

    df = step("decontamination", df)
    clean = {r["doc_id"]: r["text"] for r in df.collect()}
    assert clean.keys() == {i for i, r in now.items() if not any(" ".join(x[:14]) in (r["text"] or "") or " ".join(x[-14:]) in (r["text"] or "") for x in items)}

    packed = stages["packing"](spark, df, root).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total, by = defaultdict(int), defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
        by[r["sequence_id"]] += r["length"]
    assert total == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert max(by.values()) <= 4096
    assert sorted(map(tuple, corpus_pipeline.run(spark, root).select("doc_id", "piece", "length", "ids_crc32").collect()), key=repr) == sorted(
        ((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed), key=repr
    )


def test_hard_rows_in_every_stage(spark, tmp_path):
    rng = random.Random(12)

    def prose(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]

    root, passage, item = str(tmp_path), prose(60), prose(30)
    copy, long_ = " ".join(prose(80)), " ".join(prose(40_000))
    rows = [(1, copy), (1, copy), (2, copy), (None, copy), (None, copy), (3, " ".join(prose(70) + passage)), (3, " ".join(prose(90))), (None, " ".join(passage + prose(20)))]
    rows += [(4, " ".join(prose(5) + item)), (None, " ".join(prose(6) + item)), (5, long_), (6, None), (6, None), (7, ""), (8, "scum " + " ".join(prose(9))), (None, "scum and more"), (9, " ".join(passage + prose(50)))]
    rows += [(100 + i, " ".join(prose(12) + ["scum"] * (i % 3 == 0))) for i in range(120)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, __key int, component int, score int, length int"
    spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3, 4) for i, t in rows], columns).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    df = spark.read.parquet(f"{root}/documents.parquet")
    left = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, df, root)
        assert made.columns == df.columns
        made.write.parquet(f"{root}/{n}")
        df = spark.read.parquet(f"{root}/{n}")
        left.append([(r["doc_id"], r["text"]) for r in df.collect()])
    order = lambda x: sorted(x, key=repr)
    assert order(left[0]) == order((i, t) for i, t in rows if "scum" not in (t or ""))
    near, copies = [x for x in left[0] if x[1] != copy], [x for x in left[1] if x[1] == copy]
    assert copies == [(2, copy)] or copies == [(1, copy)]
    assert order(x for x in left[1] if x[1] != copy) == order(near)
    cut = {i: t for i, t in left[2]}
    # the smallest id that has the passage keeps it
    assert sum(" ".join(passage) in (t or "") for _, t in left[2]) == 1 and any(i == 3 and " ".join(passage) in t for i, t in left[2])
    assert len(left[2]) == len(left[1]) and cut[5] == long_ and cut[7] == "" and cut[6] is None
    assert order(x for x in left[3]) == order(x for x in left[2] if " ".join(item) not in (x[1] or ""))
    packed = corpus_pipeline.STAGES[-1][1](spark, df, root).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in left[3]} and sum(r["piece"] == 0 for r in packed) == len(left[3])


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []
