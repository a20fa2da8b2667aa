"""The stored inverted index: skipping is exact, parts are summed, and only what is asked is read."""

import random
import shutil
from pathlib import Path

import pyarrow as pa
import pytest

from groundwork import settings as C
from groundwork.operators import sparse
from groundwork.plans import index as I

HOW = C.from_dict(C.merged(C.BASE, {"chunking": {"strategy": "fixed", "chunk_size": 12, "chunk_overlap": 2}, "embedder": {"dim": 16}}))
WORDS = [f"w{i}" for i in range(60)]


def texts(seed, count):
    """Skewed words; every tenth document holds a rare one many times."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        own = [WORDS[min(int(rng.expovariate(0.15)), 59)] for _ in range(rng.randrange(0, 40))]
        out.append(" ".join(own + [f"rare{i % 50}"] * (i % 4 if i % 10 == 0 else 0)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(f"d{i:04}", "", t, None, i) for i, t in rows], "doc_id string, title string, text string, metadata map<string,string>, doc_seq long")


def asked(spark, seed, count):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice([*WORDS[:30], "rare1", "rare20", "unknown"]) for _ in range(rng.randrange(0, 9))) for _ in range(count)]
    return spark.createDataFrame([(f"q{i:02}", t) for i, t in enumerate(lines)], "question_id string, question string")


def ranking(df):
    return sorted((r["question_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("block,k", [(8, 3), (8, 40), (64, 5)])
def test_skipping_gives_the_same_ranking(spark, tmp_path, monkeypatch, block, k):
    monkeypatch.setattr(sparse, "BLOCK", block)
    docs = table(spark, list(enumerate(texts(block, 400)))).repartition(3)
    built = I.build(docs, HOW)
    I.save(built, HOW, str(tmp_path))
    stored = I.load(spark, HOW, str(tmp_path))
    assert "lists" in stored and "lists" not in built
    q = asked(spark, k, 25)
    want = ranking(sparse.search(q, built, k))
    assert ranking(sparse.search(q, stored, k)) == want
    # the lists' terms joined instead of named
    monkeypatch.setattr(sparse, "NAMED", 2)
    assert ranking(sparse.search(q, stored, k)) == want


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Blocks that share only common words with a question aren't scored once better chunks are known."""
    took = []
    real = sparse._score_block
    monkeypatch.setattr(sparse, "_score_block", lambda *a: took.append(real(*a)) or took[-1])
    first = sparse._First(2)

    def block(n, words):
        asked = pa.array([[{"question_id": "q", "weight": w}] for w, _ in words], pa.list_(pa.struct([("question_id", pa.string()), ("weight", pa.float64())])))
        lists = pa.array([[{"chunk_id": f"{n}-{i}", "doc_seq": n, "ordinal": i, "tf": tf, "dl": 10} for i in range(5)] for _, tf in words], pa.list_(sparse._POSTING))
        return pa.table({"max_tf": [tf for _, tf in words], "min_dl": [10] * len(words), "postings": lists, "asked": asked})

    for n, words in enumerate([[(0.1, 1)], [(0.1, 1), (5.0, 2)], [(0.1, 3)], [(0.1, 1), (5.0, 2)]]):
        sparse._score_block(block(n, words), first, 10.0)
    assert took == [5, 10, 0, 10]  # the third block is left out, the fourth can tie
    score, chunk, _, _ = first.rows["q"]
    assert chunk.tolist() == ["1-0", "1-1"]


def test_questions_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse, "QUESTIONS", 4)
    monkeypatch.setattr(sparse, "PAIRS", 10)
    monkeypatch.setattr(sparse, "BLOCK", 16)
    built = I.build(table(spark, list(enumerate(texts(6, 300)))).repartition(3), HOW)
    I.save(built, HOW, str(tmp_path))
    q = asked(spark, 4, 30)
    assert ranking(sparse.search(q, I.load(spark, HOW, str(tmp_path)), 7)) == ranking(sparse.search(q, built, 7))


def test_asked_terms_reach_the_reader(spark, tmp_path):
    I.save(I.build(table(spark, list(enumerate(texts(1, 50)))), HOW), HOW, str(tmp_path))
    q = spark.createDataFrame([("q", "w1 needle")], "question_id string, question string")
    plan = sparse.search(q, I.load(spark, HOW, str(tmp_path)), 5)._jdf.queryExecution().toString()
    assert "In(term, [" in plan


def same(spark, root, docs):
    """The index at ``root`` is what one build of ``docs`` gives."""
    built, stored = I.build(docs, HOW), I.load(spark, HOW, root)
    for name, columns in (("term_stats", ["term", "df", "idf"]), ("corpus_stats", ["n", "avgdl", "avg_idf"]), ("postings", ["term", "chunk_id", "tf", "weight"]), ("chunks", ["chunk_id", "text"])):
        a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t[name].select(*columns).collect()) for t in (built, stored))
        assert a == b, name
    assert stored["vectors"].count() == stored["chunks"].count()
    q = asked(spark, 9, 10)
    assert ranking(sparse.search(q, stored, 6)) == ranking(sparse.search(q, built, 6))


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_growth(spark, tmp_path):
    rows = list(enumerate(texts(3, 300)))
    root = str(tmp_path)
    assert I.add(table(spark, rows[:200]), HOW, root)["documents"] == len([t for _, t in rows[:200] if t])
    before = files(root)
    done = I.add(table(spark, rows[190:]), HOW, root)  # ten of them are there
    assert done["number"] == 1 and done["documents"] == len([t for _, t in rows[200:] if t])
    after = files(root)
    assert before.items() <= after.items()  # nothing written before is written again
    assert all("delta=1" in str(p) for p in after.keys() - before.keys())
    same(spark, root, table(spark, rows))
    # a part that is written again, as after a failure, replaces itself
    for p in Path(root).rglob("delta=1"):
        if "lists" in str(p):
            shutil.rmtree(p)
    assert I.add(table(spark, rows[190:]), HOW, root, number=1) == done
    same(spark, root, table(spark, rows))
    # nothing new, and an empty table
    assert I.add(table(spark, rows), HOW, root)["documents"] == 0
    assert I.add(table(spark, []), HOW, root)["chunks"] == 0
    same(spark, root, table(spark, rows))
    # a rebuild elsewhere joins the parts
    I.save(I.load(spark, HOW, root), HOW, f"{root}/new")
    same(spark, f"{root}/new", table(spark, rows))


def test_lists_by_term(spark, tmp_path):
    """Sorted lists are those that come by block, and are written without a shuffle, sorted in every file."""
    chunks = I.build(table(spark, list(enumerate(texts(5, 300)))).repartition(3), HOW)["chunks"].localCheckpoint()
    by_term, by_block = (sparse.lists(chunks, by_term=x).collect() for x in (True, False))
    assert sorted(map(str, by_term)) == sorted(map(str, by_block)) and len({r["block"] for r in by_term}) == 6
    assert [r["block"] for r in by_block] == sorted(r["block"] for r in by_block)
    I._part(spark, str(tmp_path), 0, chunks, HOW)
    files = list(Path(tmp_path).glob("lists/delta=0/*.parquet"))
    assert files
    for p in files:
        keys = [(r["term"], r["block"]) for r in spark.read.parquet(str(p)).select("term", "block").coalesce(1).collect()]
        assert keys == sorted(keys)
    # blocks weren't torn apart: all lists of a block are in one file
    held = [{r["block"] for r in spark.read.parquet(str(p)).select("block").distinct().collect()} for p in files]
    assert sum(map(len, held)) == len(set().union(*held))


@pytest.mark.parametrize("places", ["own", "shared", "none"])
def test_postings_meet_their_chunks(spark, tmp_path, monkeypatch, places):
    """Every stored posting with its chunk, dealt by places in the corpus that documents may share or lack; single postings don't move."""
    for name, value in (("PART", 20), ("SMALL", 20), ("DEALT", 300)):
        monkeypatch.setattr(sparse, name, value)
    seq = {"own": "doc_seq", "shared": "doc_seq div 150", "none": "cast(null as long)"}[places]
    docs = table(spark, list(enumerate(texts(7, 300)))).repartition(3).selectExpr("doc_id", "title", "text", "metadata", f"{seq} as doc_seq")
    built = I.build(docs, HOW)
    I.save(built, HOW, str(tmp_path))
    stored = I.load(spark, HOW, str(tmp_path))
    own = ["chunk_id", "doc_seq", "doc_id", "text"]
    parts = sparse._Parts(stored["chunks"])
    assert parts.count > 4 and parts.tied == (places != "own")
    found = sparse.with_chunks(stored, stored["chunks"].select(*own))
    want = built["postings"].select("term", "chunk_id", "tf", "weight").join(built["chunks"].select("chunk_id", "doc_id", "text"), "chunk_id")
    columns = ["term", "chunk_id", "tf", "doc_id", "text", "weight"]
    a, b = (sorted((*r[:5], round(r[5], 9)) for r in df.select(*columns).collect()) for df in (found, want))
    assert a == b and len(a) > 1000
    assert "hashpartitioning(chunk_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_an_index_are_small(spark, tmp_path, monkeypatch):
    """One file of chunks is parted for the lists, and the session's setting is there again; of two documents with an id one is taken."""
    monkeypatch.setattr(I, "READ", 20_000)
    monkeypatch.setattr(I, "GROUP", 20_000)
    name = "spark.sql.files.maxPartitionBytes"
    had, rng = spark.conf.get(name), random.Random(1)
    rows = [(i, " ".join(f"x{rng.getrandbits(60)}" for _ in range(12))) for i in range(4000)]
    docs = table(spark, rows + [rows[5], rows[7]]).coalesce(1)
    done = I.add(docs, HOW, str(tmp_path))
    assert done["documents"] == done["chunks"] == 4000 and spark.conf.get(name) == had
    count = lambda x: len(list(Path(tmp_path).glob(f"*/{x}/delta=0/*.parquet")))
    assert count("lists") >= 4 > count("chunks")
    assert I.load(spark, HOW, str(tmp_path))["postings"].count() == 12 * 4000


def test_nothing_to_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.load(spark, HOW, str(tmp_path))
    with pytest.raises(ValueError):
        I.save(I.build(table(spark, [(0, ""), (1, " ")]), HOW), HOW, str(tmp_path))
