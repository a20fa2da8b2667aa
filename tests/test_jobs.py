"""Both jobs on copies: growing input, reruns, failures, command lines."""

import json
import logging
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from groundwork.plans import index
from jobs import index_documents, pipeline, queries, read_config, retrieval_report
from jobs.queries import HERE

CONFIG = read_config(HERE / "index_documents.yaml")
REPORT = read_config(HERE / "retrieval_report.yaml")
SCHEMA = "doc_id long, text string, source string, lang string"


def docs(first, last, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rng.expovariate(0.1)), 80)}" for _ in range(rng.randrange(5, 300))) if i % 9 else None, "s", "en") for i in range(first, last)]


def put(spark, rows, folder, name):
    """One more file in a folder of copies."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    Path(folder).mkdir(exist_ok=True)
    for p in Path(f"{folder}-{name}").glob("*.parquet"):
        shutil.copy(p, f"{folder}/{name}.parquet")


def stored(spark, root):
    built = index.load(spark, pipeline(CONFIG), root)
    return {name: sorted(map(str, built[name].collect())) for name in ("chunks", "postings", "term_stats", "corpus_stats")}


def whole(spark, rows, root):
    """One build of all rows, for comparison."""
    how = pipeline(CONFIG)
    df = index_documents.documents(spark.createDataFrame(rows, SCHEMA), CONFIG["columns"])
    index.save(index.build(df, how), how, root)
    return stored(spark, root)


def close(a, b):
    """Postings hold sums of doubles; everything else is equal."""
    import re

    cut = lambda rows: sorted(re.sub(r"(\.\d{9})\d+", r"\1", r) for r in rows)
    return all(cut(a[k]) == cut(b[k]) for k in a)


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_index_grows(spark, tmp_path, caplog):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: index_documents.run(spark, folder, out, state, CONFIG)
    put(spark, docs(0, 60), folder, "a")
    with caplog.at_level(logging.INFO, "jobs"):
        first = run()
    assert [(b["batch"], b["read"]) for b in first] == [(0, 60)] and first[0]["documents"] == 53
    assert "read 60 rows" in caplog.text and "53 documents" in caplog.text
    before = files(out)
    assert run() == [] and files(out) == before  # nothing is new
    # new documents, some that are there already (one with another text), rows without an id
    put(spark, docs(50, 90) + [(3, "another text", "s", "en"), (None, "no id", "s", "en")], folder, "b")
    second = run()
    assert [b["batch"] for b in second] == [1] and second[0]["read"] == 42
    after = files(out)
    assert before.items() <= after.items() and all("delta=1" in str(p) for p in after.keys() - before.keys())
    new = [r for r in docs(50, 90) if r[0] >= 60 or r[0] == 54]  # 54 had no text before
    want = docs(0, 60) + [r for r in new if r[0] >= 60]
    assert close(stored(spark, out), whole(spark, want, str(tmp_path / "whole")))


def test_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, docs(0, 40), folder, "a")
    real = index_documents.index.add

    def breaks(*args, **kw):
        real(*args, **kw)
        raise RuntimeError("after the write")

    monkeypatch.setattr(index_documents.index, "add", breaks)
    with pytest.raises(Exception, match="after the write"):
        index_documents.run(spark, folder, out, state, CONFIG)
    monkeypatch.setattr(index_documents.index, "add", real)
    assert [b["batch"] for b in index_documents.run(spark, folder, out, state, CONFIG)] == [0]
    assert close(stored(spark, out), whole(spark, docs(0, 40), str(tmp_path / "whole")))


def test_json_in_several_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.json").write_text("".join(json.dumps({"key": f"k{n}-{i}", "body": f"word{i} and more", "at": 10 * n + i}) + "\n" for i in range(10)))
    config = CONFIG | {"input": {"format": "json", "schema": "key string, body string, at long", "files_per_batch": 1}, "columns": {"id": "key", "order": "at", "text": "body"}}
    done = index_documents.run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), config)
    assert [b["documents"] for b in done] == [10, 10, 10]
    built = index.load(spark, pipeline(config), str(tmp_path / "out"))
    assert built["term_stats"].where("term = 'more'").first()["df"] == 30


def test_index_read_back(spark, tmp_path):
    """Every posting with its chunk; lists and postings meet by hashes, so that no sort grows with them."""
    put(spark, docs(0, 60), str(tmp_path / "documents"), "a")
    shutil.copytree(tmp_path / "documents", tmp_path / "sf" / "documents.parquet")
    found = queries.job1_index_documents(spark, str(tmp_path / "sf"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    how = pipeline(CONFIG)
    built = index.build(index_documents.documents(spark.createDataFrame(docs(0, 60), SCHEMA), CONFIG["columns"]), how)
    chunks = {r["chunk_id"]: (r["doc_id"], r["ordinal"], r["title"], len(r["text"].split())) for r in built["chunks"].collect()}
    want = {(r["term"], r["chunk_id"], *chunks[r["chunk_id"]], r["tf"], round(r["weight"], 6)) for r in built["postings"].collect()}
    got = [(r["term"], r["chunk_id"], r["doc_id"], r["ordinal"], r["title"], r["n_words"], r["tf"], r["weight"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def report(spark, root):
    return {name: sorted(map(str, spark.read.parquet(f"{root}/{name}").collect())) for name in ("rankings", "per_question", "summary")}


def test_report(spark, tmp_path, caplog):
    rows = docs(0, 80, seed=4)
    asked = [(i, " ".join((rows[i][1] or "nothing at all here").split()[2:9])) for i in range(0, 80, 5)] + [(1000, "w1"), (1001, "not in any of these documents"), (None, "x")]
    put(spark, rows, str(tmp_path / "docs"), "a")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    out = str(tmp_path / "out")
    run = lambda config: retrieval_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), out, config)
    with caplog.at_level(logging.INFO, "jobs"):
        sizes = run(REPORT)
    assert sizes["questions"] == 18 and "wrote" in caplog.text
    first = report(spark, out)
    assert {p.name for p in (tmp_path / "out" / "summary").iterdir() if p.is_dir()} == {"variant=bm25", "variant=bm25_rerank"}
    means = {(r["variant"], r["metric"]): r for r in spark.read.parquet(f"{out}/summary").collect()}
    held = {str(i): {str(d[0]) for d in rows if q in (d[1] or "")} for i, q in asked if i is not None}
    found = {}
    for r in sorted(spark.read.parquet(f"{out}/rankings").where("variant = 'bm25'").collect(), key=lambda r: r["rank"]):
        own = found.setdefault(r["question_id"], [])
        if (d := r["chunk_id"].split("#")[0]) not in own:
            own.append(d)
    recall = [len(d & set(found.get(q, [])[:10])) / len(d) for q, d in held.items() if d]
    assert abs(means["bm25", "recall@10"]["mean"] - sum(recall) / len(recall)) < 1e-9 and means["bm25", "recall@10"]["n"] == len(recall)
    assert means["bm25", "mrr"]["z"] is None and means["bm25_rerank", "mrr"]["n_differ"] is not None
    assert run(REPORT) == sizes and report(spark, out) == first  # again, with the same result
    # one more variant into the same report: the others' partitions stay
    kept = {p: t for p, t in files(f"{out}/per_question").items()}
    run(REPORT | {"variants": {"dense": {"retrieval": {"bm25": {"enabled": False}, "dense": {"enabled": True}, "rerank": {"enabled": False}}}}})
    assert kept.items() <= files(f"{out}/per_question").items()
    last = spark.read.parquet(f"{out}/summary")
    assert last.select("variant").distinct().count() == 3 and last.where("variant = 'dense'").first()["diff_mean"] is not None


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command line parses plain paths, and creates and stops a session of its own."""
    stopped = []
    monkeypatch.setattr(SparkSession, "stop", lambda self: stopped.append(self))
    put(spark, docs(0, 10), str(tmp_path / "docs"), "a")
    spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    args = ["--input", str(tmp_path / "docs"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state")]
    index_documents.main(["--config", str(HERE / "index_documents.yaml"), *args])
    retrieval_report.main(["--config", str(HERE / "retrieval_report.yaml"), "--documents", str(tmp_path / "docs"), "--questions", str(tmp_path / "asked"), "--output", str(tmp_path / "report")])
    assert len(stopped) == 2 and (tmp_path / "report" / "summary").exists()
    with pytest.raises(SystemExit):
        index_documents.main([])
