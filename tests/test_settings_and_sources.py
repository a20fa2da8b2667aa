import json

import pytest

from groundwork import settings as C
from groundwork.sources import files


def test_settings(tmp_path):
    (tmp_path / "variants").mkdir()
    import yaml

    (tmp_path / "base.yaml").write_text(yaml.safe_dump(C.BASE | {"extends": "nothing"}))
    (tmp_path / "variants" / "v.yaml").write_text("extends: base\nname: v\nretrieval:\n  bm25:\n    enabled: false\n")
    how = C.load(tmp_path / "variants" / "v.yaml")
    assert how.name == "v" and not how.retrieval.bm25.enabled and how.retrieval.dense.enabled and how.retrieval.top_k == 5
    (tmp_path / "variants" / "w.yaml").write_text("extends: missing\n")
    with pytest.raises(FileNotFoundError):
        C.load(tmp_path / "variants" / "w.yaml")
    for over in (
        {"chunking": {"chunk_overlap": 256}},
        {"embedder": {"backend": "other"}},
        {"retrieval": {"top_k": 0}},
        {"eval": {"bootstrap": {"confidence": 1}}},
        {"generation": {"provider": "anthropic", "model": "m"}, "eval": {"judge": {"provider": "anthropic", "model": "m"}}},
    ):
        with pytest.raises(ValueError):
            C.from_dict(C.merged(C.BASE, over))
    a, b = (C.from_dict(C.merged(C.BASE, x)) for x in ({"retrieval": {"top_k": 3}}, {"embedder": {"dim": 8}}))
    assert a.signature() == C.from_dict(C.BASE).signature() != b.signature()
    assert [v.name for v in C.VARIANTS] == ["closed_book", "dense_only", "hybrid", "hybrid_rerank", "oracle"]


def test_corpus(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"id": "b", "text": "x", "title": "T"}\n\n{"id": "a", "text": "y", "metadata": {"k": "v"}}\n')
    rows = files.read_corpus(spark, str(tmp_path)).orderBy("doc_seq").collect()
    assert [(r["doc_id"], r["title"], r["metadata"]) for r in rows] == [("b", "T", {}), ("a", "", {"k": "v"})]
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path / "e.jsonl"))
    (tmp_path / "bad.jsonl").write_text('{"text": "no id"}\n')
    with pytest.raises(Exception, match="no id"):
        files.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_questions(spark, tmp_path):
    good = {"id": "1", "question": "q", "relevant_doc_ids": ["d"]}
    (tmp_path / "dev.jsonl").write_text(json.dumps(good) + "\n")
    (tmp_path / "test.jsonl").write_text(json.dumps({"id": "2", "question": "q", "no_answer": True}) + "\n" + json.dumps(good | {"id": "3"}) + "\n")
    rows = files.read_questions(spark, str(tmp_path)).orderBy("question_seq").collect()
    assert [(r["question_id"], r["split"], r["no_answer"], r["relevant_doc_ids"]) for r in rows] == [("1", "dev", False, ["d"]), ("2", "test", True, []), ("3", "test", False, ["d"])]
    for bad in ({"id": "1", "question": "q"}, good | {"no_answer": True}):
        (tmp_path / "x.jsonl").write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="relevant"):
            files.read_questions(spark, str(tmp_path / "x.jsonl")).collect()


def test_labels_and_floors(spark, tmp_path):
    row = {"id": "1", "question": "q", "answer": "a", "abstained": False, "no_answer": False, "human_correct": True, "human_faithful": True}
    (tmp_path / "l.jsonl").write_text(json.dumps(row) + "\n")
    assert files.read_judge_labels(spark, str(tmp_path / "l.jsonl")).first()["context"] == ""
    (tmp_path / "f.json").write_text('{"a": 0.5,\n "b": 1}')
    assert {(r["metric"], r["floor"]) for r in files.read_floors(spark, str(tmp_path / "f.json")).collect()} == {("a", 0.5), ("b", 1.0)}


def test_shipped_settings_are_the_built_in_ones():
    import os

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "config")
    assert C.load(f"{root}/base.yaml") == C.from_dict(C.BASE)
    for v in C.VARIANTS:
        assert C.load(f"{root}/variants/{v.name}.yaml") == v
