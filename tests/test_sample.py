"""The sample corpus and questions: every variant against a plain computation that shares no code with the library."""

import hashlib
import json
import math
import re
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from groundwork import cli, settings as C
from groundwork.plans import evaluation, index as I, report
from groundwork.sources import files

ROOT = Path(__file__).parent.parent
STOP = set(
    "a an the this that these those of in on at to for from by with about as into over after is are was were be been being am do does did has have had can could will would shall should may "
    "might must and or but if then than so not no nor too very s t it its it's what which who whom whose when where why how you i we they he she them his her their our your".split()
)


def lines(path):
    return [json.loads(x) for x in (ROOT / path).read_text().splitlines()]


DOCS, GOLD = lines("data/sample/corpus.jsonl"), lines("eval/gold/test.jsonl")
tok = lambda t: re.findall("[a-z0-9]+", t.lower())
content = lambda t: [x for x in tok(t) if x not in STOP]


def order(scores, ties):
    return sorted(range(len(scores)), key=lambda i: (-round(scores[i], 9), ties[i]))


def bm25(question):
    texts = [tok(d["text"]) for d in DOCS]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(w for t in texts for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else floor for w, x in raw.items()}
    scores = [sum(idf[w] * Counter(t)[w] * 2.5 / (Counter(t)[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in tok(question) if w in t) for t in texts]
    return order(scores, range(n))


def vector(text):
    out = np.zeros(256, np.float32)
    for t in tok(text):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        out[h % 256] += 1 if h >> 63 else -1
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).astype(float)


def dense(question):
    q = vector(question)
    return order([float(q @ vector(d["text"])) for d in DOCS], [f"{d['id']}#0" for d in DOCS])


def fused(question):
    score = Counter()
    for ranking in (bm25(question), dense(question)):
        for r, i in enumerate(ranking, 1):
            score[i] += 1 / (60 + r)
    return sorted(score, key=lambda i: (-round(score[i], 9), f"{DOCS[i]['id']}#0"))


def reranked(question):
    terms, scores = set(content(question)), {}
    for i in fused(question):
        c = content(DOCS[i]["text"])
        scores[i] = len(terms & set(c)) / len(terms) + 1e-4 * sum(t in terms for t in c)
    return sorted(scores, key=lambda i: (-round(scores[i], 9), f"{DOCS[i]['id']}#0"))


def f1(a, b):
    if not a or not b:
        return float(a == b)
    n = sum((Counter(a) & Counter(b)).values())
    return 0.0 if not n else 2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b))


def measured(ranking, q):
    """Metrics of one question from a ranking of documents."""
    want, out = set(q["relevant_doc_ids"]), {}
    ids = [DOCS[i]["id"] for i in ranking]
    for k in (1, 3, 5, 10):
        hits = [r for r, d in enumerate(ids[:k], 1) if d in want]
        ideal = sum(1 / math.log2(r + 1) for r in range(1, min(len(want), k) + 1))
        out[f"recall@{k}"] = len(hits) / len(want) if want else None
        out[f"ndcg@{k}"] = sum(1 / math.log2(r + 1) for r in hits) / ideal if want else None
    first = [r for r, d in enumerate(ids, 1) if d in want]
    out["mrr"] = (1 / first[0] if first else 0.0) if want else None
    terms, best = set(content(q["question"])), (0, None)
    for i in ranking[:5]:
        for s in re.split(r"(?<=[.!?])\s+", DOCS[i]["text"]):
            if len(terms & set(content(s))) > best[0]:
                best = (len(terms & set(content(s))), s)
    gives_up = best[1] is None or best[0] / len(terms) < 0.15
    said = content(best[1] or "")
    out["faithfulness"] = None if gives_up else 1.0
    out["answer_relevance"] = None if gives_up or q["no_answer"] else f1(said, content(q["question"]))
    out["correctness"] = float(gives_up) if q["no_answer"] else 0.0 if gives_up else f1(said, content(q["reference_answer"]))
    out["abstention_accuracy"] = float(gives_up == q["no_answer"])
    return out


RANKINGS = {
    "closed_book": lambda q: [],
    "dense_only": lambda q: dense(q["question"]),
    "hybrid": lambda q: fused(q["question"]),
    "hybrid_rerank": lambda q: reranked(q["question"]),
    "oracle": lambda q: [i for i, d in enumerate(DOCS) if d["id"] in q["relevant_doc_ids"]],
}


@pytest.fixture(scope="module")
def found(spark):
    variants = [C.load(ROOT / f"config/variants/{name}.yaml") for name in report.ORDER]
    variants = [replace(v, eval=replace(v.eval, latency=C.Latency(1))) for v in variants]
    built = I.held(I.build(files.read_corpus(spark, str(ROOT / variants[0].corpus.path)), variants[0]))
    gold = files.read_questions(spark, str(ROOT / "eval/gold")).persist()
    out = evaluation.evaluate(gold, {v.signature(): built for v in variants}, variants, "test")
    yield out
    out.release()


def test_every_value(found):
    got = {(r["variant"], r["metric"], r["question_id"]): r["value"] for r in found.per_question.collect()}
    want = {(v, m, q["id"]): x for v, rank in RANKINGS.items() for q in GOLD for m, x in measured(rank(q), q).items()}
    assert got.keys() == want.keys()
    wrong = {k: (got[k], x) for k, x in want.items() if (got[k] is None) != (x is None) or x is not None and abs(got[k] - x) > 1e-9}
    assert not wrong, list(wrong.items())[:5]


def test_intervals_and_tests(found):
    """One generator of numpy for all draws of a metric."""
    values = {}
    for v, rank in RANKINGS.items():
        for q in GOLD:
            for m, x in measured(rank(q), q).items():
                values.setdefault((v, m), []).append(x)
    tail = (1.0 - 0.95) / 2.0
    for r in found.estimates.collect():
        x = np.array([y for y in values[r["variant"], r["metric"]] if y is not None])
        assert r["n"] == len(x)
        if len(x) > 1:
            means = x[np.random.default_rng(42).integers(0, len(x), size=(1000, len(x)))].mean(axis=1)
            assert (r["mean"], r["ci_low"], r["ci_high"]) == pytest.approx((x.mean(), *np.quantile(means, [tail, 1 - tail])), abs=1e-12)
    a, b = ({q["id"]: measured(RANKINGS[v](q), q)["recall@1"] for q in GOLD} for v in ("hybrid_rerank", "dense_only"))
    ids = sorted(i for i in a if a[i] is not None)
    d = np.array([a[i] - b[i] for i in ids])
    means = d[np.random.default_rng(0).integers(0, len(d), size=(10_000, len(d)))].mean(axis=1)
    got = evaluation.compare(found, "hybrid_rerank", "dense_only", ["recall@1"]).first()
    assert (got["n"], got["diff_mean"], got["p_value"]) == pytest.approx((len(d), d.mean(), min(1, 2 * min((means <= 0).mean(), (means >= 0).mean()))), abs=1e-12)


def test_commands_on_the_sample(spark, monkeypatch, tmp_path, capsys):
    """What the README says, from the repository's folder."""
    monkeypatch.chdir(ROOT)
    assert cli.main(["ingest", "--root", str(tmp_path / "index")]) == 0
    assert cli.main(["validate-judge"]) == 0
    load = C.load
    monkeypatch.setattr(C, "load", lambda path: replace(load(path), eval=replace(load(path).eval, latency=C.Latency(3))))
    assert cli.main(["gate"]) == 0
    assert cli.main(["eval", "--config", "config/variants/hybrid.yaml", "--out", str(tmp_path)]) == 0
    said = capsys.readouterr().out
    assert f"{len(DOCS)} chunks" in said and "n=8" in said and "latency p50/p95" in said
    assert json.loads((tmp_path / "hybrid.json").read_text())["operational"]["p95_latency_ms"] > 0
