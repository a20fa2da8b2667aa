"""Command line: ``python -m groundwork.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from . import settings
from .operators import judging, statistics
from .plans import evaluation, index as index_plan, report
from .sources import files

VERSION = "0.1.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("groundwork").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groundwork", description="Question answering over a corpus, and its evaluation.")
    sub = top.add_subparsers(dest="command")
    sub.add_parser("version", help="print the version")

    def add(name: str, about: str, **options: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for option, default in options.items():
            p.add_argument(f"--{option}", default=default)
        return p

    add("ingest", "build and save the index of a corpus", config="config/base.yaml", root="artifacts/index")
    add("eval", "evaluate one configuration", config="config/base.yaml", split="test", gold="eval/gold", out="eval/results").add_argument("--smoke", action="store_true")
    add("ablate", "evaluate all configurations of a folder", suite="config/variants", split="test", gold="eval/gold", out="eval/results")
    add("plots", "draw saved reports again", out="eval/results")
    add("validate-judge", "hold the judge against human labels", config="config/base.yaml", labels="eval/judge_labels.jsonl")
    add("gate", "fail if a metric is below its floor", config="config/variants/hybrid_rerank.yaml", split="test", gold="eval/gold", floors="eval/regression_thresholds.json")
    add("serve", "answer questions over HTTP", config="config/base.yaml", host="127.0.0.1", port="8000")
    return top


def _index(spark: SparkSession, how: settings.Settings):
    return index_plan.held(index_plan.build(files.read_corpus(spark, how.corpus.path), how))


def _evaluate(spark: SparkSession, variants: list[settings.Settings], gold: str, split: str, smoke: bool = False) -> evaluation.Evaluation:
    indexes: dict = {}
    for how in variants:
        if how.signature() not in indexes:
            indexes[how.signature()] = _index(spark, how)
    return evaluation.evaluate(files.read_questions(spark, gold).persist(), indexes, variants, split, smoke)


def ingest(a) -> int:
    spark, how = session(), settings.load(a.config)
    out = index_plan.save(index_plan.build(files.read_corpus(spark, how.corpus.path), how), how, a.root)
    n = spark.read.parquet(f"{out}/chunks").count()
    print(f"ingested '{how.name}': {n} chunks (embedder={how.embedder.backend}, store={how.vector_store.backend}) -> {out}")
    return 0


def evaluate(a) -> int:
    how = settings.load(a.config)
    found = _evaluate(session(), [how], a.gold, a.split, a.smoke)
    print(report.summary(found, how.name))
    print(f"wrote {report.save(found, how.name, Path(a.out) / f'{how.name}.json')}")
    found.release()
    return 0


def ablate(a) -> int:
    order = {name: i for i, name in enumerate(report.ORDER)}
    variants = sorted((settings.load(p) for p in sorted(Path(a.suite).glob("*.yaml"))), key=lambda how: order.get(how.name, len(order)))
    found = _evaluate(session(), variants, a.gold, a.split)
    out = Path(a.out)
    for how in variants:
        report.save(found, how.name, out / f"{how.name}.json")
    text = report.ablation(found)
    (out / "ablation.md").write_text(text + "\n")
    _plots(found.estimates, out)
    print(text)
    found.release()
    print(f"\nwrote {out}/ablation.md")
    return 0


def _plots(estimates, out: Path) -> None:
    report.plot(estimates, ["recall@1", "recall@3", "recall@5"], out / "ablation_recall.png")
    report.plot(estimates, ["correctness"], out / "ablation_correctness.png")


def plots(a) -> int:
    out = Path(a.out)
    saved = [p for p in sorted(out.glob("*.json")) if "metrics" in json.loads(p.read_text())]
    if not saved:
        print(f"no reports in {out}; run ablate first")
        return 1
    spark, found = session(), None
    for p in saved:
        one = files.read_report(spark, str(p))["estimates"].withColumn("variant", F.col("config_name"))
        found = one if found is None else found.unionByName(one)
    _plots(found, out)
    print(f"drew the charts in {out}")
    return 0


def validate_judge(a) -> int:
    how = settings.load(a.config)
    got = statistics.agreement(judging.judge_for(how.eval.judge)(files.read_judge_labels(session(), a.labels)))
    print(f"judge backend: {how.eval.judge.provider} ({how.eval.judge.model})")
    print(f"n={got['n']}, threshold={got['threshold']}")
    for name in ("kappa_correctness", "kappa_faithfulness", "spearman_correctness"):
        print(f"  {name:<22} {got[name] if got[name] is None else round(got[name], 3)}")
    return 0


def gate(a) -> int:
    spark, how = session(), settings.load(a.config)
    found = _evaluate(spark, [how], a.gold, a.split)
    rows = statistics.gate(files.read_floors(spark, a.floors), found.estimates).orderBy("metric").collect()
    for r in rows:
        print(f"{'pass' if r['passed'] else 'FAIL'}  {r['metric']}: {r['value'] if r['value'] is None else round(r['value'], 4)} (floor {r['floor']})")
    return int(not all(r["passed"] for r in rows))


def serve(a) -> int:
    from .service import Service, serve as run

    spark, how = session(), settings.load(a.config)
    run(Service(_index(spark, how), how), a.host, int(a.port))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in (None, "version"):
        print(f"groundwork {VERSION}")
        return 0
    commands = {"ingest": ingest, "eval": evaluate, "ablate": ablate, "plots": plots, "validate-judge": validate_judge, "gate": gate, "serve": serve}
    return commands[a.command](a)


if __name__ == "__main__":
    raise SystemExit(main())
