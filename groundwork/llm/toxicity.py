"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier on the presence of words is trained in numpy from
confirmed toxic texts and unlabelled texts.  The risk of the negative class is
estimated from unlabelled texts corrected by the class prior; where the
estimate falls below zero, which no risk can, a step goes back up instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """``max_positive`` and ``max_unlabelled`` bound the sample that the classifier is fitted on."""

    max_positive: int = 8_000
    max_unlabelled: int = 16_000
    max_words: int = 4_096
    least_texts: int = 5
    least_z: float = 4.0
    #: A word must be in this share of the positives, or of the unlabelled.
    least_share: float = 0.02
    rounds: int = 300
    rate: float = 0.05
    #: Pull of the weights towards zero.
    decay: float = 1e-4


@dataclass
class Model:
    """Weights of words and the intercept; without confirmed examples every score is 0."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -np.inf

    def score(self, text: bytes) -> float:
        known = self.weights
        total = self.bias + sum(sorted(known[w] for w in set(words.split_alnum(text)) if w in known))
        return 1.0 / (1.0 + float(np.exp(-total))) if total > -700 else 0.0


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@words.frugal
def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in words.slices(batch):
            found = [sorted({w.decode() for w in words.split_alnum(t)}) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["positive", "words"])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on labels that aren't held out.

    The positives are texts labelled 1, the unlabelled texts are drawn from
    all that aren't held out, whatever their label; the prior is the share of
    label 1 among all labels that aren't held out.  Null ids and labels are
    left out, null texts are empty, copies of a text are one example of each
    kind, a repeated id counts as toxic if any of its labels is 1; a text is
    used whole, however long.  Without positives every score is 0; without
    words that tell the kinds apart every score is the prior.
    """
    tables = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    ids = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id")
    positive = known.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_positive)
    other = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(settings.max_unlabelled)
    wanted = positive.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False)))
    # bounded by the two settings, so it can be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("positive", "text")
    sample = sample.dropDuplicates(["positive", "text"])  # copies are one example
    bags = tables.save(sample.mapInArrow(_distinct_words, "positive boolean, words array<string>"), 2_000)
    counts = {r["positive"]: r["n"] for r in bags.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = counts.get(True, 0), counts.get(False, 0)
    if not n_p or not n_u or not 0 < prior < 1:
        return Model(bias=-np.inf if not n_p else np.inf if prior >= 1 else -np.inf)
    in_p, in_u = F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))
    rate_p, rate_u, rate = F.col("p") / n_p, F.col("u") / n_u, (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (rate_p - rate_u) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u) + 1e-12)
    chosen = (
        bags.select("positive", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(in_p.alias("p"), in_u.alias("u"))
        .where((F.greatest("p", "u") >= settings.least_texts) & (F.greatest(rate_p, rate_u) >= settings.least_share))
        .withColumn("z", z)
        .where(F.abs("z") >= settings.least_z)
        .orderBy(F.abs("z").desc(), "word")
        .limit(settings.max_words)
    )
    found = chosen.collect()
    names = [r["word"] for r in found]
    if not names:
        return Model(bias=float(np.log(prior / (1 - prior))))
    listed = F.array(*[F.lit(n) for n in names]) if len(names) < 200 else None
    kept = F.array_intersect("words", listed) if listed is not None else F.col("words")
    index = {n: i for i, n in enumerate(names)}
    rows = [(r["positive"], [index[w] for w in r["words"] if w in index]) for r in bags.select("positive", kept.alias("words")).toLocalIterator()]
    w, bias, _ = train(rows, len(names), prior, settings)
    tables.drop(bags)
    return Model({n.encode(): float(x) for n, x in zip(names, w)}, float(bias))


def risks(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """The risks of both classes for the logistic loss: prior * E_P[l(f)], and E_U[l(-f)] - prior * E_P[l(-f)], which may be below zero."""
    loss = lambda x: np.logaddexp(0, -x)
    return prior * loss(f[positive]).mean(), loss(-f[~positive]).mean() - prior * loss(-f[positive]).mean()


def train(rows: list[tuple[bool, list[int]]], n: int, prior: float, settings: Settings) -> tuple[np.ndarray, float, int]:
    """Weights of ``n`` words, the intercept, and how many steps the negative risk was corrected in.

    Minimises the positive risk + max(0, the negative risk) by Adam in full
    batches, from zero on.  Where the negative risk is below zero the step
    follows its slope upwards, away from learning the unlabelled by heart.
    """
    positive = np.array([p for p, _ in rows])
    at = np.concatenate([np.array(x, np.int64) for _, x in rows] + [np.empty(0, np.int64)])
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    each = np.where(positive, 1 / positive.sum(), 1 / (~positive).sum())
    theta = np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    m, v, corrected = np.zeros(n + 1), np.zeros(n + 1), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, settings.rounds + 1):
        f = theta[n] + np.bincount(row, theta[at], minlength=len(rows))
        slope = np.where(positive, -prior, 1) * sigmoid(f) * each  # of the negative risk
        if risks(f, positive, prior)[1] >= 0:
            slope -= np.where(positive, prior * sigmoid(-f) * each, 0)
        else:
            slope, corrected = -slope, corrected + 1
        g = np.r_[np.bincount(at, slope[row], minlength=n), slope.sum()] + settings.decay * np.r_[theta[:n], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f = np.bincount(row, theta[at], minlength=len(rows))
    return theta[:n], -cut(f, positive, prior), corrected


def cut(f: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The value of ``f`` from which a text counts as toxic: where the same risk with the zero-one loss is least, halfway to the next lower value."""
    values, place = np.unique(f, return_inverse=True)
    found_p, found_u = (np.cumsum(np.bincount(place[m], minlength=len(values))[::-1])[::-1] / max(1, m.sum()) for m in (positive, ~positive))
    risk = prior * (1 - found_p) + np.maximum(0, found_u - prior * found_p)
    best = len(values) - 1 - int(np.argmin(risk[::-1]))
    return float(values[best] - 1 if best == 0 else (values[best] + values[best - 1]) / 2)


def _scores(model):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            for part, texts in words.slices(batch):
                own = [part.column(i) for i in range(len(names)) if i != at]
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(map(score, texts)), pa.float64())], [n for n in names if n != "text"] + ["score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every row: 0 to 1, higher for likelier toxic; a null text is scored as an empty one, a null id stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(shared), "doc_id long, score double")


def _keep(model, limit: float):
    @words.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            for part, texts in words.slices(batch):
                yield part.filter(pa.array([score(t) < limit for t in texts], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, limit), docs.schema)
