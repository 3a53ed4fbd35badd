"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word and word-beginning presence is trained in numpy from texts that are
confirmed toxic and from unlabelled texts (their labels are not looked at). The risk of the
negative class is estimated from the unlabelled texts less the positives' share of it, with
the class prior pi, and kept from going below zero:

    pi * R+(positives)  +  max(0, R-(unlabelled) - pi * R-(positives))

When the second term would go below zero, the step goes back along its gradient instead. At the
end the bias is set so that the unlabelled texts' mean score is the prior.

The prior is a parameter, or it is estimated from the positives and the unlabelled texts alone:
any set of texts that holds a share p of the positives and u of the unlabelled ones bounds it by
u / p. The sets are the texts with one of the k most telling terms; terms come from one half
of the texts, shares, with a margin of their standard errors, from the other. Toxic texts
are taken to be rarer than ``MAX_PRIOR``, so that a text without any term is never rejected.

The model is fitted on a bounded sample (``positives`` and ``unlabelled`` rows, chosen by a
seeded hash of doc_id). Terms are counted on the executors; the driver gets the telling ones
(at most ``max_features`` of each half and of the whole) and each text's places among them,
never a text. Every text is then scored whole.

Defined results: a null or empty text has no features and gets the score of the bias; rows
with a null doc_id are scored but never learnt from; of repeated labels for a document any
toxic one makes it toxic; of different texts with one doc_id the smallest is learnt from, and
equal texts are learnt from once; without any toxic label, or any term that tells toxic texts,
the score is 0 for every text.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, dropped, mapped, remainder, written

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Bounds of the training sample and of the model, and of the prior.
POSITIVES, UNLABELLED, MAX_FEATURES, MAX_PRIOR = 1500, 8000, 1500, 0.2
#: Lengths in bytes of the word beginnings that are features, marked by a leading space.
BEGINNINGS = (4, 5, 6)

_LETTER = {*range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTER else 32 for b in range(256))


def terms(text: bytes) -> set[bytes]:
    """The words of a text, lower-case, and their beginnings."""
    words = set(text.translate(_NORMAL).split())
    out = set(words)
    for n in BEGINNINGS:
        out.update([b" " + w[:n] for w in words if len(w) >= n])
    return out


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def margin(self, text: bytes) -> float:
        get = self.weights.get
        words = set(text.translate(_NORMAL).split())
        found = {w for w in words if w in self.weights}
        for n in self.lengths:
            found.update({b for b in {b" " + w[:n] for w in words if len(w) >= n} if b in self.weights})
        return self.bias + sum(get(f) for f in sorted(found))

    @property
    def lengths(self) -> tuple[int, ...]:
        return BEGINNINGS

    def score(self, text: bytes) -> float:
        m = self.margin(text)
        return 1 / (1 + math.exp(-m)) if m > -700 else 0.0


def counted(batches):
    """Of ``(positive, half, text)``: how many texts of each kind and half have a term."""
    names = ["term", "p0", "p1", "u0", "u1"]
    for batch in batches:
        held: list[Counter] = [Counter() for _ in names[1:]]
        for positive, half, text in zip(batch.column("positive").to_pylist(), batch.column("half").to_pylist(), as_bytes(batch.column("text")), strict=True):
            held[(0 if positive else 2) + half].update(terms(text))
        found = sorted(set().union(*held))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(pa.array([c[t] for t in found], pa.int64()) for c in held)], names)


def telling(p: Column, u: Column, n_p: int, n_u: int, prior: float) -> tuple[Column, Column]:
    """How telling a term is that ``p`` of the positives and ``u`` of the unlabelled texts have,
    and whether it is enough. A term that only toxic texts have is 1 / prior times as frequent
    among the positives; at least half of that is asked for."""
    share, other = p / F.lit(float(max(n_p, 1))), (u + 1) / F.lit(float(n_u + 1))
    z = (share - other) / F.sqrt(other * (1 - F.least(other, F.lit(0.999))) / F.lit(float(max(n_p, 1))) + 1e-12)
    return z, (p >= 2) & (z > 6) & (share > other * max(2.0, 0.5 / prior))


def bound(first_p: np.ndarray, first_u: np.ndarray, most: int) -> float:
    """The least bound of the prior from the places of each text's most telling term (``most``
    where it has none), over doubling numbers of terms."""
    n, m, out, k = len(first_p), len(first_u), 1.0, 1
    while n and m and k <= 2 * most:
        p, u = (first_p < min(k, most)).mean(), (first_u < min(k, most)).mean()
        low = p - math.sqrt(p * (1 - p) / n + 0.25 / n**2)
        high = u + math.sqrt(u * (1 - u) / m + 0.25 / m**2)
        if low > 0:
            out = min(out, high / low)
        k *= 2
    return float(out)


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Both terms of the risk under the logistic loss (the second before it is kept from going
    below zero), and the step's gradient by the weights and the bias."""
    zp, zu = xp @ w + b, xu @ w + b
    sp, su = _sigmoid(zp), _sigmoid(zu)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gu, gp = su / len(zu), sp / len(zp)  # of the losses as negatives
    g = np.append(xu.T @ gu - prior * (xp.T @ gp), gu.sum() - prior * gp.sum())
    if negative < 0:
        return positive, negative, -g
    back = prior * (sp - 1) / len(zp)
    return positive, negative, g + np.append(xp.T @ back, back.sum())


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.08) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk, from rows of term presence."""
    w, b = np.zeros(xp.shape[1], np.float32), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = risk(w, np.float32(b), xp, xu, prior)[2]
        g[:-1] += 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1].astype(np.float32)
        b -= step[-1]
    z, low, high = xu @ w, -40.0, 40.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if _sigmoid(z + b).mean() < prior else (low, b)
    return w, b


def fit(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, max_features: int = MAX_FEATURES, prior: float | None = None) -> Model:
    """Trains on rows outside the held-out fold only; of the labels, only toxic ones are used."""
    spark = documents.sparkSession
    none = Model({}, -1e9)
    toxic = labels.where("doc_id IS NOT NULL AND toxic = 1").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    texts = documents.where("doc_id IS NOT NULL").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = bounded_sample(texts.select("doc_id").distinct(), "doc_id", unlabelled, 99).select("doc_id", F.lit(False).alias("positive"))
    ids = ids.union(bounded_sample(toxic, "doc_id", positives, 9).select("doc_id", F.lit(True)))
    # at most positives + unlabelled ids are broadcast
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text").distinct()
    rows, path = written(rows.withColumn("half", F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2)).cast("int")).repartition(F.xxhash64("text")), "toxicity-sample")
    size = {(r.positive, r.half): r.n for r in rows.groupBy("positive", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    p0, p1, u0, u1 = (size.get((p, h), 0) for p in (True, False) for h in (0, 1))
    if not p0 + p1 or not u0 + u1:
        dropped(spark, path)
        return none
    counts, counts_path = written(rows.mapInArrow(counted, "term binary, p0 bigint, p1 bigint, u0 bigint, u1 bigint").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("p0", "p1", "u0", "u1"))).where("p0 + p1 >= 2"), "toxicity-terms")

    def chosen(p, u, n_p, n_u, pi):
        z, enough = telling(p, u, n_p, n_u, pi)
        return [bytes(r.term) for r in counts.where(enough).select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(max_features).collect()]

    halves = [chosen(F.col("p0"), F.col("u0"), p0, u0, MAX_PRIOR), chosen(F.col("p1"), F.col("u1"), p1, u1, MAX_PRIOR)]
    every = chosen(F.col("p0") + F.col("p1"), F.col("u0") + F.col("u1"), p0 + p1, u0 + u1, prior or MAX_PRIOR)
    sent = spark.sparkContext.broadcast([{t: i for i, t in enumerate(names)} for names in (*halves, every)])

    def places(batches):
        for batch in batches:
            first, at = [], []
            for half, text in zip(batch.column("half").to_pylist(), as_bytes(batch.column("text")), strict=True):
                found, other = terms(text), sent.value[1 - half]
                first.append(min((other[t] for t in found if t in other), default=len(other)))
                at.append(sorted(sent.value[2][t] for t in found if t in sent.value[2]))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("half"), pa.array(first, pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["positive", "half", "first", "at"])

    # a bounded sample, in an order of its own whatever the order of tasks
    seen = sorted(rows.mapInArrow(places, "positive boolean, half int, first int, at array<int>").collect(), key=lambda r: (r.positive, r.half, r.first, r.at))
    dropped(spark, path, counts_path)
    if not every:
        return none
    if prior is None:
        first = lambda p, h: np.array([r.first for r in seen if r.positive == p and r.half == h])
        bounds = [bound(first(True, h), first(False, h), len(halves[1 - h])) for h in (0, 1)]
        prior = min(sum(bounds) / 2, MAX_PRIOR)

    def matrix(some):
        out = np.zeros((len(some), len(every)), np.float32)
        for k, r in enumerate(some):
            out[k, r.at] = 1
        return out

    w, b = train(matrix([r for r in seen if r.positive]), matrix([r for r in seen if not r.positive]), prior)
    return Model({t: float(x) for t, x in zip(every, w, strict=True) if abs(x) > 1e-3}, float(b))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents(doc_id, text)``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        score = np.array([sent.value.score(t) for t in as_bytes(batch.column("text"))])
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = mapped(plain, "doc_id bigint, score double, predicted int", rows)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without the rows whose score reaches the threshold; all columns are kept."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            keep = pa.array([sent.value.score(t) < THRESHOLD for t in as_bytes(batch.column("text"))], pa.bool_())
            yield batch.filter(keep)

    return documents.mapInArrow(run, documents.schema)
