"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from its words and the pairs
of neighbouring words, each hashed to a place in a learnt table; passages are weighted by gated
attention, and the weighted sum of encodings is classified:

    h_k = tanh(mean of E over the words and pairs of k + b)
    a_k = softmax_k( q . (tanh(V h_k) * sigmoid(U h_k)) )
    score = sigmoid( c . sum_k a_k h_k + d )

Only the document's label is known in training; the attention finds the passages that decide. A
word is whatever stands between white space, case and marks included, and no word or mark is
known beforehand. Three places are set apart: for what no other training document holds, for what
few hold, so that shares of unknown and rare words are learnt from as well, and for a word that follows
itself. A fifth of the sample is kept back, and sets the last bias so that scores of good and bad
texts part at the threshold.

Trained in numpy on a bounded sample of labelled rows (``SAMPLE``, by a seeded hash of
doc_id); every text is then scored whole, passage by passage.

Defined results: a null or empty text is one empty passage; rows with a null doc_id are scored
but never learnt from; of repeated labels for a document the lowest counts, of different texts
with one doc_id the smallest is learnt from; without labels of both kinds the score is the share of good ones for every text (1 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, in_parts, mapped, remainder

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SAMPLE = 4000
PASSAGE = 48
HIDDEN, ATTENTION = 16, 8
#: Places of the table; the first three are set apart.
PLACES, UNKNOWN, RARE, TWICE = 1 << 16, 0, 1, 2

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte at each place in a word (places go round); a word's hash is their sum.
_AT = 64
_TABLE = np.random.default_rng(1).integers(0, 1 << 64, (_AT, 256), np.uint64)


def _place(code: np.ndarray) -> np.ndarray:
    mixed = (code ^ code >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(PLACES - 3)).astype(np.int32) + 3


@dataclass
class Bags:
    """Places of words and pairs, passage after passage; where each passage's begin; each text's first
    passage."""

    places: np.ndarray
    starts: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.places))

    def texts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text its places and how many each passage has."""
        sizes, ends = self.sizes(), np.append(self.starts, len(self.places))
        edges = [*self.first.tolist(), len(self.starts)]
        return [(self.places[ends[a] : ends[b]], sizes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    @classmethod
    def of(cls, texts: list[tuple[np.ndarray, np.ndarray]]) -> Bags:
        sizes = np.concatenate([s for _, s in texts]) if texts else np.zeros(0, np.int64)
        counts = np.array([len(s) for _, s in texts], np.int64)
        return cls(np.concatenate([p for p, _ in texts]) if texts else np.zeros(0, np.int32), np.cumsum(sizes) - sizes, np.cumsum(counts) - counts)


def passages(texts: list[bytes]) -> Bags:
    """The texts as bags. A pair belongs to the passage of its second word."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(sizes) - sizes
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_BLANK[data])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(begin, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n_passages) - n_passages
    nth = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[owner]
    code = np.zeros(len(starts), np.uint64)
    if len(starts):
        length = ends - starts
        inside = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
        at = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
        code = np.add.reduceat(_TABLE[at % _AT, data[inside]], np.cumsum(length) - length)
    paired = nth > 0
    before = np.concatenate((code[:1], code[:-1]))
    pair = np.where(before == code, TWICE, _place(before * np.uint64(0xD6E8FEB86659FD93) + code))
    both = np.stack((_place(code), pair), 1)
    keep = np.stack((np.ones(len(code), bool), paired), 1)
    of_word = first[owner] + nth // PASSAGE
    per = np.bincount(of_word, weights=1 + paired, minlength=int(n_passages.sum())).astype(np.int64)
    return Bags(both[keep].astype(np.int32), np.cumsum(per) - per, first)


@dataclass
class Model:
    p: dict = field(default_factory=dict)
    seen: np.ndarray | None = None
    constant: float | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts, a few megabytes at a time."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = [self._score(part) for part in in_parts(texts, 1 << 20)]
        return np.concatenate(out) if out else np.empty(0)

    def _score(self, texts: list[bytes]) -> np.ndarray:
        bags = passages(texts)
        bags.places = self.seen[bags.places]
        return _sigmoid(forward(self.p, bags)[0]).astype(np.float64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _means(table: np.ndarray, bags: Bags) -> np.ndarray:
    """The mean of the table's rows over each passage; zero for an empty one."""
    sizes = bags.sizes()
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(table[bags.places], bags.starts[some], axis=0) / sizes[some, None]
    return out


def forward(p: dict, bags: Bags):
    h = np.tanh(_means(p["E"], bags) + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    gate = t * s
    e = gate @ p["q"]
    first = bags.first
    n = np.diff(np.concatenate((first, [len(h)])))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
    a = e / np.repeat(np.add.reduceat(e, first), n)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return z @ p["c"] + p["d"], (h, t, s, gate, a, z, n)


def gradients(p: dict, bags: Bags, dy: np.ndarray, kept) -> dict:
    """By each parameter; of the table as (places, rows)."""
    h, t, s, gate, a, z, n = kept
    g = {"c": z.T @ dy, "d": dy.sum(keepdims=True)[0]}
    dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, bags.first), n))
    g["q"] = gate.T @ de
    dgate = de[:, None] * p["q"]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dx = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    g["b"] = dx.sum(0)
    sizes = bags.sizes()
    share = np.repeat(dx / np.maximum(1, sizes)[:, None], sizes, axis=0)
    order = np.argsort(bags.places, kind="stable")
    places, at = np.unique(bags.places[order], return_index=True)
    g["E"] = places, np.add.reduceat(share[order], at, axis=0) if len(at) else share
    return g


def train(texts: list[bytes], good: np.ndarray, **options) -> Model:
    """:func:`learn` from whole texts."""
    return learn([t for part in in_parts(texts) for t in passages(part).texts()], good, **options)


def learn(texts: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 500, batch: int = 48, rate: float = 0.01, seed: int = 4) -> Model:
    """A model from each text's bag and whether the text is good."""
    if not len(good) or good.min() == good.max():
        return Model(constant=float(good.mean()) if len(good) else 1.0)
    r = np.random.default_rng(seed)
    kinds = [r.permutation(np.flatnonzero((good == 1) == kind)) for kind in (False, True)]
    back = np.concatenate([k[: len(k) // 5] for k in kinds])
    kinds = [k[len(k) // 5 :] for k in kinds]
    held = np.zeros(PLACES, np.int64)
    for i in np.concatenate(kinds):
        held[np.unique(texts[i][0])] += 1
    # of a training text, its own holding doesn't count: what is new to it is unknown, as it is to other texts
    own_place = np.arange(PLACES, dtype=np.int32)
    seen, others = (np.where(n < 1, UNKNOWN, np.where(n < rare, RARE, own_place)).astype(np.int32) for n, rare in ((held, 3), (held - 1, 2)))
    for x in (seen, others):
        x[:3] = own_place[:3]
    model = Model(_descended([(others[p], n) for p, n in texts], good, kinds, steps, batch, rate, r), seen)
    if len(back) and 0 < good[back].sum() < len(back):
        margin = forward(model.p, Bags.of([(seen[texts[i][0]], texts[i][1]) for i in back]))[0]
        model.p["d"] = np.float32(model.p["d"] + np.log(THRESHOLD / (1 - THRESHOLD)) - _parting(margin, good[back] == 1))
    return model


def _parting(margin: np.ndarray, good: np.ndarray) -> float:
    """Where good and bad part best, both kinds weighing alike: in the widest such gap, a quarter of it
    above the bad side, and below all but one in fifty good ones: a good text that goes is the worse loss."""
    order = np.argsort(margin, kind="stable")
    edges = np.concatenate(([margin.min() - 1], margin[order], [margin.max() + 1]))
    right = np.concatenate(([0], np.cumsum(~good[order]))) / (~good).sum() + 1 - np.concatenate(([0], np.cumsum(good[order]))) / good.sum()
    width = np.diff(edges)
    best = max(range(len(width)), key=lambda k: (round(float(right[k]), 9), width[k]))
    return float(min(edges[best] + 0.25 * width[best], np.quantile(margin[good], 0.02)))


def _descended(texts, good, kinds, steps, batch, rate, r) -> dict:
    """Parameters by Adam on small batches; of the table only the rows move that a batch holds."""
    shape = {"V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "q": (ATTENTION,), "c": (HIDDEN,)}
    p = {k: (r.standard_normal(v) / np.sqrt(v[0])).astype(np.float32) for k, v in shape.items()}
    p |= {"E": (0.1 * r.standard_normal((PLACES, HIDDEN))).astype(np.float32), "b": np.zeros(HIDDEN, np.float32), "d": np.float32(0)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    for t in range(1, steps + 1):
        # both kinds weigh alike
        own = np.concatenate([r.choice(k, min(batch // 2, len(k)), replace=False) for k in kinds])
        bags = Bags.of([texts[i] for i in own])
        y, kept = forward(p, bags)
        weight = np.where(good[own] == 1, 0.5 / max(1, (good[own] == 1).sum()), 0.5 / max(1, (good[own] != 1).sum()))
        g = gradients(p, bags, ((_sigmoid(y) - good[own]) * weight).astype(np.float32), kept)
        for k in p:
            at, d = g[k] if k == "E" else (..., g[k])
            d = d + 1e-4 * p[k][at]
            new_m, new_v = 0.9 * m[k][at] + 0.1 * d, 0.999 * v[k][at] + 0.001 * d * d
            if k == "E":
                m[k][at], v[k][at] = new_m, new_v
                p[k][at] -= rate * (new_m / (1 - 0.9**t)) / (np.sqrt(new_v / (1 - 0.999**t)) + 1e-8)
            else:
                m[k], v[k] = new_m, new_v
                p[k] = (p[k] - rate * (new_m / (1 - 0.9**t)) / (np.sqrt(new_v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` labelled rows outside the held-out fold. Texts are described on
    the executors; the driver gets the places of their words and pairs, none of the texts."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT), "doc_id", sample, 4)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            bags = [b for part in in_parts(as_bytes(batch.column("text"))) for b in passages(part).texts()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([p.astype("<i4").tobytes() for p, _ in bags], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in bags], pa.binary())], ["doc_id", "quality", "places", "sizes"])

    kind = rows.schema["quality"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id bigint, quality {kind}, places binary, sizes binary").orderBy("doc_id").collect()
    return learn([(np.frombuffer(r.places, "<i4"), np.frombuffer(r.sizes, "<i4").astype(np.int64)) for r in found], np.array([r.quality for r in found], np.float32))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents(doc_id, text)``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        score = sent.value.score(as_bytes(batch.column("text")))
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = mapped(plain, "doc_id bigint, score double, predicted int", rows)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
