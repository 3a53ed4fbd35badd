"""Language-model scoring with a gated recurrent network over words.

Corpus counts: all words of all training texts are counted on the executors (a bounded
counter per task, then one grouped sum) and kept as a table. Words whose counts reach a
threshold, at most ``HEAD`` of them, are broadcast; all other words meet their counts in a
join, so the vocabulary may grow without bound.

The model factors a token into class and word. The ``NEURAL`` most frequent tokens form
classes of ``PER_CLASS``, each with a softmax of its own under the network's state. The other
broadcast words form bands by frequency, and the rest one open class; in these a word's share
follows the corpus counts. The events are those of the base score: every training token, and
one for any unknown word. That one belongs to the open class with as many counts as there are
words seen once (Good and Turing's estimate), so all probabilities add up to one.

A gated recurrent unit is trained in numpy by truncated backpropagation: windows of
``WINDOW`` tokens over parallel streams, the state carried from window to window and reset where
another text or segment starts. It starts from the corpus frequencies and a few texts (``texts``, a
parameter; by a seeded hash of doc_id), fitted on the driver, and then learns from the whole
training corpus on the executors. Every training text is read whole and cut into segments of
``SEGMENT`` tokens, and every token of them gets gradients. A user who wants a cheaper model may set
``share``, which takes one segment in so many, by a hash of text and place; the query does not. A segment is read after the ``WARM`` words that stand before it in
its text, which set the state and are no targets; nothing of another text or segment reaches it.
Each of ``ROUNDS`` takes its own texts; every task trains on its segments, and the tasks' weights are
averaged by their tokens. So weights hang a little on how rows are dealt to tasks.

Scoring runs whole texts side by side, longest first, in the same windows with the state
carried on, so a text's log-likelihood is complete whatever its length.

``head`` is a size of the model, as its hidden units are: the words that have a place in a
softmax or a band. All other words form the open class, whose shares come from their exact
corpus counts by a join, however many there are.

Defined results: a null text is empty, its only token is the end; a row with a null doc_id
counts as a training text; repeated rows count and are scored each; without any training
text every token is the unknown one and has probability 1.
"""

from __future__ import annotations

import copy
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, remainder, written

FOLDS, HELD_OUT = 7, 2
HEAD, NEURAL, PER_CLASS, BANDS = 120_000, 4096, 64, 4
HIDDEN, WINDOW, STREAMS, EPOCHS, TRAIN_TEXTS = 32, 32, 48, 3, 700
#: Rounds in which the executors go over all training texts, each text in one of them; tokens of
#: a segment, and one in how many is trained on (all); streams and tokens that a task trains on at a
#: time; pieces in which weights are averaged.
ROUNDS, SEGMENT, SHARE, TASK_STREAMS, TASK_TOKENS, PIECES = 2, 128, 1, 128, 1 << 17, 16
#: Words before a segment that set the state it starts from.
WARM = 4
#: Texts that are scored side by side, states that wait for their softmax, and states whose logits are held at
#: a time; weights that the optimiser goes over at a time; how far down exp in single precision is used.
SIDE_BY_SIDE, DRAIN, ROWS, BLOCK, LOW = 256, 8192, 4096, 1 << 16, 80
#: Steps that a task takes over what it holds, or as many as eight streams give.
STEPS = 32
#: Bytes of texts whose words a counting task holds before it counts them; bytes of text scored at a time.
COUNTER_BYTES, PART_BYTES = 32 << 20, 16 << 20
END = b""
LN10 = math.log(10)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and one end."""
    out = text.lower().split()
    out.append(END)
    return out


def all_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """:func:`tokens` of all texts of a string column, one text after another (binary), and the places where
    each text's begin, with that after the last one. A null text is empty."""
    lower = pc.binary_join_element_wise(pc.ascii_lower(texts), *map(pa.scalar, ("", " "), (texts.type,) * 2), null_handling="replace", null_replacement="")
    # the blank that now ends each text leaves an empty word behind it, which is the end
    split = pc.ascii_split_whitespace(lower)
    words, begin = split.values, split.offsets.to_numpy().astype(np.int64)
    lead = begin[:-1][pc.binary_length(words).to_numpy()[begin[:-1]] == 0]
    if len(lead):  # texts that begin with a blank have an empty word before it too
        keep = np.ones(len(words), bool)
        keep[lead] = False
        words, begin = words.filter(pa.array(keep)), begin - np.searchsorted(lead, begin)
    return words.view(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()), begin


def token_counts(training: DataFrame) -> DataFrame:
    """``training(text)`` to word (binary; the end is the empty one) and c, over all rows."""

    def run(batches):
        held, size = [], 0

        def flush():
            counted = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "c"])

        for batch in batches:
            held.append(all_tokens(batch.column("text"))[0].cast(pa.binary()))
            size += batch.column("text").nbytes
            if size > COUNTER_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return training.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Places(dict):
    """Ids by word; words that are not there have the id ``other``."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.other = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.other

    def __reduce__(self):
        return Places, (list(self),)


@dataclass
class Vocabulary:
    """Broadcast words by falling count: the first ``neural`` ones have a softmax."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    once: int

    def __post_init__(self):
        self.ids = Places(self.words)
        self.column = None
        n = len(self.words)
        self.neural = min(n, NEURAL)
        self.classes = -(-self.neural // PER_CLASS)
        cls = np.arange(n) // PER_CLASS
        rest = n - self.neural
        cls[self.neural :] = self.classes + np.minimum(np.arange(rest) * BANDS // max(1, rest), BANDS - 1)
        #: Of every word, the open class last (id n stands for any other word).
        self.cls = np.append(cls, self.classes + BANDS).astype(np.int32)
        self.n_classes = self.classes + BANDS + 1
        mass = np.bincount(cls, self.counts, self.n_classes) if n else np.zeros(self.n_classes)
        self.open_total = self.total - int(self.counts.sum())
        mass[-1] = self.open_total + max(self.once, 1)
        self.mass = mass
        inside = np.zeros(n + 1)
        if n:
            inside[:n] = np.log(self.counts / mass[cls])
        inside[: self.neural] = 0
        #: log share in a class, of words in bands; 0 where a softmax or a join gives it.
        self.inside = inside
        self.base = np.append(np.log10((self.counts + 1) / (self.total + self.distinct + 1)), 0.0)
        #: Rows of the input table: each neural word, each band and the open class.
        self.inputs = np.append(np.where(np.arange(n) < self.neural, np.arange(n), self.neural + cls - self.classes), self.neural + BANDS).astype(np.int64)
        self.end = self.ids.get(END, n)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def encode_all(self, words: pa.Array) -> np.ndarray:
        """:meth:`encode` of a binary column."""
        if not self.words:
            return np.zeros(len(words), np.int32)
        if self.column is None or self.column.type != words.type:
            self.column = pa.array(self.words, words.type)
        return pc.index_in(words, value_set=self.column).fill_null(len(self.words)).to_numpy()


def _gates(of: np.ndarray) -> np.ndarray:
    """A table or matrix whose last axis holds three gates, as one contiguous stretch for each of them."""
    return np.ascontiguousarray(of.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))


def _shares(logits: np.ndarray, at: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """The log-softmax of each row at one place, and the rows' sums; ``logits`` become the exponentials
    that were summed. Bounded logits are not too low for that as they are."""
    if not bounded:
        logits -= logits.max(1, keepdims=True)
    own = logits.ravel().take(np.arange(len(at)) * logits.shape[1] + at)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return own - np.log(total), total


class Network:
    def __init__(self, v: Vocabulary, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        counts = np.zeros(v.classes * PER_CLASS)
        counts[: v.neural] = v.counts[: v.neural]
        self.v = v
        word_bias = np.where(counts > 0, np.log(np.maximum(counts, 1)), -1e4).reshape(v.classes, PER_CLASS)
        self.p = {
            "E": f(v.neural + BANDS + 1, 3 * HIDDEN),
            "R": (r.standard_normal((HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
            "b": np.zeros(3 * HIDDEN, np.float32),
            "C": f(HIDDEN, v.n_classes),
            "c": np.where(v.mass > 0, np.log(np.maximum(v.mass, 1)), -1e4).astype(np.float32),
            "W": f(v.classes, HIDDEN, PER_CLASS),
            "w": word_bias.astype(np.float32),
        }

    def _softmaxes(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of both softmaxes with their biases as a last row, less what no logit can pass: states
        lie within -1 and 1. And whether the best logit of any state stays above what exp can tell from 0."""
        p = self.p
        of_class = np.concatenate((p["C"], p["c"][None]))
        of_word = np.concatenate((p["W"], p["w"][:, None]), axis=1)
        reach_c, reach_w = np.abs(p["C"]).sum(0).max(), np.abs(p["W"]).sum(1).max(1)
        of_class[-1] -= reach_c + p["c"].max()
        of_word[:, -1] -= (reach_w + p["w"].max(1))[:, None]
        return of_class, of_word, max(reach_c, reach_w.max(initial=0)) < LOW / 2

    def log_p(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple:
        """Natural log of each target's probability (an open word's: of its class), and what :meth:`_log_p` adds."""
        order, out = self._by_class(target), np.empty(len(target))
        out[order], by_class = self._log_p(h.take(order, axis=0), target[order], grad)
        dh = np.empty_like(by_class)
        dh[order] = by_class
        return out, dh if grad is not None else None

    def _by_class(self, target: np.ndarray) -> np.ndarray:
        return np.argsort(self.v.cls[target].astype(np.uint16), kind="stable")

    def _log_p(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple:
        """:meth:`log_p` of targets that come by class. With ``grad``, which has an array for each weight, also a
        tenth (what the optimiser's average takes of it) of the gradient of the mean negative log, by weight and by h."""
        p, v = self.p, self.v
        cls = v.cls[target]
        n, bounds = len(cls), np.searchsorted(cls, np.arange(v.classes + 1)).tolist()
        states = np.ones((n, HIDDEN + 1), np.float32)
        states[:, :HIDDEN] = h
        of_class, of_word, bounded = self._softmaxes()
        lp, dh, share = v.inside[target], np.empty((n, HIDDEN), np.float32), np.float32(0.1 / max(n, 1))

        def shares(logits, at, a, b):
            """Adds what a softmax gives to the rows' logs; the logits become gradients."""
            own, total = _shares(logits, at, bounded)
            lp[a:b] += own
            if grad is not None:
                logits *= (share / total)[:, None]
                logits.reshape(-1)[np.arange(b - a) * logits.shape[1] + at] -= share

        # some rows at a time, so that their logits stay in the cache
        of_grad = np.zeros_like(of_class)
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            d = states[a:b] @ of_class
            shares(d, cls[a:b], a, b)
            if grad is not None:
                of_grad += states[a:b].T @ d
                np.matmul(d, p["C"].T, out=dh[a:b])
        if grad is not None:
            grad["C"][:], grad["c"][:] = of_grad[:-1], of_grad[-1]
            grad["W"].fill(0)
            grad["w"].fill(0)
        k, place = 0, target % PER_CLASS
        while k < v.classes:
            first, a = k, bounds[k]
            while k < v.classes and (bounds[k + 1] - a <= ROWS or k == first):
                k += 1
            logits = np.empty((bounds[k] - a, PER_CLASS), np.float32)
            runs = [(c, i, j, logits[i - a : j - a]) for c, i, j in zip(range(first, k), bounds[first:k], bounds[first + 1 : k + 1], strict=True) if i < j]
            for c, i, j, of_run in runs:
                np.matmul(states[i:j], of_word[c], out=of_run)
            shares(logits, place[a : bounds[k]], a, bounds[k])
            if grad is not None:
                for c, i, j, of_run in runs:
                    both = states[i:j].T @ of_run
                    grad["W"][c], grad["w"][c] = both[:-1], both[-1]
                    dh[i:j] += of_run @ p["W"][c].T
        return lp, dh

    def train(self, texts: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, parallel: int = STREAMS, state: dict | None = None, before: list[np.ndarray] | None = None) -> list[float]:
        """Truncated backpropagation; returns the mean loss of each epoch. ``state`` carries the
        optimiser's averages from call to call. ``before`` has the words before each text, the last one
        at least; without it, texts start after an end. Every text starts from an empty state."""
        v, p = self.v, self.p
        if not texts or not v.neural:
            return []
        before = [np.array([v.end], np.int32)] * len(texts) if before is None else before
        rows = min(parallel, len(texts))
        streams: list[list[int]] = [[] for _ in range(rows)]
        size = np.zeros(rows, np.int64)
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            k = int(size.argmin())
            streams[k].append(i)
            size[k] += len(before[i]) - 1 + len(texts[i])
        n = int(size.max())
        # the longest first, so that those which go on are always the first ones
        streams = [streams[k] for k in np.argsort(-size, kind="stable")]
        size = -np.sort(-size)
        # by time and stream: targets, -1 where a stream has ended and -2 at words that only set the state
        y, x, fresh = np.full((n, rows), -1, np.int64), np.full((n, rows), v.end, np.int64), np.zeros((n, rows), bool)
        for k, own in enumerate(streams):
            at = 0
            for i in own:
                lead, length = len(before[i]) - 1, len(before[i]) - 1 + len(texts[i])
                fresh[at, k] = True
                y[at : at + lead, k], y[at + lead : at + length, k] = -2, texts[i]
                x[at : at + length, k] = np.concatenate((before[i], texts[i][:-1]))
                at += length
        x = v.inputs[x]
        # weights, gradients and the optimiser's averages are one array each, so that a step is few calls
        flat = np.concatenate([a.ravel() for a in p.values()])
        g_flat = np.zeros_like(flat)
        p.update(self._parts(flat))
        g = self._parts(g_flat)
        state = {} if state is None else state
        for name in ("m", "s2"):
            if name not in state:
                state[name + " flat"] = np.zeros_like(flat)
                state[name] = self._parts(state[name + " flat"])
        m, s2 = state["m flat"], state["s2 flat"]
        t, losses = state.get("t", 0), []
        for epoch in range(epochs):
            h, total, count = np.zeros((rows, HIDDEN), np.float32), 0.0, 0
            for at in range(0, n, WINDOW):
                live = int(np.searchsorted(-size, -at, "left"))
                xs, ys = (a[at : at + WINDOW, :live] for a in (x, y))
                news = [np.flatnonzero(a) for a in fresh[at : at + WINDOW, :live]]
                kept = self._forward(h[:live], xs, news)
                states = kept[-1]
                h[:live] = states[-1]
                ty = ys.ravel()
                use = np.flatnonzero(ty >= 0)
                if not len(use):
                    continue
                use = use[self._by_class(ty[use])]
                lp, dh = self._log_p(states.reshape(-1, HIDDEN).take(use, axis=0), ty[use], g)
                total, count = total - lp.sum(), count + len(lp)
                dstates = np.zeros_like(states)
                dstates.reshape(-1, HIDDEN)[use] = dh
                self._back(g, dstates, kept, xs, news)
                norm = 10 * math.sqrt(float(g_flat @ g_flat))
                t += 1
                lr = rate * min(1.0, 1.0 / max(norm, 1e-9)) if norm > 1 else rate
                lr *= 0.3 if epoch == epochs - 1 and at > n // 2 else 1.0
                # m and s2 are the averages of the gradient and its square with weights 0.1 and 0.01, g is a tenth of
                # the gradient; block by block, as caches like it
                q = math.sqrt(1 - 0.99**t)
                for k in range(0, len(flat), BLOCK):
                    pk, gk, mk, sk = (a[k : k + BLOCK] for a in (flat, g_flat, m, s2))
                    mk *= 0.9
                    mk += gk
                    gk *= gk
                    sk *= 0.99
                    sk += gk
                    np.sqrt(sk, out=gk)
                    gk += 1e-6 * q
                    np.divide(mk, gk, out=gk)
                    gk *= lr * q / (1 - 0.9**t)
                    pk -= gk
            losses.append(total / max(count, 1))
        state["t"] = t
        return losses

    def _parts(self, flat: np.ndarray) -> dict:
        """Views of an array that holds all weights one after another, by name."""
        out, at = {}, 0
        for k, a in self.p.items():
            out[k] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return out

    def _forward(self, h: np.ndarray, x: np.ndarray, news: list[np.ndarray]) -> tuple:
        """A window of inputs ``x`` (by time and stream) from states ``h``; at each time those in ``news`` are emptied.
        Returns what :meth:`_back` needs: states before each step; gates r and z and the recurrent
        part of n; n; states after each step, by time, stream and unit."""
        p = self.p
        steps, n = x.shape
        shape = (steps, n, HIDDEN)
        before, gates, new, after = np.empty(shape, np.float32), np.empty((3, *shape), np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
        gi = (p["E"] + p["b"]).reshape(-1, HIDDEN).take(3 * x + np.arange(3)[:, None, None], axis=0)
        recurrent = _gates(p["R"])
        recurrent[:2] *= -1
        before[0] = h
        with np.errstate(over="ignore"):  # a gate is 0 then
            for j in range(steps):
                if len(news[j]):
                    before[j, news[j]] = 0
                gh, a, c, s = gates[:, j], gates[:2, j], new[j], after[j]
                np.matmul(before[j], recurrent, out=gh)
                a -= gi[:2, j]
                np.exp(a, out=a)
                a += 1
                np.reciprocal(a, out=a)
                np.multiply(gh[2], a[0], out=c)
                c += gi[2, j]
                np.tanh(c, out=c)
                np.subtract(before[j], c, out=s)
                s *= a[1]
                s += c
                if j + 1 < steps:
                    before[j + 1] = s
        return before, gates, new, after

    def _back(self, g: dict, dstates: np.ndarray, kept: tuple, x: np.ndarray, news: list[np.ndarray]) -> None:
        """Gradients of the unit's weights; ``dstates`` is used up."""
        before, (r, z, ghn), n, _ = kept
        steps, rows, _ = before.shape
        # what a state's gradient is multiplied by on its way to each gate, for all steps at once
        rest = 1 - z
        to_z = before - n
        to_z *= z
        to_z *= rest
        to_n = n * n
        np.subtract(1, to_n, out=to_n)
        to_n *= rest
        to_r = 1 - r
        to_r *= r
        to_r *= ghn
        # by input's n, r, z and by the recurrent part of n
        d = np.empty((4, *before.shape), np.float32)
        recurrent = _gates(self.p["R"]).transpose(0, 2, 1).copy()
        dh, parts = np.zeros((rows, HIDDEN), np.float32), np.empty((3, rows, HIDDEN), np.float32)
        for j in range(steps - 1, -1, -1):
            ds, (dn, dr, dz, dgn) = dstates[j], d[:, j]
            ds += dh
            np.multiply(ds, to_n[j], out=dn)
            np.multiply(ds, to_z[j], out=dz)
            np.multiply(dn, to_r[j], out=dr)
            np.multiply(dn, r[j], out=dgn)
            np.matmul(d[1:, j], recurrent, out=parts)
            np.multiply(ds, z[j], out=dh)
            for part in parts:
                dh += part
            if len(news[j]):
                dh[news[j]] = 0
        d, before = d.reshape(4, -1, HIDDEN), before.reshape(-1, HIDDEN)
        one = np.ones(len(before), np.float32)
        by_input = np.empty((len(before), 3 * HIDDEN), np.float32)
        for k, (of_input, of_state) in enumerate(((1, 1), (2, 2), (0, 3))):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            g["R"][:, part] = before.T @ d[of_state]
            g["b"][part] = one @ d[of_input]
            by_input[:, part] = d[of_input]
        g["E"].fill(0)
        _add_rows(g["E"], x.ravel(), by_input)

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole texts, open words up to their class."""
        out = np.zeros(len(ids))
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        for k in range(0, len(order), SIDE_BY_SIDE):
            own = order[k : k + SIDE_BY_SIDE]
            out[own] = self._score([ids[i] for i in own])
        return out

    def _score(self, ids: list[np.ndarray]) -> np.ndarray:
        """:meth:`score` of some texts, the longest first."""
        v, p = self.v, self.p
        size = np.array([len(i) for i in ids])
        flat = np.concatenate(ids)
        start = np.cumsum(size) - size
        out, n = np.zeros(len(ids)), len(ids)
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()
        h, last = np.zeros((n, HIDDEN), np.float32), np.full(n, v.end)
        states, targets, owners, waiting = [], [], [], 0

        def drain():
            lp, _ = self.log_p(np.concatenate(states), np.concatenate(targets))
            out[:] += np.bincount(np.concatenate(owners), lp, len(out))

        # the same as _forward(), with nothing kept but states; inputs and bias are added beforehand
        table, recurrent = _gates(p["E"] + p["b"]), _gates(p["R"])
        for a in (table, recurrent):
            a[:2] *= -1
        with np.errstate(over="ignore"):
            for t in range(0, len(live), WINDOW):
                ns = live[t : t + WINDOW]
                n, own = ns[0], np.arange(ns[0])
                # a text's place in the window after its end is never read
                y = flat.take(start[:n] + np.arange(t, t + len(ns))[:, None], mode="clip")
                x = v.inputs[np.concatenate((last[None, :n], y[:-1]))]
                last, h = y[-1], h[:n]
                after, gh = np.empty((len(ns), n, HIDDEN), np.float32), np.empty((3, n, HIDDEN), np.float32)
                for j, k in enumerate(ns):
                    h, s, g, gi = h[:k], after[j, :k], gh[:, :k], table.take(x[j, :k], axis=1)
                    np.matmul(h, recurrent, out=g)
                    a, c = g[:2], g[2]
                    a += gi[:2]
                    np.exp(a, out=a)
                    a += 1
                    np.reciprocal(a, out=a)
                    c *= a[0]
                    c += gi[2]
                    np.tanh(c, out=c)
                    np.subtract(h, c, out=s)
                    s *= a[1]
                    s += c
                    h = s
                    states.append(s)
                    targets.append(y[j, :k])
                    owners.append(own[:k])
                    waiting += k
                if waiting > DRAIN:
                    drain()
                    states, targets, owners, waiting = [], [], [], 0
        if states:
            drain()
        return out


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of ``rows`` to the row of ``into`` at its place: frequent places by a sum each, the first
    occurrences of all others together, then the second ones, and so on."""
    order = np.argsort(at.astype(np.uint16) if len(into) <= 1 << 16 else at, kind="stable")
    by_place = at[order]
    first = np.flatnonzero(np.diff(by_place, prepend=-1))
    places, n = by_place[first], np.diff(first, append=len(at))
    one = np.ones(len(at), np.float32)
    often = n > 8
    for place, k, c in zip(places[often].tolist(), first[often].tolist(), n[often].tolist(), strict=True):
        into[place] += one[:c] @ rows.take(order[k : k + c], axis=0)
    rest = np.flatnonzero(~often)
    rest = rest[np.argsort(-n[rest], kind="stable")]
    places, first, n = places[rest], first[rest], n[rest]
    for k in range(int(n.max(initial=0))):
        c = int(np.searchsorted(-n, -k, "left"))
        into[places[:c]] += rows.take(order[first[:c] + k], axis=0)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The most frequent words, at most ``head``: all whose count reaches a threshold, which
    comes from a histogram of the counts' logarithms."""
    band = F.floor(F.log2("c") * 32).cast("int")
    histogram = counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("band")).collect()
    kept, threshold = 0, None
    for r in histogram:
        if kept + r.n > head:
            break
        kept, threshold = kept + r.n, r.band
    rows = counts.where(band >= threshold).collect() if threshold is not None else []
    rows.sort(key=lambda r: (-r.c, bytes(r.word)))
    return Vocabulary([bytes(r.word) for r in rows], np.array([r.c for r in rows], np.float64), sum(r.c for r in histogram), sum(r.n for r in histogram), sum(r.n for r in histogram if r.band == 0))


def segments_of(text: bytes, share: int) -> list[tuple[list[bytes], list[bytes]]]:
    """The text's segments that are trained on: one in ``share``, by a hash of text and place. Each with
    the words before it, the last ``WARM`` + 1 of them; before a text stands an end."""
    words = tokens(text)
    return [(words[k - WARM - 1 : k] if k else [END], words[k : k + SEGMENT]) for k in segment_places(text, len(words), share)]


def segment_places(text: bytes, length: int, share: int) -> list[int]:
    """Where the segments of :func:`segments_of` begin in the text's ``length`` tokens."""
    if share == 1:
        return list(range(0, length, SEGMENT))
    n = -(-length // SEGMENT)
    place = np.arange(n, dtype=np.uint64) + np.uint64(zlib.crc32(text) * 0x9E3779B97F4A7C15 % (1 << 64))
    place = (place ^ place >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (np.flatnonzero((place >> np.uint64(32)) % np.uint64(share) == 0) * SEGMENT).tolist()


def train_on_all(net: Network, training: DataFrame, rounds: int = ROUNDS, share: int = SHARE) -> None:
    """Trains ``net`` on segments of every row of ``training(text)``, the rows dealt out over the
    rounds. Weights meet in pieces on the executors; only their averages come to the driver."""
    context = training.sparkSession.sparkContext
    names = list(net.p)
    for k in range(rounds):
        sent = context.broadcast(net)

        def run(batches, sent=sent):
            base = sent.value
            own = copy.copy(base)
            own.p = {n: base.p[n].copy() for n in names}
            state, seen, task, ids, before, waiting = {}, 0, TaskContext.get().partitionId(), [], [], 0
            first = np.array([own.v.end], np.int32)

            def learn():
                own.train(ids, 1, parallel=min(max(waiting // (WINDOW * STEPS), 8), TASK_STREAMS), state=state, before=before)

            for batch in batches:
                words, begin = all_tokens(batch.column("text"))
                encoded = own.v.encode_all(words)
                for text, a, b in zip(as_bytes(batch.column("text")), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    for k in segment_places(text, b - a, share):
                        # as segments_of() has them
                        before.append(encoded[a + k - WARM - 1 : a + k] if k else first)
                        ids.append(encoded[a + k : min(a + k + SEGMENT, b)])
                        waiting += len(ids[-1])
                    if waiting >= TASK_TOKENS:
                        learn()
                        seen, ids, before, waiting = seen + waiting, [], [], 0
            if waiting:
                learn()
                seen += waiting
            if seen:
                parts = np.array_split(np.concatenate([own.p[n].ravel() for n in names]), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["piece", "task", "n", "w"])

        def average(batches):
            total: dict = {}
            for batch in batches:
                for piece, n, w in zip(*(batch.column(c).to_pylist() for c in ("piece", "n", "w")), strict=True):
                    c, held = total.get(piece, (0, 0.0))
                    total[piece] = c + n, held + n * np.frombuffer(w, np.float32).astype(np.float64)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([(s / c).astype(np.float32).tobytes() for c, s in total.values()], pa.binary())], ["piece", "w"])

        dealt = training.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(rounds)) == k).select("text")
        parts = dealt.mapInArrow(run, "piece int, task int, n bigint, w binary")
        # in order of tasks, so that sums come out the same at every run
        rows = parts.repartition("piece").sortWithinPartitions("piece", "task").mapInArrow(average, "piece int, w binary").collect()
        if rows:
            flat, at = np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(rows, key=lambda r: r.piece)]), 0
            for n in names:
                net.p[n] = flat[at : at + net.p[n].size].reshape(net.p[n].shape).copy()
                at += net.p[n].size


def fit(training: DataFrame, counts: DataFrame, texts: int = TRAIN_TEXTS, head: int = HEAD, share: int = SHARE) -> Network:
    """The network for ``training(doc_id, text)``, whose words' ``counts`` are given."""
    v = vocabulary(counts, head)
    chosen = bounded_sample(training.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", texts, 1).distinct()
    # of a repeated doc_id the smallest text, so that one id cannot bring any number of texts
    first = training.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    net = Network(v)
    net.train([v.encode(tokens(r.text.encode())) for r in first.orderBy("doc_id").toLocalIterator()])
    if v.neural:
        train_on_all(net, training, share=share)
    return net


def lm_scores(documents: DataFrame, texts: int = TRAIN_TEXTS, head: int = HEAD, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``texts``, ``head`` and ``share`` are the model's: texts that it starts from, words with a
    place of their own, and one in how many segments of the training texts gives gradients.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts, _ = written(token_counts(training), "token-counts")
    return scored(docs, counts, fit(training, counts, texts, head, share))


def scored(docs: DataFrame, counts: DataFrame, net: Network) -> DataFrame:
    """The rows of :func:`lm_scores` for ``docs(doc_id, text)`` under a fitted network."""
    v = net.v
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        v, other = net.v, len(net.v.words)
        heads, ids, columns, opens, held = [], [], {"n_tokens": [], "known": [], "base": []}, [], 0

        def scored_part():
            head, places = pa.Table.from_batches(heads).combine_chunks(), pa.concat_tables(opens).sort_by("at")
            offsets = np.searchsorted(places["at"].to_numpy(), np.arange(len(ids) + 1))
            word, n = (pa.concat_arrays(places[c].chunks) if places.num_rows else pa.array([], places[c].type) for c in ("word", "count_all"))
            out = {
                **{c: head.column(c).chunk(0) for c in ("row", "doc_id")},
                **{c: pa.array(np.concatenate(x)) for c, x in columns.items()},
                "model": pa.array(net.score(ids) / LN10),
                "open": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([word, n], ["word", "n"])),
            }
            for of in (heads, ids, opens, *columns.values()):
                of.clear()
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        for batch in batches:
            if not batch.num_rows:
                continue
            words, begin = all_tokens(batch.column("text"))
            encoded = v.encode_all(words)
            # only words that the model has no place for are kept as words, once for each text
            places = np.flatnonzero(encoded == other)
            texts = np.searchsorted(begin, places, "right") - 1 + len(ids)
            of_text = pa.table({"at": texts, "word": words.take(pa.array(places)).cast(pa.binary())})
            opens.append(of_text.group_by(["at", "word"], use_threads=False).aggregate([([], "count_all")]))
            # no text is without tokens
            columns["n_tokens"].append(np.diff(begin))
            columns["known"].append(np.add.reduceat((encoded != other).astype(np.int64), begin[:-1]))
            columns["base"].append(np.add.reduceat(v.base[encoded], begin[:-1]))
            ids += np.split(encoded, begin[1:-1])
            heads.append(batch.select(["row", "doc_id"]))
            held += batch.column("text").nbytes
            if held > PART_BYTES:
                yield scored_part()
                held = 0
        if ids:
            yield scored_part()

    schema = "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, model double, open array<struct<word:binary,n:bigint>>"
    local, _ = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema), "lm-rows")
    each = local.select("row", F.explode("open").alias("w")).select("row", "w.word", "w.n")
    c = F.coalesce("c", F.lit(0))
    # the unknown word's counts are those of the words seen once
    open_score = F.log10(F.when(c > 0, c).otherwise(max(v.once, 1)) / float(v.open_total + max(v.once, 1)))
    rest = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(v.total + v.distinct + 1)))).alias("base2"),
        F.sum(F.col("n") * open_score).alias("model2"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return local.drop("open").join(rest, "row", "left").select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("known2")).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"),
        (F.col("model") + zero("model2")).alias("score"),
    )

