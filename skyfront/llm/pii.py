"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF.

The base finds emails, IP addresses, card and phone numbers by their patterns. The network
adds spans that are written otherwise (blanks or words for marks, other separators): each
character gets scores for "none" and the four kinds from a bidirectional LSTM, and a
conditional random field with learnt transitions decodes them.

Texts are cut into windows of ``CORE`` characters with ``MARGIN`` more on both sides. Every
window is decoded by itself; a character takes the tag of the window whose core it is in, and
runs of one tag over the whole text are the spans, so a span may cross windows. A span counts
if it passes its kind's check (digits, Luhn, parts, a domain) and overlaps no base span.

Training is numpy only, on labelled spans: passages of a bounded sample of texts
(``TRAIN_TEXTS``, by a seeded hash of doc_id, ``TEXT_CHARS`` of each) with the base's spans, and generated numbers and addresses
set into them at known places, among look-alikes that are none (dates, amounts, hex strings).

A window is decoded only where a span can be, which is exact (see :func:`detect`). One whose scores prefer "none" everywhere by more than any transition can make up for is
not decoded further either: the path without a span is then the best one (see ``Tagger.tags``).

Defined results: a null text is empty and has no spans; offsets are code points, the end
exclusive; rows with a null doc_id and repeated rows are scanned like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
TRAIN_TEXTS, TEXT_CHARS = 160, 20_000
CORE, MARGIN = 224, 32
HIDDEN, ALPHABET = 8, 130
BATCH = 1024
#: Characters of texts that are searched at a time.
PART_CHARS = 2_000_000

# The base's patterns. An email is found from its @, see emails(). An address is
# looked for at the first digit of a run only: a later start would fail where the first one
# did. So neither takes time that grows with the square of a run's length.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_card(s: str) -> bool:
    d = _NO_DIGIT.sub("", s)
    return 14 <= len(d) <= 19 and luhn(d)


def _is_ip(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """What EMAIL finds, left to right: of each @ the characters before it, back to the last
    match's end, and the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = after = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# Checks of what the network finds. Words and brackets may stand for the marks.
_AT = re.compile(r"\s*(?:@|[\[({]\s*at\s*[\])}]|\bat\b)\s*", re.I)
_DOT = re.compile(r"\s*(?:\.|[\[({]\s*(?:dot|\.)\s*[\])}]|\bdot\b)\s*", re.I)
_MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PHONE_MARKS = re.compile(r"[\x20()./0-9+-]+")
_CARD_MARKS = re.compile(r"[0-9]+(?:[\x20./_-]{1,2}[0-9]+)*")


def passes(kind: int, s: str) -> bool:
    digits = _NO_DIGIT.sub("", s)
    if kind == 0:
        return _MAILBOX.fullmatch(_DOT.sub(".", _AT.sub("@", s))) is not None
    if kind == 1:
        parts = _DOT.sub(".", s).split(".")
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == 2:
        return _CARD_MARKS.fullmatch(s) is not None and _is_card(s)
    return 10 <= len(digits) <= 15 and _PHONE_MARKS.fullmatch(s) is not None and len(s) > len(digits)


def symbols(text: str) -> np.ndarray:
    """ASCII as it is, any other character as 128."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64)


PAD = 129


@dataclass
class Tagger:
    """E: input tables, R: recurrent weights, both for two directions (the gates' halves are
    scaled so that one tanh serves all); O, o: tag scores; T: transitions; S: starts."""

    p: dict

    @classmethod
    def new(cls, seed: int = 10) -> Tagger:
        r = np.random.default_rng(seed)
        f = lambda scale, *s: (r.standard_normal(s) * scale).astype(np.float32)
        e = f(0.3, 2, ALPHABET, 4 * HIDDEN)
        e[:, :, HIDDEN : 2 * HIDDEN] += 0.7  # remember at first
        o = np.zeros(5, np.float32)
        o[0] = 2
        return cls({"E": e, "R": f(0.3, 2, HIDDEN, 4 * HIDDEN), "O": f(0.3, 2 * HIDDEN, 5), "o": o, "T": f(0.1, 5, 5), "S": f(0.1, 5)})

    def _run(self, x: np.ndarray, keep: bool = False):
        """Hidden states of windows x (n, t): (t, n, 2 * HIDDEN), in reading order."""
        n, steps = x.shape
        both = np.stack((x, x[:, ::-1] + ALPHABET)).transpose(2, 0, 1).copy()
        table, r = self.p["E"].reshape(2 * ALPHABET, -1), self.p["R"]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((steps, n, 2 * HIDDEN), np.float32)
        kept = []
        half = np.float32(0.5)
        for t in range(steps):
            a = table[both[t]]
            a += h @ r
            np.tanh(a, out=a)
            g = a[:, :, 3 * HIDDEN :]
            s = a[:, :, : 3 * HIDDEN] * half
            s += half
            before = c
            c = s[:, :, HIDDEN : 2 * HIDDEN] * c
            c += s[:, :, :HIDDEN] * g
            tc = np.tanh(c)
            if keep:
                kept.append((h, before, s, g, tc))
            h = s[:, :, 2 * HIDDEN :] * tc
            out[t, :, :HIDDEN] = h[0]
            out[steps - 1 - t, :, HIDDEN:] = h[1]
        return out, both, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (t, 5, n) of windows x (n, t). The same as :meth:`_run`, with the state
        turned so that every operation but the gathering runs over whole rows of windows."""
        n, steps = x.shape
        both = np.concatenate((x, x[:, ::-1] + ALPHABET)).T.copy()
        table, (r0, r1) = self.p["E"].reshape(2 * ALPHABET, -1), self.p["R"]
        h, c = np.zeros((HIDDEN, 2 * n), np.float32), np.zeros((HIDDEN, 2 * n), np.float32)
        out = np.empty((steps, 2 * HIDDEN, n), np.float32)
        a, turned = np.empty((2 * n, 4 * HIDDEN), np.float32), np.empty((4 * HIDDEN, 2 * n), np.float32)
        i, f, o, g = (turned[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        s, half = turned[: 3 * HIDDEN], np.float32(0.5)
        for t in range(steps):
            np.take(table, both[t], axis=0, out=a, mode="clip")
            a[:n] += h[:, :n].T @ r0
            a[n:] += h[:, n:].T @ r1
            np.tanh(a, out=a)
            np.copyto(turned, a.T)
            s *= half
            s += half
            c *= f
            i *= g
            c += i
            np.tanh(c, out=h)
            h *= o
            out[t, :HIDDEN] = h[:, :n]
            out[steps - 1 - t, HIDDEN:] = h[:, n:]
        return self.p["O"].T @ out + self.p["o"][:, None]

    def tags(self, x: np.ndarray) -> np.ndarray:
        """Best path of each window, (n, t).

        A path gains at most ``a`` over the one without spans at each transition that it changes;
        a stretch of k tags changes at most k + 1 of them, 2 k at least covers that. So where
        "none" leads by more than 2 a at every character, no stretch pays and "none" is best.
        """
        e = self.emissions(x)
        t, s = self.p["T"], self.p["S"]
        a = max(0.0, float(t.max() - t[0, 0]), float(s.max() - s[0]))
        lead = (e[:, 0] - e[:, 1:].max(1)).min(0)
        out = np.zeros(x.shape, np.int8)
        todo = np.flatnonzero(lead <= 2 * a)
        if len(todo):
            out[todo] = self._viterbi(e[:, :, todo].transpose(0, 2, 1))
        return out

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        steps, n, _ = e.shape
        v, back = e[0] + self.p["S"], np.empty((steps, n, 5), np.int8)
        for t in range(1, steps):
            m = v[:, :, None] + self.p["T"]
            back[t] = m.argmax(1)
            v = m.max(1) + e[t]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = v.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tag paths y (n, t) and its gradients."""
        p = self.p
        h, both, kept = self._run(x, keep=True)
        steps, n, _ = h.shape
        e = (h @ p["O"] + p["o"]).astype(np.float64)
        t, s = p["T"].astype(np.float64), p["S"].astype(np.float64)
        lse = lambda m, axis: (k := m.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(m - k).sum(axis))
        f, b = np.empty_like(e), np.zeros_like(e)
        f[0] = e[0] + s
        for k in range(1, steps):
            f[k] = lse(f[k - 1][:, :, None] + t, 1) + e[k]
        for k in range(steps - 2, -1, -1):
            b[k] = lse(t + (e[k + 1] + b[k + 1])[:, None, :], 2)
        z = lse(f[-1], 1)
        rows, yt = np.arange(n), y.T
        gold = s[yt[0]] + e[0][rows, yt[0]]
        de = np.exp(f + b - z[None, :, None])
        ds, dt = de[0].sum(0), np.zeros((5, 5))
        for k in range(steps):
            de[k][rows, yt[k]] -= 1
            if k:
                gold = gold + t[yt[k - 1], yt[k]] + e[k][rows, yt[k]]
                dt += np.exp(f[k - 1][:, :, None] + t + (e[k] + b[k])[:, None, :] - z[:, None, None]).sum(0)
                np.add.at(dt, (yt[k - 1], yt[k]), -1)
        np.add.at(ds, yt[0], -1)
        de = (de / n).astype(np.float32)
        g = {"T": dt / n, "S": ds / n, "O": np.einsum("tnh,tnk->hk", h, de), "o": de.sum((0, 1))}
        dout = de @ p["O"].T
        g["R"] = np.zeros_like(p["R"])
        table = np.zeros((2 * ALPHABET, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        for k in range(steps - 1, -1, -1):
            before_h, before_c, gate, cand, tc = kept[k]
            dh = dh + np.stack((dout[k, :, :HIDDEN], dout[steps - 1 - k, :, HIDDEN:]))
            i, forget, o = gate[:, :, :HIDDEN], gate[:, :, HIDDEN : 2 * HIDDEN], gate[:, :, 2 * HIDDEN :]
            dc = dc + dh * o * (1 - tc * tc)
            # a gate is tanh(a) / 2 + 1 / 2, so its slope by a is 2 g (1 - g)
            da = np.concatenate((dc * cand * 2 * i * (1 - i), dc * before_c * 2 * forget * (1 - forget), dh * tc * 2 * o * (1 - o), dc * i * (1 - cand * cand)), axis=2)
            g["R"] += before_h.transpose(0, 2, 1) @ da
            flat = both[k].ravel()
            order = np.argsort(flat, kind="stable")
            ids, first = np.unique(flat[order], return_index=True)
            table[ids] += np.add.reduceat(da.reshape(-1, 4 * HIDDEN)[order], first, axis=0)
            dh, dc = da @ p["R"].transpose(0, 2, 1), dc * forget
        g["E"] = table.reshape(p["E"].shape)
        return float((z - gold).mean()), g


def _examples(r: np.random.Generator) -> tuple[int, str]:
    """A generated entity (kind 0 to 3) or look-alike (-1)."""
    # numbers in texts are often round or repeat a digit
    n = lambda k: str(int(r.integers(0, 10))) * k if r.random() < 0.15 else "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[int(r.integers(len(x)))]
    letters = lambda a, b: "".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(a, b))))
    kind = int(r.integers(-2, 4))
    if kind == 0:
        name = letters(3, 9) + pick("", ".", "_", "-") + pick("", letters(2, 7), n(2))
        at, dot = pick(("@", "."), (" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", " . "), (" (at) ", " (dot) "))
        name = name.rstrip("._-")
        domain = letters(3, 9) + pick("", "", "-" + letters(2, 8), dot + letters(3, 8))
        return 0, name + at + domain + dot + pick("com", "org", "net", "de", "io", "example" + dot + "com")
    if kind == 1:
        sep = pick(".", "[.]", " . ", " dot ", "(.)")
        return 1, sep.join(str(int(x)) for x in r.integers(0, 256, 4))
    if kind == 2:
        d = pick("4", "5", "3") + n(14)
        d += str(next(c for c in range(10) if luhn(d + str(c))))
        sep = pick("", " ", "-", ".", "/", "_")
        return 2, sep.join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = n(3), n(3), n(4)
        return 3, pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{n(2)} {a} {b} {c}", f"{a} {b} {c}", f"+1-{a}-{b}-{c}", f"00{n(2)} {a} {b}{c}", f"({a}) {b} {c}", f"{a}/{b}{c}")
    hexes = "".join(pick(*"0123456789abcdef") for _ in range(int(r.integers(16, 41))))
    return -1, pick(f"{1900 + int(r.integers(120))}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(4)}-{n(2)}-{n(2)}", f"${n(3)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{n(2)}:{n(2)}:{n(2)}", hexes, f'token = "{hexes}"', n(int(r.integers(1, 9))), n(22), f"{n(3)},{n(3)},{n(3)}", "at the", "dot", f"version {n(1)}.{n(2)}", f"{n(2)}%", f"#{n(5)}")


def training_windows(texts: list[str], count: int, length: int, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Passages with the base's spans, most with one or two generated strings set in at a word's end."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()] or ["a"]
    x, y = np.full((count, length), PAD, np.int64), np.zeros((count, length), np.int64)
    for i in range(count):
        t = texts[int(r.integers(len(texts)))]
        at = int(r.integers(max(1, len(t) - length)))
        t = t[at : at + length]
        tags = np.zeros(len(t), np.int64)
        for a, k, b in base_spans(t):
            tags[a:b] = k + 1
        for _ in range(int(r.integers(0, 3))):
            k, s = _examples(r)
            gaps = [j for j, c in enumerate(t) if c in " \n" and tags[j] == 0]
            if not gaps:
                continue
            j = gaps[int(r.integers(len(gaps)))] + 1
            end = " " if r.random() < 0.8 else ("." if r.random() < 0.5 else ",") + " "
            if r.random() < 0.15:
                end = ("!!", "###", "%%%", "***", "&&&", "$$$")[int(r.integers(6))] + " "
            t = t[:j] + s + end + t[j:]
            tags = np.concatenate((tags[:j], np.full(len(s), k + 1), np.zeros(len(end), np.int64), tags[j:]))
        n = min(length, len(t))
        x[i, :n], y[i, :n] = symbols(t)[:n], tags[:n]
    return x, y


def train(texts: list[str], windows: int = 10_000, length: int = 80, batch: int = 100, epochs: int = 7, rate: float = 0.02) -> Tagger:
    x, y = training_windows(texts, windows, length)
    tagger = Tagger.new()
    p = tagger.p
    m, v = ({k: np.zeros_like(a, np.float64) for k, a in p.items()} for _ in range(2))
    t, total = 0, epochs * (windows // batch)
    for _ in range(epochs):
        for at in range(0, windows - batch + 1, batch):
            _, g = tagger.gradients(x[at : at + batch], y[at : at + batch])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            t += 1
            lr = rate * (1 - 0.95 * t / total)
            for k in p:
                d = g[k] * min(1.0, 5.0 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return tagger


def windows_of(ids: np.ndarray) -> np.ndarray:
    """The windows of one text: row k has the characters from k * CORE - MARGIN on."""
    n = -(-len(ids) // CORE)
    if not n:
        return np.empty((0, CORE + 2 * MARGIN), np.int64)
    padded = np.full(n * CORE + 2 * MARGIN, PAD, np.int64)
    padded[MARGIN : MARGIN + len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, CORE + 2 * MARGIN)[::CORE]


def found_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of a tag that pass their check and overlap no base span."""
    if not tags.any():
        return []
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate(([0], tags, [0])).astype(np.int64)))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        # a mark or blank at either end is not part of it
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        inside_word = (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum())
        if a < b and not inside_word and passes(kind, text[a:b]) and all(b <= s or a >= e for s, _, e in base):
            out.append((a, kind, b))
    return out


#: Every span that passes its kind's check holds a digit, an @ or a spelled "at".
_SPELLED = re.compile(r"(?<![A-Za-z0-9])at(?![A-Za-z0-9])", re.I)


def _to_read(text: str, ids: np.ndarray) -> np.ndarray:
    """The windows of a text whose core holds a character that every found span needs."""
    marks = np.flatnonzero((ids >= 0x30) & (ids <= 0x39) | (ids == 0x40))
    spelled = [p for m in _SPELLED.finditer(text) for p in (m.start(), m.end() - 1)]
    return np.unique(np.concatenate((marks, np.array(spelled, np.int64))) // CORE)


def detect(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; spans are (start, kind, end).

    Only windows that can be part of a span are decoded, which changes no result: a span is a run
    of one tag, and one that passes holds a digit, an @ or a spelled "at" (see :func:`passes`). So
    windows with one of these are decoded first, then, as long as a run reaches a decoded window's
    edge, the window beyond it. Every run with such a character is decoded whole; a run without one
    would not pass.
    """
    ids = [symbols(t) for t in texts]
    views = [windows_of(i) for i in ids]
    counts = np.array([len(v) for v in views], np.int64)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    tags, done = np.zeros((len(owner), CORE), np.int8), np.zeros(len(owner), bool)
    todo = np.concatenate([np.empty(0, np.int64), *(first[k] + _to_read(t, i) for k, (t, i) in enumerate(zip(texts, ids, strict=True)))])
    while len(todo):
        for at in range(0, len(todo), BATCH):
            some = todo[at : at + BATCH]
            rows = np.stack([views[k][w] for k, w in zip(owner[some].tolist(), (some - first[owner[some]]).tolist(), strict=True)])
            tags[some] = tagger.tags(rows)[:, MARGIN : MARGIN + CORE]
        done[todo] = True
        after, before = todo[tags[todo, -1] != 0], todo[tags[todo, 0] != 0]
        after = after[after + 1 < first[owner[after]] + counts[owner[after]]] + 1
        before = before[before > first[owner[before]]] - 1
        todo = np.union1d(after, before)
        todo = todo[~done[todo]]
    out = []
    for text, at, n in zip(texts, first.tolist(), counts.tolist(), strict=True):
        base = base_spans(text)
        whole = tags[at : at + n].ravel()[: len(text)]
        out.append((base, sorted(base + found_spans(text, whole, base))))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit(documents: DataFrame, texts: int = TRAIN_TEXTS) -> Tagger:
    """The tagger. ``texts`` bounds the labelled sample: passages of so many texts, of each the first
    ``TEXT_CHARS`` characters after a place chosen by its hash, which come to the driver."""
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = bounded_sample(docs.select("doc_id").distinct(), "doc_id", texts, 10)
    # of a repeated doc_id the smallest text; a passage anywhere in a text, so that bytes are bounded too
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - TEXT_CHARS, F.lit(0)) + 1) + 1
    return train([r.text for r in rows.select("doc_id", F.substring("text", at.cast("int"), F.lit(TEXT_CHARS)).alias("text")).orderBy("doc_id").collect()])


def personal_data(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all), n_added, for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(tagger)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            first, size, cut = 0, 0, []
            for i, t in enumerate(texts):
                size += len(t.as_py() or "")
                if size > PART_CHARS:
                    cut.append((first, i + 1))
                    first, size = i + 1, 0
            for a, b in [*cut, (first, len(texts))]:
                if a == b:
                    continue
                found = detect([t.as_py() or "" for t in texts[a:b]], sent.value)
                counts = np.array([np.bincount([k for _, k, _ in base], minlength=4) for base, _ in found], np.int64)
                digest = [sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                added = np.array([len(every) - len(base) for base, every in found], np.int64)
                yield pa.RecordBatch.from_arrays([ids[a:b], *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest), pa.array([_joined(every) for _, every in found]), pa.array(added)], names)

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
