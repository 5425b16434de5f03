"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The network learns from labelled spans: those the patterns find in a bounded sample of documents, and rewritings of
their values in other notations. Texts are read in overlapping windows; each character takes its tag from the window
in which it lies farthest from an edge, and spans are read off the joined tags of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Spans that only the network found carry these kinds.
MODEL_KINDS = tuple(f"model-{k}" for k in KINDS)
ORDER = {k: i for i, k in enumerate((*KINDS, *MODEL_KINDS))}

# The base patterns. Lookbehinds and possessive runs only spare work on long runs of digits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches, found from each @ outward."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


WINDOW, STRIDE = 64, 32
_MARKS = "@.-+()_%:/=,\"' \n#"
_ALPHABET = len(_MARKS) + 7 + 26
_CODE = np.full(128, 4, np.uint8)
for _i, _c in enumerate(_MARKS):
    _CODE[ord(_c)] = 7 + _i
_CODE[ord("0") : ord("9") + 1], _CODE[ord("A") : ord("Z") + 1] = 3, 2
_CODE[ord("a") : ord("z") + 1] = 7 + len(_MARKS) + np.arange(26, dtype=np.uint8)


def codes(text: str) -> np.ndarray:
    """A class for each character: capitals, digits, other scripts; small letters and some marks alone; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], np.uint8(5))


TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


class Tagger:
    """Embedding, two LSTMs, an output layer and CRF transitions."""

    def __init__(self, hidden: int = 20, embed: int = 10, seed: int = 5, dtype: type = np.float32):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.hidden = hidden
        self.p = {"E": rng.normal(0, 0.5, (_ALPHABET + 1, embed)), "O": init(2 * hidden, TAGS), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"W{d}": init(embed + hidden, 4 * hidden), f"w{d}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    def emissions(self, c: np.ndarray, keep: bool = False):
        """Scores of the tags of each character; keep: with all that the gradients need. Both directions run side by side."""
        h, (n, t) = self.hidden, c.shape
        x = self.p["E"][c]
        x = np.stack([x, x[:, ::-1]])
        w = np.stack([self.p["Wf"], self.p["Wb"]])
        e = x.shape[-1]
        scale = np.repeat([0.5, 1.0], [3 * h, h]).astype(x.dtype)  # a sigmoid is a tanh of half
        given = (x.reshape(2, n * t, e) @ w[:, :e]).reshape(2, n, t, 4 * h) + np.stack([self.p["wf"], self.p["wb"]])[:, None, None]
        state, cell, out, kept = *np.zeros((2, 2, n, h), x.dtype), np.zeros((2, n, t, h), x.dtype), []
        for i in range(t):
            g = np.tanh((given[:, :, i] + state @ w[:, e:]) * scale)
            gates = 0.5 + 0.5 * g[..., : 3 * h]
            f, u = gates[..., :h], g[..., 3 * h :]
            before, cell = cell, f * cell + gates[..., h : 2 * h] * u
            th = np.tanh(cell)
            state = gates[..., 2 * h :] * th
            out[:, :, i] = state
            if keep:
                kept.append((gates, u, before, th))
        both = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        scores = both @ self.p["O"] + self.p["o"]
        return (scores, both, (x, w, out, kept)) if keep else scores

    def back(self, grad: np.ndarray, memory: tuple, grads: dict) -> np.ndarray:
        """Adds the gradients of both directions; returns those of the embedded characters."""
        x, w, out, kept = memory
        h, (_, n, t, e) = self.hidden, x.shape
        grad = np.stack([grad[..., :h], grad[..., h:][:, ::-1]])
        all_, (gs, gc) = np.zeros((2, n, t, 4 * h), x.dtype), np.zeros((2, 2, n, h), x.dtype)
        back = w[:, e:].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            gates, u, before, th = kept[i]
            f, m, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            gh = grad[:, :, i] + gs
            gc = gc + gh * o * (1 - th**2)
            gate = np.concatenate([gc * before, gc * u, gh * th], axis=2) * gates * (1 - gates)
            gate = np.concatenate([gate, gc * m * (1 - u**2)], axis=2)
            all_[:, :, i] = gate
            gs, gc = gate @ back, gc * f
        flat = all_.reshape(2, n * t, 4 * h)
        previous = np.concatenate([np.zeros((2, n, 1, h), x.dtype), out[:, :, :-1]], axis=2)
        gw = np.concatenate([x.reshape(2, n * t, e), previous.reshape(2, n * t, h)], axis=2).transpose(0, 2, 1) @ flat
        for k, d in enumerate("fb"):
            grads[f"W{d}"], grads[f"w{d}"] = gw[k], flat[k].sum(axis=0)
        gx = (flat @ w[:, :e].transpose(0, 2, 1)).reshape(2, n, t, e)
        return gx[0] + gx[1][:, ::-1]

    def step(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss (negative log-likelihood a window) and gradients, by forward and backward sums over tag paths."""
        e, both, memory = self.emissions(c, True)
        n, t, _ = e.shape
        trans, rows = self.p["T"], np.arange(n)
        fw, bw = np.zeros_like(e), np.zeros_like(e)
        fw[:, 0] = e[:, 0]

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        for i in range(1, t):
            fw[:, i] = e[:, i] + total(fw[:, i - 1, :, None] + trans, 1)
        for i in range(t - 2, -1, -1):
            bw[:, i] = total(trans + (e[:, i + 1] + bw[:, i + 1])[:, None, :], 2)
        z = total(fw[:, -1], 1)
        ge = np.exp(fw + bw - z[:, None, None])
        pair = np.exp(fw[:, :-1, :, None] + trans + (e[:, 1:] + bw[:, 1:])[:, :, None, :] - z[:, None, None, None])
        gt = pair.sum(axis=(0, 1)) - np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gold = e[rows[:, None], np.arange(t), y].sum(axis=1) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        ge[rows[:, None], np.arange(t), y] -= 1
        grads = {"T": gt, "O": both.reshape(n * t, -1).T @ ge.reshape(n * t, -1), "o": ge.sum(axis=(0, 1)), "E": np.zeros_like(self.p["E"])}
        np.add.at(grads["E"], c, self.back(ge @ self.p["O"].T, memory, grads))
        return float((z - gold).mean()), {k: v / n for k, v in grads.items()}

    def train(self, c: np.ndarray, y: np.ndarray, *, epochs: int = 12, batch: int = 128, rate: float = 0.02, seed: int = 5) -> list[float]:
        rng, m, v, k, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(epochs):
            order, loss = rng.permutation(len(c)), []
            for at in range(0, len(c), batch):
                pick = order[at : at + batch]
                one, grads = self.step(c[pick], y[pick])
                loss.append(one)
                k += 1
                norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
                for name, g in grads.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g**2
                    self.p[name] -= rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)
            losses.append(float(np.mean(loss)))
        return losses

    def decode(self, c: np.ndarray) -> np.ndarray:
        """The best tag path of each window."""
        e = self.emissions(c)
        n, t, _ = e.shape
        score, back = e[:, 0], np.zeros((n, t, TAGS), np.int8)
        for i in range(1, t):
            all_ = score[:, :, None] + self.p["T"]
            back[:, i] = all_.argmax(axis=1)
            score = all_.max(axis=1) + e[:, i]
        out = np.zeros((n, t), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(n), i, out[:, i]]
        return out


_LABEL = r"[A-Za-z0-9-]++"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)"
#: Where plausible() can accept a span: an address around any of its at signs, numbers with three dots, and runs without
#: letters that hold the eight digits of a phone number.
AT = re.compile(r"@|\(at\)|\[at\]|(?<=\s)at(?=\s)")
HOST = re.compile(rf"\s{{0,2}}{_LABEL}(?:{_DOT}{_LABEL})+")
QUAD = re.compile(r"(?<!\d)\d++(?:(?:\.|\[\.\]|\(\.\))\d++){3,}")
NUMBERS = re.compile(r"(?<![^A-Za-z])[^A-Za-z0-9]*+[0-9](?:[^A-Za-z0-9]*+[0-9]){7}[^A-Za-z]*+")


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges that cover every span plausible() can accept, the space around it and one more character on either side.

    Where a span starts and ends depends on the tags of its characters and of their neighbours alone, so outside of
    these ranges no tag can change what is found.
    """
    found = []
    for m in AT.finditer(text):
        if host := HOST.match(text, m.end()):
            start = m.start()
            while start > max(0, m.start() - 2) and text[start - 1].isspace():
                start -= 1
            least = max(0, start - 64)
            while start > least and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            found.append((start, host.end()))
    found += [m.span() for m in QUAD.finditer(text)]
    if DIGIT.search(text):
        found += [m.span() for m in NUMBERS.finditer(text)]
    out = []
    for a, b in found:
        while a > 0 and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        out.append((max(0, a - 1), min(len(text), b + 1)))
    return out


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and codes of the text's overlapping windows that hold a digit or @ or touch one of its regions."""
    c = codes(text)
    starts = np.arange(0, max(1, len(c) - WINDOW + STRIDE), STRIDE)
    ends = np.minimum(starts + WINDOW, len(c))
    signs = np.concatenate([[0], np.cumsum((c == 3) | (c == 7))])
    wanted = signs[ends] > signs[starts]
    for a, b in regions(text):
        wanted |= (starts < b) & (ends > a)
    starts = starts[wanted]
    padded = np.concatenate([c, np.zeros(WINDOW, np.uint8)])
    return starts, padded[starts[:, None] + np.arange(WINDOW)]


def reconcile(n: int, starts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One tag for each of n characters: from the window where it lies farthest from an edge."""
    out, best = np.zeros(n, np.int64), np.full(n, -1)
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for s, row in zip(starts.tolist(), tags, strict=True):
        e = min(n, s + WINDOW)
        d = depth[: e - s].copy()
        if s == 0:
            d[: WINDOW // 2] = WINDOW
        better = d > best[s:e]
        out[s:e][better], best[s:e][better] = row[: e - s][better], d[better]
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    edges = np.flatnonzero(tags)
    while len(edges := edges[edges >= at]):
        start = int(edges[0])
        kind = (tags[start] - 1) // 2
        end = start + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((KINDS[kind], start, end))
        at = end
    return out


def plausible(kind: str, value: str) -> bool:
    """What any value of the kind must satisfy, whoever found it."""
    d = only_digits(value)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]{2,64}\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)[A-Za-z0-9-]+)+", value))
    if kind == "ip":
        parts = re.split(r"\.|\[\.\]|\(\.\)", value)
        return len(parts) == 4 and all(p.isdecimal() and int(p[:4]) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and not re.search("[A-Za-z]", value)
    return 8 <= len(d) <= 15 and not re.search(r"[A-Za-z]|\d{9}", value) and len(re.findall(r"\d+", value)) >= 3


#: Notations of an address: what stands for the at sign and for the dot.
SIGNS = (("@", "."), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" at ", "."))


def address(rng: np.random.Generator, at: str, dot: str) -> str:
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    local = word() + pick("", "", f"{pick('.', '_', '-')}{word()}", str(rng.integers(0, 100)))
    host = word() + pick("", "", f"-{word()}", f"{dot}{word()}")
    return f"{local}{at}{host}{dot}{pick('com', 'org', 'net', 'de', 'io', 'edu')}"


def rewritten(rng: np.random.Generator) -> tuple[str, str | None]:
    """A value in some notation, with its kind; None: a number or phrase that is no personal data."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    case = rng.integers(0, 12)
    if case < 2:
        sep = pick("-", " ", ".")
        return pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}{sep}{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}"), "phone"
    if case < 6:
        return address(rng, *pick(*SIGNS)), "email"
    if case < 7:
        return pick(".", "[.]", "(.)").join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if case < 8:
        return pick("", " ", "-", ".", "/").join(num(4) for _ in range(4)), "card"
    return pick(
        num(rng.integers(1, 7)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}",
        f"{num(1)}.{num(1)}", "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 32)), f"token={num(6)}ab{num(3)}", f"#{num(5)}", f"{num(2)}%", f"{word()}{num(2)}{word()}",
        f"{word()} at {word()}", f"{word()} at {word()}. {word()}", f"{word()} {pick('of', 'in', 'dot', 'was')} {word()} {word()}", f"{word()} ({word()}) {word()}",
    ), None


def training_set(texts: list[str], size: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """size windows with tags: real windows around the patterns' spans, and rewritten values set into real text."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["lorem ipsum dolor sit amet " * 5]
    c, y = np.zeros((size, WINDOW), np.int64), np.zeros((size, WINDOW), np.int64)
    real = [(t, k, a, b) for t in texts for k, a, b in base_spans(t) if b - a < WINDOW - 8]
    for row in range(size):
        if real and rng.random() < 0.4:
            t, _, a, b = real[rng.integers(len(real))]
            start = max(0, a - int(rng.integers(0, WINDOW - (b - a))))
            part = t[start : start + WINDOW]
            marks = [(k, s - start, e - start) for k, s, e in base_spans(t[max(0, start - 200) : start + 300]) for s, e in [(s + max(0, start - 200), e + max(0, start - 200))] if e > start and s < start + WINDOW]
        else:
            t = texts[rng.integers(len(texts))]
            at = int(rng.integers(0, max(1, len(t) - WINDOW)))
            value, kind = rewritten(rng)
            lead = int(rng.integers(0, WINDOW - min(len(value), WINDOW - 4)))
            head, tail = t[at : at + lead], t[at + lead : at + WINDOW]
            head = head[:-1] + " " if head else head
            part = (head + value + " " + tail)[:WINDOW]
            marks = [(kind, len(head), len(head) + len(value))] if kind else []
        row_codes = codes(part)
        c[row, : len(row_codes)] = row_codes
        for k, s, e in marks:
            i = KINDS.index(k)
            y[row, max(0, s) : max(0, e)] = 2 + 2 * i
            if s >= 0:
                y[row, s] = 1 + 2 * i
    return c, y


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, size: int = 3072, **options) -> Tagger:
    """A tagger trained on at most `sample` documents, those with the least hash of their id: from each, 4,000 characters at a place its hash picks."""
    ids = docs.select(docs[id_col].alias("_i")).where("_i is not null").distinct().orderBy(F.xxhash64("_i", F.lit(17)), "_i").limit(sample)
    text = docs[text_col]
    place = 1 + F.pmod(F.xxhash64(docs[id_col], F.lit(18)), F.greatest(F.lit(1), F.length(text) - 4000))
    rows = docs.join(F.broadcast(ids), docs[id_col] == ids["_i"]).select(F.substr(text, place.cast("int"), F.lit(4000)).alias("t"), "_i").orderBy(F.xxhash64("_i", F.lit(17)), "_i", "t").limit(sample).collect()
    tagger = Tagger()
    tagger.train(*training_set([r.t for r in rows], size), **options)
    return tagger


def model_spans(texts: list[str], tagger: Tagger, batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """What the network marks in each text, checked for plausibility."""
    found = [windows(t) if DIGIT.search(t) or "@" in t or regions(t) else (np.zeros(0, np.int64), np.zeros((0, WINDOW), np.uint8)) for t in texts]
    flat = np.concatenate([c for _, c in found]) if found else np.zeros((0, WINDOW), np.uint8)
    tags = np.zeros(flat.shape, np.int8)
    for at in range(0, len(flat), batch):
        tags[at : at + batch] = tagger.decode(flat[at : at + batch])
    out, at = [], 0
    for text, (starts, _) in zip(texts, found, strict=True):
        spans = []
        if len(starts):
            for k, a, b in spans_of(reconcile(len(text), starts, tags[at : at + len(starts)])):
                while b > a and text[b - 1].isspace():
                    b -= 1
                while a < b and text[a].isspace():
                    a += 1
                if plausible(k, text[a:b]):
                    spans.append((k, a, b))
        at += len(starts)
        out.append(spans)
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Base spans, then the network's own that touch none of them; by kind, then start."""
    out = []
    for text, more in zip(texts, model_spans(texts, tagger), strict=True):
        base = base_spans(text)
        new = [(f"model-{k}", a, b) for k, a, b in clear_of(more, base)]
        out.append(sorted(base + new, key=lambda s: (ORDER[s[0]], s[1])))
    return out


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None, **options) -> DataFrame:
    """Per row: doc_id, spans (array of kind, start, end, value), code points, end exclusive, by kind and start.

    Null and empty texts have no spans. Repeated rows give equal rows; null ids are read, never learnt from; an empty
    table gives an empty one; other columns are ignored.
    """
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    tagger = tagger or fit(docs, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Tagger()
        model.p = shared.value
        for whole in parts:
            for part in slices(whole):
                texts = [t or "" for t in part["_text"]]
                spans = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in s] for t, s in zip(texts, all_spans(texts, model), strict=True)]
                yield pd.DataFrame({"doc_id": part["_id"].values, "spans": spans})

    schema = f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>"
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInPandas(work, schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by the name of its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.removeprefix('model-').upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with personal data in text masked and n_chars, where present, counted anew.

    Null texts stay null, empty ones empty; repeated rows change alike, rows without an id too; an empty table gives an
    empty one.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options).p)

    def column(text: Column) -> Column:
        @F.pandas_udf("string")
        def work(texts: pd.Series) -> pd.Series:
            model, out = Tagger(), []
            model.p = shared.value
            for part in slices(texts.to_frame("_text")):
                plain = [t or "" for t in part["_text"]]
                out += [None if t is None else mask(t, s) for t, s in zip(part["_text"], all_spans(plain, model), strict=True)]
            return pd.Series(out, dtype=object)

        return work(text)

    out = docs.withColumn("text", column(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
