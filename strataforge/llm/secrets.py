"""Secret scans: fixed patterns, and guess-cost dynamic programming on values in a credential's context.

The guess cost of a value is the least sum, over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force runs, of each piece's log10 number of guesses. A value that no cheap cut explains was made by a machine or
a careful person: it is a secret. One that a cheap cut explains is a placeholder.

Words are a short list of those that people put into passwords, and the commonest words of the documents themselves;
each is priced by its rank in its list, the lower price counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, small_batches, sorted_chunks, stage, unstage

# The three base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Where a credential's value stands, beyond the base patterns.
CONTEXT = re.compile(
    r"""(?ai:(?<![a-z0-9])(?:pwd|pass|pass[ _-]?phrase|pass[ _-]?code|pin|credentials?|auth(?:orization)?|bearer|private[ _-]?key|access[ _-]?key|client[ _-]?secret|signing[ _-]?key|login|passw(?:or)?d|secret|token)(?![a-z0-9]))["']?(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20(?:is|was)\x20)["'`]?([^\x00-\x20"'`<>,;]{8,})"""
)

# Words that people put into passwords, commonest first.
WORDS = (
    "password passwd pass admin root user login welcome letmein secret token default changeme change master monkey dragon shadow sunshine princess football baseball "
    "qwerty abc love iloveyou trustno superman batman test testing guest demo sample example dummy placeholder your mykey key api value string none null true false "
    "hello summer winter spring autumn monday friday january february march april may june july august september october november december "
    "access server system service network database backup temp hunter soccer hockey killer jordan michael charlie freedom whatever ninja cookie pepper ginger cheese banana orange "
    "purple silver golden diamond flower butterfly angel lucky star moon sun fire water earth magic power house office home work money"
).split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
STEP = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
LEET = str.maketrans("@4310$57!", "aaeiosstl")
DATE = re.compile(r"(?:19|20)\d\d(?:[-./_]?(?:0[1-9]|1[0-2])(?:[-./_]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:(?:19|20)?\d\d)", re.ASCII)


def brute(value: str) -> list[float]:
    """log10 of the guesses for each character alone, by its class."""
    size = {"d": 10, "l": 26, "u": 26, "o": 33}
    kind = lambda c: "d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "o"
    hexa = all(c in "0123456789abcdef" for c in value) or all(c in "0123456789ABCDEF" for c in value)
    hexa = hexa and not value.isdigit()
    return [math.log10(16 if hexa else size[kind(c)]) for c in value]


#: A word of the documents: letters alone between white space, quotes, brackets and marks, so that no part of a key is one.
PLAIN_WORD = r"(?<![^\s\"'(\[])\p{L}{3,24}(?![^\s.,;:!?)\]\"'])"
LONGEST = 24


def common_words(docs: DataFrame, text_col: str = "text", most: int = 1 << 16) -> list[str]:
    """The words that most texts hold, commonest first, ties in alphabetical order; at most `most` of at most LONGEST letters.

    All texts are counted whole, a word once a text, values in a credential's context apart. A word that only copies of one
    text hold is none: it may be a secret that was copied with it (texts are told apart by 15 bits of a hash here). Null and
    empty texts hold no word.
    """
    text = F.regexp_replace("_text", CONTEXT.pattern.replace("(?ai:", "(?i:"), " ")
    rows = docs.select(docs[text_col].alias("_text")).select(F.pmod(F.xxhash64("_text"), F.lit(1 << 15)).cast("short").alias("h"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD), 0))).alias("word"))
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("texts"), F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    counted = stage(counted.select("word", (-F.col("texts")).alias("rank")), "words")
    chunks = sorted_chunks(counted, ["rank", "word"], "words-sorted")
    first, left = F.lit(True), most  # a limit would send so many words of every task to the driver
    for chunk, size in sorted(map(tuple, chunks.groupBy("_chunk").count().collect())):
        if size >= left:
            first = (F.col("_chunk") < chunk) | ((F.col("_chunk") == chunk) & (F.col("_pos") < left))
            break
        left -= size
    words = [r.word for r in chunks.where(first).sort("rank", "word").collect()]
    unstage(counted, chunks)
    return words


def ranked(words: list[str]) -> dict[str, float]:
    """Word to price: log10 of its rank, counted from 2, in the built-in list or in words, whichever is less."""
    out = dict(RANK)
    for i, w in enumerate(words):
        out[w] = min(math.log10(i + 2), out.get(w, math.inf))
    return out


def pieces(value: str, rank: dict[str, float] = RANK) -> dict[int, list[tuple[int, float]]]:
    """By end: (start, log10 guesses) of every word and date."""
    found: dict[int, list[tuple[int, float]]] = {}
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for text, extra in ((low, 0.0), (plain, 0.6)) if plain != low else ((low, 0.0),):
        for i in range(n):
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                if (price := rank.get(text[i:j])) is not None:
                    found.setdefault(j, []).append((i, price + extra + (0.3 if value[i:j] != low[i:j] else 0)))
    for i in range(n):
        if "0" <= value[i] <= "3":
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    found.setdefault(j, []).append((i, math.log10(366 * 120) if j - i > 4 else math.log10(120)))
    return found


def stretches(value: str) -> list[tuple[int, int, int, float]]:
    """(start, end, least length, base cost) of the longest stretches that are a keyboard walk or repeat with a period.

    Each part of one that is long enough is a piece and costs the base and log10 of its length. A period of 16 at most
    is looked for; a stretch that also repeats with a divisor of its period is given once, as the divisor's.
    """
    out, n, low = [], len(value), value.lower()
    i = 0
    while i < n:
        j = i + 1
        while j < n and (low[j - 1], low[j]) in STEP:
            j += 1
        if j - i >= 3:
            out.append((i, j, 3, math.log10(90)))
        i = j - 1 if j - i > 1 else j
    found: set[tuple[int, int, int]] = set()
    for period in range(1, min(n // 2, 16) + 1):
        i = period
        while i < n:
            j = i
            while j < n and value[j] == value[j - period]:
                j += 1
            if j - i >= period and j - i + period >= 3 and not any(period % p == 0 and (p, i - period, j) in found for p in range(1, period)):
                found.add((period, i - period, j))
                out.append((i - period, j, max(2 * period, 3), min(period, 8) * math.log10(36)))
            i = j + 1
    return out


class Stretch:
    """The best start of a piece that ends at a place of a stretch, for places in order.

    A later start wins for a while at most: its piece is shorter, and that tells less and less as pieces grow. So starts
    are a stack, each with the place at which the one below it takes over, and every start and end is weighed.
    """

    def __init__(self, start: int, end: int, least: int, base: float):
        self.start, self.end, self.least, self.base = start, end, least, base
        self.stack: list[tuple[int, float, float]] = []

    def at(self, e: int, best: list[float]) -> float:
        """Least cost of all that ends with a piece of this stretch at e; starts up to e - least are known by now."""
        if (s := e - self.least) >= self.start:
            self.offer(s, best[s], e)
        while self.stack and e >= self.stack[-1][2]:
            self.stack.pop()
        if not self.stack:
            return math.inf
        s, cost, _ = self.stack[-1]
        return cost + self.base + math.log10(e - s)

    def offer(self, s: int, cost: float, e: int) -> None:
        while self.stack and e >= self.stack[-1][2]:
            self.stack.pop()
        until = math.inf
        if self.stack and cost + math.log10(e - s) >= self.stack[-1][1] + math.log10(e - self.stack[-1][0]):
            return
        while self.stack:
            before, known, gives_way = self.stack[-1]
            ratio = 10 ** min(cost - known, 300)
            until = (ratio * s - before) / (ratio - 1) if ratio > 1 else math.inf
            if until < gives_way:
                break
            self.stack.pop()  # it would give way before its turn comes
            until = math.inf
        self.stack.append((s, cost, until))


def guess_cost(value: str, rank: dict[str, float] = RANK) -> float:
    """Least log10 number of guesses over all cuts; 0 for the empty value. rank: the prices of words."""
    singles, ends = brute(value), pieces(value, rank)
    waiting = sorted(stretches(value), reverse=True)
    open_now: list[Stretch] = []
    best = [0.0]
    for j in range(1, len(value) + 1):
        while waiting and waiting[-1][0] < j:
            open_now.append(Stretch(*waiting.pop()))
        open_now = [s for s in open_now if s.end >= j]
        best.append(min([best[j - 1] + singles[j - 1], *(best[i] + cost for i, cost in ends.get(j, [])), *(s.at(j, best) for s in open_now)]))
    return best[-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX_RUN.finditer(text)]


def guess_spans(text: str, least: float, taken: list[tuple[str, int, int]], rank: dict[str, float] = RANK) -> list[tuple[str, int, int]]:
    """Values in a credential's context that cost 10**least guesses or more and that no other span touches."""
    found = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".)]}":
            b -= 1
        if b - a >= 8:
            found.append(("guess", a, b))
    return [s for s in clear_of(found, taken) if guess_cost(text[s[1] : s[2]], rank) >= least]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 9.0, words: int = 1 << 16) -> DataFrame:
    """Per row: doc_id, spans (array of kind, start, end, text, and log10 guesses), code points, end exclusive.

    words bounds the list that is learnt from the documents and sent to all tasks (24 letters a word at most); 0: none.

    Null and empty texts have no spans. Repeated rows give equal rows; an empty table an empty one; other columns are
    ignored.
    """
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,value:string,cost:double>>"

    learnt = docs.sparkSession.sparkContext.broadcast(ranked(common_words(docs, text_col, words) if words else []))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = learnt.value
        for part in parts:
            column = []
            for text in part["_text"]:
                text = text or ""
                spans = base_spans(text)
                spans = sorted(spans + guess_spans(text, least, spans, rank), key=lambda s: (s[1], KINDS.index(s[0])))
                row = []
                for k, a, b in spans:
                    value = ASSIGN.match(text, a)[2] if k == "assign" else text[a:b]
                    row.append({"kind": k, "start": a, "end": b, "value": text[a:b], "cost": guess_cost(value, rank)})
                column.append(row)
            yield pd.DataFrame({"doc_id": part["_id"], "spans": column})

    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInPandas(work, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
