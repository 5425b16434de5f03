"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its own normal equations; the sums have a fixed number
of cells, whatever the input. Scores of further training rows are binned, and the bins' pooled means calibrate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, stage

STATS = ("lower", "upper", "digit", "space", "mark", "symbol", "wide", "log_bytes", "log_words", "word_length", "distinct_words", "upper_words", "top_word", "ends_symbol", "bars", "shouts", "line_length", "distinct_lines", "sentences", "log_longest")
#: Keys of rejected texts up to this many (8 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 2_000_000
MARKS = b".,;:'\"?-()"
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[list(MARKS)] = 4
_CLASS[128:] = 6
SYMBOL_END = re.compile(r"(?<![^\w\s.,;:'\"?()-])[^\w\s.,;:'\"?()-]++(?=\s|$)")


def statistics(text: str | None) -> list[float]:
    """The numbers of STATS for a whole text; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=7) / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = set(words)
    longest = max(map(len, words), default=0)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        *share.tolist(), np.log1p(len(raw)), np.log1p(n), len(text) / n, len(kinds) / n, upper / n, max(counts.values(), default=0) / n,
        len(SYMBOL_END.findall(text)) / n, text.count("|") / n, text.count("!!") / n, np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), sum(text.count(c) for c in ".?!") / n, np.log1p(longest),
    ]


def document_stats(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(x) for x in texts], dtype=object)

    return stats(text)


@dataclass
class Model:
    """Standardisation, Fourier directions, ridge weights and the calibration's knots; all of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Whole numbers, so that sums of products are exact and don't depend on their order."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases)
        return np.rint(np.hstack([np.full((len(z), 1), 64.0), z * 16, waves * 64]))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if self.weights is not None else np.full(len(stats), 0.5)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, 0 to 1; a thousandth of the raw score keeps the order within a pooled block."""
        raw = self.raw(stats)
        if self.knots is None:
            return np.clip(raw, 0, 1)
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centre and mean of each block."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    done = np.array(blocks)
    return done[:, 0] / done[:, 2], (done[:, 1] + 0.5) / (done[:, 2] + 1)


def normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over train (stats, y): each partition sums its rows, Spark sums the cells."""
    d = model.features(np.zeros((1, len(STATS)))).shape[1]
    upper = np.triu_indices(d + 1)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d + 1, d + 1), np.int64)
        for part in parts:
            if len(part):
                f = np.hstack([model.features(np.stack(part["stats"])), np.rint(part["y"].to_numpy()[:, None] * 64)])
                total += np.rint(f.T @ f).astype(np.int64)
        cells = total[upper]
        yield pd.DataFrame({"cell": np.arange(len(cells)), "v": cells})

    sums = train.mapInPandas(work, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((d + 1, d + 1))
    flat = np.zeros(len(upper[0]))
    flat[sums["cell"].to_numpy()] = sums["v"].to_numpy()
    full[upper] = flat
    full += np.triu(full, 1).T
    return full[:d, :d], full[:d, d] / 64


def fit(stats: DataFrame, labels: DataFrame, *, label: str = "quality", waves: int = 128, ridge: float = 1e-3, bins: int = 512, seed: int = 7) -> Model:
    """stats: doc_id, stats. Learns from labels of rows whose fold is not 1: fold 0 fits the ridge, fold 2 calibrates.

    Without labels of both classes every score is 0.5. A document labelled twice counts with its mean label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = known.withColumn("fold", fold(F.col("doc_id"), 3)).where("fold <> 1")
    train = stage(stats.where("doc_id is not null").join(known, "doc_id"), "quality-train")
    columns = [F.col("stats")[i] for i in range(len(STATS))]
    moments = train.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns], F.min("y"), F.max("y")).first()
    rng = np.random.default_rng(seed)
    gamma = 1 / len(STATS)
    directions = rng.normal(0, np.sqrt(2 * gamma), (len(STATS), waves))
    phases = rng.uniform(0, 2 * np.pi, waves)
    if moments[-1] is None or moments[-1] == moments[-2]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), directions, phases)
    rounded = np.array([float(f"{v:.6g}") for v in moments[:-2]])
    model = Model(rounded[: len(STATS)], np.maximum(rounded[len(STATS) :], 1e-6), directions, phases)
    left, right = normal_equations(train.where("fold = 0"), model)
    penalty = ridge * np.trace(left) / len(left) * np.eye(len(left))
    model.weights = np.linalg.solve(left + penalty + 1e-9 * np.eye(len(left)), right)

    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                raw = model.raw(np.stack(part["stats"]))
                yield pd.DataFrame({"bin": np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(int), "y": part["y"]})

    held = train.where("fold = 2").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(held) > 1:
        model.knots = isotonic((held["bin"].to_numpy() + 0.5) / bins * 2 - 0.5, held["y"].to_numpy(), held["n"].to_numpy(dtype=float))
    return model


def score_column(model: Model, stats: Column) -> Column:
    @F.pandas_udf("double")
    def scored(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(s)) if len(s) else [], dtype="float64")

    return scored(stats)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out (fold 1 of 3), score (0 to 1), predicted.

    Null and empty texts are scored as texts without any character. Repeated rows get equal scores; null ids are scored
    and never learnt from; an empty table gives an empty one. Only the text enters a score.
    """
    stats = stage(docs.select(docs[id_col].alias("doc_id"), document_stats(docs[text_col]).alias("stats")), "quality-stats")
    model = fit(stats, labels, **options)
    scored = stats.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score_column(model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """Rows of docs (doc_id, text and others), all columns, whose score is at least `least`; fitted on docs and labels.

    Statistics are computed once for each different text and meet the rows again by the text's hash. Null and empty
    texts are scored as texts without any character; repeated rows stay or go together; an empty table gives an empty one.
    """
    key = F.xxhash64("text", F.length("text"))
    stats = stage(docs.select("doc_id", key.alias("_key"), document_stats(docs["text"]).alias("stats")), "quality-stats")
    model = fit(stats, labels, **options)
    dropped = stage(stats.where(score_column(model, F.col("stats")) < least).select("_key").distinct(), "quality-dropped")
    few = dropped.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(dropped) if few else dropped, key == dropped["_key"], "left_anti")
