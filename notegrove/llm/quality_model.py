"""A quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a text; ridge scores come from
normal equations that each partition sums for itself; isotonic regression on held-out rows turns scores into
probabilities. Only sums and bin counts of fixed size reach the driver, and scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrove.llm._shared import fresh_name, written

#: Labelled rows the classifier is fitted on, at most (a bounded sample by hash of doc_id), and the share held out of it.
MAX_LABELS, HELD_OUT = 100_000, 0.25
FEATURES, BANDWIDTH, RIDGE, SEED = 128, 2.0, 1.0, 7
#: Documents stay from this calibrated probability.
THRESHOLD = 0.5
BINS = 2000
STATS = ("log_bytes", "word_bytes", "upper", "lower", "digit", "space", "newline", "exclaim", "symbol", "pipe", "comma_stop", "foreign", "distinct", "top_word", "repeat_pair", "mark_words")
_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": (_BYTES == 32) | (_BYTES == 9),
    "newline": _BYTES == 10,
    "exclaim": (_BYTES == 33) | (_BYTES == 63),
    "symbol": np.isin(_BYTES, list(b"#$%&*+<=>@\\^_`{}~[]/")),
    "pipe": _BYTES == 124,
    "comma_stop": np.isin(_BYTES, list(b",.;:")),
    "foreign": _BYTES >= 128,
}
_CLASSES = np.array([_CLASS[c] for c in STATS[2:12]], np.float64)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, in the order of STATS; zeros for a null or empty one."""
    out = np.zeros(len(STATS))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    out[0] = np.log1p(len(raw))
    out[1] = min(len(raw) / (len(words) or 1), 100) / 10
    out[2:12] = np.sqrt(_CLASSES @ np.bincount(raw, minlength=256) / len(raw))
    if words:
        counts = Counter(words)
        out[12] = len(counts) / len(words)
        out[13] = max(counts.values()) / len(words)
        out[14] = sum(map(str.__eq__, words, words[1:])) / len(words)
        out[15] = sum(not w[-1].isalnum() for w in words) / len(words)
    return out


def _table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATS))


@dataclass(frozen=True)
class Model:
    """All that scoring needs: a few thousand numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return lift(stats, self.mean, self.scale) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[np.clip(np.searchsorted(self.steps, self.score(stats), "right") - 1, 0, len(self.levels) - 1)]


def lift(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED) -> np.ndarray:
    """Random Fourier features and a constant; the projection follows from the seed alone."""
    rng = np.random.default_rng(seed)
    turn = rng.normal(0, 1 / (bandwidth * np.sqrt(stats.shape[1])), (stats.shape[1], features))
    phase = rng.uniform(0, 2 * np.pi, features)
    waves = np.sqrt(2 / features) * np.cos(np.clip((stats - mean) / scale, -8, 8) @ turn + phase)
    return np.hstack([waves, np.ones((len(stats), 1))])


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares."""
    stack: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            stack.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in stack]) if stack else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, held_out: float = HELD_OUT, ridge: float = RIDGE) -> Model | None:
    """A model from labels (doc_id, quality); None where no document has a label of both kinds among them.

    Labels with a null doc_id or quality are left out; repeated and contradictory ones count each. The sample of at
    most about max_labels rows is a threshold on a hash of doc_id and is broadcast: its size is bounded by that.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("good"))
    share = min(1.0, max_labels / (known.count() or 1))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = F.broadcast(known.filter(hashed < int(share * 1_000_000)))

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_table(texts)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("good", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10_000)) < int(held_out * 10_000)).alias("held"), stats("text").alias("x"))
    rows = written(rows, "quality")
    tell = rows.groupBy().agg(F.min("good"), F.max("good"), *(f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(len(STATS)))).first()
    if tell[0] is None or tell[0] == tell[1]:
        return None
    mean, scale = np.array(tell[2 : 2 + len(STATS)], float), np.maximum(np.array(tell[2 + len(STATS) :], float), 1e-3)
    above = np.triu_indices(FEATURES + 2)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for frame in frames:
            if len(frame):
                z = np.hstack([lift(np.stack(frame["x"]), mean, scale), frame[["good"]].to_numpy(float)])
                total += z.T @ z
        yield pd.DataFrame({"cell": np.arange(len(above[0])), "v": total[above]})

    cells = rows.filter("NOT held").select("x", "good").mapInPandas(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((FEATURES + 2, FEATURES + 2))
    gram[above[0][cells["cell"]], above[1][cells["cell"]]] = cells["v"]
    gram += np.triu(gram, 1).T
    penalty = ridge * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram[:-1, :-1] + penalty, gram[:-1, -1])

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                score = lift(np.stack(frame["x"]), mean, scale) @ weights
                yield pd.DataFrame({"bin": np.clip(((score + 1) / 3 * BINS).astype(int), 0, BINS - 1), "good": frame["good"]})

    held = rows.filter("held").select("x", "good").mapInPandas(bins, "bin int, good int").groupBy("bin").agg(F.avg("good").alias("p"), F.count("*").alias("n")).toPandas().sort_values("bin")
    if held.empty:
        return Model(mean, scale, weights, np.array([-np.inf, THRESHOLD]), np.array([0.0, 1.0]))
    return Model(mean, scale, weights, held["bin"].to_numpy() * 3 / BINS - 1, pool_adjacent(held["p"].to_numpy(), held["n"].to_numpy()))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with one more column `quality_p`, or `quality_p_` where taken: the probability that a text is good.

    Null without a model. Null and empty texts are scored as texts whose statistics are all zero. Each row is scored
    by itself, so ties and repeated rows make no difference; an empty table stays empty.
    """
    name = fresh_name(docs, "quality_p")
    if model is None:
        return docs.withColumn(name, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def p(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(_table(texts)) if len(texts) else np.zeros(0))

    return docs.withColumn(name, p(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """(doc_id, quality_p, keep) for every row of docs; without a model everything is kept."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, **settings))
    return rows.select("doc_id", "quality_p", F.coalesce(F.col("quality_p") >= threshold, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows that quality_scores keeps, with the columns they had."""
    name = fresh_name(docs, "quality_p")
    return scored(docs, fit(docs, labels, **settings)).filter(F.coalesce(F.col(name) >= threshold, F.lit(True))).drop(name)
