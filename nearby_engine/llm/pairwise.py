"""Quality by pairwise ranking: a Bradley-Terry model over text features.

A good and a bad document make a preference pair. The model says that the first is preferred with probability
sigmoid(s(a) - s(b)), with s linear in features of the text, so logistic loss on feature differences teaches the weights; a
bias would cancel. Scores so learned have no zero of their own: the threshold is a quantile of the scores of all documents,
the share of bad ones among the labelled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from nearby_engine.llm.storage import stored

#: A score at the quantile becomes this.
THRESHOLD = 0.3
#: Steps of one unit of raw score in the histogram that gives the quantile, and the largest raw score told apart.
STEPS, MOST_RAW = 512, 64.0

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = bytes(range(0x30, 0x3A))
_STOPS = b".,;:?'\"-()"
_SYMBOLS = bytes(c for c in range(0x21, 0x7F) if c not in _UPPER + _LOWER + _DIGITS + _STOPS)
_SPACE = b" \t\n\r\x0b\x0c"
#: Names of what ``measures`` gives, in order.
MEASURES = (
    "log_words", "upper", "lower", "digits", "stops", "symbols", "space", "other", "distinct", "top_word", "repeats",
    "word_length", "longest_word", "no_letter", "ends_in_symbol", "same_lines", "sentences", "short_words",
)


def measures(text: str | None) -> list[float]:
    """Shares and sizes of a whole text; all 0 for one without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(MEASURES)
    size, n = len(data), len(words)
    share = lambda chars: (size - len(data.translate(None, chars))) / size
    upper, lower, digits, stops, symbols, space = map(share, (_UPPER, _LOWER, _DIGITS, _STOPS, _SYMBOLS, _SPACE))
    counts = Counter(words)
    sizes = list(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        math.log1p(n), upper, lower, digits, stops, symbols, space, 1 - upper - lower - digits - stops - symbols - space,
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(sizes) / n, math.log1p(max(sizes)),
        sum(c for w, c in counts.items() if not w.translate(None, _SYMBOLS + _STOPS + _DIGITS)) / n,
        sum(c for w, c in counts.items() if w[-1] in _SYMBOLS) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(data.count(b". ") + data.count(b".\n") + 1) - math.log1p(n),
        sum(c for w, c in counts.items() if len(w) < 4) / n,
    ]


@dataclass
class Ranker:
    """Means and scales of the measures, weights of the measures and of their squares, and the share of bad documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bad_share: float

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.hstack([x, np.minimum(x * x, 9) - 1])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, -MOST_RAW, MOST_RAW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def preference_pairs(good: np.ndarray, opponents: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of preferred rows and of the rows they are preferred to. Every row of the rarer label meets ``opponents`` rows
    for each row of the other label that falls to it, so both labels are used whole and pairs grow with the rows."""
    first, second = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(first) or not len(second):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    draw = np.random.default_rng(seed)
    n = max(len(first), len(second))
    deal = lambda rows: np.concatenate([np.resize(draw.permutation(rows), n) for _ in range(opponents)])
    return deal(first), deal(second)


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Weights of least logistic loss on feature differences, by Newton steps; without pairs all are 0."""
    w = np.zeros(x.shape[1])
    if not len(better):
        return w
    d = x[better] - x[worse]
    for _ in range(40):
        p = _sigmoid(d @ w)
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + pull * np.eye(len(w)), d.T @ (p - 1) + pull * w)
        # A whole Newton step may overshoot where the pairs are nearly all decided.
        w = w - step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return w


# --- Spark -------------------------------------------------------------------------------------------------------------


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of remainder 0 are held out. A null id reads as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the measures of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([measures(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], rows], names=[*keep, "measures"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["measures array<double>"]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, opponents: int = 6) -> Ranker:
    """A ranker from at most ``most_rows`` labelled documents that are not held out, the first by hash of the id.

    A label counts once per id, the larger where they differ; an id with several texts gives a row for each. Null ids and
    labels teach nothing. Without both labels all weights are 0 and every document gets the same score.
    """
    taught = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .where(fold_of(F.col("doc_id")) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    # Bounded by most_rows, so it may be broadcast; bounded again after the join, because ids may repeat.
    texts = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")
    rows = measured(texts, ["doc_id", "quality"]).orderBy(F.xxhash64("doc_id"), "doc_id", "measures").limit(most_rows).collect()
    y = np.array([r["quality"] for r in rows], dtype=int) > 0
    m = np.array([r["measures"] for r in rows], dtype=float).reshape(-1, len(MEASURES))
    if not y.any() or y.all():
        return Ranker(np.zeros(len(MEASURES)), np.ones(len(MEASURES)), np.zeros(2 * len(MEASURES)), 0.0)
    spread = m.std(axis=0)
    ranker = Ranker(m.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * len(MEASURES)), float((~y).mean()))
    better, worse = preference_pairs(y, opponents)
    ranker.weights = fit_pairs(ranker.features(m), better, worse)
    return ranker


def quantile(raws: DataFrame, share: float) -> float:
    """The raw score that ``share`` of all rows stay under, from counts per step of the score: exact to one step, the same in
    every run, and of bounded size however many rows there are."""
    steps = raws.groupBy(F.floor(F.col("raw") * STEPS).alias("step")).agg(F.count("*").alias("n")).collect()
    total, below = sum(r["n"] for r in steps), 0
    for r in sorted(steps):
        if below + r["n"] > share * total:
            return r["step"] / STEPS
        below += r["n"]
    return 0.0


def score(docs: DataFrame, ranker: Ranker, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is scored. The quantile is taken over all rows of ``docs`` and moved to ``threshold``; the order of the
    scores is that of the model. Null and empty texts get the score of a text without words. Rows that repeat get equal rows;
    extra columns are left out; an empty table gives no rows.
    """
    held_out = (fold_of(F.col("doc_id")) == 0).alias("held_out")
    slim = docs.select("doc_id", held_out, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measures(t) for t in batch.column(2).to_pylist()], dtype=float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranker.raw(rows), pa.float64())], names=["doc_id", "held_out", "raw"])

    raws = stored(slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, raw double"))
    middle = math.log(threshold / (1 - threshold)) - quantile(raws, ranker.bad_share)
    value = 1 / (1 + F.exp(-(F.col("raw") + F.lit(middle))))
    # At the step itself rounding must not decide.
    scored = raws.select("doc_id", "held_out", F.round(value, 9).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def good_documents(docs: DataFrame, ranker: Ranker, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted good by the quantile over all of them."""
    raws = measured(docs, [])
    place = docs.columns.index("text")

    def raw_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(rows), pa.float64())], names=["raw"])

    least = quantile(raws.mapInArrow(raw_of, "raw double"), ranker.bad_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measures(t) for t in batch.column(place).to_pylist()], dtype=float).reshape(-1, len(MEASURES))
            yield batch.filter(pa.array(ranker.raw(rows) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
