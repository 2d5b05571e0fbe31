"""Toxicity: cumulative-link ordinal regression, one weight per feature for all ordered thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.llm.common import pick_name, small_batches
from landq.llm.linear import BITS, Leader, orders, repeated_stems, sigmoid, sums, training_rows

#: Labelled documents of either class that are learned from, at most.
SAMPLE = 4000


def telling(rows: list[tuple[int, int, np.ndarray]], odds: float = 3.0, least: int = 2, sure: float = 20.0) -> np.ndarray:
    """The features that `least` toxic rows hold, and toxic rows `odds` times as often as others, by more than chance: the
    likelihood ratio statistic against one rate for both is `sure` or more. Only these are learned.

    With thousands of features and hundreds of toxic rows, most that are held `odds` times as often are so by chance.
    """
    count, size = np.zeros((2, 1 << BITS)), np.zeros(2)
    for y, _, keys in rows:
        count[y, keys] += 1
        size[y] += 1
    expected = count.sum(axis=0) * size[:, None] / size.sum()
    ratio = 2 * (count * np.log(np.maximum(count, 1) / np.maximum(expected, 1e-9))).sum(axis=0)
    return (count[1] >= least) & ((count[1] + 0.5) / (size[1] + 1) >= odds * (count[0] + 0.5) / (size[0] + 1)) & (ratio >= sure)


def grades(rows: list[tuple[int, int, np.ndarray]]) -> list[int]:
    """0 for label 0; the labels say only toxic or not, so toxic rows are graded 1 or 2 by their features per word, cut at the median."""
    rates = [len(keys) / max(1, words) for _, words, keys in rows]
    middle = float(np.median([r for r, (y, _, _) in zip(rates, rows) if y] or [0.0]))
    return [y * (1 + (rate > middle)) for rate, (y, _, _) in zip(rates, rows)]


class Ordinal:
    """P(grade > k) = sigmoid(sum of weights - threshold k), thresholds in ascending order.

    Weights are never negative: ordinary words don't make up for offensive ones, however long a text is.
    """

    def __init__(self, levels: int = 3):
        self.leader, self.levels = Leader(alpha=2.0, l1=0.5, l2=0.01, least=0.0), levels
        self.first, self.gaps = 2.0, np.zeros(levels - 2)  # thresholds: first, then first plus sums of exp(gaps)
        self.moved = np.ones(levels - 1)

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def learn(self, rows: list[np.ndarray], grade: list[int], epochs: int = 15) -> None:
        scale = np.ones(self.levels)
        for order in orders(len(rows), epochs):
            for i in order:
                keys, y = rows[i], grade[i]
                weights = self.leader.weights(keys)
                below = np.concatenate([[0.0], sigmoid(self.thresholds() - weights.sum()), [1.0]])  # P(grade < k)
                self.leader.update(keys, weights, scale[y] * (1 - below[y + 1] - below[y]))
                self.shift(below, y, scale[y])

    def shift(self, below: np.ndarray, y: int, scale: float, rate: float = 0.1) -> None:
        """A step of the thresholds up the likelihood of grade y."""
        slope, p = below * (1 - below), max(below[y + 1] - below[y], 1e-9)
        by_threshold = np.zeros(self.levels - 1)
        if y < self.levels - 1:
            by_threshold[y] += slope[y + 1] / p
        if y:
            by_threshold[y - 1] -= slope[y] / p
        later = by_threshold[::-1].cumsum()[::-1]
        step = np.clip(scale * np.concatenate([[later[0]], later[1:] * np.exp(self.gaps)]), -3, 3)
        self.moved += step * step
        step = rate * step / np.sqrt(self.moved)
        self.first += step[0]
        self.gaps = np.clip(self.gaps + step[1:], -5, 5)


def train(rows: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, thresholds, and the severity from which documents are rejected, from (label, words, buckets).

    The cut is where the learned rows' share of caught toxic documents less five times that of caught clean ones is largest.
    """
    useful, model = telling(rows), Ordinal()
    rows = [(y, words, keys[useful[keys]]) for y, words, keys in rows]
    model.learn([keys for _, _, keys in rows], grades(rows))
    weights, thresholds = model.leader.weights(slice(None)).astype(np.float32), model.thresholds()
    severity = np.array([sigmoid(weights[keys].sum() - thresholds).sum() for _, _, keys in rows])
    toxic = np.array([y == 1 for y, _, _ in rows])
    cuts = np.unique(severity)
    caught, harmed = [1 - np.searchsorted(np.sort(severity[t]), cuts) / max(1, t.sum()) for t in (toxic, ~toxic)]
    best = int(np.argmax(caught - 5 * harmed))
    gain = caught[best] - 5 * harmed[best]
    cut = (cuts[best] + cuts[max(0, best - 1)]) / 2 if gain > 0 else np.inf  # nothing is rejected if no cut is of use
    return weights, thresholds, float(max(cut, sigmoid(-thresholds).sum() + 1e-6))  # nor a text without telling features


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` with severity (expected grade, 0 to 2), grade (how many thresholds are likelier passed than not) and
    rejected (severity from the cut of `train` on).

    Only the text counts; null and empty texts have no features and are kept; equal texts score alike. Without labels of both
    classes nothing is rejected. All rows and columns of `docs` stay; if it has columns of these names, the new ones get underscores behind them.
    """
    rows = training_rows(docs, labels, "toxic", repeated_stems, sample)
    weights, thresholds, cut = train(rows) if {r[0] for r in rows} == {0, 1} else (np.zeros(1 << BITS, np.float32), np.array([50.0, 50.0]), 1.0)
    small_batches(docs.sparkSession)
    names = [pick_name(docs, n) for n in ("severity", "grade", "rejected")]
    quoted = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = sigmoid(sums(batch.column(at).to_pylist(), repeated_stems, weights)[:, None] - thresholds)
            grade = (passed >= 0.5).sum(axis=1).astype(np.int32)
            severity = passed.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity), pa.array(grade), pa.array(severity >= cut)],
                                             [*batch.schema.names, *names])

    return docs.mapInArrow(work, ", ".join([*quoted, f"`{names[0]}` double", f"`{names[1]}` int", f"`{names[2]}` boolean"]))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that are not rejected, with the columns of `docs`."""
    scored = toxicity_scores(docs, labels, sample)
    return scored.filter(~F.col(scored.columns[-1])).select(*docs.columns)
