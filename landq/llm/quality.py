"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.llm.common import small_batches
from landq.llm.linear import Leader, ngrams, orders, sigmoid, sums, training_rows

#: Labelled documents of either class that are learned from, at most.
SAMPLE = 4000


def train(rows: list[tuple[int, int, np.ndarray]], epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and intercept from (label, words, buckets)."""
    leader, bias, moved = Leader(), 0.0, 1.0
    share = [max(1, sum(r[0] == y for r in rows)) for y in (0, 1)]
    scale = [len(rows) / 2 / s for s in share]  # both classes weigh the same
    for order in orders(len(rows), epochs):
        for i in order:
            y, _, keys = rows[i]
            weights = leader.weights(keys)
            gradient = (sigmoid(bias + weights.sum()) - y) * scale[y]
            leader.update(keys, weights, gradient)
            moved += gradient * gradient
            bias -= 0.1 * gradient / moved ** 0.5
    return leader.weights(slice(None)).astype(np.float32), float(bias)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: quality 1 is likelier), predicted, for each row of `docs` (doc_id, text).

    Scores depend on the text alone; null and empty texts get the intercept's score, equal texts equal scores. Without
    labels all scores are 0.5. A document is held out of learning if crc32(doc_id as text) mod 3 is 1 (null: false).
    """
    weights, bias = train(training_rows(docs, labels, "quality", ngrams, sample))
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sigmoid(bias + sums(batch.column(1).to_pylist(), ngrams, weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").select("doc_id", "text", held)
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")
