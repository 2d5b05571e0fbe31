"""Hard negatives by threshold joins: an inverted index that leaves out dimensions covered by norm bounds, and falling thresholds.

An anchor wants the first few rows of a window of scores. A join at a threshold finds every row that reaches it; the threshold
falls until each window is full or its lower end is reached. Anchors meet rows in blocks and shards, so neither side is ever whole
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool

#: Most rows of a shard and anchors of a block; small tables make smaller shards, for the sake of idle cores only.
SHARD, LEAST_SHARD, BLOCK = 1 << 16, 1 << 11, 1 << 14
#: Dimensions that are accumulated between two checks of the remaining norms, and anchors that search together.
STRIDE, BATCH = 8, 64
#: Part of the first threshold by which it falls from one join to the next.
FALL = 0.1
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label (bigint), x (array of long: floor(scale * component)) of the rows that take part, one for each vec_id.

    Out are null ids, labels and vectors, and vectors with null or non-finite components. Of a repeated id the least row counts.
    """
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return (rows.filter(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole.alias("x"))
            .filter("label is not null").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x"))


def matrix(lists: list[list[int]], width: int) -> np.ndarray:
    """Rows of equal width, short ones padded with 0."""
    out = np.zeros((len(lists), width), np.int64)
    for i, row in enumerate(lists):
        out[i, :len(row)] = row
    return out


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from each dimension on, with 0 behind the last."""
    squares = np.cumsum((x.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


class Index:
    """A shard's rows as an inverted index: dimensions by falling energy, postings of a dimension as one slab of a matrix."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-(x.astype(float) ** 2).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        self.values, self.tails = self.x.astype(float), tails(self.x)

    def join(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row, score) of all pairs whose score is at least the threshold `least` of the row of q. q: in the index's order.

        A row is posted under its first dimensions only, up to where its remaining norm times the greatest remaining norm of
        the queries falls below the least threshold. Partial scores are added up dimension by dimension, and a pair is given
        up as soon as its remaining norms cannot lift it to its threshold. What is left is scored in whole numbers.
        """
        values, rest = q.astype(float), tails(q)
        slack = 1e-9 * (rest[:, 0].max() * self.tails[:, 0].max() + 1)
        width = q.shape[1]
        ends = np.append(np.arange(0, width, STRIDE), width)
        covered = self.tails[:, ends] * rest[:, ends].max(axis=0) + slack < least.min()
        covered[:, -1] = True
        cut = ends[covered.argmax(axis=1)]
        rows = np.argsort(-cut, kind="stable")
        left = -cut[rows]
        n = np.searchsorted(left, 0)
        rows = rows[:n]
        partial, alive = np.zeros((len(q), n)), np.ones((len(q), n), bool)
        for low, high in zip(ends[:-1], ends[1:]):
            n = np.searchsorted(left, -low)
            if not n:
                break
            partial[:, :n] += values[:, low:high] @ self.values[rows[:n], low:high].T
            alive[:, :n] &= partial[:, :n] + rest[:, high, None] * self.tails[rows[:n], high] + slack >= least[:, None]
            if alive.sum() * 32 < alive.size:
                break
        a, at = np.nonzero(alive)
        b = rows[at]
        score = np.concatenate([np.zeros(0, np.int64), *[exact(q[a[i:i + 65536]], self.x[b[i:i + 65536]]) for i in range(0, len(a), 65536)]])
        keep = score >= least[a]
        return a[keep], b[keep], score[keep]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row; beyond a long they end at its limits."""
    if len(q) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([min(max(sum(map(int.__mul__, a, b)), LOW), HIGH) for a, b in zip(q.tolist(), x.tolist())], np.int64)


def first_rows(index: Index, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray,
               tops: list[list[int]], floors: list[list[int]], k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(query id, window, id, score): the first k rows of each window, by falling score and then by id.

    Window i of a query holds scores from floors[i] to tops[i], of rows with the query's label (`same`) or another one.
    """
    q = q[:, index.order]
    norms = tails(q)[:, 0] * index.tails[:, 0].max()
    start = np.array([min(max(t), n) for t, n in zip(tops, norms)])
    bounds, waiting = start.copy(), np.arange(len(q))
    falls = np.maximum(FALL * start, 1.0)
    while len(waiting):
        still = []
        for at in range(0, len(waiting), BATCH):
            batch = waiting[at:at + BATCH]
            a, b, score = index.join(q[batch], bounds[batch])
            who = batch[a]
            fits = (ids[b] != q_ids[who]) & ((labels[b] == q_labels[who]) == same)
            who, b, score = who[fits], b[fits], score[fits]
            order = np.lexsort((ids[b], -score, who))
            who, b, score = who[order], b[order], score[order]
            edges = np.searchsorted(who, [batch, batch + 1])
            for i, low, high in zip(batch, *edges):
                falling, near, done = -score[low:high], b[low:high], []
                for w, (top, floor) in enumerate(zip(tops[i], floors[i])):
                    first, last = np.searchsorted(falling, -top), np.searchsorted(falling, -floor, "right")
                    if last - first < k and bounds[i] > floor:
                        break
                    done.append((w, near[first:min(last, first + k)], -falling[first:min(last, first + k)]))
                else:
                    for w, rows, scores in done:
                        yield from ((int(q_ids[i]), w, int(ids[r]), int(s)) for r, s in zip(rows, scores))
                    continue
                still.append(i)
        waiting = np.array(still, int)
        low = bounds[waiting] - falls[waiting]
        bounds[waiting] = np.maximum(np.where((low > 0) | (start[waiting] <= 0), low, -np.inf), [float(min(floors[i])) for i in waiting])
        bounds[waiting] = np.where(start[waiting] <= 0, [float(min(floors[i])) for i in waiting], bounds[waiting])


FOUND = "anchor_id bigint, place int, vec_id bigint, score bigint"


def meet(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND: the first k rows of each window of each anchor, over all shards. rows: vec_id, label, x; anchors: also tops, floors.

    With `same`, an anchor meets the shards of its own label, else all. A label's rows are dealt to shards and its anchors to
    blocks by hashes of their ids, so a label with a third of all rows is only more shards.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kind = F.col("label") if same else F.lit(0).cast("bigint")

    def parts(some: DataFrame, most: int, least: int, name: str) -> DataFrame:
        size = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("n") / cores)))
        return some.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select("kind", F.ceil(F.col("n") / size).cast("int").alias(name))

    counts = parts(rows, SHARD, LEAST_SHARD, "shards").join(parts(anchors, BLOCK, BLOCK, "blocks"), "kind")

    def dealt(some: DataFrame, own: str, other: str) -> DataFrame:
        keyed = some.withColumn("kind", kind).join(counts, "kind").withColumn(own[:-1], F.pmod(F.xxhash64("vec_id"), F.col(own)))
        return keyed.withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn(
            "cell", F.xxhash64("kind", F.col("shard").cast("bigint"), F.col("block").cast("bigint")))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, q = left["x"].to_pylist(), right["q_x"].to_pylist()
            width = max(1, max(map(len, x)), max(map(len, q)))
            found = list(first_rows(Index(matrix(x, width)), left["vec_id"].to_numpy(), left["label"].to_numpy(), matrix(q, width),
                                    right["q_vec_id"].to_numpy(), right["q_label"].to_numpy(), right["tops"].to_pylist(), right["floors"].to_pylist(),
                                    k, same))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], ["anchor_id", "place", "vec_id", "score"])

    left = dealt(rows, "shards", "blocks").select("cell", "vec_id", "label", "x")
    right = dealt(anchors, "blocks", "shards").select(*[F.col(c).alias(f"q_{c}") for c in ("cell", "vec_id", "label", "x")], "tops", "floors")
    found = left.groupBy("cell").cogroup(right.groupBy("q_cell")).applyInArrow(work, FOUND)
    first = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    rows: vec_id, label, x as `usable` gives them; `anchors` says which rows ask. Scores are inner products in whole numbers (beyond
    a long they end at its limits). An anchor's positives are its first `positives` other rows of its label by falling score, ties
    by the lesser id. The negatives of a positive are the first `negatives` rows of another label, in the same order, whose score is
    `low` to `high` percent of the positive's. A positive with a negative score has none. Vectors of different lengths are padded
    with 0. Without rows, anchors or other labels the result is empty.
    """
    small_batches(rows.sparkSession)
    rows = spool(rows.select("vec_id", "label", "x"), "vectors")
    asking = rows.filter(anchors)
    near = spool(meet(rows, asking.withColumns({"tops": F.array(F.lit(HIGH)), "floors": F.array(F.lit(LOW))}), positives, True).filter(
        "score >= 0").select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p")).select(
        "anchor_id", F.col("p.positive_score").alias("p"))
    windows = asking.join(scores, asking["vec_id"] == scores["anchor_id"]).select(
        "vec_id", "label", "x", F.transform("p", lambda s: F.floor(s.cast("decimal(38,0)") * high / 100).cast("bigint")).alias("tops"),
        F.transform("p", lambda s: F.ceil(s.cast("decimal(38,0)") * low / 100).cast("bigint")).alias("floors"))
    found = meet(rows, windows, negatives, False)
    return found.withColumn("place", F.col("place") + 1).join(near, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
