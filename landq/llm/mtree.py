"""Exact top-k inner products by an M-tree: metric pages with covering radii and parent distances, searched best first.

With a coordinate sqrt(M^2 - |x|^2) added to every vector, M the largest norm, and 0 added to a query, the squared distance is
|q|^2 + M^2 - 2 q.x: nearest neighbours are largest inner products. The tree has three levels: pivots, pages, entries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool

PAGE, SHARD_PAGES, QUERY_BLOCK = 512, 32, 256
#: Rows that pivots and first bounds come from, the first by a hash of the id. Only speed depends on them.
SAMPLE, PIVOTS = 1024, 48
FLOAT_LIMIT = 1 << 53


def usable(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, x (array of long: floor(scale * component)) of the vectors that take part, one for each vec_id.

    Out are null ids, null vectors, and vectors with null or non-finite components. Of a repeated id the least vector counts.
    """
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return rows.filter(good & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(whole).alias("x"))


def matrix(lists: list[list[int]], width: int) -> np.ndarray:
    """Rows of equal width, short ones padded with 0."""
    out = np.zeros((len(lists), width), np.int64)
    for i, row in enumerate(lists):
        out[i, :len(row)] = row
    return out


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits the largest or least long."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * rows.shape[-1]
    if most < FLOAT_LIMIT:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return rows @ q
    sums = rows.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def lift(rows: np.ndarray, square: float) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, square - (x * x).sum(axis=1)))])


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of `sample` far from one another: each is the farthest from those before."""
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class Top:
    """The k best (score, then lesser id) so far."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor, self.heap = k, floor, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for score, i in zip(scores.tolist(), ids.tolist()):
            item = (score, -i)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)

    def bound(self) -> int | None:
        """A score that the k best reach."""
        own = self.heap[0][0] if len(self.heap) == self.k else None
        return max((b for b in (own, self.floor) if b is not None), default=None)


def search(query_id: int, q: np.ndarray, parent: float, reach: float, floor: int | None, pages: list[dict], k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) for one query in pages below one pivot. parent: the query's distance from it; reach: |q|^2 + M^2."""
    top, lifted = Top(k, floor), np.append(q.astype(np.float64), 0.0)

    def radius() -> float:
        bound = top.bound()
        return np.inf if bound is None else np.sqrt(max(0.0, reach - 2.0 * bound)) * (1 + 1e-9) + 1e-3

    queue = [(max(0.0, abs(parent - p["from_parent"]) - p["radius"]), 0, i, 0.0) for i, p in enumerate(pages)]
    heapq.heapify(queue)
    while queue:
        least, measured, i, distance = heapq.heappop(queue)
        if least > radius():
            break
        page = pages[i]
        if not measured:  # so far only bounded by stored distances
            distance = float(np.linalg.norm(lifted - page["center"]))
            heapq.heappush(queue, (max(0.0, distance - page["radius"]), 1, i, distance))
            continue
        near = np.flatnonzero((np.abs(distance - page["distances"]) <= radius()) & (page["ids"] != query_id))
        if len(near):
            scores = products(page["rows"][near], q)
            if (bound := top.bound()) is not None:
                near, scores = near[scores >= bound], scores[scores >= bound]
            top.offer(scores, page["ids"][near])
    return [(-i, score) for score, i in top.heap]


PAGES = ("pivot int, page int, from_parent double, radius double, center array<double>, ids array<bigint>, distances array<double>, "
         "vectors binary")


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all vectors but that of its own id, ties to lesser ids.

    vectors, queries: vec_id, x (arrays of long, shorter ones padded with 0). No vectors or no queries give no rows. Queries go in
    blocks to the shards of the pivots that their first bound doesn't exclude; each task searches a block in a shard.
    """
    spark = small_batches(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"),
                        F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("square")).first()
    if not facts["n"]:
        return empty
    width, square = max(1, facts["width"]), float(facts["square"])
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids, sample_rows = np.array([r.vec_id for r in sample]), matrix([r.x for r in sample], width)
    pivots = spread(lift(sample_rows, square), PIVOTS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1).to_pylist(), width)
            lifted = lift(rows, square)
            near = np.stack([np.linalg.norm(lifted - p, axis=1) for p in pivots])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.argmin(axis=0).astype(np.int32)), pa.array(near.min(axis=0)),
                                              pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "pivot", "from_pivot", "vector"])

    placed = spool(vectors.select("vec_id", "x").mapInArrow(assign, "vec_id bigint, pivot int, from_pivot double, vector binary"), "placed")
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("from_pivot").alias("radius"))
    radii = {r.pivot: (r.radius, r.n) for r in sizes.collect()}  # at most PIVOTS rows

    def build(rows: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.int64).reshape(-1, width)
        lifted = lift(held, square)
        middle = lifted[np.linalg.norm(lifted - lifted.mean(axis=0), axis=1).argmin()]
        distances, pivot = np.linalg.norm(lifted - middle, axis=1), rows.column("pivot")[0].as_py()
        row = {"pivot": pivot, "page": rows.column("page")[0].as_py(), "from_parent": float(np.linalg.norm(middle - pivots[pivot])),
               "radius": float(distances.max()), "center": middle.tolist(), "ids": rows.column("vec_id").to_pylist(),
               "distances": distances.tolist(), "vectors": held.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("pivot", pa.int32()), ("page", pa.int32()), ("from_parent", pa.float64()), ("radius", pa.float64()),
                                                      ("center", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())),
                                                      ("distances", pa.list_(pa.float64())), ("vectors", pa.binary())]))

    split = F.greatest(F.lit(1), F.ceil(F.col("n") / PAGE))
    paged = placed.join(F.broadcast(sizes.select("pivot", "n")), "pivot").withColumn("page", F.pmod(F.xxhash64("vec_id"), split).cast("int")).drop("n")
    pages = spool(paged.groupBy("pivot", "page").applyInArrow(build, PAGES), "pages")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = matrix([x], max(width, len(x)))[0][:width]
                scores = np.sort(products(sample_rows, q)[sample_ids != query_id])
                floor = int(scores[-k]) if len(scores) >= k else None
                reach = float((q.astype(np.float64) ** 2).sum()) + square
                far = np.inf if floor is None else np.sqrt(max(0.0, reach - 2.0 * floor)) * (1 + 1e-9) + 1e-3
                lifted = np.append(q.astype(np.float64), 0.0)
                for pivot, (radius, n) in radii.items():
                    distance = float(np.linalg.norm(lifted - pivots[pivot]))
                    if distance - radius <= far:
                        out += [{"query_id": query_id, "pivot": pivot, "shard": s, "parent": distance, "reach": reach, "floor": floor, "q": q.tobytes()}
                                for s in range(-(-max(1, -(-n // PAGE)) // SHARD_PAGES))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("query_id", pa.int64()), ("pivot", pa.int32()), ("shard", pa.int32()), ("parent", pa.float64()),
                                                             ("reach", pa.float64()), ("floor", pa.int64()), ("q", pa.binary())]))

    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select("vec_id", "x").mapInArrow(
        plan, "query_id bigint, pivot int, shard int, parent double, reach double, floor bigint, q binary").withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    stored = pages.withColumn("shard", F.floor(F.col("page") / SHARD_PAGES).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def look(some: pa.Table, shelf: pa.Table) -> pa.Table:
        held = [{"from_parent": p["from_parent"], "radius": p["radius"], "center": np.array(p["center"]), "ids": np.array(p["ids"], np.int64),
                 "distances": np.array(p["distances"]), "rows": np.frombuffer(p["vectors"], np.int64).reshape(-1, width)} for p in shelf.to_pylist()]
        found = [(r["query_id"], *hit) for r in some.to_pylist()
                 for hit in search(r["query_id"], np.frombuffer(r["q"], np.int64), r["parent"], r["reach"], r["floor"], held, k)]
        columns = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["pivot", "shard", "block"]
    hits = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(look, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
