"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping shards and searched by range-expanding greedy search.

Vectors are dealt to the shards of their nearest medoids, again and again until a shard is small. Each shard builds a pruned graph;
a vector's adjacency lists are united over its shards. A search starts at a shard's medoid (and at the vector itself where it is a
node), walks greedily, and then expands every node within a wider range. Links leave a task as counts and as a spanning forest, so
no list of pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool
from landq.llm.components import components

#: Most nodes of a shard, medoids that split a larger one (few enough for the choice of them to limit rows ahead of the shuffle),
#: rows that look for their medoids together.
SHARD, MEDOIDS, CELL = 2048, 512, 4096
#: Out-degree, candidates (near ones, and spread ones for long edges), and how much nearer a kept neighbour must be to drop one.
DEGREE, NEAR, SPREAD, ALPHA = 24, 48, 16, 1.2
#: Nodes with this cosine or more are expanded; medoids with it are searched besides the nearest ones.
WIDE = 0.9
#: Levels of medoids; a shard that is still too large then (its vectors all have one nearest medoid) is cut by hash, and searched whole.
LEVELS = 8
AUDIT, GOAL, TRIES = 256, 0.95, 3


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, unit (array of double) of the vectors that can link: not null, not zero, without null or non-finite components.

    Of a repeated id the least vector counts.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    some = rows.filter(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter(
        F.exists("x", lambda c: c != 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes, y = lists.value_lengths().to_numpy(zero_copy_only=False), stacked(pa.chunked_array([lists]))
            y = y / np.abs(y).max(axis=1, initial=0)[:, None] if len(y) else y
            y = y / np.sqrt((y * y).sum(axis=1))[:, None] + 0.0
            flat = y[np.arange(y.shape[1]) < sizes[:, None]]
            units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), units], ["vec_id", "unit"])

    return some.groupBy("vec_id").agg(F.min("x").alias("x")).mapInArrow(work, "vec_id bigint, unit array<double>")


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix, short ones padded with 0."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row: robust pruning of its near and some spread rows, and the nearest of those that chose it."""
    n = len(x)
    near, spread = min(NEAR, n - 1), np.unique(np.linspace(0, n - 1, min(SPREAD, n)).astype(int))
    sources, targets = [], []
    for low in range(0, n, 256):
        rows = np.arange(low, min(low + 256, n))
        cos = x[rows] @ x.T
        cos[np.arange(len(rows)), rows] = -2
        pick = np.concatenate([np.argpartition(-cos, near - 1, axis=1)[:, :near], np.tile(spread, (len(rows), 1))], axis=1)
        c = np.take_along_axis(cos, pick, axis=1)
        order = np.argsort(-c, axis=1, kind="stable")
        pick, c = np.take_along_axis(pick, order, axis=1), np.take_along_axis(c, order, axis=1)
        far = np.sqrt(np.maximum(2 - 2 * c, 0))
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("ikd,ijd->ikj", x[pick], x[pick]), 0))
        alive, at = c > -2, np.arange(len(rows))
        for _ in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[at, first]
            if not some.any():
                break
            sources.append(rows[some])
            targets.append(pick[at, first][some])
            alive &= ~(ALPHA * between[at, first] <= far)
            alive[at, first] = False
    a, b = np.concatenate(sources), np.concatenate(targets)
    back = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), b))
    place = np.arange(len(back)) - np.searchsorted(b[back], b[back])
    kept = back[place < DEGREE]
    edges = np.unique(np.concatenate([a * n + b, b[kept] * n + a[kept]]))
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))


def range_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, own: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, node) pairs found with cosine >= limit. graph: neighbours of each node, padded with the node itself.

    own: the node that is the query itself, or -1; it is a second start beside the medoid, and not found.
    """
    n, at = len(x), np.arange(len(q))
    seen = np.zeros((len(q), n), bool)
    found: list[np.ndarray] = []
    medoid = int((x @ x.mean(axis=0)).argmax())

    def look(pairs: np.ndarray) -> np.ndarray:
        """Marks pairs as seen; those within the wider range go on, those within the limit are found."""
        pairs = np.unique(pairs)
        pairs = pairs[~seen.ravel()[pairs]]
        seen.ravel()[pairs] = True
        wide = []
        for low in range(0, len(pairs), 1 << 17):
            some = pairs[low:low + (1 << 17)]
            cos = np.einsum("ij,ij->i", q[some // n], x[some % n])
            found.append(some[cos >= limit])
            wide.append(some[cos >= min(WIDE, limit)])
        return np.concatenate([np.zeros(0, np.int64), *wide])

    here, best = np.full(len(q), medoid), q @ x[medoid]
    trail, moving = [at * n + medoid], at
    while len(moving):
        nodes, cos = graph[here[moving]], np.empty((len(moving), graph.shape[1]))
        for low in range(0, len(moving), 512):
            cos[low:low + 512] = np.einsum("id,ijd->ij", q[moving[low:low + 512]], x[nodes[low:low + 512]])
        step = cos.argmax(axis=1)
        top = cos[np.arange(len(moving)), step]
        better = top > best[moving]
        moving = moving[better]
        here[moving], best[moving] = nodes[better, step[better]], top[better]
        trail.append(moving * n + here[moving])
    mine = own >= 0
    edge = look(np.concatenate([*trail, at[mine] * n + own[mine]]))
    while len(edge):
        parts = [edge[i:i + (1 << 16)] for i in range(0, len(edge), 1 << 16)]
        edge = np.concatenate([look(((p // n)[:, None] * n + graph[p % n]).ravel()) for p in parts])
    pairs = np.concatenate([np.zeros(0, np.int64), *found])
    a, b = pairs // n, pairs % n
    return a[b != own[a]], b[b != own[a]]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index that each of n nodes reaches over the links."""
    low = np.arange(n)
    while True:
        old = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == old).all():
            return low


def dealt(vectors: DataFrame, overlap: int, shard: int) -> DataFrame:
    """shard, vec_id, unit, weight, home: each vector in the shards of its nearest `overlap` medoids (home), and in those it searches too.

    A shard with more than `shard` homes is split by medoids of its own, which are chosen by a hash of their ids. Rows meet medoids
    in cells of bounded size, so a shard with a third of all rows is only more cells. Where medoids don't split a shard any more
    it is cut by a hash of the ids, and all its vectors search all parts.
    """
    now = vectors.withColumns({"shard": F.lit(0).cast("bigint"), "home": F.lit(True)})
    done = None
    for level in range(LEVELS + 1):
        sizes = now.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
        sizes = spool(sizes.withColumn("big", F.col("homes") > shard), "shard-sizes")
        ready = now.join(sizes.filter("not big").select("shard"), "shard", "left_semi").filter("shard is not null")
        done = ready if done is None else done.unionByName(ready)
        big = sizes.filter("big")
        if big.isEmpty():
            return done
        rows = now.join(big.select("shard", "homes", F.ceil(F.col("all") / CELL).alias("cells"), F.least(
            F.lit(MEDOIDS), F.ceil(2 * overlap * F.col("homes") / shard)).alias("wanted")), "shard")
        if level == LEVELS:
            parts = F.ceil(2 * F.col("homes") / shard)
            spread = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            return done.unionByName(spread.select(
                F.xxhash64("shard", "part").alias("shard"), "vec_id", "unit", "weight",
                (F.col("home") & (F.pmod(F.xxhash64("vec_id"), "parts") == F.col("part"))).alias("home")).select(*done.columns))
        order = Window.partitionBy("shard").orderBy("salt", "vec_id")
        chosen = (rows.filter("home").withColumn("salt", F.xxhash64("vec_id", F.lit(level))).withColumn("place", F.row_number().over(order))
                  .filter(F.col("place") <= MEDOIDS).filter("place <= wanted").select("shard", "cells", "vec_id", "unit"))
        left = rows.select(F.xxhash64("shard", F.pmod(F.xxhash64("vec_id"), "cells")).alias("cell"), "shard", "vec_id", "unit", "weight", "home")
        right = chosen.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))).select(
            F.xxhash64("shard", "c").alias("m_cell"), F.xxhash64("shard", "vec_id").alias("m_shard"), F.col("unit").alias("m_unit"))

        def work(some: pa.Table, medoids: pa.Table) -> pa.Table:
            if not some.num_rows:
                return some.select(["shard", "vec_id", "unit", "weight", "home"])
            medoids = medoids.sort_by("m_shard")
            x, m = same_width(stacked(some["unit"]), stacked(medoids["m_unit"]))
            cos = x @ m.T
            place = (-cos).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            home = some["home"].to_numpy(zero_copy_only=False)[:, None]
            a, b = np.nonzero((place < np.where(home, overlap, 1)) | (cos >= WIDE))
            out = some.select(["vec_id", "unit", "weight"]).take(pa.array(a))
            shards = medoids["m_shard"].to_numpy()[b]
            return pa.table({"shard": shards, "vec_id": out["vec_id"], "unit": out["unit"], "weight": out["weight"],
                             "home": (place[a, b] < overlap) & home[a, 0]})

        now = spool(left.groupBy("cell").cogroup(right.groupBy("m_cell")).applyInArrow(
            work, "shard bigint, vec_id bigint, unit array<double>, weight bigint, home boolean"), "shards")
    return done


def built(places: DataFrame) -> DataFrame:
    """vec_id, near: the united adjacency lists of the shards in which a vector is at home. places: shard, vec_id, unit, home."""
    def work(some: pa.Table) -> pa.Table:
        some = some.sort_by("vec_id")
        ids = some["vec_id"].to_numpy()
        lists = pruned_graph(stacked(some["unit"])) if len(ids) > 1 else [np.zeros(0, int)] * len(ids)
        return pa.table({"vec_id": ids, "near": pa.array([ids[rows] for rows in lists], pa.list_(pa.int64()))})

    lists = places.filter("home").select("shard", "vec_id", "unit").groupBy("shard").applyInArrow(work, "vec_id bigint, near array<bigint>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def searched(places: DataFrame, graph: DataFrame, limit: float, shard: int) -> DataFrame:
    """vec_id, n (weight of the vectors found linked), other (null, or a vector of the same component), several rows for a vector.

    A pair is counted once: in the first common home of both, in the order of the found one's homes, else in the found one's first.
    """
    homes = places.filter("home").groupBy("vec_id").agg(F.array_sort(F.collect_set("shard")).alias("homes"))
    full = places.join(homes, "vec_id").join(graph, "vec_id", "left")
    blocks = places.groupBy("shard").agg(F.ceil(F.count_if(~F.col("home")) / shard).alias("blocks"))
    nodes = full.filter("home").join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), "blocks"))).select(
        F.xxhash64("shard", "block").alias("cell"), "shard", "vec_id", "unit", "weight", "homes", "near")
    asking = full.join(blocks, "shard").select(
        F.xxhash64("shard", F.when(F.col("home"), F.lit(0).cast("bigint")).otherwise(1 + F.pmod(F.xxhash64("vec_id"), F.greatest("blocks", F.lit(1)))))
        .alias("q_cell"), F.col("vec_id").alias("q_id"), F.col("unit").alias("q_unit"), F.col("homes").alias("q_homes"))
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def work(some: pa.Table, queries: pa.Table) -> pa.Table:
        if not some.num_rows or not queries.num_rows:
            return schema.empty_table()
        some = some.sort_by("vec_id")
        here, ids, q_ids = some["shard"][0].as_py(), some["vec_id"].to_numpy(), queries["q_id"].to_numpy()
        x, q = same_width(stacked(some["unit"]), stacked(queries["q_unit"]))
        lists = some["near"].combine_chunks()
        rows = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        targets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.minimum(np.searchsorted(ids, targets), len(ids) - 1)
        inside = ids[place] == targets
        rows, place = rows[inside], place[inside]
        offset = np.arange(len(rows)) - np.searchsorted(rows, rows)
        graph_ = np.tile(np.arange(len(ids))[:, None], (1, 1 + (int(offset.max()) + 1 if len(offset) else 0)))
        graph_[rows, offset] = place
        own = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
        own = np.where(ids[own] == q_ids, own, -1)
        a, b = range_search(x, graph_, q, own, limit)
        if (own >= 0).all():  # nodes among themselves: found from either side is found
            back = np.full(len(ids), -1)
            back[own] = np.arange(len(own))
            both = np.unique(np.concatenate([a * len(ids) + b, back[b] * len(ids) + own[a]]))
            a, b = both // len(ids), both % len(ids)
        mine, theirs, weight, count = stacked(queries["q_homes"]), stacked(some["homes"]), some["weight"].to_numpy(), np.zeros(len(q_ids), np.int64)
        for low in range(0, len(a), 1 << 18):
            i, j = a[low:low + (1 << 18)], b[low:low + (1 << 18)]
            common = ((theirs[j][:, :, None] == mine[i][:, None, :]) & (theirs[j] != 0)[:, :, None]).any(axis=2)
            first = theirs[j, np.where(common.any(axis=1), common.argmax(axis=1), 0)]
            np.add.at(count, i, np.where(first == here, weight[j], 0))
        names = np.unique(np.concatenate([ids, q_ids]))
        low = roots(np.searchsorted(names, q_ids[a]), np.searchsorted(names, ids[b]), len(names))
        linked = np.flatnonzero(low != np.arange(len(names)))
        return pa.table({"vec_id": np.concatenate([q_ids, names[linked]]), "n": np.concatenate([count, np.zeros(len(linked), np.int64)]),
                         "other": pa.array([None] * len(q_ids) + names[low[linked]].tolist(), pa.int64())}, schema=schema)

    return nodes.groupBy("cell").cogroup(asking.groupBy("q_cell")).applyInArrow(work, "vec_id bigint, n bigint, other bigint")


def audited(vectors: DataFrame, counts: DataFrame, limit: float, sample: int = AUDIT) -> float:
    """Share of the links of `sample` vectors (by a hash of their ids; half of them linked ones, if there are) that a full scan finds too.

    vectors: vec_id, unit, weight; counts: vec_id, n (links found, by weight). The sample's vectors are the only ones that travel.
    """
    some = vectors.join(counts, "vec_id").withColumn("salt", F.xxhash64("vec_id", F.lit(7)))
    drawn = {r.vec_id: r for part in ("true", "n > 0") for r in some.filter(part).orderBy("salt", "vec_id").limit(sample // 2).collect()}
    if not drawn:
        return 1.0
    ids = np.array(sorted(drawn), np.int64)
    width = max(len(r.unit) for r in drawn.values())
    q = np.zeros((len(ids), width))
    for i, v in enumerate(ids.tolist()):
        q[i, :len(drawn[v].unit)] = drawn[v].unit

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            x, y = same_width(stacked(table["unit"]), q)
            hit = (x @ y.T >= limit) & (table["vec_id"].to_numpy()[:, None] != ids)
            total += (hit * table["weight"].to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "links"])

    exact = {r.vec_id: r.links for r in vectors.select("vec_id", "unit", "weight").mapInArrow(work, "vec_id bigint, links bigint")
             .groupBy("vec_id").agg(F.sum("links").alias("links")).collect()}
    total = sum(exact.values())
    return sum(min(drawn[i].n, n) for i, n in exact.items()) / total if total else 1.0


def near_duplicate_vectors(rows: DataFrame, limit: float = 0.95, overlap: int = 2, shard: int = SHARD, goal: float = GOAL) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall: one row for each vec_id of `rows` (vec_id, embedding).

    Vectors link if the cosine in double precision is `limit` or more, whatever their other columns say. n_links: other vectors linked
    directly; component_id: the least vec_id reachable; kept: vec_id = component_id. Null and zero vectors and those with null or
    non-finite components are alone, as is a null id (with a null component, and kept). Of a repeated id the least usable vector
    counts. Shorter vectors are padded with 0. Vectors of exactly the same direction are one node with a weight. All links are
    verified; the graph may miss some. `recall` is the audited share of links found, against a scan of all vectors for a bounded
    sample; below `goal` the work is done again with twice the overlap, up to three times.
    """
    small_batches(rows.sparkSession)
    units = spool(unit_vectors(rows).withColumn("key", F.struct(F.xxhash64("unit"), F.xxhash64(F.lit(1), "unit"))), "units")
    groups = spool(units.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "directions")
    # At most 1,024 directions hold more than 1/1,024 of all vectors: those are broadcast, so no task gets a whole large group.
    total = groups.agg(F.sum("weight")).first()[0] or 0
    large = F.col("weight") > F.lit(total / 1024)
    member = units.select("vec_id", "key").join(F.broadcast(groups.filter(large)), "key", "left")
    member = spool(member.filter("rep is not null").select("vec_id", "rep", "weight").union(
        member.filter("rep is null").select("vec_id", "key").join(groups.filter(~large), "key").select("vec_id", "rep", "weight")), "members")
    nodes = spool(units.join(member.filter("vec_id = rep").select("vec_id", "weight"), "vec_id").select("vec_id", "unit", "weight"), "nodes")
    for _ in range(TRIES):
        places = spool(dealt(nodes, overlap, shard), "places")
        found = spool(searched(places, spool(built(places), "graph"), limit, shard), "found")
        counts = spool(found.groupBy("vec_id").agg(F.sum("n").alias("n")), "link-counts")
        recall = audited(nodes, counts, limit)
        if recall >= goal:
            break
        overlap *= 2
    joined = components(found.filter("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    ends = member.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = rows.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct()
    return every.join(ends, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"), F.lit(float(recall)).alias("recall"))
