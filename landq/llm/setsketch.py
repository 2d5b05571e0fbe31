"""Near-duplicate documents by SetSketch registers: bands of register values, a joint likelihood estimate, then full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool
from landq.llm.components import link_groups
from landq.llm.words import LOWER, SPACE, Spans, blocks, edges, mix

#: Registers, and how many make a band. A pair at the least similarity of 0.8 shares no band with a chance of (1 - 0.8^4)^32 = 5e-8.
REGISTERS, ROWS = 128, 4
RATE, BASE = 20.0, 1.001
#: The estimate's standard error is under 0.036; pairs are given up only this far below the limit.
MARGIN = 0.2
DOC_BITS = 14


def shingles(texts: list[str | None], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each shingle, hash of each shingle), each shingle of a text once, in order of row and hash.

    Words are runs of bytes other than blank and 0x09-0x0D, with A-Z in lower case. A text of fewer than k words, but not
    none, has its whole sequence as its only shingle. Hashes have 50 bits.
    """
    for first, buf, at in blocks(texts):
        for low in range(0, len(at), 1 << DOC_BITS):
            starts_of = at[low:low + (1 << DOC_BITS)]
            end = at[low + (1 << DOC_BITS)] if low + (1 << DOC_BITS) < len(at) else len(buf)
            part = LOWER[buf[starts_of[0]:end]] if len(starts_of) else buf[:0]
            starts, ends = edges(~SPACE[part])
            doc = np.searchsorted(starts_of - starts_of[0], starts, "right") - 1
            h = Spans(part).hash(starts, ends)
            n = np.bincount(doc, minlength=len(starts_of))
            grams, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(h) >= k:
                whole = doc[k - 1:] == doc[:len(doc) - k + 1]
                grams = h[:len(h) - k + 1]
                for i in range(1, k):
                    grams = mix(grams) + h[i:len(h) - k + 1 + i]
                grams, rows = mix(grams)[whole], doc[k - 1:][whole]
            short = np.flatnonzero((n > 0) & (n < k))
            if len(short):
                offset = np.concatenate([[0], np.cumsum(n)])
                few = np.zeros(len(short), np.uint64)
                for i in range(k - 1):
                    has = n[short] > i
                    few[has] = mix(few[has] + np.uint64(i + 1)) + h[offset[short[has]] + i]
                grams, rows = np.concatenate([grams, mix(few)]), np.concatenate([rows, short])
            keys = np.unique(rows.astype(np.uint64) << np.uint64(64 - DOC_BITS) | grams >> np.uint64(DOC_BITS))
            yield first + low, len(starts_of), (keys >> np.uint64(64 - DOC_BITS)).astype(np.int64), keys & np.uint64((1 << 64 - DOC_BITS) - 1)


def registers(doc: np.ndarray, hashes: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of n sets: floor(1 - log_b of the minima of exponentially distributed values), as unsigned 16-bit integers.

    Each element sends ascending values to the registers in an order of its own, and stops at the set's largest minimum.
    """
    least, state, start = np.full(n * m, np.inf), mix(hashes), mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    place, step = (start & np.uint64(m - 1)).astype(np.int64), (start >> np.uint64(20) & np.uint64(m - 1) | np.uint64(1)).astype(np.int64)
    value = np.zeros(len(hashes))
    for j in range(m):
        if not len(doc):
            break
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        value = value - np.log((state >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / (RATE * (m - j))
        np.minimum.at(least, doc * m + (place & m - 1), value)
        active = np.unique(doc) if j else np.arange(n)
        bound = np.zeros(n)
        bound[active] = least.reshape(n, m)[active].max(axis=1)
        keep = value < bound[doc]
        doc, value, state, place, step = doc[keep], value[keep], state[keep], (place + step)[keep], step[keep]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 65535).astype("<u2").reshape(n, m)


SKETCHES = "doc_id bigint, n_shingles bigint, set_hash bigint, sketch array<bigint>"


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (equal for equal sets), sketch (registers, four to a long; empty for an empty set)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, n, doc, grams in shingles(batch.column(1).to_pylist(), k):
                size = np.bincount(doc, minlength=n)
                total = np.zeros(n, np.uint64)
                np.add.at(total, doc, mix(grams + np.uint64(77)))
                packed = registers(doc, grams, n).view("<i8")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, packed.shape[1], 0))]), pa.int32()),
                                                 pa.array(packed[size > 0].ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(size), pa.array(mix(total).view(np.int64)), lists],
                                                 ["doc_id", "n_shingles", "set_hash", "sketch"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, SKETCHES)


def likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the register comparisons likeliest. u, v: the sets' shares of the sum of their sizes."""
    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    best, found = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 201):
        j = step * np.minimum(u / v, v / u)
        a, b = p(u - v * j), p(v - u * j)
        score = more * np.log(a + 1e-12) + less * np.log(b + 1e-12) + same * np.log(np.clip(1 - a - b, 1e-12, None))
        better = score > best
        best, found = np.where(better, score, best), np.where(better, j, found)
    return found


def likely(pairs: DataFrame, sketches: DataFrame, limit: float) -> DataFrame:
    """The pairs a, b whose sizes allow the limit and whose joint estimate comes near it."""
    def side(name: str) -> DataFrame:
        return sketches.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            sa, sb = (batch.column(i).flatten().to_numpy().view("<u2").reshape(len(na), -1) for i in (4, 5))
            more, less = (sa > sb).sum(axis=1), (sa < sb).sum(axis=1)
            j = likelihood(more, less, REGISTERS - more - less, na / (na + nb), nb / (na + nb))
            keep = pa.array(j >= limit - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(100 * limit)))
    return near.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(work, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, limit: float) -> DataFrame:
    """The pairs a, b whose full shingle sets reach the limit, decided in whole numbers."""
    percent = round(100 * limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in range(4)]
            known: dict = {}
            for at in range(0, batch.num_rows, 256):
                chunk = [s[at:at + 256] for s in sides]
                new = {(i, hash(t)): t for i, t in zip(chunk[0] + chunk[1], chunk[2] + chunk[3]) if (i, hash(t)) not in known}
                for first, n, doc, grams in shingles(list(new.values()), k):
                    split = np.split(grams, np.searchsorted(doc, np.arange(1, n)))
                    known.update(zip(list(new)[first:first + n], split))
                keep = []
                for a, b, ta, tb in zip(*chunk):
                    x, y = known[a, hash(ta)], known[b, hash(tb)]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(keep)).filter(mask) for i in (0, 1)], ["a", "b"])
                if len(known) > 2000:
                    known.clear()

    small_batches(pairs.sparkSession)
    rows = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"))
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(work, "a bigint, b bigint").distinct()


GRAMS = "item bigint, component bigint, n bigint, copy bigint, gram bigint"


def rare_prefixes(items: DataFrame, texts: DataFrame, k: int, limit: float) -> DataFrame:
    """bucket (a shingle), item, component, n (size of the set), place: the rarest shingles of each item's set, rarest first.

    items: item, component, each once. Shingles that only one component holds come first: no pair of different components shares
    them. The others follow by the number of items that hold them. Two sets that reach the limit share one of their first
    n - limit * n + 1 shingles in any order common to all, so leaving out the rest, and what nobody else holds, loses no pair.
    """
    percent = round(100 * limit)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, doc, grams in shingles(batch.column(2).to_pylist(), k):
                size, total = np.bincount(doc, minlength=n), np.zeros(n, np.uint64)
                np.add.at(total, doc, mix(grams + np.uint64(77)))
                item, component = (batch.column(i).to_numpy()[first:first + n] for i in (0, 1))
                for low in range(0, len(doc), 1 << 16):
                    at = doc[low:low + (1 << 16)]
                    columns = [item[at], component[at], size[at], total.view(np.int64)[at], grams[low:low + (1 << 16)].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "component", "n", "copy", "gram"])

    small_batches(items.sparkSession)
    rows = texts.withColumnRenamed("doc_id", "item").join(items, "item").select("item", "component", "text")
    grams = spool(rows.mapInArrow(work, GRAMS), "open-shingles")
    mixed = grams.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held"))
    met = grams.join(mixed.filter("low < high").select("gram", "held"), "gram")
    own = Window.partitionBy("item", "copy")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "gram")) - 1
    return (met.withColumn("place", place).filter(f"place < n - (n * {percent} + 99) div 100 + 1")
            .select(F.col("gram").alias("bucket"), "item", "component", "n", "place"))


def near_duplicates(docs: DataFrame, k: int = 5, limit: float = 0.8, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id), for each row of `docs` (doc_id, text).

    Two documents are linked if their sets of k-word shingles have a Jaccard similarity of `limit` or more. Null and empty
    texts and texts without words have empty sets and no links. Rows with the same doc_id are one document, and each has its row;
    a null doc_id is alone, with a null component, and kept. Other columns are not read.

    Documents with equal sets are one class before all else. Classes that share a band meet one lead of that band in each of the
    first `rounds` rounds. What is then still in a band with other components meets by the rarest shingles of whole sets, under the
    prefix, length and positional filters, so neither a large group of near copies nor copies a little too far apart cost pairs.
    """
    sketches = spool(sketch_documents(docs, k), "sketches")
    full = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = full.select("doc_id", "set_hash", "n_shingles").join(classes, ["set_hash", "n_shingles"]).select("doc_id", "rep").distinct()
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "set_hash", "n_shingles"), ["doc_id", "set_hash", "n_shingles"], "left_semi")
    bands = reps.dropDuplicates(["doc_id", "set_hash"]).select(
        "doc_id", "n_shingles", F.posexplode("sketch")).select("doc_id", F.col("n_shingles").alias("n"), F.xxhash64("pos", "col").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    bands = spool(bands.join(shared, "band", "left_semi"), "bands")
    near = bands.select("doc_id").distinct()
    some = spool(reps.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id", "set_hash"]).drop("set_hash"), "candidates")
    texts = spool(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(near, "doc_id", "left_semi"), "candidate-texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        return confirmed(spool(likely(pairs.select("a", "b").distinct(), some, limit), "pairs"), texts, k, limit)

    def narrow(open_: DataFrame) -> DataFrame:
        return rare_prefixes(open_.select("item", "component").distinct(), texts, k, limit)

    percent = round(100 * limit)
    close = F.expr(f"least(n_x, n_y) * 100 >= greatest(n_x, n_y) * {percent}")
    ahead = F.expr(f"least(n_x - place_x, n_y - place_y) * {100 + percent} >= (n_x + n_y) * {percent}")
    joined = link_groups(bands.select(F.col("band").alias("bucket"), F.col("doc_id").alias("item"), "n"), links_of, rounds,
                         close=close, narrow=narrow, near=close & ahead)
    groups = member.join(joined.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"))
    return (sketches.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, k: int = 5, limit: float = 0.8) -> DataFrame:
    """The rows of `docs` whose document is the least of its group, with the columns of `docs`. Rows without an id stay."""
    gone = near_duplicates(docs, k, limit).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone_id"], "left_anti")
