"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.llm.common import drop_spools, spool
from landq.session import checkpointed


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour: the greater ones (large star), or the smaller ones and itself (small star)."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (least node that it reaches), for each node with a link. links: a, b; loops and repeated links do no harm.

    Edges stay in tables of the shared folder; only their count and a sum of hashes reach the driver.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.expr("sum(xxhash64(a, b) % 1000000007)")).first()
        if mark == seen or not mark[0]:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                edges.select("b", "b").distinct()).groupBy("node").agg(F.min("component").alias("component"))
        seen = mark
        edges = checkpointed(star(star(edges, True), False))


def link_groups(buckets: DataFrame, links_of: Callable[[DataFrame], DataFrame], rounds: int = 2,
                close: Column | None = None, small: int = 0, narrow: Callable[[DataFrame], DataFrame] | None = None,
                near: Column | None = None) -> DataFrame:
    """Components of the links among items that share a bucket: node, component.

    buckets: bucket, item, and columns that `links_of` wants of either side, with suffixes _a and _b. `links_of` gets candidate
    pairs (a < b, once for each bucket that brought them) and returns the links among them (a, b). `close` is a condition on
    the columns with suffixes _x and _y without which a bucket doesn't make a pair. With `small`, buckets have a column `size`:
    in those of at most `small` items all meet in the first round, and they are done with; at that size pairs grow as the items.

    In each of the first `rounds` rounds the items of a bucket meet one lead of it. After that only items of different components
    meet all others of their bucket. `narrow` may deal those anew for that: it gets bucket, item, component and the other columns,
    and returns bucket, item, component and what `near` (a condition like `close`) wants, so that items which may be linked and
    are of different components still share a bucket; `links_of` then has only a and b. So a large group of like items costs rounds, not pairs, and no link between components is lost.
    """
    extra = [c for c in buckets.columns if c not in ("bucket", "item", "size")]
    close = F.lit(True) if close is None else close
    joined, few = None, None
    if small:
        few, buckets = buckets.filter(F.col("size") <= small), buckets.filter(F.col("size") > small)
    for turn in range(rounds + 1):
        open_ = buckets.withColumn("component", F.col("item"))
        if joined is not None:
            open_ = buckets.join(joined.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
            mixed = open_.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
            open_ = dealt = spool(open_.join(mixed.select("bucket"), "bucket", "left_semi"), "open")
            if open_.isEmpty():
                drop_spools(open_)
                break
        if turn == rounds and narrow is not None:
            open_, extra, close = spool(narrow(open_), "narrowed"), [], F.lit(True) if near is None else near
        columns = [c for c in open_.columns if c not in ("bucket", "size")]
        left, right = ([F.col(c).alias(f"{c}_{s}") for c in columns] for s in "xy")

        def all_pairs(some: DataFrame) -> DataFrame:
            return some.select("bucket", *left).join(some.select("bucket", *right), "bucket").filter(
                close & F.expr("component_x <> component_y and item_x < item_y"))

        if turn < rounds:
            order = F.col("item") if turn == 0 else F.xxhash64("item", F.lit(turn))
            lead = open_.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "item", "component", *extra)).alias("lead"))
            others = lead.select("bucket", *[F.col(f"lead.{c}").alias(f"{c}_y") for c in ["item", "component", *extra]])
            pairs = open_.select("bucket", *left).join(others, "bucket").filter(close & F.expr("component_x <> component_y"))
        else:
            pairs = all_pairs(open_)
        if turn == 0 and few is not None:
            pairs = pairs.unionByName(all_pairs(few.withColumn("component", F.col("item"))))
        first = F.col("item_x") < F.col("item_y")
        sides = [F.when(first, F.col(f"{c}_{p}")).otherwise(F.col(f"{c}_{q}")).alias(n)
                 for s, p, q in (("a", "x", "y"), ("b", "y", "x")) for c, n in [("item", s), *[(e, f"{e}_{s}") for e in extra]]]
        found = spool(links_of(pairs.select("bucket", *sides)), "links")
        known = found if joined is None else found.union(joined)  # what earlier links have joined, as one link for each item
        before, joined = joined, spool(components(known), "components")
        drop_spools(found, before, dealt if turn else None)
    return joined
