"""Language accuracy as a fold over the verification log, in order of time, without folding a language in one task.

A verification moves the accuracy x (in hundredths) of its language to min(9940, x + 5k - 2c), at least 8000, where
k and c are the verifications and corrections so far. Each step clips a shift, and clipped shifts compose to clipped
shifts, so any run of the log is one triple (shift, low, high). The log is range-partitioned by language and time into
even chunks; chunks are folded side by side, in blocks of bounded length, and only triples are folded per language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq import dims
from landq.session import checkpointed

LOW, HIGH = 8000, 9940
BLOCK_ROWS = 10_000


def known_language(column: str = "language_code") -> Column:
    codes = [c for c, _, _ in dims.LANGUAGE_ACCURACY]
    return F.when(F.col(column).isin(codes), F.col(column)).otherwise("en")


def start_state(spark) -> DataFrame:
    rows = [(c, n, a, 0, 0) for c, n, a in dims.LANGUAGE_ACCURACY]
    return spark.createDataFrame(rows, "code string, language string, accuracy bigint, processed bigint, corrections bigint")


def _then(first: Column, second: Column) -> Column:
    """The clipped shift that applies `first`, then `second`."""
    def clip(v: Column) -> Column:
        return F.least(second["hi"], F.greatest(second["lo"], v + second["s"]))
    return F.struct((first["s"] + second["s"]).alias("s"), clip(first["lo"]).alias("lo"), clip(first["hi"]).alias("hi"))


def _fold(steps: Column) -> Column:
    wide = 1 << 60
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(-wide).alias("lo"), F.lit(wide).alias("hi"))
    return F.aggregate(steps, start, lambda a, b: _then(a, b["f"]))


def language_telemetry(log: DataFrame, state: DataFrame | None = None, chunks: int | None = None,
                       order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """Final state per language: code, language, accuracy (hundredths), processed, corrections.

    `log` has language_code, corrections, and the order columns, which must identify a row. `chunks` defaults to the
    number of shuffle partitions.
    """
    spark = log.sparkSession
    state = start_state(spark) if state is None else state
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = log.select(known_language().alias("code"), F.coalesce("corrections", F.lit(0)).cast("bigint").alias("c"), *order)
    placed = checkpointed(events.repartitionByRange(chunks, "code", *order).withColumn("chunk", F.spark_partition_id()))

    totals = placed.groupBy("code", "chunk").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    before = Window.partitionBy("code").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("code", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                            F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    begin = state.select("code", F.col("processed").alias("p0"), F.col("corrections").alias("k0"))
    offsets = offsets.join(begin, "code").select("code", "chunk", (F.col("n0") + F.col("p0")).alias("n0"),
                                                 (F.col("c0") + F.col("k0")).alias("c0"))
    within = Window.partitionBy("code", "chunk").orderBy(*order)
    k = F.row_number().over(within)
    step = placed.select("code", "chunk", *order, k.alias("k"), F.sum("c").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("cc"))
    step = step.join(offsets, ["code", "chunk"]).select(
        "code", "chunk", "k", F.floor((F.col("k") - 1) / BLOCK_ROWS).alias("block"),
        F.struct((5 * (F.col("n0") + F.col("k")) - 2 * (F.col("c0") + F.col("cc"))).alias("s"),
                 F.lit(LOW).cast("bigint").alias("lo"), F.lit(HIGH).cast("bigint").alias("hi")).alias("f"))
    blocks = step.groupBy("code", "chunk", "block").agg(_fold(F.sort_array(F.collect_list(F.struct("k", "f")))).alias("f"))
    folded = blocks.groupBy("code", "chunk").agg(_fold(F.sort_array(F.collect_list(F.struct("block", "f")))).alias("f"))
    per_language = folded.groupBy("code").agg(_fold(F.sort_array(F.collect_list(F.struct("chunk", "f")))).alias("f"))
    grown = totals.groupBy("code").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = state.join(per_language, "code", "left").join(grown, "code", "left")
    moved = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("accuracy") + F.col("f.s")))
    return out.select("code", "language", F.coalesce(moved, F.col("accuracy")).alias("accuracy"),
                      (F.col("processed") + F.coalesce("n", F.lit(0))).alias("processed"),
                      (F.col("corrections") + F.coalesce("c", F.lit(0))).alias("corrections"))
