"""Lookups against a registry: "the first other row that ...", without pairing up the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq import dims

SMALL_GROUP = 32


def lowest_two(df: DataFrame, keys: list[str], entry: str) -> DataFrame:
    """Per key the two entries with the lowest `entry.id`, as the array `firsts`.

    The row-number filter becomes a group limit ahead of the shuffle, so each task sends at most two rows per key
    however hot the key is. Two are enough to find the first row that is not a given one.
    """
    window = Window.partitionBy(*keys).orderBy(F.col(entry)["id"])
    ranked = df.select(*keys, entry, F.row_number().over(window).alias("rn")).where("rn <= 2")
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("firsts"))


def other_than(firsts: str, own_id: Column) -> Column:
    """The first entry of `firsts` whose id differs from `own_id` (NULL own id: the first one)."""
    return F.get(F.filter(firsts, lambda e: ~e["id"].eqNullSafe(own_id)), F.lit(0))


def first_equal(incoming: DataFrame, registry: DataFrame, key: Column | str, payload: list[str] = (),
                registry_key: Column | str | None = None, own_id: str = "id") -> DataFrame:
    """Incoming rows that have another registry row with an equal key; `match` is the one with the lowest id."""
    key = F.col(key) if isinstance(key, str) else key
    registry_key = key if registry_key is None else registry_key
    registry_key = F.col(registry_key) if isinstance(registry_key, str) else registry_key
    entries = registry.select(registry_key.alias("k"), F.struct("id", *payload).alias("entry")).where("k is not null")
    found = lowest_two(entries, ["k"], "entry")
    joined = incoming.withColumn("k", key).join(found, "k").withColumn("match", other_than("firsts", F.col(own_id)))
    return joined.where("match is not null").drop("k", "firsts")


def first_containing(incoming: DataFrame, registry: DataFrame, key: Column | str, text: str, payload: list[str] = (),
                     small_group: int = SMALL_GROUP, own_id: str = "id", blank_finds_null: bool = False) -> DataFrame:
    """Incoming rows with another registry row of the same key whose `text` contains the incoming `text`.

    Case is ignored; `match` is the matching registry row with the lowest id. A NULL text contains nothing, or with
    `blank_finds_null` the blank incoming text, which then asks for the key alone. Both sides are first reduced to their
    distinct (key, text), so copies cost nothing. Keys with few distinct registry texts compare directly. For the
    others every registry text is cut into the pieces that have the length of some incoming text of that key, and
    pieces meet incoming texts by an equi join: the work grows with the texts, not with their pairs.
    """
    key = F.col(key) if isinstance(key, str) else key
    hay = F.coalesce(F.col(text), F.lit("")) if blank_finds_null else F.col(text)
    hay_rows = registry.select(key.alias("k"), F.lower(hay).alias("hay"), F.struct("id", *payload).alias("entry"))
    hays = lowest_two(hay_rows.where("k is not null and hay is not null"), ["k", "hay"], "entry")
    keyed = incoming.withColumn("k", key).withColumn("needle", F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))))
    needles = keyed.where("k is not null").select("k", "needle").distinct()
    sizes = hays.groupBy("k").agg(F.count("*").alias("texts"))

    sized = hays.join(sizes, "k")
    direct = (sized.where(F.col("texts") <= small_group).join(needles, "k")
              .where(F.contains("hay", "needle")).select("k", "needle", F.explode("firsts").alias("entry")))

    lengths = needles.groupBy("k").agg(F.collect_set(F.length("needle")).alias("lengths"))
    pieces = F.flatten(F.transform(
        F.filter("lengths", lambda n: n <= F.length("hay")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("hay") - n + 1), lambda i: F.substr(F.col("hay"), i, n))))
    cut = (sized.where(F.col("texts") > small_group).join(lengths, "k")
           .select("k", F.explode(F.array_distinct(pieces)).alias("needle"), "firsts")
           .select("k", "needle", F.explode("firsts").alias("entry")))
    indexed = (lowest_two(cut, ["k", "needle"], "entry").join(needles, ["k", "needle"])
               .select("k", "needle", F.explode("firsts").alias("entry")))

    found = lowest_two(direct.unionByName(indexed), ["k", "needle"], "entry")
    joined = keyed.join(found, ["k", "needle"]).withColumn("match", other_than("firsts", F.col(own_id)))
    return joined.where("match is not null").drop("k", "needle", "firsts")


def not_blank(column: str) -> Column:
    """The value, or NULL where it is empty or only spaces."""
    return F.nullif(F.trim(column), F.lit(""))


def found(column: str) -> Column:
    """True where the value is neither NULL, empty nor the not-found word."""
    return F.coalesce(~F.col(column).isin("", dims.NOT_FOUND), F.lit(False))
