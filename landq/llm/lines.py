"""Line dedup by an exact set-similarity join: tokens by rarity, keys of neighbours in that order, length and parity filters, Jaccard on whole sets.

Built-in functions only. Token sets are hashed once, into a table of the shared folder that all later steps read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import drop_spools, small_batches, spool
from landq.llm.components import link_groups

#: The operators' default: lines of fewer different tokens (headings, rules, single words) are left alone. The queries take EVERY.
LEAST_TOKENS, EVERY = 4, 1
#: Counters that tokens are counted in by hash. Only the order of tokens depends on them, never which lines are linked.
COUNTERS = 1 << 18
#: Classes of lines that share a key and meet without a lead; more meet leads, then by a second key.
SMALL = 16
BLANKS = "\t\x0b\x0c\r"


def token_set(line: Column) -> Column:
    """Hashes of the different tokens of a line, ascending: runs of characters other than blank and 0x09-0x0D, in lower case."""
    lower = F.lower(line)
    odd = reduce(or_, [F.contains(line, F.lit(c)) for c in BLANKS])
    words = F.when(odd, F.split(lower, r"[\x09-\x0D ]")).otherwise(F.split(lower, " "))
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))))


def line_sets(docs: DataFrame) -> DataFrame:
    """doc_id, copy (tells rows of the same doc_id but different texts apart), line_no, n (different tokens), item (hash of the
    token set), tokens. Lines end at line feeds; a null text has none."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"), F.split("text", "\n").alias("lines"))
    lines = rows.select("doc_id", "copy", F.posexplode("lines").alias("line_no", "line"))
    return lines.select("doc_id", "copy", "line_no", token_set(F.col("line")).alias("tokens")).select(
        "doc_id", "copy", "line_no", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("item"), "tokens")


def counter(token: Column) -> Column:
    return F.pmod(token, F.lit(COUNTERS)).cast("int")


def rarity(lines: DataFrame) -> Column:
    """Array of the levels of all counters: how often their tokens occur in all lines, on a scale of logarithms.

    COUNTERS small numbers, whatever the input. They reach the driver as one string, and the tasks as a literal.
    """
    counts = lines.select(F.explode("tokens").alias("token")).groupBy(counter(F.col("token")).alias("counter")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(127.0), 6 * F.log2("n")).cast("tinyint")
    every = lines.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("counter"))
    levels = every.join(counts, "counter", "left").select(F.struct("counter", F.coalesce(level, F.lit(0).cast("tinyint")).alias("level")).alias("x"))
    text = levels.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["level"].cast("string")), ",")).first()[0]
    return F.split(F.lit(text), ",").cast("array<tinyint>")


def by_rarity(levels: Column) -> Column:
    """The tokens of a line, rarest first, as longs that sort in that order."""
    return F.sort_array(F.transform("tokens", lambda t: F.shiftleft(F.get(levels, counter(t)).cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(t, 8))))


def parted(percent: int) -> str:
    """How many neighbours of a line of n tokens are none in a linked line at most, of those ahead of the first that is."""
    return f"((200 - 2 * {percent}) * n) div 100"


def enough(percent: int) -> str:
    """Whether a line has so many neighbours that any linked line has two of them."""
    return f"n - 1 >= {parted(percent)} + 2"


def keys(order: Column, percent: int) -> Column:
    """Hashes of 40 bits of each two neighbours in the order of rarity, rarest first: two linked lines share one of theirs.

    With a tokens of this line alone and b of the other alone, 2a + b neighbours of this line at most are none of the other. For linked
    lines that is (200 - 2 percent) / 100 * n at most, reached where the other line has nothing else. So the first neighbours of both
    lie behind that many others. One key more is there to narrow crowded buckets. Lines too short for that have their rarest tokens
    as keys too, the usual prefix.
    """
    short = F.shiftrightunsigned  # 40 of 64 bits: few chance meetings also among 10^9 keys, and fewer bytes to move
    near = F.transform(F.slice(order, F.lit(1), F.expr(f"cast(least(n - 1, {parted(percent)} + 2) as int)")),
                       lambda x, i: short(F.xxhash64(x, F.get(order, i + 1)), 24))
    rarest = F.transform(F.slice(order, F.lit(1), F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 as int)")), lambda x: short(F.xxhash64(x), 24))
    return F.when(F.expr(enough(percent)), near).otherwise(F.concat(near, rarest))


def parity(tokens: str, low: int) -> Column:
    """64 bits, each the parity of the tokens that fall on it: two sets differ in as many tokens at least as their bits differ.

    Of 128 places those from `low` on, 0 or 64, are taken."""
    place = lambda t: F.pmod(F.shiftrightunsigned(t, 20), F.lit(128)).cast("int") - low
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda bits, t: F.when(
        place(t).between(0, 63), bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place(t)))).otherwise(bits))


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose whole token sets reach the limit."""
    sides = [sets.select(F.col("item").alias(s), F.col("tokens").alias(f"tokens_{s}")) for s in "ab"]
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(
        100 * both >= percent * (F.size("tokens_a") + F.size("tokens_b") - both)).select("a", "b")


def repeated_lines(docs: DataFrame, limit: float = 0.8, least: int = LEAST_TOKENS) -> DataFrame:
    """doc_id, copy, line_no, group of each line that goes: all lines of a group of linked lines but its first, by doc_id, copy, line_no.

    Two lines are linked if the Jaccard similarity of their token sets is `limit` or more; a group is what links connect. Lines
    with fewer than `least` different tokens stay. Null and empty texts have no such lines. Rows alike in doc_id and text are one.
    """
    small_batches(docs.sparkSession)
    percent = round(100 * limit)
    lines = spool(line_sets(docs), "lines").filter(F.col("n") >= least)
    rows = lines.select("doc_id", "copy", "line_no", "item", "n", parity("tokens", 0).alias("bits"), parity("tokens", 64).alias("more"),
                        by_rarity(rarity(lines)).alias("order")).withColumn("keys", keys(F.col("order"), percent)).drop("order")
    keyed = spool(rows.groupBy("item").agg(F.min(F.struct("doc_id", "copy", "line_no")).alias("first"), F.count("*").alias("lines"),
                                           *[F.first(c).alias(c) for c in ("n", "bits", "more", "keys")]), "line-keys")
    # A set of n can be linked to another one only if n / (n + 1) reaches the limit; smaller ones are linked to equal sets alone.
    able = keyed.filter(f"n * 100 >= (n + 1) * {percent}").select("item", "n", "bits", "more", "keys")
    entries = able.select(F.explode(F.expr(f"slice(keys, 1, size(keys) - cast({enough(percent)} as int))")).alias("bucket"), "item")
    shared = spool(entries.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).filter("size > 1"), "line-shared")
    buckets = spool(shared.join(able.drop("keys"), "item"), "line-buckets")
    crowd = spool(able.select("item", "keys").join(shared.filter(F.col("size") > SMALL).select("item").distinct(), "item", "left_semi"), "line-crowds")
    classes = spool(keyed.drop("keys"), "line-classes")
    drop_spools(shared, keyed)  # the keys are most of what is on disk, and from here on few of them are wanted

    # Lengths m, n need an overlap of limit / (1 + limit) * (m + n), so they differ in (1 - limit) / (1 + limit) * (m + n)
    # tokens at most, and in no more bits.
    close = F.expr(f"least(n_x, n_y) * 100 >= greatest(n_x, n_y) * {percent} and "
                   f"(bit_count(bits_x ^ bits_y) + bit_count(more_x ^ more_y)) * {100 + percent} <= (n_x + n_y) * {100 - percent}")

    def narrowed(open_: DataFrame) -> DataFrame:
        """Each item once for each key behind that of its bucket: linked lines whose first common key is the bucket's share a second one.

        Where that isn't sure for want of keys, the item stays in the bucket itself too."""
        held = open_.join(crowd, "item")
        later = F.transform(F.slice("keys", F.array_position("keys", F.col("bucket")).cast("int") + 1, F.size("keys")), lambda key: F.xxhash64("bucket", key))
        dealt = F.when(F.expr(enough(percent)), later).otherwise(F.concat(F.array("bucket"), later))
        rows = held.select(F.explode(dealt).alias("bucket"), "item", "component")
        own = Window.partitionBy("bucket")
        mixed = rows.withColumn("low", F.min("component").over(own)).withColumn("high", F.max("component").over(own)).filter("low < high")
        return mixed.drop("low", "high").join(classes.select("item", "n", "bits", "more"), "item")

    def links_of(pairs: DataFrame) -> DataFrame:
        near = spool(pairs.select("a", "b").distinct(), "line-pairs")
        items = near.select(F.col("a").alias("item")).union(near.select("b")).distinct()
        wanted = lines.select("item", "tokens").join(items, "item", "left_semi")
        sets = spool(wanted.groupBy("item").agg(F.first("tokens").alias("tokens")), "line-sets")
        links = spool(similar(near, sets, percent), "line-links")
        drop_spools(near, sets)
        return links

    joined = link_groups(buckets, links_of, rounds=2, close=close, small=SMALL, narrow=narrowed, near=close)
    groups = classes.join(joined.withColumnRenamed("node", "item"), "item", "left").withColumn("group", F.coalesce("component", "item"))
    firsts = groups.groupBy("group").agg(F.min("first").alias("head"), F.sum("lines").alias("lines")).filter("lines > 1")
    members = groups.join(firsts, "group").select("item", "group", "head")
    return lines.select("doc_id", "copy", "line_no", "item").join(members, "item").filter(
        "struct(doc_id, copy, line_no) > head").select("doc_id", "copy", "line_no", "group")


def line_report(docs: DataFrame, limit: float = 0.8, least: int = LEAST_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (line numbers from 0, ascending), for each row of `docs` (doc_id, text)."""
    gone = repeated_lines(docs, limit, least).groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"),
                       F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    match = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["copy"] == gone["copy"])
    lines = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return rows.join(gone, match, "left").select(rows["doc_id"], "n_lines", F.size(lines).alias("n_removed"), lines.alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame, limit: float = 0.8, least: int = LEAST_TOKENS) -> DataFrame:
    """`docs` with the lines of `repeated_lines` taken out of `text`; all rows and columns stay, null texts stay null."""
    gone = repeated_lines(docs, limit, least).groupBy(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy")).agg(
        F.collect_set("line_no").alias("gone_lines"))
    match = docs["doc_id"].cast("bigint").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_copy"])
    lines = F.split(docs["text"], "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone["gone_lines"], i))
    text = F.when(gone["gone_lines"].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, match, "left").select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
