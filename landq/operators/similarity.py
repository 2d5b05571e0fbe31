"""Which items have a similar partner: near-equal texts and near-equal image hashes, exactly and without caps.

Both problems reduce to "items that share a key may be similar; verify". Only whether a partner exists is wanted, so
the items of an overfull key meet one lead of it, which settles groups of near copies; if some stay open, the key is
lengthened until its keys are small enough for all their items to meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.text import let
from landq.session import checkpointed, discard, transient_shuffles, written

#: Items of a key that all meet, and how often an overfull key is lengthened; at the last length all meet whatever their number.
FULL, LENGTHS = 64, 6


def partnered(postings: DataFrame, light: list[str], fits: Callable[[str, str, int], Column], lengthen: Callable[[DataFrame, int], DataFrame],
              full: int = FULL, lengths: int = LENGTHS) -> DataFrame:
    """Ids (`gid`) of the items that have a similar item.

    `postings` has gid, key and the `light` columns. `fits` tests a pair that shares a key on those, given the prefixes of
    the two sides and the length of the key (from 1 on). `lengthen` gives postings with longer keys for those of overfull keys: a similar pair
    that shares a key must share a longer one, too.
    """
    def side(df: DataFrame, prefix: str, *more: str) -> DataFrame:
        return df.select(*[F.col(c).alias(prefix + c) for c in ["gid", *light]], *more)

    settled = None
    for level in range(1, lengths + 1):
        postings = written(postings.select("gid", "key", *light), "postings")
        keys = postings.groupBy("key").agg(F.count("*").alias("n"), F.min_by(F.struct("gid", *light), "gid").alias("lead")).where("n > 1")
        keys = checkpointed(keys.withColumn("all", (F.col("n") <= full) | F.lit(level == lengths)))
        members = postings.join(keys.select("key", "all"), "key")
        few, many = members.where("all"), members.where("not all")
        leads = keys.where("not all").select("key", F.col("lead.gid").alias("a_gid"), *[F.col(f"lead.{c}").alias(f"a_{c}") for c in light])
        pairs = side(few, "a_", "key").join(side(few, "b_", "key"), "key").where("a_gid < b_gid").unionByName(
            leads.join(side(many, "b_", "key"), "key").where("a_gid <> b_gid"))
        pairs = pairs.where(fits("a_", "b_", level))
        found = pairs.select(F.explode(F.array("a_gid", "b_gid")).alias("gid")).distinct()
        settled = checkpointed(found if settled is None else settled.unionByName(found).distinct())
        if level == lengths or keys.where("not all").isEmpty():
            return settled
        open_ = many.join(settled, "gid", "left_anti").select("key").distinct()
        postings = lengthen(many.join(open_, "key", "left_semi"), level)
    return settled


def grouped_copies(documents: DataFrame, signature: Column, payload: list[str]) -> DataFrame:
    """Documents reduced to their distinct signatures: `gid`, payload, and whether several owners hold a copy.

    A document belongs to its record, or to itself without one. `only` is the owner where there is just one.
    """
    owner = F.coalesce(F.concat(F.lit("r"), F.col("land_record_id").cast("string")), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    low, high = F.min("owner"), F.max("owner")
    groups = (documents.withColumn("signature", signature).withColumn("owner", owner).groupBy("signature").agg(
        F.min("doc_id").alias("gid"), F.min_by(F.struct(*payload), "doc_id").alias("p"), low.alias("low"), high.alias("high")))
    return groups.select("signature", "gid", "p.*", (F.col("low") != F.col("high")).alias("shared"),
                         F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))


def different_owner(a: str, b: str) -> Column:
    return F.coalesce(F.col(f"{a}only") != F.col(f"{b}only"), F.lit(True))


def _documents_with_partner(documents: DataFrame, groups: DataFrame, signature: Column, partners: DataFrame) -> DataFrame:
    hit = groups.join(partners.withColumn("near", F.lit(True)), "gid", "left").where("shared or near").select("signature")
    return documents.withColumn("signature", signature).join(hit, "signature", "left_semi").select("doc_id", "land_record_id")


def word_set(column: str) -> Column:
    """Hashes of the different words of a text, ascending."""
    words = F.array_remove(F.split(F.lower(F.trim(column)), r"\s+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


#: Counters that words are counted in by hash. Only the order of words depends on them, never which texts are similar.
COUNTERS = 1 << 18


def counter(word: Column) -> Column:
    return F.pmod(word, F.lit(COUNTERS)).cast("int")


def rarity(sets: DataFrame) -> Column:
    """Array of how often the words of each counter occur in `words`, on a scale of logarithms.

    COUNTERS small numbers, whatever the input, as a literal of the tasks: no text's words are shuffled to be ranked.
    """
    counts = sets.select(F.explode("words").alias("word")).groupBy(counter(F.col("word")).alias("counter")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(127.0), 6 * F.log2("n")).cast("tinyint")
    every = sets.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("counter"))
    levels = every.join(counts, "counter", "left").select(F.struct("counter", F.coalesce(level, F.lit(0).cast("tinyint")).alias("level")).alias("x"))
    text = levels.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["level"].cast("string")), ",")).first()[0]
    return F.split(F.lit(text), ",").cast("array<tinyint>")


#: Bits of the map that most of what a join would drop is left out by before.
MAP_BITS = 1 << 22


def among(some: DataFrame, column: str) -> Column:
    """True where `column` is one of those in `some`, and for a few others: a map of MAP_BITS bits, as a literal of the tasks."""
    bit = F.pmod(F.xxhash64(column), F.lit(MAP_BITS))
    part, mask = F.shiftright(bit, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))
    marks = some.select(part.alias("part"), mask.alias("mask")).groupBy("part").agg(F.bit_or("mask").alias("mask"))
    every = some.sparkSession.range(MAP_BITS // 64).select(F.col("id").cast("int").alias("part")).join(marks, "part", "left")
    text = every.select(F.struct("part", F.coalesce("mask", F.lit(0)).alias("mask")).alias("x")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["mask"].cast("string")), ",")).first()[0]
    return F.get(F.split(F.lit(text), ",").cast("array<bigint>"), part).bitwiseAND(mask) != 0


def by_rarity(levels: Column) -> Column:
    """`words` from rare to common, the same order in all texts."""
    ordered = F.sort_array(F.transform("words", lambda w: F.struct(F.get(levels, counter(w)).alias("level"), w.alias("word"))))
    return F.transform(ordered, lambda x: x["word"])


def rarity_ranks(levels: Column) -> Column:
    """`words` from rare to common as plain numbers, which sort fast: the level, then 56 bits of the word's hash.

    Good for keys only: words that agree in those bits look alike, so sets meet in vain.
    """
    return F.sort_array(F.transform("words", lambda w: F.call_function("shiftleft", F.get(levels, counter(w)).cast("bigint"), F.lit(56)).bitwiseOR(
        F.shiftrightunsigned(w, 8))))


#: Most words of a key.
LONGEST = 5


def smallest(threshold: float, words: int) -> int:
    """Size from which on two similar sets, ordered alike, always have so many neighbours in common.

    Of `d` words that only one of the sets has, each parts what is common once, and they leave c - d (words - 1) >= words. In a set
    of n the words before the first such neighbours, and those it lacks, are fewer than words (1 - t) n (see `prefix_keys`).
    """
    def enough(n: int) -> bool:
        return n - (math.ceil(words * (1 - threshold) * n - 1e-6) - 1) >= words
    n = math.ceil(words / (1 - words * (1 - threshold)))  # enough from here on
    while n > 1 and enough(n - 1):
        n -= 1
    return n


def key_lengths(threshold: float) -> list[int]:
    """How many neighbours a key has, at first and where keys are overfull; 1, an exact prefix filter, for low thresholds.

    Sets that differ are similar only if they have more than 1 / (1 - t) words together, so the first length must do for those.
    """
    fit = [g for g in range(2, LONGEST + 1) if g * (1 - threshold) < 0.95 and g - 1 <= g * threshold]
    return fit if fit and smallest(threshold, fit[0]) <= least_words(threshold) else [1, *fit]


def least_words(threshold: float) -> int:
    return math.floor(1 / (1 - threshold) - 1e-6) if threshold < 1 else 1


def prefix_keys(words: Column, size: Column, threshold: float, length: int) -> Column:
    """Hashes of `length` neighbours in `words`, from the first on, so many that similar sets share one.

    Say the first shared neighbours stand behind a words that only this set has and b that only the other has. Runs of common words
    between those are shorter than `length`, so a + (a + b) (length - 1) words stand before them at most. Of similar sets, a + t b is
    under (1 - t) n, and so that is under length (1 - t) n if (length - 1) / t <= length.
    """
    last = F.least(size - length, F.floor(size * F.lit(length * (1 - threshold)) + 1e-6).cast("int"))
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(length)])))


def similar_texts(documents: DataFrame, text: str = "ocr_raw_text", threshold: float = 0.85, min_chars: int = 50,
                  full: int = FULL) -> DataFrame:
    """Documents (doc_id, land_record_id) whose word set has a Jaccard similarity above the threshold with another's.

    Equal word sets are grouped first. With words ordered from rare to common, similar sets share neighbours in that order among
    their first ones (`prefix_keys`); these are the keys. All sets of a key meet its lowest one, which settles near copies. Those still
    open meet the others of their keys; of keys with more than `full` sets only the small ones do, and the rest get longer keys. Word
    sets are written once and fetched for pairs only that pass by size and place.
    """
    transient_shuffles(documents.sparkSession)
    usable = documents.where(F.length(F.trim(text)) > min_chars).select("doc_id", "land_record_id", word_set(text).alias("words"))
    usable = usable.where(F.size("words") > 0)
    usable = written(usable.select("doc_id", "land_record_id", "words", F.size("words").alias("n"), F.concat_ws(
        ":", F.xxhash64("words"), F.xxhash64(F.lit(1), "words")).alias("code")), "word-sets")
    signature = F.col("code")
    groups = written(grouped_copies(usable.drop("words"), signature, ["n"]), "text-groups")
    ranked, lengths = rarity_ranks(rarity(usable)), key_lengths(threshold)
    chosen = groups.where(F.col("n") >= least_words(threshold)).select("gid", F.col("signature").alias("code"))
    settled = None

    def sets_of(ids: DataFrame, value: Column) -> DataFrame:
        """`value` of the word sets of the groups in `ids` (gid, code). Where those are few, most others don't reach the join."""
        sets = usable.select(F.col("doc_id").alias("gid"), "code", "n", "words")
        if ids is chosen:
            return sets.select("gid", "code", value.alias("value")).join(ids, ["gid", "code"], "left_semi").select("gid", "value")
        return sets.where(among(ids, "code")).join(ids, ["gid", "code"], "left_semi").select("gid", value.alias("value"))

    def fits(length: int) -> Column:
        """Sizes are close enough, and enough words can be common before the shared neighbours and from them on.

        The first neighbours that similar sets share pass: see `prefix_keys` for what stands before them.
        """
        a, b = F.col("a.pos"), F.col("b.pos")
        small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
        before = F.least(F.floor((a + b) * (length - 1) / (2 * length - 1)), a, b)
        needed = F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n"))
        owners = F.coalesce(F.col("a.only") != F.col("b.only"), F.lit(True))
        return ((F.col("a.gid") != F.col("b.gid")) & (small > F.lit(threshold) * large) & owners
                & (before + F.least(F.col("a.n") - a, F.col("b.n") - b) + 1e-6 >= needed))

    def settle(pairs: DataFrame) -> DataFrame:
        """Ids settled so far and of the pairs that are similar."""
        pairs = checkpointed(pairs.select(F.least("a.gid", "b.gid").alias("a_gid"), F.greatest("a.gid", "b.gid").alias("b_gid")).distinct())
        asked = pairs.select(F.explode(F.array("a_gid", "b_gid")).alias("gid")).distinct()
        sets = sets_of(checkpointed(chosen.join(asked, "gid", "left_semi")), F.col("words"))
        met = pairs.join(sets.select(F.col("gid").alias("a_gid"), F.col("value").alias("a")), "a_gid").join(
            sets.select(F.col("gid").alias("b_gid"), F.col("value").alias("b")), "b_gid")
        common = F.size(F.array_intersect("a", "b"))
        similar = met.where(common / (F.size("a") + F.size("b") - common) > threshold)
        found = similar.select(F.explode(F.array("a_gid", "b_gid")).alias("gid")).distinct()
        return checkpointed(found if settled is None else settled.unionByName(found).distinct())

    some = chosen
    for length, longer in zip(lengths, [*lengths[1:], None]):
        keys = sets_of(some, F.when(F.col("n") >= length, prefix_keys(ranked, F.col("n"), threshold, length)))
        keys = written(keys.select("gid", F.posexplode("value").alias("pos", "key")), "keys")
        shared = keys.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
        members = keys.join(shared, "key").join(groups.select("gid", "n", "only"), "gid")
        members = written(members.select("key", "sets", F.struct("gid", "pos", "n", "only").alias("set")), "shared-keys")
        discard(keys)
        leads = members.groupBy("key").agg(F.min("set").alias("a"))
        settled = settle(leads.join(members.select("key", F.col("set").alias("b")), "key").where(fits(length)))
        still = members.where("sets > 2").join(settled, F.col("set.gid") == settled["gid"], "left_anti")
        meet = still.select("key", "sets", F.col("set").alias("a")).join(members.select("key", F.col("set").alias("b")), "key")
        if longer is not None:
            meet = meet.where((F.col("sets") <= full) | (F.least("a.n", "b.n") < smallest(threshold, longer)))
        settled = settle(meet.where(fits(length)))
        if longer is None:
            break
        crowded = still.where(F.col("sets") > full).join(settled, F.col("set.gid") == settled["gid"], "left_anti").select("key").distinct()
        ids = checkpointed(members.join(crowded, "key", "left_semi").select("set.gid").distinct())
        if ids.isEmpty():
            break
        some = checkpointed(chosen.join(ids, "gid", "left_semi"))
    return _documents_with_partner(usable, groups, signature, settled)


def band_keys(bands: int, spare: int) -> Column:
    """Keys for 64-bit hashes in two halves `hi`, `lo`: every choice of bands - spare equal bands."""
    edges = [round(i * 64 / bands) for i in range(bands + 1)]

    def band(i: int) -> Column:
        start, stop = edges[i], edges[i + 1]
        parts = []
        for half, base in (("hi", 0), ("lo", 32)):
            a, b = max(start, base), min(stop, base + 32)
            if a < b:
                parts.append(F.shiftright(half, base + 32 - b).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("string"))
        return F.concat_ws(".", *parts)
    return F.array(*[F.struct(F.xxhash64(F.lit(",".join(map(str, chosen))), *[band(i) for i in chosen]).alias("key")) for chosen in combinations(range(bands), bands - spare)])


def bands_for(rows: int, distance: int = 6) -> int:
    """Bands whose keys are about as many bits long as rows need to be told apart."""
    need = max(8.0, math.log2(max(rows, 2)) - 4)
    return next(b for b in range(distance + 2, distance + 11) if 64 * (b - distance) / b >= need or b == distance + 10)


def similar_hashes(hashes: DataFrame, distance: int = 6, bands: int | None = None, full: int = FULL) -> DataFrame:
    """Documents (doc_id, land_record_id) whose 64-bit hash is within `distance` bits of another document's.

    Hashes come as two 32-bit halves. Equal hashes are grouped first. Of `bands` bands at most `distance` can differ,
    so similar hashes agree on some bands - distance of them; the number of bands follows the number of hashes. A key with
    more than `full` hashes gets further bits: of distance + 1 parts of the bits, dealt anew at each length, similar hashes
    agree on one at least.
    """
    signature = F.concat_ws(":", "hi", "lo")
    groups = checkpointed(grouped_copies(hashes, signature, ["hi", "lo"]))
    first = groups.select("gid", "hi", "lo", "only", F.inline(band_keys(bands or bands_for(groups.count(), distance), distance)))

    def lengthen(some: DataFrame, length: int) -> DataFrame:
        step = (5, 11, 13, 17, 19, 23)[length % 6]
        parts = [[bit for bit in range(64) if (bit * step % 64) * (distance + 1) // 64 == i] for i in range(distance + 1)]
        masks = [(sum(1 << b - 32 for b in p if b >= 32), sum(1 << b for b in p if b < 32)) for p in parts]
        keys = F.array(*[F.xxhash64("key", F.lit(i), F.col("hi").bitwiseAND(F.lit(h)), F.col("lo").bitwiseAND(F.lit(m)))
                         for i, (h, m) in enumerate(masks)])
        return some.select("gid", "hi", "lo", "only", F.explode(keys).alias("key"))

    def fits(a: str, b: str, _: int) -> Column:
        bits = F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))
        return (bits <= distance) & different_owner(a, b)

    partners = partnered(first, ["hi", "lo", "only"], fits, lengthen, full=full)
    return _documents_with_partner(hashes, groups, signature, partners)


def hash_halves(hex_hash: str) -> list[Column]:
    """`hi` and `lo` of a 16-digit hex hash; NULL for anything else."""
    ok = F.col(hex_hash).rlike("^[0-9a-fA-F]{16}$")

    def half(start: int) -> Column:
        return F.when(ok, F.conv(F.substring(hex_hash, start, 8), 16, 10).cast("bigint"))
    return [half(1).alias("hi"), half(9).alias("lo")]
