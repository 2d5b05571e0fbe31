"""Document fingerprints by SpotSigs: chains of content words that follow common words, compared by pruned Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool

#: Common words of English, German, French and Spanish that start a chain and are left out of chains.
ANCHORS = ("the a an and of to in is that it for on as with was by this be or are at from "
           "der die das und ein eine ist zu den von mit für auf im nicht des dem "
           "le la les de et un une est que pour dans en du au qui sur "
           "el los las y del se por con para lo su es").split()
#: Content words of a chain behind a common word; common words between them are skipped, however many.
CHAIN = 2
#: Of the pairs of neighbouring words (any words) those whose hash falls on 0 of these classes are signatures too, at every length:
#: they stand for texts, and parts of texts, without common words.
PAIR_CLASSES = 3
#: Sets whose lengths alone keep their likeness under this are not compared: their likeness is 0.
LEAST = 0.5
WORD, GAP = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]++"
COMMON = "(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}])"
STARTS = r"(?<![\p{L}\p{N}])"
#: The last common word of a run starts a chain, those before it would start the same one. The chain begins with its first content word.
ANCHORED = f"{STARTS}{COMMON}{GAP}(?!{COMMON})(?=({WORD}(?:{GAP}(?:{COMMON}{GAP})*+(?!{COMMON}){WORD}){{{CHAIN - 1}}}))"
PAIRS = f"{STARTS}(?=({WORD}{GAP}{WORD}))"
SKIPPED = f"{GAP}(?:{COMMON}{GAP})*+"


def with_signatures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """`docs` with the signature set of column `text`: hashes of its chains and of its chosen pairs, ascending, each once.

    A text without signatures has its own hash, an empty one none. Each step is a column, so that no search runs twice.
    """
    def found(pattern: str, between: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda c: F.hash(F.regexp_replace(c, between, " ")))

    chains, pairs = f"{name}_chains", f"{name}_pairs"
    steps = docs.withColumn(chains, found(ANCHORED, SKIPPED)).withColumn(pairs, found(PAIRS, GAP))
    chosen = F.filter(pairs, lambda h: F.pmod(h, F.lit(PAIR_CLASSES)) == 0)
    steps = steps.withColumn(name, F.array_sort(F.array_distinct(F.concat(chains, chosen)))).drop(chains, pairs)
    own = F.when(F.col(text) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    return steps.withColumn(name, F.when(F.size(name) == 0, own).otherwise(F.col(name)))


def length_class(sets: Column, limit: float = LEAST) -> Column:
    """Partition by set length: sets of a similarity of `limit` or more are in the same partition or in neighbouring ones."""
    return F.when(F.size(sets) == 0, -1).otherwise(F.floor(F.log(F.size(sets).cast("double")) / F.log(F.lit(1 / limit)) + 1e-9).cast("int"))


def pruned_jaccard(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two signature sets; 0 where their partitions or lengths keep it under `least`. Two empty sets are equal."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    apart = F.abs(length_class(a, least) - length_class(b, least)) > 1
    return (F.when(large == 0, 1.0).when((small == 0) | apart | (small < F.lit(float(least)) * large), 0.0)
            .otherwise(both / (small + large - both)))


def fingerprint(sets: Column, limit: float = LEAST) -> Column:
    """Text form: the length partition, then the signatures in hexadecimal, ascending."""
    return F.concat(length_class(sets, limit).cast("string"), F.lit(":"), F.array_join(F.transform(sets, lambda s: F.hex(s.cast("bigint").bitwiseAND(0xFFFFFFFF))), "."))


def next_of(sizes: DataFrame) -> DataFrame:
    """doc_id, n_chars, prev_id, prev_n: the ring of documents in ascending doc_id, the last before the first.

    Ids are dealt out by range; each part looks at its own rows, and at the last row of the part before. One task sees a row for each part.
    """
    placed = spool(sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ring")
    lasts = placed.groupBy("part").agg(F.max(F.struct("doc_id", "n_chars")).alias("last"))
    order = Window.orderBy("part")
    top = F.max("last").over(Window.partitionBy())
    carried = lasts.select("part", F.coalesce(F.lag("last").over(order), top).alias("carried"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    before = F.coalesce(F.lag(F.struct("doc_id", "n_chars")).over(inside), F.col("carried"))
    return placed.join(carried, "part").withColumn("before", before).select(
        "doc_id", "n_chars", F.col("before.doc_id").alias("prev_id"), F.col("before.n_chars").alias("prev_n"))


def one_each(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text) with one row for each doc_id: the least of its texts. Where no id repeats, no text moves."""
    again = spool(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    return rows.join(again, "doc_id", "left_anti").unionByName(
        rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def fingerprint_edits(docs: DataFrame, limit: float = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, length_class.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document, in ascending doc_id, after the last the first; a single document is its own next. Null texts are empty. Rows with
    the same doc_id count as one document with the least of their texts. A document without doc_id has an empty next text and
    is nobody's next. Two empty texts are alike (1), an empty and another are not (0). Likeness is the Jaccard similarity of the
    signatures, 0 where the lengths of the sets keep it under `limit`. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    # A new name for an id that is a bigint already would keep the two uses of the exchange below from being the same plan.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    named = one_each(rows.filter("doc_id is not null"))
    unnamed = rows.filter("doc_id is null").groupBy("doc_id").agg(F.min("text").alias("text"))
    own = spool(with_signatures(named, "text", "sets").select("doc_id", F.length("text").alias("n_chars"), "sets"), "signatures")
    ring = spool(next_of(own.select("doc_id", "n_chars")), "ring-sizes")
    after = own.join(ring, "doc_id").select(F.col("prev_id").alias("doc_id"), F.col("sets").alias("next_sets"))
    near = spool(own.join(after, "doc_id").select("doc_id", pruned_jaccard(F.col("sets"), F.col("next_sets"), limit).alias("near_next")), "near-next")
    whole = named.repartition("doc_id")  # the one exchange of whole texts, which both uses below share
    heads = whole.join(ring.select("doc_id", "prev_id", "prev_n"), "doc_id").select(
        F.col("prev_id").alias("doc_id"), F.expr("left(text, prev_n div 4)").alias("head"))
    alone = with_signatures(unnamed, "text", "sets").withColumns({"head": F.lit(""), "near_next": F.when(F.col("text") == "", 1.0).otherwise(0.0)})
    joined = whole.join(heads, "doc_id").join(own.select("doc_id", "sets"), "doc_id").join(near, "doc_id").unionByName(alone)
    edited = joined.select("doc_id", "sets", F.length("text").cast("bigint").alias("n_chars"), "near_next",
                           F.expr("concat(left(text, length(text) - length(text) div 4), left(head, length(text) div 4))").alias("edited"))
    final = with_signatures(edited, "edited", "edited_sets")
    return final.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sets"), limit).alias("fingerprint"),
                        fingerprint(F.col("edited_sets"), limit).alias("edited_fingerprint"),
                        pruned_jaccard(F.col("sets"), F.col("edited_sets"), limit).alias("near_edited"),
                        "near_next", length_class(F.col("sets"), limit).alias("length_class"))
