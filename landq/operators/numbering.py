"""Document numbers for records made from extracted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = ["registration_number", "order_number", "document_number", "mutation_number"]


def pick_document_number(documents: DataFrame, taken: DataFrame | None = None, prefix: str = "DOC-") -> DataFrame:
    """The first candidate with a digit, else the first present one, else a number made from the id.

    Of documents with one number the lowest id keeps it, unless `taken` (document_number) holds it already; the others
    get a suffix made from their id. Made parts have 128 bits, so numbers stay unique at any number of documents. The lowest id per number is a grouped minimum joined back, not a window, so a
    number that very many documents share is no single task's work.
    """
    present = F.filter(F.array(*CANDIDATES), lambda c: c.isNotNull() & ~F.lower(F.trim(c)).isin("not found", "none", "null", ""))
    made = F.upper(F.sha2(F.col("id").cast("string"), 256))
    picked = documents.select("id", F.trim(F.coalesce(
        F.get(F.filter(present, lambda c: c.rlike("[0-9]")), F.lit(0)), F.get(present, F.lit(0)),
        F.concat(F.lit(prefix), F.substring(made, 1, 32)))).alias("number"))
    first = picked.groupBy("number").agg(F.min("id").alias("first_id"))
    if taken is not None:
        known = taken.select(F.col("document_number").alias("number")).distinct().withColumn("known", F.lit(True))
        first = first.join(known, "number", "left").withColumn("first_id", F.when(F.col("known").isNull(), F.col("first_id"))).drop("known")
    joined = picked.join(first, "number")
    own = F.coalesce(F.col("id") == F.col("first_id"), F.lit(False))
    return joined.select("id", F.when(own, F.col("number")).otherwise(
        F.concat("number", F.lit("-"), F.substring(made, 1, 32))).alias("document_number"))
