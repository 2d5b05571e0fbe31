"""Extraction accuracy over pairs of true and read texts and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.distance import edit_distance

STATUTORY_FIELDS = ["survey_number", "owner_name", "land_area", "registration_number"]


def _rate(distance: Column, length: Column, hypothesis_empty: Column) -> Column:
    return F.when(length == 0, F.when(hypothesis_empty, 0.0).otherwise(1.0)).otherwise(F.round(distance / length * 100, 2))


def character_error_rate(reference: str, hypothesis: str) -> Column:
    ref, hyp = F.trim(reference), F.trim(hypothesis)
    return _rate(edit_distance(ref, hyp), F.length(ref), hyp == "")


def _words(column: str) -> Column:
    return F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")


def word_error_rate(reference: str, hypothesis: str) -> Column:
    """Edit distance of the words, in percent of the reference's words."""
    ref, hyp = _words(reference), _words(hypothesis)
    return _rate(edit_distance(ref, hyp), F.size(ref), F.size(hyp) == 0)


def exact_average(column: str) -> Column:
    """Average to two decimals, independent of the order of rows."""
    return F.round(F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column), 2)


def compared_fields(truth: DataFrame, extracted: DataFrame, key: str = "id") -> DataFrame:
    """True fields (key, field_name, value) with what was read: matched, wrong or absent."""
    read = extracted.select(key, "field_name", F.col("value").alias("read"))
    joined = truth.join(read, [key, "field_name"], "left")
    given = F.coalesce("read", F.lit("")) != ""
    same = given & (F.lower(F.trim("read")) == F.lower(F.trim("value")))
    return joined.withColumn("outcome", F.when(same, "match").when(given, "wrong").otherwise("absent"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(100.0)


def field_scores(compared: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1; a wrong value is a false positive, an absent one a false negative."""
    grouped = compared.groupBy(*by) if by else compared
    out = grouped.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in
                        (("match", "tp"), ("wrong", "fp"), ("absent", "fn"))])
    precision = _percent(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _percent(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(100.0)
    return out.select(*by, "tp", "fp", "fn", F.round(precision, 2).alias("precision"), F.round(recall, 2).alias("recall"),
                      F.round(f1, 2).alias("f1"))


def statutory_exact_match(compared: DataFrame, fields: list[str] = STATUTORY_FIELDS) -> DataFrame:
    out = compared.where(F.col("field_name").isin(fields)).groupBy("field_name").agg(
        F.count_if(F.col("outcome") == "match").alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("total") * 100.0, 2))


def _split(df: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("breakdown"), F.col(k).alias("value_of")) for k in ("language", "document_type")])
    return df.select("*", F.inline(kinds))


def breakdown(documents: DataFrame, compared: DataFrame, key: str = "id") -> DataFrame:
    """Samples, average character error and field accuracy by language and by document type.

    `documents` has key, language, document_type, cer. Documents and fields are aggregated apart, so a document's
    error is not counted once per field.
    """
    docs = _split(documents).groupBy("breakdown", "value_of").agg(F.count("*").alias("samples"), exact_average("cer").alias("avg_cer"))
    placed = compared.join(documents.select(key, "language", "document_type"), key)
    hits = _split(placed).groupBy("breakdown", "value_of").agg(
        F.round(F.count_if(F.col("outcome") == "match") / F.count("*") * 100.0, 2).alias("field_accuracy"))
    return docs.join(hits, ["breakdown", "value_of"], "left")
