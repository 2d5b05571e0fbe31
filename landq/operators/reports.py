"""Dashboard figures and feeds. Counts come from one pass of conditional aggregates, not one scan per figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq import dims
from landq.operators.lookup import found


def _status(*statuses: str) -> Column:
    return F.count_if(F.col("status").isin(list(statuses)))


def average_confidence(empty: float = 96.0) -> Column:
    """Average to one decimal. Scores are added as decimals, so the result does not depend on the order of rows."""
    total = F.sum(F.col("confidence_score").cast("decimal(18,4)")).cast("double")
    return F.coalesce(F.round(total / F.nullif(F.count("confidence_score"), F.lit(0)), 1), F.lit(empty))


def dashboard_cards(records: DataFrame, registrations: DataFrame) -> DataFrame:
    """One row of totals by status, open registrations and average confidence (96.0 without records)."""
    totals = records.agg(
        F.count("*").alias("total"), _status(*dims.PUBLIC_STATUSES).alias("approved"),
        _status(*dims.PENDING_STATUSES).alias("pending"), _status("LOW_CONFIDENCE").alias("low_confidence"),
        _status("VALIDATION_FAILED").alias("validation_errors"), _status("REJECTED").alias("rejected"),
        average_confidence().alias("average_confidence"))
    opened = registrations.agg(F.count_if(F.col("status") != "PUBLISHED").alias("new_registrations"))
    return totals.select("*", opened.scalar().alias("new_registrations"))


def confidence_distribution(records: DataFrame) -> DataFrame:
    """Counts of the three confidence bands; empty bands stay with 0."""
    score = F.col("confidence_score")
    bands = [("High Confidence (>80%)", score >= 80), ("Medium Confidence (60-80%)", (score >= 60) & (score < 80)),
             ("Low Confidence (<60%)", score < 60)]
    counts = records.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(bands)])
    rows = F.array(*[F.struct(F.lit(n).alias("tier"), F.col(f"c{i}").alias("records")) for i, (n, _) in enumerate(bands)])
    return counts.select(F.inline(rows))


def workflow_breakdown(records: DataFrame) -> DataFrame:
    parts = [("Verified & Published", dims.PUBLIC_STATUSES), ("Pending Verification", dims.PENDING_STATUSES),
             ("Validation Flagged", ["VALIDATION_FAILED"]), ("Low Confidence", ["LOW_CONFIDENCE"])]
    counts = records.agg(*[_status(*s).alias(f"c{i}") for i, (_, s) in enumerate(parts)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("value")) for i, (n, _) in enumerate(parts)])
    return counts.select(F.inline(rows))


def district_progress(records: DataFrame) -> DataFrame:
    """Records per named district with the overall average confidence; one general row where no district is named.

    The overall figures are one narrow aggregate without a shuffle of rows, read as a scalar subquery.
    """
    overall = records.agg(
        F.count("*").alias("total"), _status(*dims.PUBLIC_STATUSES).alias("approved"),
        F.count_if(found("district")).alias("named"), average_confidence().alias("accuracy"))
    groups = records.where(found("district")).groupBy("district").agg(F.count("*").alias("total"))
    accuracy = overall.select("accuracy").scalar()
    named = groups.select(
        "district", "total", F.col("total").alias("digitized"), accuracy.alias("accuracy"))
    general = overall.where("named = 0 and total > 0").select(
        F.lit("General District").alias("district"), "total", F.col("approved").alias("digitized"), "accuracy")
    return named.unionByName(general)


def public_stats(records: DataFrame) -> DataFrame:
    """Verified public records and how many districts, villages and states appear (at least 1 each)."""
    public = F.col("status").isin(dims.PUBLIC_STATUSES) & F.col("is_public")

    def distinct(column: str) -> Column:
        return F.greatest(F.countDistinct(F.when(found(column), F.col(column))), F.lit(1).cast("bigint"))
    return records.agg(
        F.count_if(public).alias("total_verified_records"), distinct("village").alias("villages_covered"),
        distinct("district").alias("districts_active"), distinct("state").alias("states_onboarded"))


def recent_activity(records: DataFrame, limit: int = 10) -> DataFrame:
    shown = records.where(F.col("owner_name").isNotNull() & (F.col("document_type") != dims.CADASTRAL_MAP))
    label = (F.when(F.col("status").isin(dims.PUBLIC_STATUSES), "Approved").when(F.col("status") == "LOW_CONFIDENCE", "Low Confidence")
             .when(F.col("status") == "VALIDATION_FAILED", "Validation Discrepancy").otherwise("Pending Verification"))
    return shown.orderBy(F.desc("id")).limit(limit).select(
        "id", F.coalesce(F.nullif("registration_number", F.lit("")), F.concat(F.lit("REC-"), F.col("id").cast("string"))).alias("reg_id"),
        F.col("owner_name").alias("owner"),
        F.when(found("registration_date"), F.col("registration_date")).alias("date"), label.alias("activity"),
        F.coalesce(F.nullif("document_type", F.lit("")), F.lit("Land Record")).alias("type"))


def audit_feed(log: DataFrame, limit: int = 100) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).withColumn(
        "timestamp", F.date_format("timestamp", "dd-MM-yyyy HH:mm:ss"))


def learning_metrics(corrections: DataFrame, base: float = 91.2, step: float = 0.6, cap: float = 98.8,
                     baseline: float = 91.2, digits: int = 2) -> DataFrame:
    """Correction count and the accuracy claimed for it: base + step per correction, up to the cap."""
    counted = corrections.agg(F.count("*").alias("corrections"))
    accuracy = F.least(F.lit(cap), F.round(F.lit(base) + F.col("corrections") * step, digits))
    return counted.withColumn("accuracy", accuracy).withColumn("gain", F.round(F.col("accuracy") - baseline, 2))


def recent_corrections(corrections: DataFrame, limit: int = 10) -> DataFrame:
    return audit_feed(corrections, limit)


def corrections_by_field(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("field_name").agg(F.count("*").alias("corrections")).orderBy(F.desc("corrections"), "field_name")


def daily_processing(records: DataFrame) -> DataFrame:
    return records.agg(F.lit("Total").alias("day"), F.count("*").alias("processed"),
                       _status(*dims.PUBLIC_STATUSES).alias("approved"),
                       _status("VALIDATION_FAILED", "LOW_CONFIDENCE").alias("flagged"))


def recent_registrations(registrations: DataFrame, limit: int | None = 20) -> DataFrame:
    ordered = registrations.orderBy(F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)
