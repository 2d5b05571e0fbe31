"""Registrations as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq import schemas
from landq.operators.joins import parcels_for


def read_registrations(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.REGISTRATION).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_registrations(stream: DataFrame, parcels: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Incoming registrations with mismatch flag and message against the static cadastre; append mode."""
    joined = stream.drop("has_mismatch").join(parcels_for(parcels).select("survey_number", "cadastral_area"), "survey_number", "left")
    off = F.coalesce(F.abs(F.col("cadastral_area") - F.col("land_area")) > tolerance, F.lit(False))
    return joined.withColumn("has_mismatch", off).withColumn("mismatch_details", F.when(off, F.concat(
        F.lit("Area mismatch detected: Incoming Registered Deed specifies "), F.col("land_area").cast("string"),
        F.lit(" Acres, while official Cadastral Ground Truth records "), F.col("cadastral_area").cast("string"), F.lit(" Acres."))))


def stream_unique_registrations(stream: DataFrame, delay: str = "7 days", time: str = "received_at") -> DataFrame:
    """The first of each registration number within the delay; rows later than the watermark are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["registration_number"])
