"""Readers: record JSON, state and district seeds, document files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landq import dims, schemas


def read_land_records(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """Record JSON with nested GeoJSON. `json_array` files are read whole; one object per line splits and scales."""
    return spark.read.schema(schemas.LAND_RECORD).option("multiLine", json_array).json(path)


def parse_land_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a frame with one JSON object per row."""
    return lines.select(F.from_json(column, schemas.LAND_RECORD).alias("r")).select("r.*")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STATE_SOURCE).option("multiLine", True).json(path)


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DISTRICT_SOURCE).option("multiLine", True).json(path)


def build_state_dims(states: DataFrame) -> DataFrame:
    """States with their settings, defaults filled, numbered by code. States are few: the order is a single window."""
    number = F.row_number().over(Window.orderBy("code")).cast("bigint")
    return states.select(
        number.alias("id"), "name", "code", "capital", "region",
        F.coalesce("survey_label", F.lit("Survey Number")).alias("survey_number_label"),
        F.coalesce("admin_unit_label", F.lit("Tehsil")).alias("admin_unit_label"),
        F.coalesce("default_area_unit", F.lit("Acres")).alias("default_area_unit"),
        F.coalesce("language_code", F.lit("en")).alias("language_code"))


def build_admin_units(districts: DataFrame, states: DataFrame) -> DataFrame:
    """One row per administrative unit; districts of unknown states are dropped."""
    known = districts.join(states.select(F.col("id").alias("state_id"), "code", F.col("admin_unit_label").alias("unit_type")),
                           F.col("state_code") == F.col("code"))
    return known.select("state_id", "district_name", F.explode("admin_units").alias("name"), "unit_type")


def catalog_files(spark: SparkSession, folder: str, extensions: list[str] = dims.ALLOWED_EXTENSIONS,
                  max_bytes: int = dims.MAX_FILE_BYTES) -> DataFrame:
    """All files with extension and type; accepted ones with SHA-256, the others with the reason of their rejection.

    Contents of rejected files are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring_index("path", "/", -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    small, known = F.col("length") <= max_bytes, extension.isin(extensions)
    reason = F.when(~known, "type not allowed").otherwise("file too large")

    def rows(some: DataFrame, file_hash: Column, rejection: Column) -> DataFrame:
        return some.select("path", name.alias("filename"), extension.alias("extension"), F.upper(extension).alias("file_type"),
                           F.col("length").alias("file_size"), file_hash.alias("file_hash"), rejection.alias("rejection"))

    nothing = F.lit(None).cast("string")
    return rows(files.where(small & known), F.sha2("content", 256), nothing).unionByName(
        rows(files.drop("content").where(~(small & known)), nothing, reason))
