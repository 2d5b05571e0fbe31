"""Joins of records with cadastre, registrations, states, documents and fields.

No side is broadcast by hint except literal lists of fixed length: adaptive execution broadcasts a side once its size
at run time is known to be small, and splits skewed partitions of the other cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq import dims
from landq.operators.lookup import found


def area_delta(own: Column | str, other: Column | str) -> Column:
    own = F.col(own) if isinstance(own, str) else own
    other = F.col(other) if isinstance(other, str) else other
    return F.abs(own - other)


def parcels_for(parcels: DataFrame) -> DataFrame:
    """One parcel per survey number (lowest id), with prefixed columns."""
    first = parcels.groupBy("survey_number").agg(
        F.min_by(F.struct("id", "village", "cadastral_area", "survey_year"), "id").alias("c"))
    return first.selectExpr("survey_number", "c.id as cadastral_id", "c.village as cadastral_village",
                            "c.cadastral_area as cadastral_area", "c.survey_year as survey_year")


def reconcile_cadastral(deeds: DataFrame, parcels: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Deed area against the cadastre: difference, flag, recommended action and message."""
    joined = deeds.join(parcels_for(parcels), "survey_number", "left")
    delta = area_delta("land_area", "cadastral_area")
    matched = F.col("cadastral_id").isNotNull()
    off = F.coalesce(delta > tolerance, F.lit(False))
    return joined.select(
        "id", "survey_number", F.col("land_area").alias("deed_area"), "cadastral_id", "cadastral_area",
        matched.alias("matched"), F.round(delta, 3).alias("delta"), off.alias("has_discrepancy"),
        F.when(off, "SYNC_TO_CADASTRAL").when(matched, "CONFIRMED").alias("recommended_action"),
        F.when(~matched, F.concat(F.lit("No baseline cadastral ground-truth entry found for survey number "),
                                  "survey_number", F.lit(".")))
        .when(off, F.concat(F.lit("Area mismatch detected: Land Deed = "), F.col("land_area").cast("string"),
                            F.lit(" Acres, Cadastral Ground Truth = "), F.col("cadastral_area").cast("string"),
                            F.lit(" Acres.")))
        .otherwise(F.lit("Land area matches official Cadastral Ground Truth.")).alias("message"))


def cadastral_crosscheck(records: DataFrame, parcels: DataFrame, tolerance: float = 0.01, fallback: bool = True,
                         default_year: int = 2021) -> DataFrame:
    """Records with the cadastral area; with `fallback`, a record without parcel stands for itself."""
    joined = records.join(parcels_for(parcels), "survey_number", "left")
    delta = area_delta("land_area", "cadastral_area")
    out = (joined.withColumn("mismatch_detected", F.coalesce(delta > tolerance, F.lit(False)))
           .withColumn("delta_acres", F.coalesce(F.round(delta, 2), F.lit(0.0))))
    if fallback:
        out = (out.withColumn("cadastral_area", F.coalesce("cadastral_area", "land_area"))
               .withColumn("survey_year", F.coalesce("survey_year", F.lit(default_year))))
    return out


def parcels_with_status(parcels: DataFrame, records: DataFrame, default_status: str = "UNVERIFIED",
                        default_owner: str = "Official Revenue Cadastre",
                        default_class: str = "Revenue Land") -> DataFrame:
    """Every parcel with status, owner and class of its first record."""
    first = records.groupBy("survey_number").agg(
        F.min_by(F.struct("status", "owner_name", "land_classification"), "id").alias("r"))
    return parcels.join(first, "survey_number", "left").select(
        *parcels.columns,
        F.when(F.col("r").isNull(), default_status).otherwise(F.col("r.status")).alias("status"),
        F.when(F.col("r").isNull(), default_owner).otherwise(F.col("r.owner_name")).alias("owner_name"),
        F.when(F.col("r").isNull(), default_class).otherwise(F.col("r.land_classification")).alias("land_classification"))


def registration_status(asked: DataFrame, records: DataFrame, registrations: DataFrame) -> DataFrame:
    """Per asked number: its public record, else its pending registration, else absent (case is ignored).

    Only rows of asked numbers reach the two aggregates: a semi join on the asked keys comes first. It is broadcast, or
    preceded by a runtime filter, where the asked side turns out small; else it brings the exchange that the aggregate needs.
    """
    columns = ["registration_number", "owner_name", "survey_number", "village", "district"]
    wanted = asked.select(F.lower("registration_number").alias("k")).distinct()

    def first(rows: DataFrame, name: str, *more: str) -> DataFrame:
        some = rows.withColumn("k", F.lower("registration_number")).join(wanted, "k", "left_semi")
        return some.groupBy("k").agg(F.min_by(F.struct("id", *more, *columns), "id").alias(name))

    public = first(records.where("is_public"), "pub")
    pending = first(registrations, "pend", "status", "source", "expected_public_date")
    joined = (asked.withColumn("k", F.lower("registration_number")).withColumnRenamed("registration_number", "asked")
              .join(public, "k", "left").join(pending, "k", "left"))
    is_public = F.col("pub").isNotNull()

    def pick(name: str) -> Column:
        return F.when(is_public, F.col(f"pub.{name}")).otherwise(F.col(f"pend.{name}")).alias(name)
    return joined.select(
        "asked",
        F.when(is_public, "PUBLISHED").when(F.col("pend").isNotNull(), F.col("pend.status")).otherwise("NOT_FOUND").alias("status"),
        *[pick(c) for c in columns],
        F.col("pub.id").alias("land_record_id"),
        F.when(~is_public, F.col("pend.expected_public_date")).alias("expected_public_date"),
        is_public.alias("public_available"))


def enrich_state_profile(records: DataFrame, profiles: list[tuple] = dims.STATE_PROFILES, column: str = "state") -> DataFrame:
    """State-specific labels; states without a profile take the default one. The profile list is short and fixed."""
    names = ["survey_label", "ror_label", "admin_unit_label", "area_unit", "profile_language"]
    frame = records.sparkSession.createDataFrame(profiles, ["profile_state", *names])
    joined = records.join(F.broadcast(frame), F.col(column) == F.col("profile_state"), "left").drop("profile_state")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(names, dims.STATE_PROFILE_DEFAULT)})


def core_field_frame(spark) -> DataFrame:
    """The core fields as a frame of fixed length: name, label, group, defaults."""
    rows = [(n, label, group, conf, req, kind) for n, label, group, _, conf, req, kind, _ in dims.CORE_FIELDS]
    return spark.createDataFrame(rows, "field_name string, field_label string, category string, confidence double, "
                                       "is_required boolean, validation_type string")


def backfill_canonical_fields(records: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per record and core field that none of its aliases provides, filled from the record.

    Which core fields a record already has is reduced to one number per record (a bit per core field) by a grouped
    OR, so the record table meets the fields table once and no field list is collected.
    """
    mask = F.lit(0)
    for bit, (*_, aliases) in enumerate(dims.CORE_FIELDS):
        mask = mask.bitwiseOR(F.when(F.col("field_name").isin(aliases), F.lit(1 << bit)).otherwise(F.lit(0)))
    have = fields.groupBy("land_record_id").agg(F.bit_or(mask).alias("have"))

    def value(column: str | None) -> Column:
        if column is None or column not in records.columns:
            return F.lit(dims.NOT_FOUND)
        if column == "land_area":
            shown = F.when(F.col(column) != 0, F.col(column).cast("string"))
        else:
            shown = F.nullif(F.col(column).cast("string"), F.lit(""))
        return F.coalesce(shown, F.lit("Land Document" if column == "document_type" else dims.NOT_FOUND))

    candidates = F.array(*[
        F.struct(F.lit(1 << bit).alias("bit"), F.lit(name).alias("field_name"), F.lit(label).alias("field_label"),
                 F.lit(group).alias("category"), value(column).alias("final_value"), F.lit(conf).alias("confidence"),
                 F.lit(required).alias("is_required"), F.lit(kind).alias("validation_type"))
        for bit, (name, label, group, column, conf, required, kind, _) in enumerate(dims.CORE_FIELDS)])
    joined = records.join(have, records["id"] == have["land_record_id"], "left")
    absent = F.filter(candidates, lambda c: F.coalesce("have", F.lit(0)).bitwiseAND(c["bit"]) == 0)
    return joined.select(F.col("id").alias("land_record_id"), F.col("status").alias("record_status"),
                         F.inline(absent)).drop("bit").withColumn(
        "status", F.when(F.col("record_status") == "USER_VERIFIED", "USER_VERIFIED").otherwise("AI_EXTRACTED")).drop("record_status")


def dossier_header(records: DataFrame, parcels: DataFrame, documents: DataFrame, fields: DataFrame,
                   results: DataFrame) -> DataFrame:
    """One row per record: cadastral check, first document, and how many documents, fields and findings it has.

    The children stay in their own long frames (`dossier_items`): a record may own any number of them.
    """
    docs = documents.groupBy(F.col("land_record_id").alias("id")).agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))
    counts = fields.groupBy(F.col("land_record_id").alias("id")).agg(F.count("*").alias("fields"))
    checks = results.groupBy("id").agg(F.count_if(F.col("status") == "ERROR").alias("errors"),
                                       F.count_if(F.col("status") == "WARNING").alias("warnings"))
    view = cadastral_crosscheck(records, parcels)
    for child in (docs, counts, checks):
        view = view.join(child, "id", "left")
    return view.fillna(0, ["documents", "fields", "errors", "warnings"])


def dossier_items(documents: DataFrame, fields: DataFrame, results: DataFrame) -> DataFrame:
    """Documents, fields and findings of the records as one long frame keyed by record."""
    docs = documents.select(F.col("land_record_id").alias("id"), F.lit("document").alias("section"),
                            F.col("doc_id").cast("string").alias("item"), F.col("document_type").alias("value"))
    values = fields.select(F.col("land_record_id").alias("id"), F.lit("field").alias("section"),
                           F.col("field_name").alias("item"),
                           F.coalesce("corrected_value", "extracted_value").alias("value"))
    checks = results.select("id", F.lit("validation").alias("section"), F.col("rule_id").alias("item"),
                            F.col("status").alias("value"))
    return docs.unionByName(values).unionByName(checks)


def trace_fields(values: DataFrame, lines: DataFrame, aliases: dict[str, list[str]] = dims.FIELD_ALIASES,
                 first_aliases: int = 6) -> DataFrame:
    """Source line of each extracted value: the first line holding it, else holding an alias, else the value itself.

    Values meet lines on the document id. A pair is ranked by one number, alias before line, and the lowest number per
    value is a hash aggregate that combines ahead of the shuffle; the line it names is fetched afterwards.
    """
    wanted = {n: a[:first_aliases] for n, a in aliases.items()}
    table = F.create_map(*[x for n, a in wanted.items() for x in (F.lit(n), F.array(*[F.lit(t.lower()) for t in a]))])
    usable = values.select("doc_id", "field_name", F.lower(F.trim("value")).alias("needle"),
                           F.try_element_at(table, F.col("field_name")).alias("terms"))
    usable = usable.where(~F.coalesce("needle", F.lit("")).isin("not found", "none", ""))
    searched = lines.select("doc_id", "line_no", F.lower("text").alias("low"))
    rank = F.when(F.contains("low", "needle"), 0)
    for i in range(first_aliases):
        rank = rank.when(F.contains("low", F.get("terms", F.lit(i))), i + 1)
    place = rank.cast("bigint") * (1 << 40) + F.col("line_no")
    best = (usable.join(searched, "doc_id").groupBy("doc_id", "field_name").agg(F.min(place).alias("place"))
            .select("doc_id", "field_name", (F.col("place") % (1 << 40)).cast("int").alias("line_no")))
    named = lines.select("doc_id", "line_no", F.struct(F.col("text").alias("source_text"), "confidence", "x1", "y1", "x2", "y2").alias("line"))
    best = best.join(named, ["doc_id", "line_no"]).drop("line_no")
    box = F.when(F.col("line").isNotNull(), F.struct(
        F.col("line.x1").alias("x"), F.col("line.y1").alias("y"),
        F.greatest(F.lit(0), F.col("line.x2") - F.col("line.x1")).alias("w"),
        F.greatest(F.lit(0), F.col("line.y2") - F.col("line.y1")).alias("h")))
    fraction = F.col("line.confidence")
    percent = F.round(F.when(fraction <= 1.0, fraction * 100).otherwise(fraction), 1)
    missing = F.coalesce(F.lower(F.trim("value")), F.lit("")).isin("not found", "none", "")
    return values.join(best, ["doc_id", "field_name"], "left").select(
        *values.columns,
        F.when(missing, F.coalesce(F.nullif("value", F.lit("")), F.lit(dims.NOT_FOUND)))
        .otherwise(F.coalesce("line.source_text", F.trim("value"))).alias("source_text"),
        box.alias("bounding_box"),
        F.when(missing, 0.0).otherwise(F.coalesce(percent, F.lit(90.0))).alias("ocr_confidence"),
        F.lit(1).alias("page_number"))


def sync_to_cadastral(records: DataFrame, parcels: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of `ids` take the area of their parcel; all others stay."""
    wanted = ids.select("id").distinct().withColumn("sync", F.lit(True))
    joined = records.join(wanted, "id", "left").join(
        parcels_for(parcels).select("survey_number", F.col("cadastral_area").alias("parcel_area")), "survey_number", "left")
    area = F.when(F.col("sync"), F.coalesce("parcel_area", "land_area")).otherwise(F.col("land_area"))
    return joined.withColumn("land_area", area).drop("sync", "parcel_area")
