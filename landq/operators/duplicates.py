"""Duplicate vectors of incoming records against a registry, and their risk score.

Every vector gives one row per incoming record that has a match: id, vector, score, conflict, match_id, detail. The
score of a vector counts once however many matches a record has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq import dims
from landq.operators.lookup import first_containing, lowest_two, not_blank
from landq.operators.similarity import similar_hashes, similar_texts


def _hit(df: DataFrame, vector: Column | str, score: Column | int, conflict: Column | str | None, match: Column | None,
         detail: Column) -> DataFrame:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return df.select("id", lit(vector).alias("vector"), lit(score).cast("int").alias("score"),
                     lit(conflict).cast("string").alias("conflict"),
                     (match if match is not None else F.lit(None)).cast("bigint").alias("match_id"), detail.alias("detail"))


def same_file(documents: DataFrame) -> DataFrame:
    """Identical file hash on a document of another record; one row per document, match is the lowest document."""
    owner = F.coalesce(F.concat(F.lit("r"), F.col("land_record_id").cast("string")),
                       F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    owned = documents.where("file_hash is not null").withColumn("owner", owner)
    firsts = (owned.groupBy("file_hash", "owner").agg(F.min("doc_id").alias("first"))
              .select("file_hash", F.struct(F.col("first").alias("id"), "owner").alias("entry")))
    two = lowest_two(firsts, ["file_hash"], "entry")
    match = F.get(F.filter("firsts", lambda e: e["owner"] != F.col("owner")), F.lit(0))
    hits = owned.join(two, "file_hash").withColumn("match", match).where("match is not null")
    return _hit(hits.withColumn("id", F.col("land_record_id")), "DOCUMENT_HASH_COLLISION", 40, "EXACT_DOCUMENT_DUPLICATE",
                F.col("match.id"), F.concat(F.lit("File binary identical to document #"), F.col("match.id").cast("string")))


def same_registration(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    hits = first_containing(incoming, registry, F.lower(not_blank("registration_number")), "district", ["owner_name", "status"],
                            blank_finds_null=True)
    holder, status = (F.coalesce(f"match.{c}", F.lit("None")) for c in ("owner_name", "status"))
    return _hit(hits, "REGISTRATION_DUPLICATE", 40, "REGISTRATION_NUMBER_COLLISION", F.col("match.id"),
                F.concat(F.lit("Deed registered under owner '"), holder, F.lit("' with status "), status))


def same_parcel(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Survey number and village on an active record; another owner scores higher and is a conflict."""
    active = registry.where(F.col("status").isin(dims.COLLISION_STATUSES))
    placed = incoming.where(not_blank("village").isNotNull())
    hits = first_containing(placed, active, not_blank("survey_number"), "village", ["owner_name"])
    owner = F.coalesce(F.lower(F.trim("owner_name")), F.lit(""))
    differs = (owner != "") & (F.lower(F.trim("match.owner_name")) != owner)
    return _hit(hits, F.when(differs, "SURVEY_NUMBER_OWNER_MISMATCH").otherwise("EXISTING_PARCEL_RECORD"),
                F.when(differs, 30).otherwise(15), F.when(differs, "SURVEY_OWNERSHIP_MISMATCH"), F.col("match.id"),
                F.concat(F.lit("Existing landowner on record: '"), "match.owner_name", F.lit("'")))


def same_owner_survey(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    named = incoming.where(not_blank("owner_name").isNotNull())
    hits = first_containing(named, registry, not_blank("survey_number"), "owner_name")
    return _hit(hits, "OWNER_SURVEY_COLLISION", 20, None, F.col("match.id"),
                F.concat(F.lit("Owner '"), "owner_name", F.lit("' already holds a record for the parcel")))


def same_khasra_area(incoming: DataFrame, registry: DataFrame, tolerance: float = 0.05) -> DataFrame:
    sized = incoming.where(not_blank("village").isNotNull() & (F.col("land_area") > 0))
    hits = first_containing(sized, registry, not_blank("khasra_number"), "village", ["land_area"])
    hits = hits.where(F.abs(F.col("match.land_area") - F.col("land_area")) < tolerance)
    return _hit(hits, "KHASRA_VILLAGE_AREA_COLLISION", 25, None, F.col("match.id"),
                F.concat(F.lit("Matching Khasra with area "), F.col("match.land_area").cast("string"), F.lit(" Ac")))


def same_registration_owner(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    named = incoming.where(not_blank("owner_name").isNotNull())
    hits = first_containing(named, registry, not_blank("registration_number"), "owner_name")
    return _hit(hits, "REGISTRATION_OWNER_MATCH", 15, None, F.col("match.id"),
                F.lit("Same registration number and owner submitted previously"))


def _per_record(documents: DataFrame) -> DataFrame:
    return documents.where("land_record_id is not null").select(F.col("land_record_id").alias("id")).distinct()


def similar_text(documents: DataFrame, text: str = "ocr_raw_text", window_n: int | None = None, **options) -> DataFrame:
    """Near-equal texts over all documents; `window_n` restricts the search to the newest documents."""
    scope = documents if window_n is None else documents.orderBy(F.desc("doc_id")).limit(window_n)
    return _hit(_per_record(similar_texts(scope, text, **options)), "OCR_TEXT_SIMILARITY", 20, None, None,
                F.lit("High textual similarity detected"))


def similar_image(hashes: DataFrame, **options) -> DataFrame:
    return _hit(_per_record(similar_hashes(hashes, **options)), "PERCEPTUAL_IMAGE_SIMILARITY", 25, None, None,
                F.lit("Visual perceptual match detected"))


def low_confidence(scores: DataFrame, limit: float = 80.0) -> DataFrame:
    return _hit(scores.where(F.col("ocr_confidence") < limit), "LOW_OCR_CONFIDENCE", 15, None, None,
                F.concat(F.lit("Overall document recognition confidence is low ("),
                         F.round("ocr_confidence", 1).cast("string"), F.lit("%)")))


def record_vectors(incoming: DataFrame, registry: DataFrame) -> list[DataFrame]:
    return [same_registration(incoming, registry), same_parcel(incoming, registry), same_owner_survey(incoming, registry),
            same_khasra_area(incoming, registry), same_registration_owner(incoming, registry)]


def risk_score(incoming: DataFrame, hits: list[DataFrame]) -> DataFrame:
    """Risk per incoming record: sum of its vectors up to 100, level, flags, conflicts and breakdown.

    A record has at most one row per vector (documents of one record count once), so the arrays stay short.
    """
    long = hits[0]
    for other in hits[1:]:
        long = long.unionByName(other)
    once = long.groupBy("id", "vector").agg(F.max("score").alias("score"), F.min("conflict").alias("conflict"),
                                            F.min("match_id").alias("match_id"), F.min("detail").alias("detail"))
    totals = once.groupBy("id").agg(
        F.sum("score").alias("total"), F.count("conflict").alias("conflicts_count"),
        F.sort_array(F.collect_list(F.struct("vector", "score", "detail"))).alias("risk_breakdown"),
        F.sort_array(F.collect_list(F.when(F.col("conflict").isNotNull(), F.struct("conflict", "match_id", "detail")))).alias("conflicts"))
    score = F.least(F.lit(100), F.coalesce("total", F.lit(0))).cast("int")
    return (incoming.select("id").join(totals, "id", "left").withColumn("risk_score", score).select(
        "id", "risk_score",
        F.when(score <= 20, "LOW").when(score <= 50, "MEDIUM").when(score <= 80, "HIGH").otherwise("CRITICAL").alias("risk_level"),
        (score >= 40).alias("is_duplicate"), (score > 20).alias("requires_officer_review"),
        F.coalesce("conflicts_count", F.lit(0)).alias("conflicts_count"), "conflicts", "risk_breakdown"))


def parcel_collision(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Risk from survey number, village and district alone: no owner is compared."""
    bare = incoming.select("id", "survey_number", "village", "district", F.lit("").alias("owner_name"))
    return risk_score(bare.where(not_blank("survey_number").isNotNull()), [same_parcel(bare, registry)])
