"""Comparison of the documents of a parcel dossier.

Everything stays in long form keyed by dossier: no document list and no field map is collected, so a dossier may hold
any number of documents. Of each kind the last document counts.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq import dims
from landq.functions.text import extract, folded

DEFAULTS = ["survey_number", "khasra_number", "khata_number", "owner_name", "previous_owner", "land_area", "village",
            "district", "state"]


def dossier_select(records: DataFrame, ids: DataFrame | None = None, survey_number: str | None = None,
                   newest: int = 4, source_type: str | None = None) -> DataFrame:
    """Records by id, else by survey number, else the newest ones (of a source)."""
    if ids is not None:
        return records.join(ids.select("id"), "id", "left_semi")
    if survey_number is not None:
        return records.where(F.col("survey_number") == survey_number)
    pool = records if source_type is None else records.where(F.col("source_type") == source_type)
    return pool.orderBy(F.desc("id")).limit(newest)


def with_dossier_key(records: DataFrame, columns: list[str] = ("survey_number", "village")) -> DataFrame:
    return records.withColumn("dossier", F.concat_ws("|", *columns))


def fields_long(records: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, field_name, value): corrected else extracted; for nine keys without a field row, the record's own value."""
    bits = F.lit(0)
    for i, name in enumerate(DEFAULTS):
        bits = F.when(F.col("field_name") == name, F.lit(1 << i)).otherwise(bits)
    have = fields.groupBy(F.col("land_record_id").alias("id")).agg(F.bit_or(bits).alias("have"))
    own = F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(n).alias("field_name"), (
        F.concat(F.col(n).cast("string"), F.lit(" Acres")) if n == "land_area" else F.col(n)).alias("value"))
        for i, n in enumerate(DEFAULTS)])
    absent = F.filter(own, lambda d: F.coalesce("have", F.lit(0)).bitwiseAND(d["bit"]) == 0)
    defaults = records.join(have, "id", "left").select("id", F.inline(absent)).drop("bit")
    read = fields.join(records.select("id"), fields["land_record_id"] == records["id"], "left_semi").select(
        F.col("land_record_id").alias("id"), "field_name",
        F.coalesce(F.nullif("corrected_value", F.lit("")), "extracted_value").alias("value"))
    return read.unionByName(defaults)


def bucket(document_type: Column) -> Column:
    kind = F.lower(F.coalesce(document_type, F.lit(dims.SALE_DEED)))

    def held(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(kind, F.lit(w))
        return out
    return (F.when(held("sale"), "sale_deed").when(held("khasra", "khatauni"), "khasra")
            .when(held("cadastral", "map"), "cadastral").when(held("mutation"), "mutation"))


def bucket_by_type(records: DataFrame) -> DataFrame:
    """Per dossier and kind (NULL: none of the four) the last document and the number of documents."""
    return records.groupBy("dossier", bucket(F.col("document_type")).alias("bucket")).agg(
        F.max("id").alias("id"), F.count("*").alias("documents"))


def comparison_matrix(records: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per dossier and comparison field: the value of each kind of document, and the number of documents.

    A value is the first non-missing one in alias order. The rows that carry values and the rows that only say which
    kinds are present are grouped together, so there is a single shuffle by dossier and field.
    """
    last = bucket_by_type(records)
    chosen = last.where("bucket is not null").select("id", "dossier", "bucket")
    targets: dict[str, list[tuple[int, int]]] = {}
    for i, (name, _, aliases) in enumerate(dims.COMPARISON_FIELDS):
        for order, alias in enumerate([name, *aliases]):
            targets.setdefault(alias, []).append((i, order))
    table = F.create_map(*[x for alias, spots in targets.items() for x in (
        F.lit(alias), F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(o).alias("ord")) for i, o in spots]))])
    spots = F.try_element_at(table, F.col("field_name"))
    values = (fields_long(records.join(chosen.select("id"), "id", "left_semi"), fields)
              .where(folded(F.col("value"), [*dims.MISSING_CROSSDOC, ""]).isNotNull()).where(spots.isNotNull())
              .join(chosen, "id").select("dossier", "bucket", F.trim("value").alias("value"), F.inline(spots)))
    numbers = F.sequence(F.lit(0), F.lit(len(dims.COMPARISON_FIELDS) - 1))
    marks = last.select("dossier", "bucket", "documents", F.explode(numbers).alias("field_no"))
    rows = values.withColumn("documents", F.lit(0).cast("bigint")).unionByName(
        marks.withColumn("value", F.lit(None).cast("string")).withColumn("ord", F.lit(None).cast("int")))

    def of(kind: str) -> list[Column]:
        here = F.col("bucket") == kind
        first = F.min_by(F.when(here, F.col("value")), F.when(here & F.col("value").isNotNull(), F.col("ord")))
        return [first.alias(f"v_{kind}"), F.bool_or(here).alias(f"has_{kind}")]
    grouped = rows.groupBy("dossier", "field_no").agg(F.sum("documents").alias("documents"),
                                                      *[c for k in dims.DOSSIER_BUCKETS for c in of(k)])
    names = F.array(*[F.lit(n) for n, _, _ in dims.COMPARISON_FIELDS])
    labels = F.array(*[F.lit(label) for _, label, _ in dims.COMPARISON_FIELDS])
    return grouped.select(
        "dossier", "field_no", F.get(names, F.col("field_no")).alias("field_key"), F.get(labels, F.col("field_no")).alias("field_label"),
        "documents", *[F.when(F.coalesce(f"has_{k}", F.lit(False)), F.coalesce(f"v_{k}", F.lit(dims.NOT_FOUND)))
                       .otherwise(dims.NO_DOCUMENT).alias(k) for k in dims.DOSSIER_BUCKETS])


def comparable(value: Column) -> Column:
    """Lower case without punctuation, single spaces. Vowel signs stay: dropping them would merge distinct names."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.regexp_replace(bare, r"\s+", " ")


def lowest_similarity(values: Column) -> Column:
    """Lowest pairwise difflib ratio of the up to four texts of a row; rows already settled carry NULL.

    A pair of texts is matched once in a batch, however many dossiers hold it. The function is made here, so it travels to
    the executors by value and they need no copy of this package.
    """
    def score(batch: pd.Series) -> pd.Series:
        rows = [None if v is None else list(combinations(v, 2)) for v in batch]
        known = {pair: SequenceMatcher(None, *pair).ratio() for pair in {p for row in rows if row for p in row}}
        return pd.Series([None if row is None else min(known[p] for p in row) for row in rows], dtype="float64")
    return F.pandas_udf(score, T.DoubleType())(values)


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1))))


def similarity_bound(a: Column, b: Column) -> Column:
    """No difflib ratio of two texts is above this: twice the characters they share, in any order, to their length."""
    def held(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))
    both = F.aggregate(F.array_distinct(characters(a)), F.lit(0), lambda n, c: n + F.least(held(a, c), held(b, c)))
    return 2.0 * both / (F.length(a) + F.length(b))


def lengths_bound(a: Column, b: Column) -> Column:
    """The same from the lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def all_pairs_reach(texts: Column, limit: float, bound: Callable[[Column, Column], Column]) -> Column:
    """Whether no pair of the up to four texts has a lower bound."""
    pairs = combinations([F.get(texts, F.lit(i)) for i in range(len(dims.DOSSIER_BUCKETS))], 2)
    return reduce(and_, [F.coalesce(bound(a, b) >= limit, F.lit(True)) for a, b in pairs])


def given_values() -> Column:
    cells = F.array(*[F.col(k) for k in dims.DOSSIER_BUCKETS])
    return F.filter(cells, lambda v: ~v.isin(dims.NO_DOCUMENT, dims.NOT_FOUND))


def area_spread(values: Column) -> Column:
    numbers = F.array_compact(F.transform(values, lambda v: extract(v, "[0-9.]+", 0).try_cast("double")))
    return F.when(F.size(numbers) > 0, F.array_max(numbers) - F.array_min(numbers))


def evaluate_fields(matrix: DataFrame, fuzzy: float = 0.82, exact: bool = True) -> DataFrame:
    """The matrix with status GREEN / YELLOW / RED and a note per field.

    `similarity` is the lowest ratio of two values. It needs Python, so where it needn't be `exact`, rows whose lengths or
    characters rule out `fuzzy` have none; status and note are the same.
    """
    vals = given_values()
    spread = F.when(F.col("field_key") == "land_area", area_spread(F.col("vals")))
    texts = F.array_distinct(F.transform("vals", comparable))
    staged = (matrix.withColumn("vals", vals).withColumn("n", F.size("vals")).withColumn("spread", spread)
              .withColumn("texts", F.when(F.col("spread").isNull(), texts)))
    open_ = (F.col("n") > 1) & F.col("spread").isNull() & (F.size("texts") > 1)
    if not exact:
        staged = staged.withColumn("reach", open_ & all_pairs_reach(F.col("texts"), fuzzy, lengths_bound)).withColumn(
            "reach", F.when(F.col("reach"), all_pairs_reach(F.col("texts"), fuzzy, similarity_bound)))
        open_ = F.col("reach")
    scored = staged.withColumn("similarity", lowest_similarity(F.when(open_, F.col("texts")))).drop("reach")
    near = F.col("similarity") >= fuzzy
    delta = F.format_string("%.2f", "spread")
    status = (F.when(F.col("n") < 2, "YELLOW").when(F.col("spread") > 0.05, "RED").when(F.col("spread") > 0.001, "YELLOW")
              .when(F.col("spread").isNotNull(), "GREEN").when(F.size("texts") == 1, "GREEN").when(near, "YELLOW")
              .when(F.col("field_key").isin(dims.IDENTITY_FIELDS), "RED").otherwise("YELLOW"))
    note = (F.when(F.col("n") == 0, "Information missing across uploaded records")
            .when(F.col("n") == 1, "Only 1 document provides this field; unable to cross-validate")
            .when(F.col("spread") > 0.05, F.concat(F.lit("Area conflict detected: delta "), delta, F.lit(" units between uploaded documents")))
            .when(F.col("spread") > 0.001, F.concat(F.lit("Minor area discrepancy: delta "), delta, F.lit(" units")))
            .when(F.col("spread").isNotNull(), "Land area perfectly matches across records")
            .when(F.size("texts") == 1, "Values match across documents")
            .when(near, "Possible minor OCR typographical discrepancy")
            .when(F.col("field_key").isin(dims.IDENTITY_FIELDS), "Substantial conflict in legal identifier/party name")
            .otherwise("Discrepancy detected across records; requires officer clarification"))
    return scored.withColumn("status", status).withColumn("notes", note).drop("vals", "n", "spread", "texts")


def dossier_summary(evaluated: DataFrame) -> DataFrame:
    """Matches, mismatches, missing values and overall status per dossier."""
    status = F.col("status")
    lacking = F.array_contains(F.array(*[F.col(k) for k in dims.DOSSIER_BUCKETS]), dims.NOT_FOUND)
    out = evaluated.groupBy("dossier").agg(
        F.max("documents").alias("documents"), F.count_if(status == "GREEN").alias("match_count"),
        F.count_if((status == "RED") | ((status == "YELLOW") & ~lacking)).alias("mismatch_count"),
        F.count_if((status == "YELLOW") & lacking).alias("missing_count"),
        F.count_if(status == "RED").alias("red"), F.count_if(status == "YELLOW").alias("yellow"))
    overall = F.when(F.col("red") > 0, "RED").when((F.col("yellow") > 0) | (F.col("documents") < 2), "YELLOW").otherwise("GREEN")
    return out.withColumn("overall_status", overall).drop("red", "yellow")


def unify_survey(records: DataFrame) -> DataFrame:
    """Records without a survey number take the first one found in their dossier (by id)."""
    known = folded(F.col("survey_number"), [*dims.MISSING_CROSSDOC, ""])
    first = records.where(known.isNotNull()).groupBy("dossier").agg(F.min_by("survey_number", "id").alias("first_survey"))
    joined = records.join(first, "dossier", "left")
    value = F.when(F.col("survey_number") == dims.NOT_FOUND, F.coalesce("first_survey", "survey_number")).otherwise(F.col("survey_number"))
    return joined.withColumn("survey_number", value).drop("first_survey")


APPROVAL = {"status": "APPROVED", "verification_status": "Officer Verified & Certified", "publication_status": "PUBLISHED",
            "is_public": True, "document_status": "Digitized, Verified & Publicly Available"}


def approve_dossier(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.lit(v) for c, v in APPROVAL.items()})


def approval_log(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("id").alias("land_record_id"), F.lit("Senior Revenue Officer & Tahsildar").alias("officer_name"),
        F.lit("APPROVED_CONSISTENT").alias("action"),
        F.lit("Approved Title & Boundary Consistency across Parcel Dossier").alias("remarks"))
