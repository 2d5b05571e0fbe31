"""Validation rules as column expressions; each gives struct(rule_id, rule_name, status, message, details, severity, requires_review).

`details` is JSON text; severity and requires_review belong to the cadastral rule alone and are NULL elsewhere.

Set A has 14 rules, set B 8 stricter ingest rules. The facts a rule needs from other rows (parcel of the survey
number, another record with the same number) are joined in first, reduced to one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq import dims
from landq.operators.joins import parcels_for
from landq.operators.lookup import first_containing

NAMES_A = {rule: name for rule, name, _ in dims.RULE_CATALOG}


def text(column: str) -> Column:
    """The trimmed value, NULL read as missing."""
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))


def facts(**values: Column) -> Column:
    """The named values as JSON text; NULL values are kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def row(rule_id: str, name: str, status: Column, message: Column, details: Column | None = None, severity: Column | None = None,
        requires_review: Column | None = None) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), status.alias("status"),
                    message.alias("message"), (F.lit(None) if details is None else details).cast("string").alias("details"),
                    (F.lit(None) if severity is None else severity).cast("string").alias("severity"),
                    (F.lit(None) if requires_review is None else requires_review).cast("boolean").alias("requires_review"))


def _a(number: int, status: Column, message: Column, details: Column, **more: Column) -> Column:
    rule_id = f"RULE-{number:02d}"
    return row(rule_id, NAMES_A[rule_id], status, message, details, **more)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def missing_fields() -> Column:
    """Names of mandatory fields that are NULL, empty or zero."""
    def absent(column: str) -> Column:
        if column == "land_area":
            return F.coalesce(F.col(column).try_cast("double") == 0, F.lit(True))
        return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""
    return F.array_compact(F.array(*[F.when(absent(c), F.lit(c)) for c in dims.MANDATORY_FIELDS]))


def area_value() -> Column:
    """The land area, 0 where it does not parse."""
    return F.coalesce(F.col("land_area").try_cast("double"), F.lit(0.0))


def mandatory() -> Column:
    lacking = missing_fields()
    bad = F.size(lacking) > 0
    return _a(1, F.when(bad, "ERROR").otherwise("PASS"),
              F.when(bad, _say("Missing mandatory field(s): ", F.array_join(lacking, ", ")))
              .otherwise("All mandatory legal fields present."), facts(missing_fields=lacking))


def survey_syntax() -> Column:
    ok = text("survey_number").rlike("^[0-9]+(/[0-9A-Za-z]+)?$")
    return _a(2, F.when(ok, "PASS").otherwise("WARNING"),
              F.when(ok, _say("Survey number '", text("survey_number"), "' format is compliant."))
              .otherwise(_say("Survey number '", text("survey_number"), "' might have non-standard sub-division format.")),
              facts(survey_number=text("survey_number")))


def area_bounds() -> Column:
    area = area_value()
    ok = F.coalesce(F.col("land_area").try_cast("double").between(0.01, 5000.0), F.lit(False))
    return _a(3, F.when(ok, "PASS").otherwise("ERROR"),
              F.when(ok, _say("Land area (", area.cast("string"), " Acres) is within permissible realistic bounds."))
              .otherwise(_say("Invalid land area (", area.cast("string"), " Acres). Must be > 0 and <= 5000 Acres.")),
              facts(land_area=area))


def lineage() -> Column:
    owner = F.length(text("owner_name")) >= 3
    both = owner & (F.length(text("father_husband_name")) >= 3)
    return _a(4, F.when(both, "PASS").when(owner, "WARNING").otherwise("ERROR"),
              F.when(both, "Owner identity and lineage verified.")
              .otherwise("Father/Husband name is missing or ambiguous."),
              facts(owner_name=text("owner_name"), father_husband_name=text("father_husband_name")))


def chronology(as_of: str) -> Column:
    """Fails only for a date that parses and lies after `as_of`."""
    value = text("registration_date")
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in ("d-M-yyyy", "yyyy-M-d", "d/M/yyyy")])
    late = F.coalesce(parsed > F.lit(as_of).cast("timestamp"), F.lit(False))
    return _a(5, F.when(late, "ERROR").otherwise("PASS"),
              F.when(late, _say("Registration date '", value, "' is invalid or set in the future."))
              .otherwise("Registration date is chronological and verified."), facts(registration_date=value))


def hierarchy() -> Column:
    ok = (text("district") != "") & (text("tehsil") != "")
    return _a(6, F.when(ok, "PASS").otherwise("WARNING"),
              F.when(ok, _say("Administrative hierarchy verified for ", text("tehsil"), ", ", text("district"), ", ",
                              text("state"), "."))
              .otherwise("Incomplete administrative jurisdiction specified."),
              facts(state=F.col("state"), district=F.col("district"), tehsil=F.col("tehsil")))


def cadastral_match(tolerance: float = 0.01) -> Column:
    """Needs `cadastral_area` and `survey_year` joined in; no parcel passes, with empty details."""
    delta = F.abs(area_value() - F.col("cadastral_area"))
    off = F.coalesce(delta > tolerance, F.lit(False))
    return _a(7, F.when(off, "WARNING").otherwise("PASS"),
              F.when(off, _say("Area mismatch detected: Land Record = ", area_value().cast("string"),
                               " Acres, Cadastral Ground Truth = ", F.col("cadastral_area").cast("string"),
                               " Acres (Delta: ", F.format_string("%.2f", delta), " Ac)."))
              .when(F.col("cadastral_area").isNotNull(),
                    _say("Cadastral ground truth matches perfectly (", F.col("cadastral_area").cast("string"), " Acres)."))
              .otherwise(_say("Survey parcel ", text("survey_number"),
                              " verified without prior conflicting cadastral survey.")),
              F.when(F.col("cadastral_area").isNull(), "{}").otherwise(facts(
                  cadastral_area=F.col("cadastral_area"), record_area=area_value(), delta=F.round(delta, 3), survey_year=F.col("survey_year"))),
              severity=F.when(off, "ERROR").otherwise("INFO"), requires_review=off)


def land_class() -> Column:
    value = F.coalesce("land_classification", F.lit("Agricultural"))
    ok = value.isin(dims.LAND_CLASSES)
    return _a(8, F.when(ok, "PASS").otherwise("WARNING"),
              F.when(ok, _say("Land classification '", value, "' recognized by revenue code."))
              .otherwise(_say("Unrecognized land classification '", value, "'.")), facts(land_classification=value))


def deed_type() -> Column:
    value = F.coalesce("document_type", F.lit("Sale Deed"))
    return _a(9, F.when(value.isin(dims.DEED_TYPES), "PASS").otherwise("WARNING"),
              _say("Standard statutory deed type recognized: ", value, "."), facts(document_type=value))


def constant(number: int, message: str) -> Column:
    return _a(number, F.lit("PASS"), F.lit(message), F.lit(CONSTANT_DETAILS[number]))


def unique_registration() -> Column:
    """Needs `duplicate_id` joined in."""
    taken = F.col("duplicate_id").isNotNull()
    return _a(12, F.when(taken, "ERROR").otherwise("PASS"),
              F.when(taken, _say("Collision: Registration number '", text("registration_number"), "' already exists."))
              .otherwise(_say("Registration number '", text("registration_number"), "' is unique.")),
              facts(registration_number=text("registration_number"), is_duplicate=taken))


def confidence_gate() -> Column:
    value = F.coalesce(F.col("confidence_score"), F.lit(92.0))
    return _a(14, F.when(value >= 80, "PASS").when(value >= 60, "WARNING").otherwise("ERROR"),
              F.when(value >= 80, _say("Extraction confidence (", F.format_string("%.1f", value), "%) meets quality criteria."))
              .otherwise(_say("Moderate/Low confidence extraction (", F.format_string("%.1f", value),
                              "%). Officer review required.")), facts(confidence_score=value))


#: Messages and details of the rules that always pass.
CONSTANT_DETAILS = {10: '{"sro_verified":true}', 11: '{"encumbrance_status":"CLEAR"}', 13: '{"topology_valid":true}'}
SEAL = "Sub-Registrar digital signature & biometric verification mark validated."
DISPUTE = "No active injunction or revenue dispute on record."
POLYGON = "Cadastral boundary coordinates form closed topological polygon."


def rule_set_a(as_of: str) -> list[Column]:
    return [mandatory(), survey_syntax(), area_bounds(), lineage(), chronology(as_of), hierarchy(), cadastral_match(),
            land_class(), deed_type(), constant(10, SEAL), constant(11, DISPUTE), unique_registration(),
            constant(13, POLYGON), confidence_gate()]


def with_parcel(records: DataFrame, parcels: DataFrame) -> DataFrame:
    side = parcels_for(parcels).select("survey_number", "cadastral_area", "cadastral_village", "survey_year")
    return records.join(side, "survey_number", "left")


def with_duplicate(records: DataFrame, registry: DataFrame) -> DataFrame:
    """`duplicate_id`: whether another record holds the same registration number.

    Lowest and highest id per number decide it, so the registry is reduced ahead of the shuffle.
    """
    ids = registry.where(F.coalesce("registration_number", F.lit("")) != "").groupBy("registration_number").agg(
        F.min("id").alias("low"), F.max("id").alias("high"))
    joined = records.join(ids, "registration_number", "left")
    other = F.when(F.col("low") != F.col("id"), F.col("low")).when(F.col("high") != F.col("id"), F.col("high"))
    return joined.withColumn("duplicate_id", other).drop("low", "high")


STATUS = ("rule_id", "status")


def results_of(rule_set: list[Column], columns: tuple[str, ...] | None) -> Column:
    """The array of the rules' results, or of the named columns of each: what isn't named is not computed."""
    return F.array(*[r if columns is None else F.struct(*[r[c].alias(c) for c in columns]) for r in rule_set])


def evaluate_a(records: DataFrame, parcels: DataFrame, registry: DataFrame, as_of: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Records with the array `results` of all 14 rules."""
    known = with_duplicate(with_parcel(records, parcels), registry)
    return known.withColumn("results", results_of(rule_set_a(as_of), columns))


def long_form(evaluated: DataFrame, key: str = "id") -> DataFrame:
    return evaluated.select(key, F.inline("results"))


def summarize(evaluated: DataFrame, failed: str, warned: str, passed: str, key: str = "id") -> DataFrame:
    """One row per record from its own results: no shuffle."""
    errors = F.exists("results", lambda r: r["status"] == "ERROR")
    warnings = F.exists("results", lambda r: r["status"] == "WARNING")
    return evaluated.select(
        key, errors.alias("has_errors"), warnings.alias("has_warnings"),
        F.when(errors, failed).when(warnings, warned).otherwise(passed).alias("overall_status"),
        F.size(F.filter("results", lambda r: r["status"] == "PASS")).alias("passed_rules"),
        F.size("results").alias("total_rules"))


def summarize_a(evaluated: DataFrame) -> DataFrame:
    return summarize(evaluated, "FAILED", "WARNING", "PASSED")


def with_catalog(results: DataFrame, catalog: list[tuple] = dims.RULE_CATALOG) -> DataFrame:
    """Results with the catalogued name and nominal severity (in place of their own). The catalog is short and fixed."""
    frame = results.sparkSession.createDataFrame(catalog, "rule_id string, catalog_name string, severity string")
    return results.drop("severity").join(frame, "rule_id")


# ---- set B ----------------------------------------------------------------------------------------------------

def b_required() -> Column:
    lacking = missing_fields()
    bad = F.size(lacking) > 0
    return row("RULE-01", "Required Fields Completeness Check", F.when(bad, "ERROR").otherwise("PASS"),
               F.when(bad, _say("Missing mandatory field(s): ", F.array_join(lacking, ", ")))
               .otherwise("All mandatory land record fields are present"), F.when(bad, facts(missing_fields=lacking)))


def b_survey() -> Column:
    value = text("survey_number")
    bad = (value != "") & ~value.rlike("^[0-9]+(/[0-9]+[A-Za-z]*)?$")
    return row("RULE-02", "Survey Number Format Validation", F.when(bad, "WARNING").otherwise("PASS"),
               F.when(bad, _say("Survey number '", value, "' does not strictly match standard Tehsil notation (e.g. 123/4A)"))
               .otherwise(_say("Survey number format valid: '", value, "'")), F.when(bad, '{"format_expected":"Digit/DigitSubdivision"}'))


def b_area() -> Column:
    parsed = F.col("land_area").try_cast("double")
    ok = (parsed > 0) & (parsed <= 5000)
    return row("RULE-03", "Land Area Feasibility Range",
               F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("ERROR"),
               F.when(parsed.isNull(), "Land area must be a numerical quantity")
               .when(ok, _say("Land area ", parsed.cast("string"), " Acres is within permissible range"))
               .otherwise(_say("Invalid land area: ", parsed.cast("string"), " Acres (must be between 0.01 and 5000 Acres)")),
               F.when(parsed.isNull(), "{}").when(~ok, facts(area=parsed)))


def b_duplicate_survey() -> Column:
    """Needs `survey_match` joined in."""
    hit = F.col("survey_match").isNotNull()
    return row("RULE-04", "Duplicate Survey Number Detection", F.when(hit, "WARNING").otherwise("PASS"),
               F.when(hit, _say("Duplicate survey number '", text("survey_number"), "' in village '", text("village"),
                                "' already exists (Record #", F.col("survey_match.registration_number"), ")"))
               .otherwise("No conflicting duplicate active survey parcel detected"),
               F.when(hit, facts(existing_owner=F.col("survey_match.owner_name"), existing_reg=F.col("survey_match.registration_number"))))


def b_unique_registration() -> Column:
    taken = F.col("duplicate_id").isNotNull()
    return row("RULE-05", "Registration Number Uniqueness", F.when(taken, "ERROR").otherwise("PASS"),
               F.when(taken, _say("Registration Number '", text("registration_number"),
                                  "' already exists in the Official Land Registry"))
               .otherwise(_say("Registration number '", text("registration_number"), "' is unique")),
               F.when(taken, facts(reg_no=text("registration_number"))))


def b_cadastral(tolerance: float = 0.02) -> Column:
    delta = F.abs(area_value() - F.col("cadastral_area"))
    off = F.coalesce(delta > tolerance, F.lit(False))
    return row("RULE-07", "Cadastral Database Cross-Verification", F.when(off, "WARNING").otherwise("PASS"),
               F.when(off, F.format_string("Area mismatch: Extracted Record = %.2f Acres, Cadastral Database = %.2f Acres "
                                           "(Delta: %.2f Acres)", area_value(), F.col("cadastral_area"), delta))
               .when(F.col("cadastral_area").isNotNull(),
                     _say("Land area verified with Cadastral DB (Extracted: ", area_value().cast("string"),
                          " Acres, Cadastral: ", F.col("cadastral_area").cast("string"), " Acres)"))
               .otherwise(_say("Survey number '", text("survey_number"), "' cadastral baseline registered")),
               F.when(off, facts(extracted_area=area_value(), cadastral_area=F.col("cadastral_area"), delta=F.round(delta, 2),
                                 cadastral_village=F.col("cadastral_village"))),
               severity=F.when(off, "ERROR"), requires_review=F.when(off, True))


def b_district(known: list[str] = dims.KNOWN_DISTRICTS) -> Column:
    value = text("district")
    listed = F.exists(F.array(*[F.lit(d.lower()) for d in known]), lambda d: F.contains(F.lower(value), d))
    bad = (value != "") & ~listed
    return row("RULE-09", "Administrative District Boundary Verification", F.when(bad, "WARNING").otherwise("PASS"),
               F.when(bad, _say("District '", value, "' requires manual administrative zone confirmation"))
               .otherwise(_say("District '", value, "' matched official administrative boundaries")), F.when(bad, facts(district=value)))


def b_timeline() -> Column:
    return row("RULE-10", "Registration Date Timeline Integrity", F.lit("PASS"),
               _say("Registration date '", text("registration_date"), "' is consistent with deed sequence"))


def rule_set_b() -> list[Column]:
    return [b_required(), b_survey(), b_area(), b_duplicate_survey(), b_unique_registration(), b_cadastral(),
            b_district(), b_timeline()]


def with_survey_match(records: DataFrame, registry: DataFrame, own_id: str = "id") -> DataFrame:
    """`survey_match`: the first other approved record of the same survey number whose village holds this village."""
    approved = registry.where(F.col("status").isin(dims.LEGACY_PUBLIC_STATUSES))
    hits = first_containing(records, approved, "survey_number", "village", ["owner_name", "registration_number"],
                            own_id=own_id)
    found = hits.select(F.col("id"), F.col("match").alias("survey_match"))
    return records.join(found, "id", "left")


def evaluate_b(records: DataFrame, parcels: DataFrame, registry: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Records with the array `results` of the ingest rules."""
    known = with_survey_match(with_duplicate(with_parcel(records, parcels), registry), registry)
    return known.withColumn("results", results_of(rule_set_b(), columns))


def summarize_b(evaluated: DataFrame) -> DataFrame:
    return summarize(evaluated, "VALIDATION_FAILED", "OFFICER_REVIEW", "APPROVED")


def rollup(results: DataFrame, key: str = "id") -> DataFrame:
    """Stored results (long) per document: error and warning counts, valid without errors."""
    return results.groupBy(key).agg(
        F.count_if(F.col("status") == "ERROR").alias("error_count"),
        F.count_if(F.col("status") == "WARNING").alias("warning_count")).withColumn("is_valid", F.col("error_count") == 0)


def field_form_error(value: Column, kind: Column) -> Column:
    """Form check of one field: the complaint, or NULL. Missing values are fine."""
    text_ = F.trim(F.coalesce(value, F.lit("")))
    missing = F.lower(text_).isin("", "not found", "n/a")
    number = F.regexp_extract(text_, "[0-9]+\\.?[0-9]*|\\.[0-9]+", 0).try_cast("double")
    bad_number = F.coalesce(number <= 0, F.lit(True))
    return (F.when(missing, F.lit(None).cast("string"))
            .when((kind == "numeric") & bad_number, "Must contain a positive numeric value")
            .when((kind == "survey_number") & ~text_.rlike(r"^[a-zA-Z0-9/\-,.\s]+$"),
                  "Contains invalid characters for survey/plot number"))
