"""Validation rules, one query per rule, then the summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq import dims
from landq.operators import rules
from landq.plans.suite import Suite

suite = Suite()
q = suite.query

AS_OF = "1997-06-01"
PASS = "'PASS'"


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


MISSING = ("list_filter([" + ", ".join(
    f"case when coalesce({c}, 0) = 0 then '{c}' end" if c == "land_area" else f"case when coalesce({c}, '') = '' then '{c}' end"
    for c in dims.MANDATORY_FIELDS) + "], lambda x: x is not null)")
PARSED = "coalesce(try_strptime(registration_date, '%d-%m-%Y'), try_strptime(registration_date, '%Y-%m-%d'), try_strptime(registration_date, '%d/%m/%Y'))"
DELTA = "abs(land_area - cadastral_area)"
AREA = "cast(land_area as varchar)"


def _json(**values: str) -> str:
    return "cast(json_object(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ") as varchar)"


def _rule(name: str, rule_id: str, source: str, status: str, message: str, column, views: tuple[str, ...], prepare=None,
          details: str = "cast(null as varchar)", severity: str = "cast(null as varchar)", review: str = "cast(null as boolean)") -> None:
    """Register one rule over all records: SQL over `source`, Spark over the records with joined facts."""
    @q(name, f"select id, '{rule_id}' as rule_id, {status} as status, {message} as message, {details} as details, {severity} as severity, "
             f"{review} as requires_review from {source}", *views)
    def _(v):
        df = v.lr if prepare is None else prepare(v)
        return df.select("id", F.inline(F.array(column()))).drop("rule_name")


DIRTY = {"village": "case when id % 23 = 0 then '' else village end", "owner_name": "case when id % 29 = 0 then 'Al' when id % 31 = 0 then null else owner_name end",
         "tehsil": "case when id % 37 = 0 then null else tehsil end", "survey_number": "case when id % 41 = 0 then '' else survey_number end",
         "confidence_score": "case when id % 43 = 0 then null else confidence_score end",
         "registration_date": "case id % 5 when 0 then replace(registration_date, '-', '/') when 1 then concat('on ', registration_date) else registration_date end"}
DIRTY_SQL = "(select * replace (" + ", ".join(f"{e} as {c}" for c, e in DIRTY.items()) + ") from lr)"


def _dirty(v):
    return v.lr.withColumns({c: F.expr(e) for c, e in DIRTY.items()})


_rule("VA01_mandatory_fields", "RULE-01", f"(select id, {MISSING} as m from {DIRTY_SQL})", "case when len(m) > 0 then 'ERROR' else 'PASS' end",
      "case when len(m) > 0 then concat('Missing mandatory field(s): ', array_to_string(m, ', ')) else 'All mandatory legal fields present.' end",
      rules.mandatory, ("lr",), _dirty, _json(missing_fields="m"))
SYNTAX_A = "regexp_matches(survey_number, '^[0-9]+(/[0-9A-Za-z]+)?$')"
_rule("VA02_survey_syntax", "RULE-02", DIRTY_SQL, f"case when {SYNTAX_A} then 'PASS' else 'WARNING' end",
      f"case when {SYNTAX_A} then concat('Survey number ''', survey_number, ''' format is compliant.') "
      "else concat('Survey number ''', survey_number, ''' might have non-standard sub-division format.') end",
      rules.survey_syntax, ("lr",), _dirty, _json(survey_number="survey_number"))
_rule("VA03_area_bounds", "RULE-03", "lr", "case when land_area between 0.01 and 5000 then 'PASS' else 'ERROR' end",
      f"case when land_area between 0.01 and 5000 then concat('Land area (', {AREA}, ' Acres) is within permissible realistic bounds.') "
      f"else concat('Invalid land area (', {AREA}, ' Acres). Must be > 0 and <= 5000 Acres.') end", rules.area_bounds, ("lr",),
      details=_json(land_area="land_area"))
OWNER_OK, BOTH_OK = "length(coalesce(owner_name, '')) >= 3", "length(coalesce(owner_name, '')) >= 3 and length(coalesce(father_husband_name, '')) >= 3"
_rule("VA04_owner_lineage", "RULE-04", DIRTY_SQL, f"case when {BOTH_OK} then 'PASS' when {OWNER_OK} then 'WARNING' else 'ERROR' end",
      f"case when {BOTH_OK} then 'Owner identity and lineage verified.' else 'Father/Husband name is missing or ambiguous.' end",
      rules.lineage, ("lr",), _dirty, _json(owner_name="trim(coalesce(owner_name, ''))", father_husband_name="trim(coalesce(father_husband_name, ''))"))
LATE = f"coalesce({PARSED} > timestamp '{AS_OF}', false)"
_rule("VA05_date_chronology", "RULE-05", DIRTY_SQL, f"case when {LATE} then 'ERROR' else 'PASS' end",
      f"case when {LATE} then concat('Registration date ''', registration_date, ''' is invalid or set in the future.') "
      "else 'Registration date is chronological and verified.' end", lambda: rules.chronology(AS_OF), ("lr",), _dirty,
      _json(registration_date="trim(coalesce(registration_date, ''))"))
_rule("VA06_admin_hierarchy", "RULE-06", DIRTY_SQL, "case when coalesce(tehsil, '') <> '' then 'PASS' else 'WARNING' end",
      "case when coalesce(tehsil, '') <> '' then concat('Administrative hierarchy verified for ', tehsil, ', ', district, ', ', state, '.') "
      "else 'Incomplete administrative jurisdiction specified.' end", rules.hierarchy, ("lr",), _dirty,
      _json(state="state", district="district", tehsil="tehsil"))
WITH_CAD = "(select lr.*, cadastral_area, survey_year, cad.village as cadastral_village from lr left join cad on cad.survey_number = lr.survey_number)"
_rule("VA07_cadastral_area", "RULE-07", WITH_CAD, f"case when {DELTA} > 0.01 then 'WARNING' else 'PASS' end",
      f"case when {DELTA} > 0.01 then concat('Area mismatch detected: Land Record = ', {AREA}, ' Acres, Cadastral Ground Truth = ', "
      f"cast(cadastral_area as varchar), ' Acres (Delta: ', printf('%.2f', {DELTA}), ' Ac).') when cadastral_area is not null then "
      "concat('Cadastral ground truth matches perfectly (', cast(cadastral_area as varchar), ' Acres).') "
      "else concat('Survey parcel ', survey_number, ' verified without prior conflicting cadastral survey.') end",
      rules.cadastral_match, ("lr", "cad"), lambda v: rules.with_parcel(v.lr, v.cad),
      f"case when cadastral_area is null then '{{}}' else " + _json(cadastral_area="cadastral_area", record_area="land_area",
                                                                   delta=f"round({DELTA}, 3)", survey_year="survey_year") + " end",
      f"case when {DELTA} > 0.01 then 'ERROR' else 'INFO' end", f"coalesce({DELTA} > 0.01, false)")
CLASS_OK = f"land_classification in ({_listed(dims.LAND_CLASSES)})"
_rule("VA08_land_classification", "RULE-08", "lr", f"case when {CLASS_OK} then 'PASS' else 'WARNING' end",
      f"case when {CLASS_OK} then concat('Land classification ''', land_classification, ''' recognized by revenue code.') "
      "else concat('Unrecognized land classification ''', land_classification, '''.') end", rules.land_class, ("lr",),
      details=_json(land_classification="land_classification"))
_rule("VA09_deed_type", "RULE-09", "(select * replace (case when id % 3 = 0 then null when id % 3 = 1 then 'Gift Deed' else document_type end as document_type) from lr)",
      f"case when coalesce(document_type, 'Sale Deed') in ({_listed(dims.DEED_TYPES)}) then 'PASS' else 'WARNING' end",
      "concat('Standard statutory deed type recognized: ', coalesce(document_type, 'Sale Deed'), '.')", rules.deed_type, ("lr",),
      lambda v: v.lr.withColumn("document_type", F.expr(
          "case when id % 3 = 0 then null when id % 3 = 1 then 'Gift Deed' else document_type end")),
      _json(document_type="coalesce(document_type, 'Sale Deed')"))


CONSTANTS = ((10, rules.SEAL), (11, rules.DISPUTE), (13, rules.POLYGON))


@q("VA10_constant_rules", " union all ".join(
    f"select id, 'RULE-{n}' as rule_id, 'PASS' as status, '{m}' as message, '{rules.CONSTANT_DETAILS[n]}' as details, cast(null as varchar) as severity, "
    "cast(null as boolean) as requires_review from lr" for n, m in CONSTANTS), "lr")
def _(v):
    return v.lr.select("id", F.inline(F.array(*[rules.constant(n, m) for n, m in CONSTANTS]))).drop("rule_name")


TAKEN = "exists (select 1 from lr o where o.registration_number = r.registration_number and o.id <> r.id)"
_rule("VA11_duplicate_registration", "RULE-12", "lr r", f"case when {TAKEN} then 'ERROR' else 'PASS' end",
      f"case when {TAKEN} then concat('Collision: Registration number ''', registration_number, ''' already exists.') "
      "else concat('Registration number ''', registration_number, ''' is unique.') end",
      rules.unique_registration, ("lr",), lambda v: rules.with_duplicate(v.lr, v.lr),
      _json(registration_number="registration_number", is_duplicate=TAKEN))
SCORE = "coalesce(confidence_score, 92)"
_rule("VA12_confidence_gate", "RULE-14", DIRTY_SQL, f"case when {SCORE} >= 80 then 'PASS' when {SCORE} >= 60 then 'WARNING' else 'ERROR' end",
      f"case when {SCORE} >= 80 then concat('Extraction confidence (', printf('%.1f', {SCORE}), '%) meets quality criteria.') "
      f"else concat('Moderate/Low confidence extraction (', printf('%.1f', {SCORE}), '%). Officer review required.') end",
      rules.confidence_gate, ("lr",), _dirty, _json(confidence_score="cast(coalesce(confidence_score, 92) as double)"))

SET_A = {  # rule -> status of one row, over lr joined with cad
    "RULE-01": "case when coalesce(land_area, 0) = 0 then 'ERROR' else 'PASS' end",
    "RULE-02": f"case when {SYNTAX_A} then 'PASS' else 'WARNING' end",
    "RULE-03": "case when land_area between 0.01 and 5000 then 'PASS' else 'ERROR' end",
    "RULE-04": f"case when {BOTH_OK} then 'PASS' when {OWNER_OK} then 'WARNING' else 'ERROR' end",
    "RULE-05": f"case when {LATE} then 'ERROR' else 'PASS' end",
    "RULE-06": PASS, "RULE-07": f"case when {DELTA} > 0.01 then 'WARNING' else 'PASS' end",
    "RULE-08": f"case when {CLASS_OK} then 'PASS' else 'WARNING' end", "RULE-09": "'WARNING'", "RULE-10": PASS, "RULE-11": PASS,
    "RULE-12": "case when n > 1 then 'ERROR' else 'PASS' end", "RULE-13": PASS,
    "RULE-14": f"case when {SCORE} >= 80 then 'PASS' when {SCORE} >= 60 then 'WARNING' else 'ERROR' end",
}
FACTS = ("f as (select lr.*, cadastral_area, count(*) over (partition by registration_number) as n from lr "
         "left join cad on cad.survey_number = lr.survey_number)")
LONG_A = "long as (" + " union all ".join(f"select id, '{r}' as rule_id, {s} as status from f" for r, s in SET_A.items()) + ")"


@q("VA13_summarize", f"""with {FACTS}, {LONG_A}
   select id, count(*) filter (status = 'ERROR') > 0 as has_errors, count(*) filter (status = 'WARNING') > 0 as has_warnings,
     case when count(*) filter (status = 'ERROR') > 0 then 'FAILED' when count(*) filter (status = 'WARNING') > 0 then 'WARNING' else 'PASSED' end as overall_status,
     (count(*) filter (status = 'PASS'))::int as passed_rules, count(*)::int as total_rules from long group by id""", "lr", "cad")
def _(v):
    return rules.summarize_a(rules.evaluate_a(v.lr, v.cad, v.lr, AS_OF, rules.STATUS))


@q("VA14_rule_catalog", f"""with {FACTS}, {LONG_A}, cat(rule_id, catalog_name, severity) as (values {', '.join(str(r) for r in dims.RULE_CATALOG)})
   select long.rule_id, catalog_name, severity, status, count(*) as records from long join cat on cat.rule_id = long.rule_id group by all""", "lr", "cad")
def _(v):
    results = rules.long_form(rules.evaluate_a(v.lr, v.cad, v.lr, AS_OF, rules.STATUS))
    counted = results.groupBy("rule_id", "status").agg(F.count("*").alias("records"))
    return rules.with_catalog(counted).select("rule_id", "catalog_name", "severity", "status", "records")


_rule("VB01_required_fields", "RULE-01", f"(select id, {MISSING} as m from {DIRTY_SQL})", "case when len(m) > 0 then 'ERROR' else 'PASS' end",
      "case when len(m) > 0 then concat('Missing mandatory field(s): ', array_to_string(m, ', ')) else 'All mandatory land record fields are present' end",
      rules.b_required, ("lr",), _dirty, "case when len(m) > 0 then " + _json(missing_fields="m") + " end")
SYNTAX_B = "(survey_number <> '' and not regexp_matches(survey_number, '^[0-9]+(/[0-9]+[A-Za-z]*)?$'))"
_rule("VB02_survey_format", "RULE-02", DIRTY_SQL, f"case when {SYNTAX_B} then 'WARNING' else 'PASS' end",
      f"case when {SYNTAX_B} then concat('Survey number ''', survey_number, ''' does not strictly match standard Tehsil notation (e.g. 123/4A)') "
      "else concat('Survey number format valid: ''', survey_number, '''') end", rules.b_survey, ("lr",), _dirty,
      f"case when {SYNTAX_B} then " + _json(format_expected="'Digit/DigitSubdivision'") + " end")
TEXT_AREA = "case when id % 47 = 0 then 'two acres' else cast(land_area as varchar) end"
_rule("VB03_area_feasible", "RULE-03", f"(select id, try_cast({TEXT_AREA} as double) as a from lr)",
      "case when a > 0 and a <= 5000 then 'PASS' else 'ERROR' end",
      "case when a is null then 'Land area must be a numerical quantity' when a > 0 and a <= 5000 then concat('Land area ', cast(a as varchar), "
      "' Acres is within permissible range') else concat('Invalid land area: ', cast(a as varchar), ' Acres (must be between 0.01 and 5000 Acres)') end",
      rules.b_area, ("lr",), lambda v: v.lr.withColumn("land_area", F.expr(TEXT_AREA.replace("varchar", "string"))),
      "case when a is null then '{}' when not (a > 0 and a <= 5000) then " + _json(area="a") + " end")
FIRST_APPROVED = """(select r.*, (select min(o.id) from lr o where o.survey_number = r.survey_number and o.id <> r.id and o.status in ('APPROVED', 'PUBLISHED')
   and contains(lower(o.village), lower(r.village))) as m from lr r) x left join lr o on o.id = x.m"""
_rule("VB04_duplicate_survey", "RULE-04", f"(select x.id, x.survey_number, x.village, x.m, o.registration_number as other, o.owner_name as holder from {FIRST_APPROVED})",
      "case when m is not null then 'WARNING' else 'PASS' end",
      "case when m is not null then concat('Duplicate survey number ''', survey_number, ''' in village ''', village, ''' already exists (Record #', other, ')') "
      "else 'No conflicting duplicate active survey parcel detected' end",
      rules.b_duplicate_survey, ("lr",), lambda v: rules.with_survey_match(v.lr, v.lr),
      "case when m is not null then " + _json(existing_owner="holder", existing_reg="other") + " end")
_rule("VB05_unique_registration", "RULE-05", "lr r", f"case when {TAKEN} then 'ERROR' else 'PASS' end",
      f"case when {TAKEN} then concat('Registration Number ''', registration_number, ''' already exists in the Official Land Registry') "
      "else concat('Registration number ''', registration_number, ''' is unique') end",
      rules.b_unique_registration, ("lr",), lambda v: rules.with_duplicate(v.lr, v.lr),
      f"case when {TAKEN} then " + _json(reg_no="registration_number") + " end")
_rule("VB06_cadastral_crosscheck", "RULE-07", WITH_CAD, f"case when {DELTA} > 0.02 then 'WARNING' else 'PASS' end",
      f"case when {DELTA} > 0.02 then printf('Area mismatch: Extracted Record = %.2f Acres, Cadastral Database = %.2f Acres (Delta: %.2f Acres)', land_area, cadastral_area, {DELTA}) "
      f"when cadastral_area is not null then concat('Land area verified with Cadastral DB (Extracted: ', {AREA}, ' Acres, Cadastral: ', cast(cadastral_area as varchar), ' Acres)') "
      "else concat('Survey number ''', survey_number, ''' cadastral baseline registered') end",
      rules.b_cadastral, ("lr", "cad"), lambda v: rules.with_parcel(v.lr, v.cad),
      f"case when {DELTA} > 0.02 then " + _json(extracted_area="land_area", cadastral_area="cadastral_area", delta=f"round({DELTA}, 2)",
                                                cadastral_village="cadastral_village") + " end",
      f"case when {DELTA} > 0.02 then 'ERROR' end", f"case when {DELTA} > 0.02 then true end")
DISTRICTS = "case id % 4 when 0 then 'Bhopal Urban' when 1 then 'west WARANGAL' when 2 then '' else district end"
DISTRICT_OK = " or ".join(f"contains(lower(d), '{x.lower()}')" for x in dims.KNOWN_DISTRICTS)
_rule("VB07_known_district", "RULE-09", f"(select id, {DISTRICTS} as d from lr)", f"case when d <> '' and not ({DISTRICT_OK}) then 'WARNING' else 'PASS' end",
      f"case when d <> '' and not ({DISTRICT_OK}) then concat('District ''', d, ''' requires manual administrative zone confirmation') "
      "else concat('District ''', d, ''' matched official administrative boundaries') end",
      rules.b_district, ("lr",), lambda v: v.lr.withColumn("district", F.expr(DISTRICTS)),
      f"case when d <> '' and not ({DISTRICT_OK}) then " + _json(district="d") + " end")
_rule("VB08_date_timeline", "RULE-10", "lr", PASS, "concat('Registration date ''', registration_date, ''' is consistent with deed sequence')",
      rules.b_timeline, ("lr",))

SET_B = {
    "RULE-01": SET_A["RULE-01"], "RULE-02": f"case when {SYNTAX_B} then 'WARNING' else 'PASS' end",
    "RULE-03": "case when land_area > 0 and land_area <= 5000 then 'PASS' else 'ERROR' end",
    "RULE-04": """case when exists (select 1 from lr o where o.survey_number = f.survey_number and o.id <> f.id and o.status in ('APPROVED', 'PUBLISHED')
                  and contains(lower(o.village), lower(f.village))) then 'WARNING' else 'PASS' end""",
    "RULE-05": SET_A["RULE-12"], "RULE-07": f"case when {DELTA} > 0.02 then 'WARNING' else 'PASS' end",
    "RULE-09": "case when district <> '' then 'WARNING' else 'PASS' end", "RULE-10": PASS,
}
LONG_B = "long as (" + " union all ".join(f"select id, '{r}' as rule_id, {s} as status from f" for r, s in SET_B.items()) + ")"


@q("VB09_summarize", f"""with {FACTS}, {LONG_B}
   select id, count(*) filter (status = 'ERROR') > 0 as has_errors, count(*) filter (status = 'WARNING') > 0 as has_warnings,
     case when count(*) filter (status = 'ERROR') > 0 then 'VALIDATION_FAILED' when count(*) filter (status = 'WARNING') > 0 then 'OFFICER_REVIEW' else 'APPROVED' end as overall_status,
     (count(*) filter (status = 'PASS'))::int as passed_rules, count(*)::int as total_rules from long group by id""", "lr", "cad")
def _(v):
    return rules.summarize_b(rules.evaluate_b(v.lr, v.cad, v.lr, rules.STATUS))


@q("VB10_document_rollup", f"""with {FACTS}, {LONG_A} select id, count(*) filter (status = 'ERROR') as error_count, count(*) filter (status = 'WARNING') as warning_count,
   count(*) filter (status = 'ERROR') = 0 as is_valid from long group by id""", "lr", "cad")
def _(v):
    return rules.rollup(rules.long_form(rules.evaluate_a(v.lr, v.cad, v.lr, AS_OF, rules.STATUS)))


VALUE = "case when ordinal = 5 and land_record_id % 3 = 0 then '-' when ordinal = 5 and land_record_id % 3 = 1 then '0.0 Acres' when ordinal = 3 and land_record_id % 5 = 0 then concat(extracted_value, '#') else extracted_value end"


@q("VB11_form_checks", f"""
   with val as (select land_record_id as id, field_name, {VALUE} as value, case when field_name = 'land_area' then 'numeric' when field_name = 'registration_date' then 'date'
     when field_name in ('survey_number', 'khasra_number') then 'survey_number' else 'text' end as kind from fields)
   select id, field_name, value, case when lower(trim(value)) in ('', 'not found', 'n/a') then null
     when kind = 'numeric' and coalesce(try_cast(nullif(regexp_extract(value, '[0-9]+\\.?[0-9]*|\\.[0-9]+'), '') as double) <= 0, true) then 'Must contain a positive numeric value'
     when kind = 'survey_number' and not regexp_matches(value, '^[a-zA-Z0-9/\\-,.\\s]+$') then 'Contains invalid characters for survey/plot number' end as error from val""", "fields")
def _(v):
    from landq.functions.labels import validation_type
    values = v.fields.selectExpr("land_record_id as id", "field_name", f"{VALUE} as value")
    return values.withColumn("error", rules.field_form_error(F.col("value"), validation_type("field_name")))
