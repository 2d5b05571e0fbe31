"""Joins of records with cadastre, registrations, states, documents and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq import dims
from landq.operators import joins, rules
from landq.plans.rules import AS_OF, FACTS, LONG_A
from landq.plans.suite import Suite
from landq.sources.views import FIELD_COLUMNS

suite = Suite()
q = suite.query


@q("JN01_reconcile_cadastral", """
   select l.id, l.survey_number, l.land_area as deed_area, c.id as cadastral_id, c.cadastral_area, c.id is not null as matched,
     round(abs(l.land_area - c.cadastral_area), 3) as delta, coalesce(abs(l.land_area - c.cadastral_area) > 0.01, false) as has_discrepancy,
     case when abs(l.land_area - c.cadastral_area) > 0.01 then 'SYNC_TO_CADASTRAL' when c.id is not null then 'CONFIRMED' end as recommended_action,
     case when c.id is null then concat('No baseline cadastral ground-truth entry found for survey number ', l.survey_number, '.')
          when abs(l.land_area - c.cadastral_area) > 0.01 then concat('Area mismatch detected: Land Deed = ', cast(l.land_area as varchar),
            ' Acres, Cadastral Ground Truth = ', cast(c.cadastral_area as varchar), ' Acres.')
          else 'Land area matches official Cadastral Ground Truth.' end as message
   from lr l left join cad c on l.survey_number = c.survey_number""", "lr", "cad")
def _(v):
    return joins.reconcile_cadastral(v.lr, v.cad)


for _name, _tolerance in [("", 0.01), ("_ingest", 0.02), ("_document", 0.05)]:
    @q(f"JN02_cadastral_crosscheck{_name}", f"""
       select l.id, coalesce(c.cadastral_area, l.land_area) as cadastral_area, coalesce(c.survey_year, 2021) as survey_year,
         coalesce(abs(l.land_area - c.cadastral_area) > {_tolerance}, false) as mismatch_detected,
         coalesce(round(abs(l.land_area - c.cadastral_area), 2), 0) as delta_acres
       from lr l left join cad c on l.survey_number = c.survey_number""", "lr", "cad")
    def _(v, tolerance=_tolerance):
        return joins.cadastral_crosscheck(v.lr, v.cad, tolerance).select(
            "id", "cadastral_area", "survey_year", "mismatch_detected", "delta_acres")


@q("JN03_parcels_with_status", """
   with first as (select survey_number, min(id) as id from lr group by 1)
   select c.id, c.survey_number, c.cadastral_area, coalesce(l.status, 'UNVERIFIED') as status,
     coalesce(l.owner_name, 'Official Revenue Cadastre') as owner_name, coalesce(l.land_classification, 'Revenue Land') as land_classification
   from cad c left join first f on f.survey_number = c.survey_number left join lr l on l.id = f.id""", "lr", "cad")
def _(v):
    return joins.parcels_with_status(v.cad, v.lr).select(
        "id", "survey_number", "cadastral_area", "status", "owner_name", "land_classification")


@q("JN04_registration_status", """
   with asked as (select distinct concat('reg/', lpad(cast(event_id * 3 as varchar), 8, '0')) as asked from events),
   pub as (select lower(registration_number) as k, min(id) as id from lr where is_public group by 1),
   pend as (select lower(registration_number) as k, min(id) as id from reg group by 1)
   select a.asked, case when p.id is not null then 'PUBLISHED' when r.id is not null then r.status else 'NOT_FOUND' end as status,
     case when p.id is not null then l.registration_number else r.registration_number end as registration_number,
     case when p.id is not null then l.owner_name else r.owner_name end as owner_name,
     case when p.id is not null then l.survey_number else r.survey_number end as survey_number,
     case when p.id is not null then l.village else r.village end as village,
     case when p.id is not null then l.district else r.district end as district,
     p.id as land_record_id, case when p.id is null then r.expected_public_date end as expected_public_date,
     p.id is not null as public_available
   from asked a left join pub p on p.k = a.asked left join lr l on l.id = p.id left join pend d on d.k = a.asked left join reg r on r.id = d.id""",
   "lr", "reg")
def _(v):
    asked = v.table("events").selectExpr(
        "concat('reg/', lpad(cast(event_id * 3 as string), 8, '0')) as registration_number").distinct()
    return joins.registration_status(asked, v.lr, v.reg)


STATE_BY_ID = "case id % 4 when 0 then 'Telangana' when 1 then 'Kerala' when 2 then 'West Bengal' else state end"


@q("JN05_enrich_state_profile", f"""
   with s as (select id, {STATE_BY_ID} as state from lr)
   select id, state, case state when 'Kerala' then 'Resurvey Number / Tandaper' when 'West Bengal' then 'Dag Number' else 'Survey Number' end as survey_label,
     case state when 'Telangana' then 'Dharani Pattadar Passbook' when 'Kerala' then 'e-Rekhakal RoR' when 'West Bengal' then 'Banglarbhumi Khatian'
       else 'Record of Rights (RoR)' end as ror_label,
     case state when 'Telangana' then 'Mandal' when 'Kerala' then 'Taluk' when 'West Bengal' then 'Block' else 'Tehsil / Taluka' end as admin_unit_label,
     case state when 'Telangana' then 'Acres / Guntas' when 'Kerala' then 'Hectares / Ares' when 'West Bengal' then 'Acres / Decimals' else 'Acres' end as area_unit,
     case state when 'Telangana' then 'Telugu / English' when 'Kerala' then 'Malayalam / English' when 'West Bengal' then 'Bengali / English'
       else 'English / Regional' end as profile_language from s""", "lr")
def _(v):
    return joins.enrich_state_profile(v.lr.selectExpr("id", f"{STATE_BY_ID} as state"))


@q("JN06_record_dossier_view", """
   with n as (select land_record_id as id, count(*) as n from fields group by 1),
   dup as (select registration_number from lr group by 1 having count(*) > 1)
   select l.id, l.owner_name, coalesce(c.cadastral_area, l.land_area) as cadastral_area,
     coalesce(abs(l.land_area - c.cadastral_area) > 0.01, false) as mismatch_detected, 1::bigint as documents, l.id as first_document,
     coalesce(n.n, 0) as fields,
     cast(l.land_area < 0.01 as bigint) * 2 + cast(d.registration_number is not null as bigint) + cast(l.confidence_score < 60 as bigint) as errors
   from lr l left join cad c on c.survey_number = l.survey_number left join n on n.id = l.id
   left join dup d on d.registration_number = l.registration_number""", "lr", "cad", "fields")
def _(v):
    results = rules.long_form(rules.evaluate_a(v.lr, v.cad, v.lr, "2026-01-01"))
    return joins.dossier_header(v.lr, v.cad, v.deed, v.fields, results).select(
        "id", "owner_name", "cadastral_area", "mismatch_detected", "documents", "first_document", "fields", "errors")


@q("JN06_record_dossier_items", f"""
   with {FACTS}, {LONG_A}
   select id, 'document' as section, cast(doc_id as varchar) as item, document_type as value from deed
   union all select land_record_id, 'field', field_name, coalesce(corrected_value, extracted_value) from fields
   union all select id, 'validation', rule_id, status from long""", "deed", "fields", "lr", "cad")
def _(v):
    results = rules.long_form(rules.evaluate_a(v.lr, v.cad, v.lr, AS_OF, rules.STATUS))
    return joins.dossier_items(v.deed, v.fields, results)


def _core_sql() -> str:
    parts = []
    for name, label, group, column, conf, required, kind, aliases in dims.CORE_FIELDS:
        listed = ", ".join(f"'{a}'" for a in aliases)
        if column is None:
            value = "'Not found'"
        elif column == "land_area":
            value = "case when land_area <> 0 then cast(land_area as varchar) else 'Not found' end"
        else:
            value = f"coalesce(nullif({column}, ''), '{'Land Document' if column == 'document_type' else 'Not found'}')"
        label = label.replace("'", "''")
        parts.append(
            f"select l.id as land_record_id, '{name}' as field_name, '{label}' as field_label, '{group}' as category, {value} as final_value, "
            f"{conf}::double as confidence, {required} as is_required, '{kind}' as validation_type, "
            f"case when status = 'USER_VERIFIED' then 'USER_VERIFIED' else 'AI_EXTRACTED' end as status from lr l "
            f"where not exists (select 1 from fields f where f.land_record_id = l.id and f.field_name in ({listed}))")
    return " union all ".join(parts)


@q("JN07_backfill_canonical_fields", _core_sql(), "lr", "fields")
def _(v):
    return joins.backfill_canonical_fields(v.lr, v.fields)


@q("JN08_trace_fields_to_lines", f"""
   with ol as materialized (select * from ocr_lines),
   val as materialized (select land_record_id as doc_id, field_name, extracted_value as value from fields),
   al(field_name, a, r) as (values {', '.join(f"('{n}', '{t.lower().replace(chr(39), chr(39) * 2)}', {i + 1})" for n in FIELD_COLUMNS for i, t in enumerate(dims.FIELD_ALIASES.get(n, [])[:6]))}),
   hit as materialized (select v.doc_id, v.field_name, 0 as rank, l.line_no from val v join ol l on l.doc_id = v.doc_id
             where contains(lower(l.text), lower(trim(v.value))) and lower(trim(v.value)) not in ('not found', 'none', '')
           union all select v.doc_id, v.field_name, al.r, l.line_no from val v join al on al.field_name = v.field_name join ol l on l.doc_id = v.doc_id
             where contains(lower(l.text), al.a) and lower(trim(v.value)) not in ('not found', 'none', '')),
   best as (select doc_id, field_name, min(rank * 1000 + line_no) % 1000 as line_no from hit group by 1, 2)
   select v.doc_id, v.field_name, v.value, coalesce(l.text, trim(v.value)) as source_text, l.x1 as x, l.x2 - l.x1 as w,
     case when lower(trim(v.value)) = 'not found' then 0.0::double else coalesce(round(l.confidence * 100, 1), 90.0::double) end as ocr_confidence
   from val v left join best b on b.doc_id = v.doc_id and b.field_name = v.field_name
   left join ol l on l.doc_id = b.doc_id and l.line_no = b.line_no""", "fields", "ocr_lines")
def _(v):
    values = v.fields.selectExpr("land_record_id as doc_id", "field_name", "extracted_value as value")
    return joins.trace_fields(values, v.ocr_lines).select(
        "doc_id", "field_name", "value", "source_text", "bounding_box.x", "bounding_box.w", "ocr_confidence")


@q("JN09_sync_to_cadastral", """
   select l.id, case when l.id in (select record_id from actions where action = 'SYNC_CADASTRAL') then coalesce(c.cadastral_area, l.land_area) else l.land_area end as land_area
   from lr l left join cad c on c.survey_number = l.survey_number""", "lr", "cad", "actions")
def _(v):
    ids = v.actions.where("action = 'SYNC_CADASTRAL'").select(F.col("record_id").alias("id"))
    return joins.sync_to_cadastral(v.lr, v.cad, ids).select("id", "land_area")
