"""Projections, filters and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq import dims
from landq.operators import filters
from landq.plans.suite import Suite

suite = Suite()
q = suite.query

PUBLIC = "status in ('APPROVED', 'PUBLISHED', 'USER_VERIFIED') and is_public"
SHORT = ["id", "owner_name", "survey_number", "village", "district", "status", "land_area"]
SHORT_SQL = ", ".join(SHORT)


@q("PF01_public_records", f"select {SHORT_SQL} from lr where {PUBLIC} order by id desc limit 50", "lr")
def _(v):
    return filters.public_records(v.lr).select(*SHORT)


@q("PF01_public_records_legacy",
   f"select {SHORT_SQL} from lr where status in ('APPROVED', 'PUBLISHED') and is_public", "lr")
def _(v):
    return filters.public_records(v.lr, statuses=dims.LEGACY_PUBLIC_STATUSES, limit=None, order_by="updated_at").select(*SHORT)


KEYWORD_SQL = " or ".join(f"contains(lower({c}), 'reg/00000')" for c in dims.KEYWORD_COLUMNS)


@q("PF02_keyword_filter", f"select {SHORT_SQL}, registration_number from lr where {KEYWORD_SQL}", "lr")
def _(v):
    return filters.keyword_filter(v.lr, "Reg/00000").select(*SHORT, "registration_number")


@q("PF03_column_filters", f"""select {SHORT_SQL} from lr where contains(lower(owner_name), 'customer#0000001')
   and contains(lower(survey_number), '/3') and contains(lower(village), 'village')""", "lr")
def _(v):
    return filters.column_filters(v.lr, {"owner_name": "Customer#0000001", "survey_number": "/3", "village": "village",
                                         "district": ""}).select(*SHORT)


def _any(term: str) -> str:
    return " or ".join(f"contains(lower(coalesce({c}, '')), '{term}')" for c in dims.SEARCH_COLUMNS)


@q("PF04_global_search", f"select {SHORT_SQL} from lr where {PUBLIC} and ({_any('12/३')} or {_any('12/3')})", "lr")
def _(v):
    return filters.global_search(v.lr, "12/३").select(*SHORT)


@q("PF04_global_search_many", f"""
   select '१२/४' as query, id from lr where {_any('12/4')}
   union all select 'రమేష్' as query, id from lr where {_any('ramesh')}
   union all select 'kh-77' as query, id from lr where {_any('kh-77')}""", "lr")
def _(v):
    return filters.global_search_many(v.lr, ["१२/४", "రమేష్", "kh-77"], include_internal=True).select("query", "id")


ASKED_SQL = "select c_name as query from customer union all select n_name from nation union all select substr(r_name, 1, 2) from region"


@q("PF04_global_search_frame", f"""
   with held as (select distinct id, lower(v) as v from (select id, unnest([{', '.join(dims.SEARCH_COLUMNS)}]) as v from lr where {PUBLIC})),
   hit as (select query, v from (select distinct query from ({ASKED_SQL})) join (select distinct v from held) on contains(v, lower(query)))
   select distinct query, id from hit join held using (v)""", "lr")
def _(v):
    parts = [("customer", "c_name"), ("nation", "n_name"), ("region", "substr(r_name, 1, 2)")]
    asked = reduce(DataFrame.unionAll, [v.table(t).selectExpr(f"{c} as query") for t, c in parts])
    return filters.global_search_many(v.lr, asked).select("query", "id")


@q("PF05_public_projection", f"""select id, owner_name, father_husband_name, survey_number, khasra_number, khata_number,
   plot_number, village, tehsil, district, state, land_area, land_classification, registration_number, registration_date,
   status, document_status, verification_status, cast(null as varchar) as last_verification_date,
   cast(null as varchar) as coordinates_geojson from lr where {PUBLIC}""", "lr")
def _(v):
    return filters.public_projection(v.lr.where(filters.visible()))


@q("PF06_record_by_id", f"""select {SHORT_SQL} from lr where {PUBLIC} and id in (select event_id % 500 from events)""", "lr")
def _(v):
    return filters.records_by_id(v.lr, v.actions.select(F.col("record_id").alias("id"))).select(*SHORT)


for _name, _statuses, _skip in [("", dims.QUEUE_STATUSES, True), ("_wide", dims.QUEUE_STATUSES_WIDE, False),
                                ("_narrow", dims.QUEUE_STATUSES_NARROW, False)]:
    _list = ", ".join(f"'{s}'" for s in _statuses)
    _maps = "and document_type <> 'Cadastral Boundary Map' and owner_name is not null" if _skip else ""

    @q(f"PF07_verification_queue{_name}", f"select {SHORT_SQL} from lr where status in ({_list}) {_maps}", "lr")
    def _(v, statuses=_statuses, skip=_skip):
        return filters.verification_queue(v.lr, statuses, skip).select(*SHORT)


@q("PF08_sanitize_survey_number", """
   with raw as (select id, case when id % 3 = 0 then concat('[''', survey_number, ''', ''7'']') when id % 3 = 1
     then concat('[', village, ' none]') else survey_number end as s from lr)
   select id, case when contains(s, '[') or contains(s, '''') then
     coalesce(nullif(regexp_extract(s, '[0-9]+/[0-9A-Za-z]+|[0-9]+'), ''), s) else s end as survey_number from raw""", "lr")
def _(v):
    raw = v.lr.selectExpr("id", """case when id % 3 = 0 then concat("['", survey_number, "', '7']") when id % 3 = 1
        then concat('[', village, ' none]') else survey_number end as survey_number""")
    return raw.select("id", filters.sanitize_survey_number("survey_number").alias("survey_number"))


@q("PF09_queue_subset", f"select {SHORT_SQL} from lr where status = 'VALIDATION_FAILED'", "lr")
def _(v):
    return filters.queue_subset(filters.verification_queue(v.lr, skip_maps=False), "VAL_ERR").select(*SHORT)


@q("PF10_pending_documents", """select doc_id, source from documents
   where case when doc_id % 4 = 0 then 'QUEUED' when doc_id % 4 = 1 then 'FAILED' else 'SUCCESS' end <> 'SUCCESS'""")
def _(v):
    documents = v.table("documents").withColumn("processing_status", F.expr(
        "case when doc_id % 4 = 0 then 'QUEUED' when doc_id % 4 = 1 then 'FAILED' else 'SUCCESS' end"))
    return filters.pending_documents(documents).select("doc_id", "source")


@q("PF11_list_parcels", """select id, survey_number, village, district, cadastral_area from cad
   where lower(village) = 'village 3' and lower(district) <> '' and lower(district) = lower('NATION_7')""", "cad")
def _(v):
    return filters.list_parcels(v.cad, "VILLAGE 3", "Nation_7").select("id", "survey_number", "village", "district", "cadastral_area")
