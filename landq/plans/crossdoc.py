"""Dossier comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq import dims
from landq.operators import crossdoc
from landq.plans.suite import Suite
from landq.plans.text import lit

suite = Suite()
q = suite.query


def _records(v):
    return crossdoc.with_dossier_key(v.lr)


BUCKET = ("case when contains(lower(document_type), 'sale') then 'sale_deed' when contains(lower(document_type), 'khasra') then 'khasra' "
          "when contains(lower(document_type), 'map') then 'cadastral' when contains(lower(document_type), 'mutation') then 'mutation' end")
SHOWN = ["id", "survey_number", "village", "document_type"]


@q("XD01_dossier_select_newest", "select id, survey_number, village, document_type from lr where source_type = 'DOSSIER' order by id desc limit 4", "lr")
def _(v):
    return crossdoc.dossier_select(v.lr, source_type="DOSSIER").select(*SHOWN)


@q("XD01_dossier_select_survey", "select id, survey_number, village, document_type from lr where survey_number = '23/7A'", "lr")
def _(v):
    return crossdoc.dossier_select(v.lr, survey_number="23/7A").select(*SHOWN)


@q("XD01_dossier_select_ids", "select id, survey_number, village, document_type from lr where id in (select record_id from actions)", "lr", "actions")
def _(v):
    return crossdoc.dossier_select(v.lr, ids=v.actions.selectExpr("record_id as id")).select(*SHOWN)


def _default(n: str) -> str:
    value = "concat(cast(land_area as varchar), ' Acres')" if n == "land_area" else n
    return f"select id, '{n}' as field_name, {value} as value from lr l where not exists (select 1 from fields f where f.land_record_id = l.id and f.field_name = '{n}')"


FIELDS_MAP = ("select land_record_id as id, field_name, coalesce(nullif(corrected_value, ''), extracted_value) as value from fields union all "
              + " union all ".join(_default(n) for n in crossdoc.DEFAULTS))


@q("XD02_fields_map", FIELDS_MAP, "lr", "fields")
def _(v):
    return crossdoc.fields_long(v.lr, v.fields)


LAST = f"last as (select concat(survey_number, '|', village) as dossier, {BUCKET} as bucket, max(id) as id, count(*) as documents from lr group by 1, 2)"


@q("XD03_bucket_by_type", f"with {LAST} select * from last", "lr")
def _(v):
    return crossdoc.bucket_by_type(_records(v))


ALIASES = ", ".join(f"({i}, {lit(n)}, {lit(label)}, {o}, {lit(a)})" for i, (n, label, al) in enumerate(dims.COMPARISON_FIELDS) for o, a in enumerate([n, *al]))
MATRIX = f"""fm as materialized ({FIELDS_MAP}), {LAST}, al(field_no, field_key, field_label, o, alias) as (values {ALIASES}),
   val as (select l.dossier, l.bucket, al.field_no, arg_min(trim(fm.value), o) as value from last l join fm on fm.id = l.id join al on al.alias = fm.field_name
     where fm.value is not null and lower(trim(fm.value)) not in ('none', 'null', 'n/a', 'not found', '') group by 1, 2, 3),
   dos as (select dossier, sum(documents)::bigint as documents, {', '.join(f"bool_or(bucket = '{k}') as has_{k}" for k in dims.DOSSIER_BUCKETS)} from last group by 1),
   mat as (select d.dossier, f.field_no, f.field_key, f.field_label, d.documents,
     {', '.join(f"case when has_{k} then coalesce(max(v.value) filter (v.bucket = '{k}'), 'Not found') else 'Document not uploaded' end as {k}" for k in dims.DOSSIER_BUCKETS)}
     from dos d cross join (select distinct field_no, field_key, field_label from al) f left join val v on v.dossier = d.dossier and v.field_no = f.field_no
     group by d.dossier, f.field_no, f.field_key, f.field_label, d.documents, has_sale_deed, has_khasra, has_cadastral, has_mutation)"""


@q("XD04_resolve_alias", f"with {MATRIX} select * from mat", "lr", "fields")
def _(v):
    return crossdoc.comparison_matrix(_records(v), v.fields)


GIVEN = "list_filter([sale_deed, khasra, cadastral, mutation], lambda x: x not in ('Document not uploaded', 'Not found'))"
NUMBERS = f"list_filter(list_transform({GIVEN}, lambda x: try_cast(nullif(regexp_extract(x, '[0-9.]+'), '') as double)), lambda x: x is not null)"


@q("XD05_area_comparison", f"""with {MATRIX}, a as (select dossier, len({GIVEN}) as n, {NUMBERS} as nums from mat where field_key = 'land_area')
   select dossier, case when n < 2 then 'YELLOW' when list_max(nums) - list_min(nums) > 0.05 then 'RED' when list_max(nums) - list_min(nums) > 0.001 then 'YELLOW' else 'GREEN' end as status from a""", "lr", "fields")
def _(v):
    matrix = crossdoc.comparison_matrix(_records(v), v.fields).where("field_key = 'land_area'")
    return crossdoc.evaluate_fields(matrix, exact=False).select("dossier", "status")


COMPARABLE = r"regexp_replace(regexp_replace(lower(trim(x)), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')"


@q("XD06_text_equality", f"""with {MATRIX}, a as (select dossier, field_key, list_distinct(list_transform({GIVEN}, lambda x: {COMPARABLE})) as t, len({GIVEN}) as n from mat where field_key <> 'land_area')
   select dossier, field_key, n::int as values_given, n > 1 and len(t) = 1 as equal from a""", "lr", "fields")
def _(v):
    matrix = crossdoc.comparison_matrix(_records(v), v.fields).where("field_key <> 'land_area'")
    vals = crossdoc.given_values()
    texts = F.array_distinct(F.transform(vals, crossdoc.comparable))
    return matrix.select("dossier", "field_key", F.size(vals).alias("values_given"), ((F.size(vals) > 1) & (F.size(texts) == 1)).alias("equal"))


#: The ratio of two texts: twice the characters in matching blocks to their length. The longest block comes first (of equal
#: ones the first in a, then in b), then what is left of it and what is right of it.
BLOCK = """list_max(flatten([[{'k': k, 'i': -i} for k in range(1, len(s) - i + 2) if contains(t, substr(s, i, k))] for i in range(1, len(s) + 1)]))"""
EVALUATED = f"""with {MATRIX}, g as (select *, {GIVEN} as vals from mat),
   w as (select *, case when field_key = 'land_area' then list_max({NUMBERS}) - list_min({NUMBERS}) end as spread, list_transform(vals, lambda x: {COMPARABLE}) as raw from g),
   tx as (select *, case when spread is null then list_filter(raw, lambda x, i: list_position(raw, x) = i) end as texts from w),
   pairs as materialized (select distinct texts[x.i] as a, texts[y.i] as b from tx, range(1, 5) as x(i), range(1, 5) as y(i) where len(vals) > 1 and x.i < y.i and y.i <= len(texts)),
   ratio as (with recursive step(a, b, s, t, blk) as (select a, b, a, b, {BLOCK.replace('(t,', '(b,').replace('(s', '(a')} from pairs
     union all select a, b, s2, t2, {BLOCK.replace('(t,', '(t2,').replace('(s', '(s2')} from (
       select a, b, unnest([substr(s, 1, -blk.i - 1), substr(s, -blk.i + blk.k)]) as s2,
         unnest([substr(t, 1, instr(t, substr(s, -blk.i, blk.k)) - 1), substr(t, instr(t, substr(s, -blk.i, blk.k)) + blk.k)]) as t2
       from step where blk is not null) where s2 <> '' and t2 <> '')
     select a, b, 2.0::double * coalesce(sum(blk.k), 0)::double / (len(a) + len(b)) as r from step group by a, b),
   low as (select dossier, field_no, min(r) as similarity from tx, range(1, 5) as x(i), range(1, 5) as y(i), ratio
     where len(vals) > 1 and x.i < y.i and y.i <= len(texts) and a = texts[x.i] and b = texts[y.i] group by 1, 2),
   ev as (select tx.*, similarity, case when len(vals) < 2 then 'YELLOW' when spread > 0.05 then 'RED' when spread > 0.001 then 'YELLOW' when spread is not null then 'GREEN'
       when len(texts) = 1 then 'GREEN' when similarity >= 0.82 then 'YELLOW' when field_key in ({', '.join(lit(f) for f in dims.IDENTITY_FIELDS)}) then 'RED' else 'YELLOW' end as status,
     case when len(vals) = 0 then 'Information missing across uploaded records' when len(vals) = 1 then 'Only 1 document provides this field; unable to cross-validate'
       when spread > 0.05 then concat('Area conflict detected: delta ', printf('%.2f', spread), ' units between uploaded documents')
       when spread > 0.001 then concat('Minor area discrepancy: delta ', printf('%.2f', spread), ' units')
       when spread is not null then 'Land area perfectly matches across records' when len(texts) = 1 then 'Values match across documents'
       when similarity >= 0.82 then 'Possible minor OCR typographical discrepancy'
       when field_key in ({', '.join(lit(f) for f in dims.IDENTITY_FIELDS)}) then 'Substantial conflict in legal identifier/party name'
       else 'Discrepancy detected across records; requires officer clarification' end as notes
     from tx left join low using (dossier, field_no))"""


@q("XD07_fuzzy_similarity", f"{EVALUATED} select dossier, field_key, round(similarity, 6) as similarity from ev where similarity is not null", "lr", "fields")
def _(v):
    evaluated = crossdoc.evaluate_fields(crossdoc.comparison_matrix(_records(v), v.fields), exact=True)
    return evaluated.where("similarity is not null").select("dossier", "field_key", F.round("similarity", 6).alias("similarity"))


@q("XD08_field_status", f"{EVALUATED} select dossier, field_key, {', '.join(dims.DOSSIER_BUCKETS)}, status, notes from ev", "lr", "fields")
def _(v):
    return crossdoc.evaluate_fields(crossdoc.comparison_matrix(_records(v), v.fields), exact=False).select(
        "dossier", "field_key", *dims.DOSSIER_BUCKETS, "status", "notes")


@q("XD09_dossier_summary", f"""{EVALUATED},
   c as (select dossier, max(documents) as documents, count(*) filter (status = 'GREEN') as match_count,
     count(*) filter (status = 'RED' or (status = 'YELLOW' and not list_contains([{', '.join(dims.DOSSIER_BUCKETS)}], 'Not found'))) as mismatch_count,
     count(*) filter (status = 'YELLOW' and list_contains([{', '.join(dims.DOSSIER_BUCKETS)}], 'Not found')) as missing_count,
     count(*) filter (status = 'RED') as red, count(*) filter (status = 'YELLOW') as yellow from ev group by dossier)
   select dossier, documents, match_count, mismatch_count, missing_count,
     case when red > 0 then 'RED' when yellow > 0 or documents < 2 then 'YELLOW' else 'GREEN' end as overall_status from c""", "lr", "fields")
def _(v):
    return crossdoc.dossier_summary(crossdoc.evaluate_fields(crossdoc.comparison_matrix(_records(v), v.fields), exact=False))


GAPPED = "case when id % 3 = 0 then 'Not found' else survey_number end"


@q("XD10_unify_survey", f"""with r as (select id, concat(khasra_number, '|', village) as dossier, {GAPPED} as survey_number from lr),
   f as (select dossier, arg_min(survey_number, id) as s from r where survey_number <> 'Not found' group by 1)
   select r.id, r.dossier, case when survey_number = 'Not found' then coalesce(s, survey_number) else survey_number end as survey_number from r left join f on f.dossier = r.dossier""", "lr")
def _(v):
    keyed = crossdoc.with_dossier_key(v.lr, ["khasra_number", "village"]).withColumn("survey_number", F.expr(GAPPED))
    return crossdoc.unify_survey(keyed.select("id", "dossier", "survey_number"))


@q("XD11_approve_dossier", """select id, 'APPROVED' as status, 'Officer Verified & Certified' as verification_status, 'PUBLISHED' as publication_status,
   true as is_public, 'Digitized, Verified & Publicly Available' as document_status from lr where survey_number = '23/7A'""", "lr")
def _(v):
    return crossdoc.approve_dossier(crossdoc.dossier_select(v.lr, survey_number="23/7A")).select("id", *crossdoc.APPROVAL)


@q("XD11_approval_log", """select id as land_record_id, 'Senior Revenue Officer & Tahsildar' as officer_name, 'APPROVED_CONSISTENT' as action,
   'Approved Title & Boundary Consistency across Parcel Dossier' as remarks from lr where survey_number = '23/7A'""", "lr")
def _(v):
    return crossdoc.approval_log(crossdoc.dossier_select(v.lr, survey_number="23/7A"))
