"""Duplicate vectors and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import duplicates, rules
from landq.plans.suite import Suite

suite = Suite()
q = suite.query

FIRST = ("select r.id, (select min(o.id) from lr o where o.id <> r.id and {cond}) as match_id from lr r where {guard}")


def _first(cond: str, guard: str = "true") -> str:
    return f"(select * from ({FIRST.format(cond=cond, guard=guard)}) where match_id is not null)"


VECTOR_SQL = {
    "file": """select d.doc_id as id, 'DOCUMENT_HASH_COLLISION' as vector, 40 as score, 'EXACT_DOCUMENT_DUPLICATE' as conflict, min(o.doc_id) as match_id
       from documents d join documents o on sha256(d.text) = sha256(o.text) and d.doc_id <> o.doc_id group by 1""",
    "registration": "select id, 'REGISTRATION_DUPLICATE' as vector, 40 as score, 'REGISTRATION_NUMBER_COLLISION' as conflict, match_id from "
       + _first("lower(o.registration_number) = lower(r.registration_number) and contains(lower(o.district), lower(r.district))"),
    "parcel": "select m.id, case when lower(o.owner_name) <> lower(r.owner_name) then 'SURVEY_NUMBER_OWNER_MISMATCH' else 'EXISTING_PARCEL_RECORD' end as vector, "
       "case when lower(o.owner_name) <> lower(r.owner_name) then 30 else 15 end as score, "
       "case when lower(o.owner_name) <> lower(r.owner_name) then 'SURVEY_OWNERSHIP_MISMATCH' end as conflict, m.match_id from "
       + _first("o.survey_number = r.survey_number and contains(lower(o.village), lower(r.village)) and o.status in ('APPROVED', 'PUBLISHED', 'OFFICER_REVIEW')")
       + " m join lr o on o.id = m.match_id join lr r on r.id = m.id",
    "owner": "select id, 'OWNER_SURVEY_COLLISION' as vector, 20 as score, null::varchar as conflict, match_id from "
       + _first("o.survey_number = r.survey_number and contains(lower(o.owner_name), lower(r.owner_name))"),
    "khasra": "select m.id, 'KHASRA_VILLAGE_AREA_COLLISION' as vector, 25 as score, null::varchar as conflict, m.match_id from "
       + _first("o.khasra_number = r.khasra_number and contains(lower(o.village), lower(r.village))", "r.land_area > 0")
       + " m join lr o on o.id = m.match_id join lr r on r.id = m.id where abs(o.land_area - r.land_area) < 0.05",
    "registration_owner": "select id, 'REGISTRATION_OWNER_MATCH' as vector, 15 as score, null::varchar as conflict, match_id from "
       + _first("o.registration_number = r.registration_number and contains(lower(o.owner_name), lower(r.owner_name))"),
    "text": """select id, 'OCR_TEXT_SIMILARITY' as vector, 20 as score, null::varchar as conflict, null::bigint as match_id from (
       with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) as ws from documents where length(trim(text)) > 50),
       n as (select doc_id, len(ws) as n, ws from w where len(ws) > 0)
       select distinct a.doc_id as id from n a join n b on a.doc_id <> b.doc_id and least(a.n, b.n) > 0.85 * greatest(a.n, b.n)
       where len(list_intersect(a.ws, b.ws)) / (a.n + b.n - len(list_intersect(a.ws, b.ws)))::double > 0.85)""",
    "image": """select distinct a.vec_id as id, 'PERCEPTUAL_IMAGE_SIMILARITY' as vector, 25 as score, null::varchar as conflict, null::bigint as match_id
       from ph a join ph b on a.vec_id <> b.vec_id where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6""",
    "confidence": "select id, 'LOW_OCR_CONFIDENCE' as vector, 15 as score, null::varchar as conflict, null::bigint as match_id from lr where confidence_score < 80",
}
SHOWN = ["id", "vector", "score", "conflict", "match_id"]


def _files(v):
    return v.texts.select("doc_id", F.col("doc_id").alias("land_record_id"), F.sha2("text", 256).alias("file_hash"),
                                       F.col("text").alias("ocr_raw_text"))


def _images(v):
    return v.ph.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("land_record_id"), "hi", "lo")


def _scores(v):
    return v.lr.select("id", F.col("confidence_score").alias("ocr_confidence"))


VECTORS = {
    "DU01_same_file": ("file", (), lambda v: duplicates.same_file(_files(v))),
    "DU02_same_registration": ("registration", ("lr",), lambda v: duplicates.same_registration(v.lr, v.lr)),
    "DU03_same_parcel": ("parcel", ("lr",), lambda v: duplicates.same_parcel(v.lr, v.lr)),
    "DU04_same_owner_survey": ("owner", ("lr",), lambda v: duplicates.same_owner_survey(v.lr, v.lr)),
    "DU05_same_khasra_area": ("khasra", ("lr",), lambda v: duplicates.same_khasra_area(v.lr, v.lr)),
    "DU06_same_registration_owner": ("registration_owner", ("lr",), lambda v: duplicates.same_registration_owner(
        v.lr.withColumn("id", -F.col("id") - 1), v.lr)),  # every record filed again under an id of its own
    "DU07_similar_text": ("text", (), lambda v: duplicates.similar_text(_files(v))),
    "DU08_similar_image": ("image", ("ph",), lambda v: duplicates.similar_image(_images(v))),
    "DU09_low_confidence": ("confidence", ("lr",), lambda v: duplicates.low_confidence(_scores(v))),
}
FILED_AGAIN = """select -r.id - 1 as id, 'REGISTRATION_OWNER_MATCH' as vector, 15 as score, null::varchar as conflict, min(o.id) as match_id
   from lr r join lr o on o.registration_number = r.registration_number and contains(lower(o.owner_name), lower(trim(r.owner_name)))
   where trim(r.owner_name) <> '' and trim(r.registration_number) <> '' group by r.id"""
for _name, (_key, _views, _plan) in VECTORS.items():
    q(_name, FILED_AGAIN if _key == "registration_owner" else VECTOR_SQL[_key], *_views)(
        lambda v, plan=_plan: plan(v).select(*SHOWN))


def all_hits(v):
    return [duplicates.same_file(_files(v)), *duplicates.record_vectors(v.lr, v.lr), duplicates.similar_text(_files(v)),
            duplicates.similar_image(_images(v)), duplicates.low_confidence(_scores(v))]


def risk_sql(vectors: list[str], base: str = "lr") -> str:
    return f"""hits as ({' union all '.join(f'select * from ({VECTOR_SQL[k]})' for k in vectors)}),
   per as (select id, sum(score) as total, count(conflict) as conflicts_count, string_agg(vector, ',' order by vector) as vectors from hits group by 1),
   risk as (select b.id, least(100, coalesce(total, 0))::int as risk_score, coalesce(conflicts_count, 0) as conflicts_count, coalesce(vectors, '') as vectors
     from {base} b left join per p on p.id = b.id)"""


RISK_COLUMNS = """id, risk_score, case when risk_score <= 20 then 'LOW' when risk_score <= 50 then 'MEDIUM' when risk_score <= 80 then 'HIGH' else 'CRITICAL' end as risk_level,
   risk_score >= 40 as is_duplicate, risk_score > 20 as requires_officer_review, conflicts_count, vectors"""


def _flat(risk):
    names = F.array_join(F.transform("risk_breakdown", lambda r: r["vector"]), ",")
    return risk.withColumn("vectors", F.coalesce(names, F.lit(""))).drop("conflicts", "risk_breakdown")


@q("DU10_risk_score", f"with {risk_sql(list(VECTOR_SQL))} select {RISK_COLUMNS} from risk", "lr", "ph")
def _(v):
    return _flat(duplicates.risk_score(v.lr, all_hits(v)))


@q("DU10_risk_by_district", f"""with {risk_sql(list(VECTOR_SQL))},
   f as (select lr.*, cadastral_area, count(*) over (partition by registration_number) as n from lr left join cad on cad.survey_number = lr.survey_number),
   bad as (select id, coalesce(land_area, 0) = 0 or n > 1 or confidence_score < 60 as failed from f)
   select district, count(*) as records, count(*) filter (risk_score >= 40) as duplicates, count(*) filter (risk_score > 80) as critical,
     round(avg(risk_score), 2) as average_risk, count(*) filter (failed) as failed_validation
   from lr join risk on risk.id = lr.id join bad on bad.id = lr.id group by district""", "lr", "cad", "ph")
def _(v):
    risk = duplicates.risk_score(v.lr, all_hits(v)).select("id", "risk_score")
    checks = rules.summarize_a(rules.evaluate_a(v.lr, v.cad, v.lr, "2026-01-01", rules.STATUS)).select("id", "has_errors")
    joined = v.lr.select("id", "district").join(risk, "id").join(checks, "id")
    return joined.groupBy("district").agg(
        F.count("*").alias("records"), F.count_if(F.col("risk_score") >= 40).alias("duplicates"),
        F.count_if(F.col("risk_score") > 80).alias("critical"), F.round(F.avg("risk_score"), 2).alias("average_risk"),
        F.count_if("has_errors").alias("failed_validation"))


COLLISION = ("case when exists (select 1 from lr o where o.id <> r.id and o.survey_number = r.survey_number and contains(lower(o.village), lower(r.village)) "
             "and o.status in ('APPROVED', 'PUBLISHED', 'OFFICER_REVIEW')) then 15 else 0 end")


@q("DU11_parcel_collision", f"""select id, ({COLLISION})::int as risk_score, 'LOW' as risk_level, false as is_duplicate, 0::bigint as conflicts_count from lr r""", "lr")
def _(v):
    return duplicates.parcel_collision(v.lr, v.lr).select("id", "risk_score", "risk_level", "is_duplicate", "conflicts_count")
