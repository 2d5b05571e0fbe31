"""Dashboard figures, feeds and learning telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import reports, telemetry
from landq.plans.suite import Suite

suite = Suite()
q = suite.query

APPROVED = "status in ('APPROVED', 'PUBLISHED', 'USER_VERIFIED')"
NAMED = "{0} is not null and {0} not in ('', 'Not found')"


@q("AG01_dashboard_cards", f"""select count(*) as total, count(*) filter ({APPROVED}) as approved,
   count(*) filter (status in ('OFFICER_REVIEW', 'VALIDATION_PENDING')) as pending,
   count(*) filter (status = 'LOW_CONFIDENCE') as low_confidence, count(*) filter (status = 'VALIDATION_FAILED') as validation_errors,
   count(*) filter (status = 'REJECTED') as rejected, round(cast(sum(cast(confidence_score as decimal(18,4))) as double) / count(*), 1) as average_confidence,
   (select count(*) from reg where status <> 'PUBLISHED') as new_registrations from lr""", "lr", "reg")
def _(v):
    return reports.dashboard_cards(v.lr, v.reg)


@q("AG02_confidence_distribution", """select 'High Confidence (>80%)' as tier, count(*) as records from lr where confidence_score >= 80
   union all select 'Medium Confidence (60-80%)', count(*) from lr where confidence_score >= 60 and confidence_score < 80
   union all select 'Low Confidence (<60%)', count(*) from lr where confidence_score < 60""", "lr")
def _(v):
    return reports.confidence_distribution(v.lr)


@q("AG03_workflow_breakdown", f"""select 'Verified & Published' as name, count(*) as value from lr where {APPROVED}
   union all select 'Pending Verification', count(*) from lr where status in ('OFFICER_REVIEW', 'VALIDATION_PENDING')
   union all select 'Validation Flagged', count(*) from lr where status = 'VALIDATION_FAILED'
   union all select 'Low Confidence', count(*) from lr where status = 'LOW_CONFIDENCE'""", "lr")
def _(v):
    return reports.workflow_breakdown(v.lr)


@q("AG04_district_progress", f"""select district, count(*) as total, count(*) as digitized,
   (select round(cast(sum(cast(confidence_score as decimal(18,4))) as double) / count(*), 1) from lr) as accuracy from lr where {NAMED.format('district')} group by district""", "lr")
def _(v):
    return reports.district_progress(v.lr)


@q("AG04_district_progress_unnamed", f"""select 'General District' as district, count(*) as total,
   count(*) filter ({APPROVED}) as digitized, round(cast(sum(cast(confidence_score as decimal(18,4))) as double) / count(*), 1) as accuracy from lr where district = 'Not found'""", "lr")
def _(v):
    return reports.district_progress(v.lr.where("district = 'Not found'")).selectExpr("district", "total", "digitized", "accuracy")


@q("AG05_public_stats", f"""select count(*) filter ({APPROVED} and is_public) as total_verified_records,
   greatest(count(distinct village) filter ({NAMED.format('village')}), 1) as villages_covered,
   greatest(count(distinct district) filter ({NAMED.format('district')}), 1) as districts_active,
   greatest(count(distinct state) filter ({NAMED.format('state')}), 1) as states_onboarded from lr""", "lr")
def _(v):
    return reports.public_stats(v.lr)


@q("AG06_recent_activity", f"""select id, registration_number as reg_id, owner_name as owner, registration_date as date,
   case when {APPROVED} then 'Approved' when status = 'LOW_CONFIDENCE' then 'Low Confidence'
        when status = 'VALIDATION_FAILED' then 'Validation Discrepancy' else 'Pending Verification' end as activity,
   document_type as type from lr where document_type <> 'Cadastral Boundary Map' order by id desc limit 10""", "lr")
def _(v):
    return reports.recent_activity(v.lr)


@q("AG07_audit_feed", """select id, actor, action, entity_id, strftime("timestamp", '%d-%m-%Y %H:%M:%S') as "timestamp" from audit
   order by audit."timestamp" desc, id desc limit 100""", "audit")
def _(v):
    return reports.audit_feed(v.audit).select("id", "actor", "action", "entity_id", "timestamp")


@q("AG08_learning_metrics", """select count(*) as corrections, least(98.8::double, round(91.2::double + count(*) * 0.6::double, 2)) as accuracy,
   round(least(98.8::double, round(91.2::double + count(*) * 0.6::double, 2)) - 91.2::double, 2) as gain from corrections""", "corrections")
def _(v):
    return reports.learning_metrics(v.corrections)


@q("AG08_learning_metrics_legacy", """select count(*) as corrections, least(98.4::double, round(94.2::double + count(*) * 0.4::double, 1)) as accuracy,
   round(least(98.4::double, round(94.2::double + count(*) * 0.4::double, 1)) - 91.2::double, 2) as gain from corrections""", "corrections")
def _(v):
    return reports.learning_metrics(v.corrections, base=94.2, step=0.4, cap=98.4, digits=1)


@q("AG09_recent_corrections", """select id, field_name, corrected_value, strftime("timestamp", '%d-%m-%Y %H:%M:%S') as "timestamp"
   from corrections order by corrections."timestamp" desc, id desc limit 10""", "corrections")
def _(v):
    return reports.recent_corrections(v.corrections).select("id", "field_name", "corrected_value", "timestamp")


@q("AG09_corrections_by_field", "select field_name, count(*) as corrections from corrections group by 1", "corrections")
def _(v):
    return reports.corrections_by_field(v.corrections)


TELEMETRY_SQL = """
   with known as (select *, case when language_code in ('hi', 'te', 'ta', 'mr', 'kn', 'bn', 'gu', 'en') then language_code else 'en' end as code from verifications),
   steps as (select code, ts, event_id, corrections, 5 * row_number() over w - 2 * sum(corrections) over w as d from known
             window w as (partition by code order by ts, event_id)),
   folds as (select code, list(d::bigint order by ts, event_id) as ds, count(*) as n, sum(corrections)::bigint as c from steps group by code),
   start(code, language, a) as (values ('hi', 'Hindi', 9240::bigint), ('te', 'Telugu', 9310), ('ta', 'Tamil', 9180), ('mr', 'Marathi', 9200),
     ('kn', 'Kannada', 9150), ('bn', 'Bengali', 9090), ('gu', 'Gujarati', 9220), ('en', 'English', 9650))
   select s.code, language, case when ds is null then a else list_reduce(list_prepend(a, ds), lambda x, y: greatest(8000, least(9940, x + y))) end as accuracy,
          coalesce(n, 0) as processed, coalesce(c, 0) as corrections from start s left join folds f on f.code = s.code"""


@q("AG10_language_telemetry", TELEMETRY_SQL, "verifications")
def _(v):
    return telemetry.language_telemetry(v.verifications)


@q("AG11_daily_processing", f"""select 'Total' as day, count(*) as processed, count(*) filter ({APPROVED}) as approved,
   count(*) filter (status in ('VALIDATION_FAILED', 'LOW_CONFIDENCE')) as flagged from lr""", "lr")
def _(v):
    return reports.daily_processing(v.lr)


@q("AG12_recent_registrations", "select id, registration_number, status from reg order by id desc limit 20", "reg")
def _(v):
    return reports.recent_registrations(v.reg).select("id", "registration_number", "status")


@q("AG12_all_registrations", "select id, registration_number, status from reg", "reg")
def _(v):
    return reports.recent_registrations(v.reg, None).select("id", "registration_number", "status")
