"""Extraction accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import accuracy
from landq.plans.suite import Suite

suite = Suite()
q = suite.query

CER = "case when length(trim(truth)) = 0 then case when trim(hypothesis) = '' then 0.0::double else 1.0 end else round(levenshtein(trim(truth), trim(hypothesis)) / length(trim(truth))::double * 100, 2) end"
SPLIT = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> '')"
CODED = "array_to_string(list_transform({0}, lambda w: chr((39 + list_position(voc, w))::int)), '')"
ADDED = "case when id % 4 = 0 then concat(hypothesis, ' page ', cast(id % 9 as string)) else hypothesis end"


@q("EV01_character_error_rate", f"select id, {CER} as cer from eval_pairs", "eval_pairs")
def _(v):
    return v.eval_pairs.select("id", accuracy.character_error_rate("truth", "hypothesis").alias("cer"))


@q("EV02_word_error_rate", f"""with p as (select id, {SPLIT.format('truth')} as r, {SPLIT.format(ADDED)} as h from eval_pairs), c as (select *, list_distinct(list_concat(r, h)) as voc from p)
   select id, round(levenshtein({CODED.format('r')}, {CODED.format('h')}) / len(r)::double * 100, 2) as wer from c""", "eval_pairs")
def _(v):
    pairs = v.eval_pairs.withColumn("hypothesis", F.expr(ADDED))
    return pairs.select("id", accuracy.word_error_rate("truth", "hypothesis").alias("wer"))


TRUTH = {"owner_name": "owner_name", "father_husband_name": "father_husband_name", "survey_number": "survey_number", "khasra_number": "khasra_number",
         "land_area": "concat(cast(cast(round(land_area * 100) as int) as string), ' Cents')", "village": "village", "tehsil": "tehsil", "district": "district",
         "registration_number": "registration_number", "registration_date": "registration_date"}
TRUTH_SQL = "truth as (" + " union all ".join(f"select id, '{n}' as field_name, {e} as value from lr where ({e}) is not null" for n, e in TRUTH.items()) + ")"
OUTCOME = f"""{TRUTH_SQL}, o as (select t.id, t.field_name, case when coalesce(x.read, '') = '' then 'absent' when lower(trim(x.read)) = lower(trim(t.value)) then 'match' else 'wrong' end as outcome
   from truth t left join (select land_record_id as id, field_name, coalesce(corrected_value, extracted_value) as read from fields) x on x.id = t.id and x.field_name = t.field_name)"""


def _compared(v):
    rows = ", ".join(f"struct('{n}' as field_name, {e} as value)" for n, e in TRUTH.items())
    truth = v.lr.selectExpr("id", f"inline(array({rows}))").where("value is not null")
    read = v.fields.selectExpr("land_record_id as id", "field_name", "coalesce(corrected_value, extracted_value) as value")
    return accuracy.compared_fields(truth, read)


SCORES = """count(*) filter (outcome = 'match') as tp, count(*) filter (outcome = 'wrong') as fp, count(*) filter (outcome = 'absent') as fn"""
RATES = """tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp)::double * 100 else 100 end, 2) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double * 100 else 100 end, 2) as recall,
   round(case when tp > 0 then 2 * (tp / (tp + fp)::double * 100) * (tp / (tp + fn)::double * 100) / (tp / (tp + fp)::double * 100 + tp / (tp + fn)::double * 100) else 100 end, 2) as f1"""


@q("EV03_field_scores", f"with {OUTCOME}, s as (select {SCORES} from o) select {RATES} from s", "lr", "fields")
def _(v):
    return accuracy.field_scores(_compared(v))


@q("EV03_field_scores_by_field", f"with {OUTCOME}, s as (select field_name, {SCORES} from o group by 1) select field_name, {RATES} from s", "lr", "fields")
def _(v):
    return accuracy.field_scores(_compared(v), "field_name")


@q("EV04_statutory_exact_match", f"""with {OUTCOME} select field_name, count(*) filter (outcome = 'match') as correct, count(*) as total,
   round(count(*) filter (outcome = 'match') / count(*)::double * 100, 2) as accuracy from o where field_name in ('survey_number', 'owner_name', 'land_area', 'registration_number') group by 1""", "lr", "fields")
def _(v):
    return accuracy.statutory_exact_match(_compared(v))


@q("EV05_breakdown", f"""with {OUTCOME}, d as (select id, language, document_type, {CER} as cer from eval_pairs),
   ds as (select 'language' as breakdown, language as value_of, cer, id from d union all select 'document_type', document_type, cer, id from d),
   a as (select breakdown, value_of, count(*) as samples, round(cast(sum(cast(cer as decimal(18,4))) as double) / count(*), 2) as avg_cer from ds group by 1, 2),
   b as (select breakdown, value_of, round(count(*) filter (outcome = 'match') / count(*)::double * 100, 2) as field_accuracy from ds join o on o.id = ds.id group by 1, 2)
   select a.*, field_accuracy from a left join b on b.breakdown = a.breakdown and b.value_of = a.value_of""", "lr", "fields", "eval_pairs")
def _(v):
    docs = v.eval_pairs.select("id", "language", "document_type", accuracy.character_error_rate("truth", "hypothesis").alias("cer"))
    return accuracy.breakdown(docs, _compared(v))
