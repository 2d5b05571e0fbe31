"""Exact values of scalar operators."""

import json
import pytest
from pyspark.sql import functions as F

from landq import dims
from landq.functions import script, text, translit
from landq.functions.confidence import evaluate_field, tier
from landq.functions.numbers import number_ambiguity
from landq.operators import dictionary, rules, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("सर्वे १२३/४", "सर्वे 123/4"), ("సర్వే ౧౮౪/ఎ", "సర్వే 184/ఎ"), ("சர்வே ௧௨௩", "சர்வே 123"), ("দাগ ১২৩", "দাগ 123")])
def test_numerals(spark, given, want):
    assert one(spark, text.normalize_numerals(F.lit(given))) == want


@pytest.mark.parametrize("given, acres, unit", [("20 Guntas", 0.5, "Guntas"), ("50 Cents", 0.5, "Cents"), ("2.45 Acres", 2.45, "Acres"), ("२.५ एकड़", 2.5, "Acres"), ("7", 7.0, "Acres"), ("none", None, "Unspecified")])
def test_area(spark, given, acres, unit):
    got = one(spark, text.land_area(F.lit(given)))
    assert (got.acres, got.unit) == (acres, unit)


def test_dates_and_survey_numbers(spark):
    assert one(spark, text.normalize_date(F.lit("14/08/2023"))).iso == "2023-08-14"
    assert one(spark, text.normalize_date(F.lit("१४/०८/२०२३"))).iso == "2023-08-14"
    assert one(spark, text.normalize_date(F.lit("15th March 2023"))).iso is None
    assert one(spark, text.survey_number(F.lit("184 / a"))) == "184/A"


@pytest.mark.parametrize("given, code", [
    ("Government of Telangana Registration Department Sale Deed", "en"),
    ("తెలంగాణ ప్రభుత్వం రిజిస్ట్రేషన్ మరియు స్టాంపుల శాఖ క్రయవిక్రయ పత్రము", "te"),
    ("उत्तर प्रदेश शासन निबंधन विभाग बैनामा विक्रय पत्र भू-स्वामी", "hi"),
    ("தமிழ்நாடு அரசு பதிவுத்துறை கிரய பத்திரம் நில உரிமையாளர்", "ta"), ("खरेदीखत गट क्रमांक", "mr"), ("মাটিৰ গৰাকী", "as"), ("", "en")])
def test_language(spark, given, code):
    assert one(spark, script.detect_languages(F.lit(given))).code == code


def test_mixed_language(spark):
    got = one(spark, script.detect_languages(F.lit("తెలంగాణ ప్రభుత్వం Sale Deed No 4521/2023 సర్వే నంబరు 184/A Shamshabad village")))
    assert got.is_mixed and {"te", "en"} <= {d.code for d in got.distribution}


def test_names_are_spelled_not_translated(spark):
    got = one(spark, translit.preserve_and_transliterate(F.lit("రమేష్ శర్మ")))
    assert (got.original, got.transliterated) == ("రమేష్ శర్మ", "Ramesh Sharma")
    assert one(spark, translit.transliterate(F.lit("ప్లాట్"))) == "Plaat"


def test_terms(spark):
    assert "Sale Deed" in one(spark, dictionary.translate_term(F.lit("క్రయవిక్రయ పత్రము"))).translated
    for label, field in [("భూయజమాని", "owner_name"), ("खातेदार", "owner_name"), ("సర్వే నంబరు", "survey_number"), ("खसरा", "survey_number"), ("பரப்பளவு", "land_area")]:
        assert one(spark, dictionary.canonical_field(F.lit(label))) == field


def test_confidence(spark):
    good = one(spark, evaluate_field(F.lit("survey_number"), F.lit("184/A"), 92.0))
    assert good.tier == "HIGH" and not good.requires_review
    bad = one(spark, evaluate_field(F.lit("survey_number"), F.lit(""), 30.0))
    assert bad.tier == "LOW" and bad.requires_review
    assert [one(spark, tier(F.lit(float(c)))) for c in (95, 84, 72, 45)] == ["HIGH", "MEDIUM", "LOW", "LOW"]
    urdu = F.lit("رام لال")
    assert one(spark, evaluate_field(F.lit("owner_name"), urdu)).confidence > 90
    assert one(spark, evaluate_field(F.lit("owner_name"), urdu, strict_parity=True)).confidence == 40.0


def test_ambiguous_survey_number_is_kept(spark):
    got = one(spark, number_ambiguity(F.lit("survey_number"), F.lit("125/Z")))
    assert got.ambiguous and got.requires_review and got.confidence <= 61 and got.alternatives == ["125/2"]


CLEAN = ("SUB REGISTRAR OFFICE SANWER - SALE DEED\nRegistration No: REG2025/04118 | Date: 03-02-2025\nPurchaser / Owner: Meena Patel\n"
         "Father Name: Harish Patel\nSurvey Number: 57/2B | Khasra Number: KHA-3310\nTotal Area: 1.80 Acres | Land Classification: Residential\n"
         "Village: Chandpura | Tehsil: Sanwer | District: Indore | State: Madhya Pradesh\nConsideration Amount: Rs. 8,40,000 | Stamp Duty Paid: Rs. 58,800")
NOISY = "S.B R.G... - S..E\nNo: ?4?/18 | ..-..-....\nBuy..: M..n. P...l\nSy ..\n1.8? A.r..\nCh..d.ura"
HANDWRITTEN = "Pencil note on the back of a receipt\nName: S. Devi (faint)\nSurvey No: to be checked\nArea: some 2 bigha\nnear the old well"
TELUGU = ("ఆంధ్రప్రదేశ్ ప్రభుత్వం\nక్రయ దస్తావేజు (Sale Deed)\nరిజిస్ట్రేషన్ సంఖ్య: 2025/AP/1207 | తేదీ: 05-03-2025\nపట్టాదారు పేరు: సీత రెడ్డి\n"
          "తండ్రి పేరు: గోపాల్ రెడ్డి\nసర్వే నంబర్: 77/3 | ఖాదా నంబర్: 318\nవిస్తీర్ణము: 1.25 ఎకరాలు\nగ్రామము: నందిగామ | మండలం: నందిగామ | జిల్లా: కృష్ణా")


def test_scored_extraction(spark):
    docs = spark.createDataFrame(list(enumerate([CLEAN, NOISY, HANDWRITTEN, TELUGU])), "doc_id bigint, ocr_raw_text string")
    records = {r.doc_id: r for r in scoring.normalized_record(docs).collect()}
    headers = {r.doc_id: r for r in scoring.record_header(docs).collect()}
    clean = records[0]
    assert (clean.owner_name, clean.survey_number, clean.village) == ("Meena Patel", "57/2B", "Chandpura")
    assert headers[0].average_confidence >= 90 and not headers[0].requires_review
    assert headers[1].requires_review and headers[2].requires_review
    assert (records[3].survey_number, records[3].owner_name) == ("77/3", "సీత రెడ్డి")


def test_rules(spark):
    columns = "id bigint, owner_name string, father_husband_name string, survey_number string, village string, tehsil string, district string, state string, land_area double, registration_number string, registration_date string, document_type string, land_classification string, confidence_score double, status string"
    rows = [(1, "S Devi", None, None, None, None, None, None, None, None, None, None, None, None, "OFFICER_REVIEW"),
            (2, "Meena Patel", "Harish", "57/2B", "Chandpura", "Sanwer", "Indore", "MP", 1.80, "R-2", "01-01-2020", "Sale Deed", "Agricultural", 95.0, "APPROVED"),
            (3, "Gopal Rao", "Harish", "12/7", "Chandpura", "Sanwer", "Indore", "MP", -1.5, "R-3", "01-01-2020", "Sale Deed", "Agricultural", 95.0, "APPROVED"),
            (4, "Sita Rao", "Gopal", "88/1C", "Chandpura", "Sanwer", "Indore", "MP", 2.60, "R-4", "01-01-2020", "Sale Deed", "Agricultural", 95.0, "APPROVED")]
    records = spark.createDataFrame(rows, columns)
    parcels = spark.createDataFrame([(1, "57/2B", "Chandpura", "Indore", 1.75, 2019), (2, "88/1C", "Chandpura", "Indore", 2.10, 2019)],
                                    "id bigint, survey_number string, village string, district string, cadastral_area double, survey_year int")
    a = {(r.id, r.rule_id): r.status for r in rules.long_form(rules.evaluate_a(records, parcels, records, "2026-01-01")).collect()}
    assert a[1, "RULE-01"] == "ERROR" and a[3, "RULE-03"] == "ERROR" and a[2, "RULE-07"] == "WARNING" and a[2, "RULE-12"] == "PASS"
    assert a[1, "RULE-04"] == "WARNING"  # a NULL father name is missing, not the text "None"
    b = {(r.id, r.rule_id): r.status for r in rules.long_form(rules.evaluate_b(records, parcels, records)).collect()}
    assert b[4, "RULE-07"] == "WARNING" and b[3, "RULE-03"] == "ERROR"
    full = {(r.id, r.rule_id): r for r in rules.long_form(rules.evaluate_a(records, parcels, records, "2026-01-01")).collect()}
    hit = full[2, "RULE-07"]
    assert json.loads(hit.details) == {"cadastral_area": 1.75, "record_area": 1.8, "delta": 0.05, "survey_year": 2019}
    assert (hit.severity, hit.requires_review, full[3, "RULE-07"].severity, full[3, "RULE-07"].details) == ("ERROR", True, "INFO", "{}")
    assert json.loads(full[1, "RULE-06"].details) == {"state": None, "district": None, "tehsil": None} and full[1, "RULE-01"].severity is None
    assert len({k for _, k in a}) == 14 and len({k for _, k in b}) == 8


def test_fixed_values():
    assert len(dims.LANGUAGES) == 13 and len(dims.INDIC_DIGITS) == 100 and len(dims.RULE_CATALOG) == 14


def test_every_term_of_the_dictionaries(spark):
    """The counts and hashes are those of the reference's TERM_MAPPINGS and FIELD_ALIASES."""
    import hashlib

    from landq.operators.dictionary import canonical_field, match_alias

    def plain(t):
        return t.lower().replace(":", "").replace("-", " ").replace(".", "")
    for lists, n, code, column, first in (
            (dims.FIELD_TERMS, 450, "0dd2b5c856f7b882", canonical_field, lambda label: label if label in dims.CANONICAL_FIELDS else next(
                k for k, ts in dims.FIELD_TERMS.items() for t in ts if t.lower() in label or label in t.lower())),
            (dims.FIELD_ALIASES, 274, "4a4b899501f18ef5", match_alias, lambda label: next(
                k for k, ts in dims.FIELD_ALIASES.items() for t in ts if plain(t) in plain(label)))):
        terms = [t for ts in lists.values() for t in ts]
        assert len(terms) == n and hashlib.sha256(json.dumps(lists).encode()).hexdigest()[:16] == code
        got = spark.createDataFrame([(t,) for t in terms], "label string").select("label", column(F.col("label")).alias("field")).collect()
        assert [(r.label, r.field) for r in got] == [(t, first(t.lower())) for t in terms]
    assert one(spark, match_alias(F.lit("জেলা"))) == "district" and one(spark, canonical_field(F.lit("ജില്ല"))) == "district"


def test_each_letter_is_looked_up_once(spark):
    """Letters are found by their place in the blocks: letters of every script, marks without a romanization, other characters."""
    from landq.functions.translit import letter_table
    table = letter_table()
    assert one(spark, translit.spelled(F.lit("".join(table) + "a😀\u0e01"))) == "".join(table.values()) + "a😀\u0e01"
    unread = "".join(chr(i) for i in range(0x0900, 0x0E00) if chr(i) not in table and chr(i).strip())
    assert one(spark, translit.spelled(F.lit(unread))) == unread


def test_expensive_texts_are_not_repeated(spark):
    """The languages of a text are worked out once, not again in a filter below."""
    from landq.plans import catalog
    plan = catalog.queries()["TX05_detect_language"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 1


def test_letters_of_a_language_are_counted_in_runs(spark):
    given = [("Deed 12, सर्वे १२ नं \U0001f600 దస్తావేజు é",), ("plain text",), ("१२३",), ("",), (None,)]
    frame = spark.createDataFrame(given, "text string")
    found = frame.select("text", script.detect_languages("text").alias("l"))
    for row in found.collect():
        value = row.text or ""
        count = {lang[0]: sum(any(a <= ord(c) <= b for a, b in lang[4]) for c in value) for lang in script.counted_languages()}
        total = sum(count.values())
        assert {d.code: d["count"] for d in row.l.distribution} == {k: n for k, n in count.items() if n and round(n / total * 100, 1) >= 3}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # a list entry for every letter
