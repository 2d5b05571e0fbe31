"""Text and scalar operators over the whole corpus of records, deeds, lines or fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq import dims
from landq.functions import geo, labels, script, text, translit
from landq.functions.numbers import number_ambiguity
from landq.operators import dictionary, layout
from landq.plans.suite import Suite

suite = Suite()
q = suite.query


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return ", ".join(lit(x) for x in values)


DIGITS = f"translate({{}}, '{dims.INDIC_DIGITS}', '{dims.ASCII_DIGITS}')"


@q("TX01_normalize_numerals", f"select doc_id, {DIGITS.format('text')} as normalized from indic", "indic")
def _(v):
    return v.indic.select("doc_id", text.normalize_numerals("text").alias("normalized"))


UNITS = ["guntha", "Cents", "ground", "বিঘা", "biswa", "hectare", "ares", "कनाल", "marla", "sq yd", "Acres", "एकड़", "spans", ""]
AREA_TEXT = ("case when id % 53 = 0 then null when id % 59 = 0 then '' when id % 61 = 0 then 'unknown' when id % 67 = 0 then '1.2.3 Acres' else "
             "concat(case when id % 4 = 0 then translate(cast(land_area as string), '0123456789', '०१२३४५६७८९') else cast(land_area as string) end, ' ', "
             f"case id % {len(UNITS)} " + " ".join(f"when {i} then '{u}'" for i, u in enumerate(UNITS)) + " end) end")


def _area_sql() -> str:
    number, unit = "null", "'Unspecified'"
    steps = [(f"try_cast(nullif(regexp_extract(t, '([0-9.]+)\\s*{p}', 1), '') as double)", f, n) for p, f, n in dims.AREA_UNITS]
    steps.append(("try_cast(nullif(regexp_extract(t, '[0-9.]+'), '') as double)", 1.0, "Acres"))
    for expr, factor, name in reversed(steps):
        number = f"case when {expr} is not null then round({expr} * {factor}::double, 4) else {number} end"
        unit = f"case when {expr} is not null then '{name}' else {unit} end"
    return f"""with raw as (select id, trim({AREA_TEXT}) as r from lr), t as (select id, r, lower({DIGITS.format("coalesce(r, '')")}) as t from raw)
       select id, coalesce(r, '') as original, round(case when r is null or r = '' then null else {number} end, 3) as acres,
         case when r is null or r = '' then 'Unknown' else {unit} end as unit from t"""


@q("TX02_normalize_land_area", _area_sql(), "lr")
def _(v):
    area = text.land_area(F.expr(AREA_TEXT))
    return v.lr.select("id", area.alias("a")).select("id", "a.original", F.round("a.acres", 3).alias("acres"), "a.unit")


DATE_TEXT = ("case id % 6 when 0 then registration_date when 1 then replace(registration_date, '-', '.') when 2 then "
             "translate(replace(registration_date, '-', '/'), '0123456789', '౦౧౨౩౪౫౬౭౮౯') when 3 then concat(substr(registration_date, 7, 4), '/', "
             "substr(registration_date, 4, 2), '/', substr(registration_date, 1, 2)) when 4 then concat('99-', substr(registration_date, 4)) else '15th March 2023' end")


@q("TX03_normalize_date", f"""
   with raw as (select id, {DATE_TEXT} as r from lr), t as (select id, r, regexp_replace({DIGITS.format('r')}, '[-.]', '/', 'g') as t from raw),
   p as (select id, r, coalesce(case when regexp_matches(t, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') then try_strptime(t, '%d/%m/%Y') end,
     case when regexp_matches(t, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$') then try_strptime(t, '%Y/%m/%d') end) as d from t)
   select id, r as original, strftime(d, '%Y-%m-%d') as iso, coalesce(strftime(d, '%d-%b-%Y'), r) as display from p""", "lr")
def _(v):
    return v.lr.select("id", text.normalize_date(F.expr(DATE_TEXT)).alias("d")).select("id", "d.*")


SURVEY_TEXT = "case when id % 3 = 0 then replace(survey_number, '/', ' / ') when id % 3 = 1 then lower(translate(survey_number, '0123456789', '०१२३४५६७८९')) else survey_number end"


@q("TX04_normalize_survey_number", f"""select id, upper(regexp_replace({DIGITS.format(SURVEY_TEXT)}, '\\s*([/\\-_])\\s*', '\\1', 'g')) as normalized from lr""", "lr")
def _(v):
    return v.lr.select("id", text.survey_number(F.expr(SURVEY_TEXT)).alias("normalized"))


COUNTED = script.counted_languages()


def _language_ctes(source: str) -> str:
    counts = " union all ".join(
        f"select doc_id, {i} as ord, '{c[0]}' as code, '{c[1]}' as name, '{c[3]}' as script, length(regexp_replace(text, '[^{script.block_class(c[4])[1:]}', '', 'g')) as n from {source}"
        for i, c in enumerate(COUNTED))
    return f"""cnt as ({counts}), tot as (select doc_id, sum(n) as total from cnt group by 1),
     share as (select c.*, round(n / total::double * 100, 1) as pct from cnt c join tot t on t.doc_id = c.doc_id where n > 0),
     kept as (select *, row_number() over (partition by doc_id order by pct desc, ord) as rk from share where pct >= 3)"""


def _marks(words: list[str]) -> str:
    return " + ".join(f"contains(d.text, '{w}')::int" for w in words)


LANGUAGE_SQL = f"""
   select d.doc_id, case when coalesce(a.code, 'en') = 'hi' and ({_marks(dims.MARATHI_MARKERS)}) > ({_marks(dims.HINDI_MARKERS)}) then 'mr'
       when a.code = 'bn' and (contains(d.text, 'ৰ') or contains(d.text, 'ৱ')) then 'as' else coalesce(a.code, 'en') end as code,
     coalesce(a.script, 'Latin') as script, coalesce(b.pct >= 10, false) as is_mixed,
     case when b.pct >= 10 then concat(a.name, ' + ', b.name, ' (Mixed)') else coalesce(a.name, 'English') end as summary
   from {{0}} d left join kept a on a.doc_id = d.doc_id and a.rk = 1 left join kept b on b.doc_id = d.doc_id and b.rk = 2"""


@q("TX05_detect_language", f"""with {_language_ctes('indic')}
   select doc_id, string_agg(concat(code, ':', cast(pct as varchar), ':', cast(n as varchar)), ' ' order by rk) as distribution from kept group by doc_id""", "indic")
def _(v):
    found = script.detect_languages("text")["distribution"]
    plain = F.transform(found, lambda x: F.concat_ws(":", F.when(x["code"] == "mr", "hi").when(x["code"] == "as", "bn").otherwise(x["code"]),
                                                     x["percentage"].cast("string"), x["count"].cast("string")))
    # A generator in place of a filter: a filter would be pushed below and repeat the text's own expression at each use.
    return v.indic.select("doc_id", F.explode(F.filter(F.array(F.array_join(plain, " ")), lambda d: d != "")).alias("distribution"))


@q("TX05_detect_language_documents", f"""with docs as (select doc_id, text from documents), {_language_ctes('docs')} {LANGUAGE_SQL.format('docs')}""")
def _(v):
    return v.texts.select("doc_id", script.detect_languages("text").alias("l")).select(
        "doc_id", "l.code", "l.script", "l.is_mixed", "l.summary")


@q("TX06_language_summary", f"with {_language_ctes('indic')}, o as ({LANGUAGE_SQL.format('indic')}) select doc_id, is_mixed, summary, is_mixed or code <> 'en' as is_multilingual from o", "indic")
def _(v):
    return v.indic.select("doc_id", script.detect_languages("text").alias("l")).select("doc_id", "l.is_mixed", "l.summary", "l.is_multilingual")


@q("TX07_disambiguate_language", f"with {_language_ctes('indic')}, o as ({LANGUAGE_SQL.format('indic')}) select doc_id, code from o", "indic")
def _(v):
    return v.indic.select("doc_id", script.detect_languages("text")["code"].alias("code"))


@q("TX08_script_class", "select doc_id, case " + " ".join(
    f"when regexp_matches(text, '{script.block_class([(a, b)])}') then '{n}'" for n, a, b in dims.SCRIPT_CLASSES) + " else 'English' end as script from indic", "indic")
def _(v):
    return v.indic.select("doc_id", script.script_class("text").alias("script"))


LETTERS = translit.letter_table()
ROMAN_SQL = f"""
   with words as (select doc_id, t.i, string_split_regex(trim(text), '\\s+')[t.i] as w from indic, unnest(range(1, len(string_split_regex(trim(text), '\\s+')) + 1)) as t(i)),
   names(n, r) as (values {', '.join(f"('{k}', '{r}')" for k, r in dims.KNOWN_NAMES.items())}),
   letters(c, r) as (values {', '.join(f"('{k}', '{r}')" for k, r in LETTERS.items())}),
   chars as (select doc_id, i, t.k, substr(w, t.k, 1) as c from words, unnest(range(1, length(w) + 1)) as t(k)),
   spelled as (select doc_id, i, string_agg(coalesce(r, chars.c), '' order by k) as s from chars left join letters on letters.c = chars.c group by 1, 2),
   out as (select w.doc_id, w.i, case when n.r is not null then replace(w.w, n.n, n.r)
      when regexp_matches(s, '^\\p{{L}}') then concat(upper(substr(s, 1, 1)), substr(s, 2)) else s end as s
      from words w join spelled p on p.doc_id = w.doc_id and p.i = w.i left join names n on n.n = trim(w.w, ' ,.-;:"()'))
   select doc_id, string_agg(s, ' ' order by i) as romanized from out group by 1"""


@q("TX09_transliterate", ROMAN_SQL, "indic")
def _(v):
    return v.indic.select("doc_id", translit.transliterate(F.col("text")).alias("romanized"))


@q("TX10_preserve_and_transliterate", f"""with r as ({ROMAN_SQL}) select i.doc_id, trim(text) as original, romanized as transliterated,
   case when romanized <> trim(text) and romanized <> '' then concat(trim(text), ' (', romanized, ')') else trim(text) end as display
   from indic i join r on r.doc_id = i.doc_id""", "indic")
def _(v):
    return v.indic.select("doc_id", translit.preserve_and_transliterate(F.col("text")).alias("p")).select("doc_id", "p.*")


TERM_TEXT = ("case id % 7 when 0 then 'बैनामा' when 1 then ' கிரய பத்திரம் ' when 2 then concat('बंजर ', village) when 3 then 'زرعی زمین' "
             "when 4 then 'నేటి క్రయ దస్తావేజు' when 5 then '' else land_classification end")
TERMS = list((dims.DEED_TERMS | dims.CLASS_TERMS).items())


@q("TX11_translate_term", f"""
   with raw as (select id, trim({TERM_TEXT}) as t from lr), d(k, said, o) as (values {', '.join(f"({lit(k)}, {lit(s)}, {i})" for i, (k, s) in enumerate(TERMS))}),
   hit as (select t, arg_min(said, o) filter (k = t) as exact, arg_min(said, o) as held from (select distinct t from raw) r join d on contains(t, k) group by t)
   select id, coalesce(exact, held, r.t) as translated, case when r.t = '' then 100.0::double when exact is not null then 99.0 when held is not null then 90.0 else 75.0 end as confidence,
     r.t <> '' and exact is null and held is null as needs_verification from raw r left join hit h on h.t = r.t""", "lr")
def _(v):
    return v.lr.select("id", dictionary.translate_term(F.expr(TERM_TEXT)).alias("t")).select("id", "t.translated", "t.confidence", "t.needs_verification")


LABELS = ["Owner Name:", "खातेदार", "survey", "SY NO", "Land Area (acres)", "గ్రామం", "dist", "Deed Type", "Zone", "Registration No.", "s/o", "பரப்பளவு",
          "खसरा", "khata", "Plot-No", "reg.no", "village name", "Order Date", "owner_name", "mandal"]
LABEL_TEXT = f"case id % {len(LABELS)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(LABELS)) + " end"


def _dict_values(terms: dict[str, list[str]], fix=lambda t: t.lower()) -> str:
    flat = [(k, fix(t)) for k, ts in terms.items() for t in ts]
    return ", ".join(f"({lit(k)}, {lit(t)}, {i})" for i, (k, t) in enumerate(flat))


@q("TX12_canonical_field", f"""
   with raw as (select id, {LABEL_TEXT} as label from lr), d(k, t, o) as (values {_dict_values(dims.FIELD_TERMS)}),
   hit as (select label, arg_min(k, o) as k from (select distinct label from raw) r join d on contains(lower(trim(label)), t) or contains(t, lower(trim(label))) group by 1)
   select id, r.label, case when r.label in ({listed(dims.CANONICAL_FIELDS)}) then r.label else k end as field from raw r left join hit h on h.label = r.label""", "lr")
def _(v):
    labelled = v.lr.selectExpr("id", f"{LABEL_TEXT} as label")
    return labelled.withColumn("field", dictionary.canonical_field(F.col("label")))


@q("TX13_match_alias", f"""
   with raw as (select id, {LABEL_TEXT} as label from lr), d(k, t, o) as (values {_dict_values(dims.FIELD_ALIASES, lambda t: t.lower().replace(':', '').replace('-', ' ').replace('.', ''))}),
   hit as (select label, arg_min(k, o) as k from (select distinct label from raw) r join d on contains(replace(replace(replace(lower(trim(label)), ':', ''), '-', ' '), '.', ''), t) group by 1)
   select id, r.label, k as field from raw r left join hit h on h.label = r.label""", "lr")
def _(v):
    labelled = v.lr.selectExpr("id", f"{LABEL_TEXT} as label")
    return labelled.withColumn("field", dictionary.match_alias(F.col("label")))


NUMBER_TEXT = ("case id % 12 when 0 then concat(cast(id % 90 as string), '/Z') when 1 then concat(cast(id % 90 as string), '-o') when 2 then concat(cast(id % 90 as string), '/l') "
               "when 3 then concat('12', 'O', cast(id % 90 as string)) when 4 then 'Not found' when 5 then '2.0O acres' when 6 then 'none here' when 7 then '9000 acres' "
               "when 8 then '12' when 9 then concat(cast(id % 90 as string), ' A/4') else survey_number end")
NUMBER_FIELD = "case when id % 12 in (5, 6, 7) then 'land_area' when id % 12 = 8 then 'registration_number' when id % 12 = 10 and id % 5 = 0 then 'village' else 'survey_number' end"
NUMBER_SQL = f"""
   raw as (select id, {NUMBER_FIELD} as f, trim({NUMBER_TEXT}) as x from lr),
   part as (select *, regexp_extract(x, '^([0-9]+)\\s*[/\\-]\\s*([A-Za-z0-9]+)$', 1) as m, regexp_extract(x, '^([0-9]+)\\s*[/\\-]\\s*([A-Za-z0-9]+)$', 2) as s,
     try_cast(nullif(regexp_extract(x, '[0-9.]+'), '') as double) as a from raw),
   num as (select id, f, x, case when lower(x) in ({listed(dims.MISSING_NUMBER)}) then {{{{'c': 40.0::double, 'a': false, 'alt': ''}}}}
     when f = 'survey_number' then case when s in ('Z', 'z') then {{{{'c': 61.0, 'a': true, 'alt': concat(m, '/2')}}}} when s in ('O', 'o') then {{{{'c': 62.0, 'a': true, 'alt': concat(m, '/0')}}}}
       when s in ('l', 'I') then {{{{'c': 65.0, 'a': true, 'alt': concat(m, '/1')}}}}
       when regexp_matches(x, '[0-9]+[OIlSZGB][0-9]+') then {{{{'c': 64.0, 'a': true, 'alt': translate(x, '{dims.LOOKALIKE_LETTERS}', '{dims.LOOKALIKE_DIGITS}')}}}}
       when regexp_matches(x, '^[0-9]+(/[A-Za-z0-9]+)?$') or regexp_matches(x, '^[0-9]+[A-Za-z]*$') then {{{{'c': 95.0, 'a': false, 'alt': ''}}}} else {{{{'c': 78.0, 'a': false, 'alt': ''}}}} end
     when f = 'land_area' then case when regexp_matches(x, '[0-9]+\\.[0-9]*[Oo]+') then {{{{'c': 68.0, 'a': true, 'alt': regexp_replace(x, '[Oo]', '0', 'g')}}}}
       when a is null then {{{{'c': 45.0, 'a': true, 'alt': ''}}}} when a <= 0 or a > 5000 then {{{{'c': 60.0, 'a': false, 'alt': ''}}}} else {{{{'c': 95.0, 'a': false, 'alt': ''}}}} end
     when f = 'registration_number' and length(x) < 4 then {{{{'c': 55.0, 'a': true, 'alt': ''}}}} else {{{{'c': 95.0, 'a': false, 'alt': ''}}}} end as n from part)""".replace("{{", "{").replace("}}", "}")


@q("TX14_number_ambiguity", f"with {NUMBER_SQL} select id, f as field, x as value, n.c as confidence, n.a as ambiguous, n.a or n.c < 80 as requires_review, n.alt as alternatives from num", "lr")
def _(v):
    raw = v.lr.selectExpr("id", f"{NUMBER_FIELD} as field", f"trim({NUMBER_TEXT}) as value")
    return raw.withColumn("n", number_ambiguity(F.col("field"), F.col("value"))).select(
        "id", "field", "value", "n.confidence", "n.ambiguous", "n.requires_review", F.array_join("n.alternatives", ",").alias("alternatives"))


SELECTED = "case doc_id % 5 when 0 then 'Auto-detect' when 1 then 'village map' when 2 then 'Mutation' else null end"


def _classify_sql() -> str:
    scores = [" + ".join(f"(length(l) - length(replace(l, {lit(k)}, ''))) // {len(k)}" for k in ks) for ks in dims.TYPE_KEYWORDS.values()]
    names = dims.DOCUMENT_TYPES
    return f"""with d as (select doc_id, {SELECTED} as sel, lower(ocr_raw_text) as l from typed), s as (select doc_id, sel, {', '.join(f'2 * ({x}) as s{i}' for i, x in enumerate(scores))} from d),
     t as (select *, s0 + s1 + s2 + s3 as total, greatest(s0, s1, s2, s3) as best from s),
     w as (select doc_id, sel, total, best, case when total = 0 then coalesce(sel, '{names[0]}') when s0 = best then '{names[0]}' when s1 = best then '{names[1]}' when s2 = best then '{names[2]}' else '{names[3]}' end as detected,
       case when sel is null or contains(lower(sel), 'auto') then null when contains(sel, 'map') then '{names[2]}' else '{names[3]}' end as chosen from t)
     select doc_id, detected as detected_type, coalesce(chosen, detected) as selected_type,
       case when total = 0 then 72.0::double else greatest(68, least(99, round(best / total::double * 100, 1))) end as confidence, chosen is not null and chosen <> detected as is_user_overridden from w"""


@q("TX15_classify_document", _classify_sql(), "typed")
def _(v):
    return v.typed.select("doc_id", dictionary.classify_document(F.col("ocr_raw_text"), F.expr(SELECTED)).alias("c")).select("doc_id", "c.*")


KIND_TEXT = "case id % 9 when 0 then 'Auto' when 1 then ' SALE agreement' when 2 then 'Pahani copy' when 3 then '7/12' when 4 then 'FMB' when 5 then 'dakhil kharij' when 6 then 'misc' when 7 then null else document_type end"


@q("TX16_normalize_document_type", f"""with r as (select id, lower(trim({KIND_TEXT})) as k from lr)
   select id, case when k is null or k = '' or contains(k, 'auto') then null when contains(k, 'sale') or contains(k, 'deed') or contains(k, 'बैनामा') then 'Registered Sale Deed'
     when regexp_matches(k, 'khasra|khatauni|pahani|7/12|patta') then 'Khasra / Khatauni Register' when regexp_matches(k, 'cadastral|map|fmb|sketch|naksha') then 'Cadastral Boundary Map'
     when regexp_matches(k, 'mutation|sanction|dakhil|namantaran') then 'Mutation Sanction Order' else 'Registered Sale Deed' end as document_type from r""", "lr")
def _(v):
    return v.lr.select("id", labels.document_type(F.expr(KIND_TEXT)).alias("document_type"))


def _section_sql(keywords: dict, heights: list) -> str:
    parts = " ".join(f"when {' or '.join(f'contains(lower(text), {lit(k)})' for k in ks)} then '{s}'" for s, ks in keywords.items())
    high = " ".join(f"when (y1 + y2) / 2.0 / 1400 < {h} then '{s}'" for h, s in heights[:-1])
    return f"case {parts} {high} else '{heights[-1][1]}' end"


PLAIN_LINES = "case when line_no % 2 = 0 and doc_id % 3 = 0 then 'lorem ipsum' else text end"
LINES_SQL = f"(select doc_id, line_no, {PLAIN_LINES} as text, y1 * case when doc_id % 5 = 0 then 5 else 1 end as y1, y2 * case when doc_id % 5 = 0 then 5 else 1 end as y2 from ocr_lines)"


def _lines(v):
    return v.ocr_lines.selectExpr("doc_id", "line_no", f"{PLAIN_LINES} as text", "y1 * case when doc_id % 5 = 0 then 5 else 1 end as y1",
                                  "y2 * case when doc_id % 5 = 0 then 5 else 1 end as y2")


@q("TX24_segment_regions", f"""with l as (select *, {_section_sql(dims.SECTION_KEYWORDS, dims.SECTION_HEIGHTS)} as section from {LINES_SQL})
   select doc_id, section, count(*) as line_count, string_agg(text, chr(10) order by line_no) as text from l group by 1, 2""", "ocr_lines")
def _(v):
    return layout.segment_regions(_lines(v))


@q("TX24_segment_regions_six", f"""with l as (select *, {_section_sql(dims.SECTION_KEYWORDS_SIX, dims.SECTION_HEIGHTS_SIX)} as section from {LINES_SQL})
   select doc_id, section, count(*) as line_count, string_agg(text, chr(10) order by line_no) as text from l group by 1, 2""", "ocr_lines")
def _(v):
    return layout.segment_regions(_lines(v), keywords=dims.SECTION_KEYWORDS_SIX, heights=dims.SECTION_HEIGHTS_SIX)


@q("TX25_detect_tables", """
   with l as (select doc_id, line_no, text, x1, (((line_no - 1) // 3) * 60 // 20 * 20 + 40)::int as y from ocr_lines),
   r as (select doc_id, y, string_agg(text, ' | ' order by x1, line_no) as cells from l group by 1, 2 having count(*) >= 3),
   n as (select *, count(*) over (partition by doc_id) as row_count, row_number() over (partition by doc_id order by y) as row_no from r)
   select doc_id, y, cells, row_no::int as row_no, row_count from n where row_count >= 2""", "ocr_lines")
def _(v):
    grid = v.ocr_lines.selectExpr("doc_id", "line_no", "text", "x1", "cast(floor((line_no - 1) / 3) as int) * 60 + 47 as y1")
    return layout.detect_tables(grid).select("doc_id", "y", F.array_join("cells", " | ").alias("cells"), "row_no", "row_count")


@q("TX26_ocr_rollup", """
   with d as (select doc_id from deed union all select -1 - doc_id from deed where doc_id % 13 = 0)
   select d.doc_id, coalesce(string_agg(l.text, chr(10) order by line_no), '') as text,
     coalesce(round(sum(round(confidence * 100, 1)) / count(l.text), 1), 35.0::double) as confidence, count(l.text) as line_count,
     case when count(l.text) > 0 then 'English' else 'Unknown' end as language, count(l.text) = 0 as requires_manual_review
   from d left join ocr_lines l on l.doc_id = d.doc_id group by d.doc_id""", "deed", "ocr_lines")
def _(v):
    blank = v.deed.where("doc_id % 13 = 0").selectExpr("-1 - doc_id as doc_id")  # documents in which nothing was read
    return layout.ocr_rollup(v.ocr_lines, v.deed.select("doc_id").unionByName(blank))


NAMES = ["owner_name", "witness_information", "land_area", "north_boundary", "stamp_duty", "mandal_tehsil_taluk", "order_date", "survey_number", "Seller_Address", "misc_note", "state", "sro"]
NAME_TEXT = f"case id % {len(NAMES)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(NAMES)) + " end"


def _group_sql(groups, default) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains(lower(f), {lit(k)})' for k in ks)} then '{n}'" for n, ks in groups) + f" else '{default}' end"


@q("TX27_categorize_field", f"""with r as (select id, {NAME_TEXT} as f from lr) select id, f as field_name, {_group_sql(dims.FIELD_GROUPS, dims.FIELD_GROUP_DEFAULT)} as category,
   {_group_sql(dims.FIELD_INPUTS, 'text')} as validation_type, lower(f) in ({listed(dims.REQUIRED_FIELDS)}) as is_required from r""", "lr")
def _(v):
    named = v.lr.selectExpr("id", f"{NAME_TEXT} as field_name")
    return named.select("id", "field_name", labels.categorize_field("field_name").alias("category"),
                        labels.validation_type("field_name").alias("validation_type"), labels.is_required("field_name").alias("is_required"))


CANDIDATES = ("case when id % 3 = 0 then 'Not found' else registration_number end as registration_number", "case when id % 5 = 0 then 'pending' else null end as order_number",
              "case when id % 7 = 0 then concat('D-', cast(id % 50 as string)) else 'none' end as document_number", "case when id % 2 = 0 then '' else 'N/A mut' end as mutation_number")


@q("TX28_pick_document_number", f"""
   with c as (select id, {', '.join(CANDIDATES)} from lr),
   l as (select id, list_filter([registration_number, order_number, document_number, mutation_number], lambda x: x is not null and lower(trim(x)) not in ('not found', 'none', 'null', '')) as ok from c),
   p as (select id, trim(coalesce(list_filter(ok, lambda x: regexp_matches(x, '[0-9]'))[1], ok[1], concat('DOC-', upper(substr(sha256(cast(id as varchar)), 1, 32))))) as n from l),
   f as (select n, min(id) as first_id from p group by 1)
   select p.id, case when p.id = first_id then p.n else concat(p.n, '-', upper(substr(sha256(cast(p.id as varchar)), 1, 32))) end as document_number from p join f on f.n = p.n""", "lr")
def _(v):
    from landq.operators.numbering import pick_document_number
    return pick_document_number(v.lr.selectExpr("id", *CANDIDATES))


PARTY_TEXT = "case id % 5 when 0 then concat('PURCHASER / OWNER: ', owner_name) when 1 then concat('vendor ', owner_name) when 2 then concat('/: ', owner_name) else owner_name end"


@q("TX29_clean_party_name", f"select id, trim(regexp_replace({PARTY_TEXT}, '(?i)^(?:PURCHASER|BUYER|OWNER|VENDOR|SELLER|/|:|\\s)+', '')) as party from lr", "lr")
def _(v):
    return v.lr.select("id", text.party_name(F.expr(PARTY_TEXT)).alias("party"))


FIRST_TEXT = "case id % 5 when 0 then concat('approx ', cast(land_area as string), ' Ac') when 1 then 'none' when 2 then '1.2.3' else cast(land_area as string) end"


@q("TX30_first_number", f"select id, coalesce(try_cast(nullif(regexp_extract({FIRST_TEXT}, '[0-9.]+'), '') as double), 0.0::double) as number from lr", "lr")
def _(v):
    return v.lr.select("id", text.first_number(F.expr(FIRST_TEXT)).alias("number"))


@q("TX31_bbox", """
   with b as (select doc_id, line_no, x1::double as x, y1::double as y, (x2 - x1)::double as w, (y2 - y1)::double as h from ocr_lines),
   s as (select doc_id, line_no, case when doc_id % 2 = 0 then x / 1000 else x end as x, case when doc_id % 2 = 0 then y / 1400 else y end as y,
     case when doc_id % 2 = 0 then w / 1000 else w end as w, case when doc_id % 2 = 0 then h / 1400 else h end as h from b)
   select doc_id, line_no, round(case when x <= 1 and y <= 1 and w <= 1 then x * 100 else x / 1000 * 100 end, 6) as "left", round(case when x <= 1 and y <= 1 and w <= 1 then y * 100 else y / 1400 * 100 end, 6) as top,
     round(case when x <= 1 and y <= 1 and w <= 1 then least(100, w * 100) else w / 1000 * 100 end, 6) as width, round(case when x <= 1 and y <= 1 and w <= 1 then least(100, h * 100) else h / 1400 * 100 end, 6) as height from s""", "ocr_lines")
def _(v):
    corner = F.expr("array(array(cast(x1 as double), cast(y1 as double)), array(cast(x2 as double), cast(y1 as double)), array(cast(x2 as double), cast(y2 as double)))")
    box = v.ocr_lines.select("doc_id", "line_no", geo.polygon_box(corner).alias("b"))
    scaled = F.when(F.col("doc_id") % 2 == 0, F.struct((F.col("b.x") / 1000).alias("x"), (F.col("b.y") / 1400).alias("y"),
                                                       (F.col("b.w") / 1000).alias("w"), (F.col("b.h") / 1400).alias("h"))).otherwise(F.col("b"))
    pct = box.withColumn("b", scaled).select("doc_id", "line_no", geo.box_percent(F.col("b")).alias("p"))
    return pct.select("doc_id", "line_no", *[F.round(f"p.{c}", 6).alias(c) for c in ("left", "top", "width", "height")])


METRICS = {"width": "cast(900 + id % 1700 as int)", "height": "cast(1000 + id % 1900 as int)", "blur": "cast(id * 7 % 5000 as double) / 10", "contrast": "cast(id * 3 % 900 as double) / 10"}
METRICS_SQL = ", ".join(f"{e} as {c}" for c, e in METRICS.items())


@q("TX32_quality_tier", f"""
   with m as (select id, {METRICS_SQL} from lr), d as (select *, round(greatest(width / 8.27::double, height / 11.69::double), 1) as dpi from m),
   f as (select *, width < 1200 or height < 1200 or dpi < 150 as low, blur < 80 as blurry, contrast < 35 as flat from d)
   select id, dpi, case when blurry and low then 'POOR_QUALITY' when low or blurry or flat then 'MEDIUM' else 'HIGH' end as tier,
     case when blurry and low then greatest(35, round(least(blur, 60), 1)) when low or blurry or flat then least(85, greatest(65, round(blur * 0.5::double, 1)))
       else least(98.5::double, round(75 + least(blur * 0.05::double, 23.5::double), 1)) end as score from f""", "lr")
def _(v):
    pages = v.lr.selectExpr("id", *[f"{e} as {c}" for c, e in METRICS.items()])
    return pages.select("id", labels.quality_tier("width", "height", "blur", "contrast").alias("q")).select("id", "q.*")


CLEAN_TEXT = "case id % 6 when 0 then concat(' : ', owner_name, ' ,;') when 1 then ' Unknown ' when 2 then 'N/A' when 3 then null when 4 then ':-=' else owner_name end"


@q("TX33_clean_value", f"""with r as (select id, trim(trim({CLEAN_TEXT}), ':=-,; ') as s from lr)
   select id, case when lower(s) not in ({listed(dims.MISSING_CLEAN)}) then s end as clean from r""", "lr")
def _(v):
    return v.lr.select("id", text.clean_value(F.expr(CLEAN_TEXT)).alias("clean"))


@q("TX34_language_registry", f"""
   with c as (select lang, count(*) as documents from documents group by 1), r(code, name, native_name, script, locale_code) as
     (values {', '.join(f"({lit(x[0])}, {lit(x[1])}, {lit(x[2])}, {lit(x[3])}, {lit(x[5])})" for x in dims.LANGUAGES)}, ('de', 'German', 'Deutsch', 'Latin', 'de-DE'))
   select r.*, coalesce(documents, 0) as documents from r left join c on c.lang = r.code""")
def _(v):
    from landq.sources.languages import language_registry
    extra = [("de", "German", "Deutsch", "Latin", [(0x41, 0x5A)], "de-DE", ["Kaufvertrag"])]
    counts = v.table("documents").groupBy("lang").agg(F.count("*").alias("documents"))
    registry = language_registry(v.spark, extra)
    return registry.join(counts, registry["code"] == counts["lang"], "left").select(
        "code", "name", "native_name", "script", "locale_code", F.coalesce("documents", F.lit(0)).alias("documents"))
