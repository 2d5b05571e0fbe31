"""Field extraction from the whole texts of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq import dims, patterns
from landq.operators import extract
from landq.plans.suite import Suite
from landq.plans.text import DIGITS, listed, lit

suite = Suite()
q = suite.query

CLEAN = r"(select case when lower(x) not in ({missing}) then x end from (select trim(regexp_replace({value}, '^\s+|\s+$', '', 'g'), ':=-,; ') as x))"


def first(alternatives: list[str], column: str = "norm", flags: str = "(?i)", group: int = 1) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, {lit(flags + p)}, {group}), '')" for p in alternatives) + ", null)"


def clean(value: str) -> str:
    x = f"trim(regexp_replace({value}, '^\\s+|\\s+$', '', 'g'), ':=-,; ')"
    return f"case when lower({x}) not in ({listed(dims.MISSING_CLEAN)}) then {x} end"


def place(value: str) -> str:
    return clean(f"string_split({value}, ',')[1]")


def held(pattern: str) -> str:
    return f"regexp_matches(norm, {lit('(?i)' + pattern)})"


def cased(table, default: str = "null") -> str:
    return "case " + " ".join(f"when {held(p)} then {lit(n)}" for p, n in table) + f" else {default} end"


def found(table: dict) -> dict[str, str]:
    return {f: place(first(p)) if f in extract.PLACES else clean(first(p)) for f, p in table.items()}


def sale_sql() -> dict[str, str]:
    v = found(patterns.SALE_DEED)
    v["registration_number"] = v["document_number"]
    for c in ("sale_consideration", "stamp_duty", "registration_fee"):
        v[c] = f"'Rs. ' || ({v[c]})"
    return v


def cadastral_sql() -> dict[str, str]:
    v = found(patterns.CADASTRAL_MAP)
    v["plot_boundaries"] = f"'North: ' || ({v['plot_boundaries']})"
    return v | {f: f"case when {held(p)} then '{patterns.MAP_FLAG_TEXT}' end" for f, p in patterns.MAP_FLAGS}


def mutation_sql() -> dict[str, str]:
    v = {f: clean(first(p)) for f, p in patterns.MUTATION_ORDER.items()}
    v["order_number"] = f"coalesce({v['order_number']}, {v['mutation_number']})"
    acres = (f"case when {held(patterns.ACRES[0])} then coalesce({first(patterns.ACRES)}, {first(patterns.ACRES, group=2)}) "
             f"else '0.' || {first([patterns.ACRES_LOOSE], flags='')} end")
    small = first([patterns.HECTARES_LOOSE], flags="")
    hectares = f"coalesce({first([patterns.HECTARES])}, case when {small} is distinct from ({acres}) then {small} end)"
    v["land_area"] = (f"case when ({acres}) is not null then coalesce({clean(acres)}, 'Not found') || ' Acres' || "
                      f"coalesce(' (' || ({clean(hectares)}) || ' Hectares)', '') end")
    v["authority_officer_name"] = f"regexp_replace({first(patterns.OFFICER, flags='')}, '^\\s+|\\s+$', '', 'g')"
    v["state"] = cased([(s, s) for s in patterns.MUTATION_STATES])
    v["mutation_status"] = cased(patterns.MUTATION_STATUS, lit(patterns.MUTATION_STATUS_DEFAULT))
    papers = ", ".join(f"case when {held(p)} then '{n}' end" for p, n in patterns.SUPPORTING)
    v["supporting_document"] = f"nullif(array_to_string(list_filter([{papers}], lambda x: x is not null), ' & '), '')"
    v["reason_for_mutation"] = cased(patterns.REASONS)
    v["seal_signature_info"] = cased([patterns.SEAL])
    return v


SQL = {dims.SALE_DEED: sale_sql, dims.KHASRA: lambda: found(patterns.KHASRA), dims.CADASTRAL_MAP: cadastral_sql,
       dims.MUTATION_ORDER: mutation_sql}
NORM = f"norm as (select doc_id, document_type, {DIGITS.format('ocr_raw_text')} as norm from typed)"


def wide(kind: str, where: str = "true") -> str:
    values = SQL[kind]()
    columns = ", ".join(f"coalesce({values.get(n, 'null::varchar')}, 'Not found') as f{i + 1}" for i, (n, _) in enumerate(patterns.TYPE_FIELDS[kind]))
    return f"(select doc_id, document_type, {columns} from norm where {where})"


def long(kind: str, source: str) -> str:
    return " union all ".join(f"select doc_id, '{n}' as field_name, {i + 1} as ordinal, f{i + 1} as value from {source}"
                              for i, (n, _) in enumerate(patterns.TYPE_FIELDS[kind]))


for _name, _kind in [("TX17_extract_sale_deed", dims.SALE_DEED), ("TX18_extract_khasra", dims.KHASRA),
                     ("TX19_extract_cadastral", dims.CADASTRAL_MAP), ("TX20_extract_mutation", dims.MUTATION_ORDER)]:
    @q(_name, f"with {NORM}, w as materialized {wide(_kind)} {long(_kind, 'w')}", "typed")
    def _(v, kind=_kind):
        return extract.extract_type(v.typed, kind).select("doc_id", "field_name", "ordinal", "value")


ROUTED = ", ".join(f"w{i} as materialized {wide(k, f'document_type = {lit(k)}')}" for i, k in enumerate(dims.DOCUMENT_TYPES))
ROUTED_LONG = " union all ".join(f"select *, {lit(k)} as document_type from ({long(k, f'w{i}')})" for i, k in enumerate(dims.DOCUMENT_TYPES))


@q("TX21_route_and_score", f"""with {NORM}, {ROUTED}, l as ({ROUTED_LONG}) select doc_id, document_type, field_name, value,
   case when value = 'Not found' then 0.0::double when length(value) > 2 then 96.0 else 88.0 end as confidence, value <> 'Not found' as is_found from l""", "typed")
def _(v):
    return extract.route_and_score(v.typed).select("doc_id", "document_type", "field_name", "value", "confidence", "is_found")


@q("TX21_route_summary", f"""with {NORM}, {ROUTED}, l as ({ROUTED_LONG}) select doc_id, document_type, count(*)::int as total_fields,
   (count(*) filter (value <> 'Not found'))::int as found_fields,
   coalesce(round(avg(case when length(value) > 2 then 96.0::double else 88.0 end) filter (value <> 'Not found'), 1), 50.0) as average_confidence from l group by 1, 2""", "typed")
def _(v):
    return extract.route_summary(v.typed)


def generic_sql(source: str) -> str:
    cells = ", ".join(
        f"trim(string_split(regexp_replace(regexp_replace({first(p)}, '^\\s+|\\s+$', '', 'g'), '[\\r\\n\\t]+', ' ', 'g'), '|')[1]) as {f}" for f, p in patterns.GENERIC.items())
    return f"norm as (select doc_id, {DIGITS.format('ocr_raw_text')} as norm from {source}), gen as materialized (select doc_id, {cells} from norm)"


GENERIC_LONG = " union all ".join(f"select doc_id, '{f}' as field_name, {f} as value from gen" for f in patterns.GENERIC)


@q("TX22_extract_generic", f"with {generic_sql('deed')} {GENERIC_LONG}", "deed")
def _(v):
    return extract.extract_generic(v.deed)


@q("TX22_extract_generic_typed", f"with {generic_sql('typed')} {GENERIC_LONG}", "typed")
def _(v):
    return extract.extract_generic(v.typed)


def pan_sql() -> str:
    def value(ps: list[str]) -> str:
        return "coalesce(" + ", ".join(
            f"nullif(trim(regexp_replace(nullif(regexp_extract(ocr_raw_text, {lit('(?im)' + p)}, 1), ''), '[\\t\\r]+', ' ', 'g'), ' :,.-_|/' || chr(9) || chr(10)), '')" for p in ps) + ", null)"
    cells = ", ".join(f"{value(p)} as {f}" for f, (p, _, _) in patterns.PAN_INDIA.items())

    def keyword(table) -> str:
        return "case " + " ".join(f"when regexp_matches(ocr_raw_text, {lit('(?i)' + p)}) then '{n}'" for p, n in table) + " end"
    rows = []
    for f, (_, yes, no) in patterns.PAN_INDIA.items():
        shown = "coalesce(khasra_number, concat('KHA-', nullif(replace(survey_number, '/', '-'), '')))" if f == "khasra_number" else f
        if f == "khasra_number":
            shown = "case when khasra_number is not null then khasra_number when survey_number is not null then 'KHA-' || replace(survey_number, '/', '-') end"
        rows.append(f"select doc_id, '{f}' as field_name, {shown} as value, case when {f} is not null then {yes}::double else {no}::double end as confidence from pan")
    rows.append("select doc_id, 'current_owner', owner_name, case when owner_name is not null then 98.0 else 88.0 end from pan")
    rows.append("select doc_id, 'land_classification', class, 90.0 from pan")
    rows.append("select doc_id, 'document_type', kind, 90.0 from pan")
    rows += [f"select doc_id, '{f}', null, 90.0 from pan" for f in ("ownership_type", "mutation_number")]
    return (f"with pan as materialized (select doc_id, {cells}, {keyword(patterns.PAN_INDIA_CLASSES)} as class, {keyword(patterns.PAN_INDIA_TYPES)} as kind from typed), "
            f"l as ({' union all '.join(rows)}) select *, case when confidence >= 80 then 'HIGH' when confidence >= 60 then 'MEDIUM' else 'LOW' end as confidence_tier from l")


@q("TX23_extract_pan_india", pan_sql(), "typed")
def _(v):
    return extract.extract_pan_india(v.typed)
