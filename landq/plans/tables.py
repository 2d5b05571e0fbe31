"""Sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq import dims
from landq.functions import text
from landq.operators import tables
from landq.plans.suite import Suite
from landq.session import shared_folder
from landq.sources import land, sinks

suite = Suite()
q = suite.query

#: Folders of the written tables; a deployment takes about one for each 128 MB.
BUCKETS = 16
RING = "array(array(lon, lat), array(lon + 0.0025D, lat), array(lon + 0.0025D, lat - 0.0025D), array(lon, lat - 0.0025D), array(lon, lat))"


@q("IO01_read_land_records")
def _(v):
    records = v.lr.join(v.geo, "id").withColumn("coordinates_geojson", F.expr(
        f"struct('Polygon' as type, array({RING}) as coordinates)"))
    lines = records.select(F.to_json(F.struct(*[c for c in records.columns if c not in ("lon", "lat", "updated_at")])).alias("value"))
    return land.parse_land_records(lines).select(
        "id", "owner_name", "land_area", "is_public", F.col("coordinates_geojson.type").alias("geometry_type"),
        F.size(F.get("coordinates_geojson.coordinates", F.lit(0))).alias("vertices"))


STATES_SQL = """select row_number() over (order by code)::bigint as id, name, code, capital, region,
   coalesce(survey_label, 'Survey Number') as survey_number_label, coalesce(admin_unit_label, 'Tehsil') as admin_unit_label,
   coalesce(default_area_unit, 'Acres') as default_area_unit, coalesce(language_code, 'en') as language_code from state_source"""


@q("IO02_build_state_dims", STATES_SQL, "state_source")
def _(v):
    return land.build_state_dims(v.state_source)


@q("IO03_build_admin_units", f"""
   with states as ({STATES_SQL}), d as (select state_code, district_name, unnest(admin_units) as name from district_source)
   select s.id as state_id, d.district_name, d.name, s.admin_unit_label as unit_type from d join states s on s.code = d.state_code""",
   "state_source", "district_source")
def _(v):
    return land.build_admin_units(v.district_source, land.build_state_dims(v.state_source))


@q("IO04_catalog_files")
def _(v):
    return land.catalog_files(v.spark, v.folder, extensions=[*dims.ALLOWED_EXTENSIONS, "parquet"]).drop("path")


FILES_SQL = "concat(source, '/My Deed (', cast(doc_id as varchar), ')', case when doc_id % 3 = 0 then '.PDF' when doc_id % 3 = 1 then '.tar.Gz' else '' end)"


@q("IO05_sanitize_filename", f"""
   with f as (select doc_id, regexp_replace(list_last(string_split({FILES_SQL}, '/')), '[^a-zA-Z0-9_.-]', '_', 'g') as clean from documents)
   select doc_id, clean as filename, case when contains(clean, '.') then lower(list_last(string_split(clean, '.'))) else 'bin' end as extension from f""")
def _(v):
    named = v.table("documents").selectExpr("doc_id", f"{FILES_SQL.replace('varchar', 'string')} as name")
    clean = text.sanitized_filename("name")
    return named.select("doc_id", clean.alias("filename"), text.file_extension(clean).alias("extension"))


@q("IO06_export_corrections", """select id, document_id, field_name, original_ai_value, corrected_value, officer_name, reason,
   language, document_type, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') as "timestamp" from corrections order by id desc limit 1000""",
   "corrections")
def _(v):
    return tables.export_corrections(v.corrections)


REPLACED_SQL = """select land_record_id, field_name, extracted_value, 'old' as origin from fields where land_record_id not in (select id from lr where id % 5 = 0)
   union all select id, 'owner_name', owner_name, 'new' from lr where id % 5 = 0"""


def _replacement(v):
    old = v.fields.select("land_record_id", "field_name", "extracted_value", F.lit("old").alias("origin"))
    new = v.lr.where("id % 5 = 0").selectExpr("id as land_record_id", "'owner_name' as field_name", "owner_name as extracted_value", "'new' as origin")
    return old, new


@q("IO07_replace_by_key", REPLACED_SQL, "fields")
def _(v):
    return tables.replace_by_key(*_replacement(v), ["land_record_id"])


@q("IO07_replace_in_table", REPLACED_SQL, "fields")
def _(v):
    """Written to a table in buckets, and once more: the second run changes nothing."""
    (old, new), path = _replacement(v), shared_folder(v.spark, "fields-table")
    sinks.write_table(old, path, ["land_record_id"], BUCKETS)
    for _ in range(2):
        sinks.replace_in_table(path, new, ["land_record_id"], BUCKETS)
    return sinks.read_table(v.spark, path)


@q("IO08_conform_schema", """select id, owner_name, document_type, 'Acres' as area_unit, cast(null as bigint) as state_id,
   0.0::double as quality_score, false as requires_review from lr""", "lr")
def _(v):
    return tables.conform_schema(v.lr.select("id", "owner_name", "document_type"), {
        "area_unit": ("string", "Acres"), "document_type": ("string", "Sale Deed"), "state_id": ("bigint", None),
        "quality_score": ("double", 0.0), "requires_review": ("boolean", False)})


CHANGES = ("id", "case when id % 2 = 0 then concat(owner_name, ' II') end as owner_name",
           "case when id % 3 = 0 then land_area + 1 end as land_area")


UPSERT_SQL = f"""with changes as (select {', '.join(CHANGES)} from lr where id % 4 <> 1
     union all select id + 100000000, 'New owner', 1.5 from lr where id % 1000 = 0)
   select coalesce(l.id, c.id) as id, coalesce(c.owner_name, l.owner_name) as owner_name, coalesce(c.land_area, l.land_area) as land_area,
          l.village from lr l full join changes c on l.id = c.id"""


def _upsert(v):
    changes = v.lr.where("id % 4 <> 1").selectExpr(*CHANGES).unionByName(
        v.lr.where("id % 1000 = 0").selectExpr("id + 100000000 as id", "'New owner' as owner_name", "1.5D as land_area"))
    return v.lr.select("id", "owner_name", "land_area", "village"), changes


@q("IO09_upsert_partial", UPSERT_SQL, "lr")
def _(v):
    return tables.upsert_partial(*_upsert(v), "id", insert=True)


@q("IO09_upsert_in_table", UPSERT_SQL, "lr")
def _(v):
    """Written to a table in buckets, and once more: the second run changes nothing."""
    (records, changes), path = _upsert(v), shared_folder(v.spark, "records-table")
    sinks.write_table(records, path, ["id"], BUCKETS)
    for _ in range(2):
        sinks.upsert_in_table(path, changes, "id", BUCKETS, insert=True)
    return sinks.read_table(v.spark, path)


@q("IO10_feature_collection", f"""select c.id, concat('{{"type":"Feature","properties":{{"id":', c.id, coalesce(concat(',"survey_number":', to_json(survey_number)), ''),
   coalesce(concat(',"village":', to_json(village)), ''), coalesce(concat(',"district":', to_json(district)), ''),
   coalesce(concat(',"cadastral_area":', cadastral_area), ''), coalesce(concat(',"survey_year":', to_json(survey_year)), ''),
   '}},"geometry":{{"type":"Polygon","coordinates":[[[', lon, ',', lat, '],[', lon + 0.0025::double, ',', lat, '],[', lon + 0.0025::double, ',',
   lat - 0.0025::double, '],[', lon, ',', lat - 0.0025::double, '],[', lon, ',', lat, ']]]}}}}') as feature
   from cad c join (select id, 77 + (id % 100) / 100.0::double as lon, 23 + (id % 50) / 100.0::double as lat from lr) using (id)""", "cad")
def _(v):
    parcels = v.cad.join(v.geo, "id").withColumn("geometry", F.expr(f"struct('Polygon' as type, array({RING}) as coordinates)"))
    return tables.feature_collection(parcels, ["id", "survey_number", "village", "district", "cadastral_area", "survey_year"])


@q("IO11_purge_by_predicate", """select id, owner_name, father_husband_name, district from lr where not coalesce(
   father_husband_name in ('Parent 3', 'Parent 4') or lower(father_husband_name) like '%parent 1%' or district in ('NATION_7', 'NATION_8'), false)""", "lr")
def _(v):
    people = v.lr.select("id", F.col("father_husband_name").alias("owner_name"), F.col("owner_name").alias("kept"), "district")
    gone = tables.purge_predicate(["Parent 3", "Parent 4"], ["%Parent 1%"], ["NATION_7", "NATION_8"])
    return tables.purge(people, gone).select("id", F.col("kept").alias("owner_name"), F.col("owner_name").alias("father_husband_name"), "district")
