"""Source lines of extracted values."""

import datetime

import __spark_entry__ as entry
from landq.sources import views


def tables(spark, folder, keys):
    day = datetime.datetime(1995, 3, 4)
    made = {
        "orders": ([(i, 1 + i % 2, "FOP"[i % 3], 1.0, day, "1-URGENT") for i in keys], "o_orderkey bigint, o_custkey bigint, "
                   "o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(1, "Ann Lee", 1, "A"), (2, "Bo Ray", 1, "B")], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(1, "R")], "r_regionkey int, r_name string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_every_field_of_the_table_is_traced(spark, tmp_path):
    tables(spark, tmp_path, range(1, 40))
    want = sorted((r.land_record_id, r.field_name, r.extracted_value) for r in views.Views(spark, str(tmp_path)).fields.collect())
    got = entry.queries()["JN08_trace_fields_to_lines"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.field_name, r.value) for r in got) == want
    assert {r.field_name for r in got} == set(views.FIELD_COLUMNS)
    native = [r for r in got if r.field_name == "survey_number" and r.doc_id % 4 == 0]
    assert native and all(r.source_text.startswith("Survey Number: ") and r.value not in r.source_text for r in native)  # found by its label
