"""Written tables, searches for many queries, asked registrations, and late rows of a stream."""

import datetime
import os
import random

from pyspark.sql import functions as F

from landq.operators import filters, joins
from landq.sources import sinks, views
from landq.streaming import registrations


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_table_is_replaced_by_bucket(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    old = [(i // 3, f"v{i}") for i in range(300)] + [(7, f"hot{i}") for i in range(200)]
    sinks.write_table(spark.createDataFrame(old, "k bigint, v string"), path, keys, 8)
    before = files(path)
    new = [(7, "new"), (7, "newer"), (5000, "first")]
    frame = spark.createDataFrame(new, "k bigint, v string")
    touched = {r[0] for r in frame.select(sinks.bucket_of(keys, 8)).collect()}
    want = sorted([r for r in old if r[0] != 7] + new)
    for _ in range(2):
        sinks.replace_in_table(path, frame, keys, 8)
        assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == want
    after = files(path)
    for name in before:
        bucket = int(name.split(f"{sinks.BUCKET}=")[1].split("/")[0])
        assert (after.get(name) == before[name]) == (bucket not in touched)
    sinks.replace_in_table(path, frame.limit(0), keys, 8)
    assert files(path) == after


def test_upsert_in_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(i, f"o{i}", float(i)) for i in range(50)], "id bigint, owner string, area double"), path, ["id"], 4)
    changes = spark.createDataFrame([(3, None, 9.5), (4, "New", None), (99, "Late", None)], "id bigint, owner string, area double")
    for _ in range(2):
        sinks.upsert_in_table(path, changes, "id", 4, insert=True)
    got = {r.id: (r.owner, r.area) for r in sinks.read_table(spark, path).collect()}
    want = {i: (f"o{i}", float(i)) for i in range(50)} | {3: ("o3", 9.5), 4: ("New", 4.0), 99: ("Late", None)}
    assert got == want


def test_search_for_many_queries_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Asha", "asha devi", "Ravi", None, ""]), f"{rng.randrange(40)}/{rng.randrange(9)}", "Village 1" if i % 3 else "Anand pur")
            for i in range(400)]
    records = spark.createDataFrame(rows, "id bigint, owner_name string, survey_number string, village string")
    asked = ["asha", "SHA D", "1/2", "/", "a", "12", "nothing here", "", "   ", None, "asha", "age 1", "१/२", "%", "_"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    columns = ["owner_name", "survey_number", "village"]
    got = sorted((r["query"], r["id"]) for r in filters.global_search_many(records, queries, True, columns).select("query", "id").collect())
    want = sorted((q, r.id) for q in {q for q in asked if q} for r in filters.global_search(records, q, True, columns).select("id").collect())
    assert got == want and len(want) > 400
    plan = filters.global_search_many(records, queries, True, columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert filters.global_search_many(records, queries.limit(0), True, columns).isEmpty()
    assert filters.global_search_many(records.limit(0), queries, True, columns).isEmpty()


def test_only_asked_registrations_are_aggregated(spark):
    columns = "id bigint, registration_number string, owner_name string, survey_number string, village string, district string"
    rows = [(i, f"REG/{i % 900}", f"o{i}", "1", "v", "d") for i in range(2000)]
    records = spark.createDataFrame(rows, columns).withColumn("is_public", F.col("id") % 2 == 0)
    pending = spark.createDataFrame(rows, columns).withColumns({"status": F.lit("PENDING"), "source": F.lit("s"), "expected_public_date": F.lit("x")})
    asked = spark.createDataFrame([("reg/4",), ("Reg/5",), ("reg/none",), ("reg/4",), (None,)], "registration_number string")
    result = joins.registration_status(asked, records, pending)
    got = sorted((r.asked or "", r.status, r.land_record_id or 0, r.owner_name or "") for r in result.collect())
    assert got == [("", "NOT_FOUND", 0, ""), ("Reg/5", "PENDING", 0, "o5"), ("reg/4", "PUBLISHED", 4, "o4"), ("reg/4", "PUBLISHED", 4, "o4"), ("reg/none", "NOT_FOUND", 0, "")]
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    steps = ["semi join" if "LeftSemi" in line else "aggregate" for line in plan.splitlines() if "LeftSemi" in line or "min_by" in line]
    assert steps == ["aggregate", "semi join"] * 2  # from the result down to the tables


def test_late_and_repeated_registrations(spark, tmp_path):
    """One number a day for 100 days in ten deliveries, each sent twice; the state holds no more than the delay."""
    start = datetime.datetime(2024, 1, 1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kept = []
    for turn in range(10):
        rows = [(f"R{d}", start + datetime.timedelta(days=d)) for d in range(10 * turn, 10 * turn + 10)] * 2
        if turn:
            rows.append((f"LATE{turn}", start + datetime.timedelta(days=10 * turn - 9)))
            rows.append((f"R{10 * turn - 1}", start + datetime.timedelta(days=10 * turn)))
        spark.createDataFrame(rows, "registration_number string, received_at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("registration_number string, received_at timestamp").parquet(source)
        query = (registrations.stream_unique_registrations(stream, "5 days").writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", out).trigger(availableNow=True).start())
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(r.registration_number for r in spark.read.parquet(out).collect())
    assert got == sorted(f"R{d}" for d in range(100))
    assert max(kept) <= 15


def test_fields_are_a_row_for_each_ordinal_and_only_the_read_columns_are_made(spark, tmp_path):
    day = datetime.datetime(1995, 3, 4)
    tables = {
        "orders": ([(i, 1 + i % 2, "FOP"[i % 3], 1.0, day, "1-URGENT") for i in [*range(1, 120), 7, 7]], "o_orderkey bigint, o_custkey bigint, "
                   "o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(1, "Ann", 1, "A"), (2, None, 1, "B")], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(1, "R")], "r_regionkey int, r_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    v = views.Views(spark, str(tmp_path))
    want = [v.lr.where(row["present"]).selectExpr(*[f"{e} as {c}" for c, e in row.items() if c != "present"]) for row in views.FIELD_ROWS]
    both = want[0]
    for other in want[1:]:
        both = both.unionByName(other)
    assert v.fields.columns == both.columns and [f.dataType for f in v.fields.schema] == [f.dataType for f in both.schema]
    assert sorted(map(repr, v.fields.collect())) == sorted(map(repr, both.collect()))
    plan = v.fields.select("field_id", "ordinal")._jdf.queryExecution().optimizedPlan().toString()
    assert " rev" not in plan and "Cents" not in plan
