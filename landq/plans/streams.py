"""Stream operators run to the end of the given tables; the result is what the stream left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq import schemas
from landq.plans.reports import TELEMETRY_SQL
from landq.plans.suite import Suite
from landq.plans.workflow import DONE, MIXED
from landq.session import shared_folder
from landq.streaming import registrations, review

suite = Suite()
q = suite.query


def work_folder(spark) -> str:
    """A new folder of this run that driver and executors share."""
    return shared_folder(spark, "landq-stream")


def run(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def append(df: DataFrame, folder: str, name: str) -> DataFrame:
    run(df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-checkpoint")
        .option("path", f"{folder}/{name}"))
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _incoming(v, folder: str) -> DataFrame:
    v.reg.write.parquet(f"{folder}/incoming")
    return registrations.read_registrations(v.spark, f"{folder}/incoming")


@q("ST01_stream_registrations", """select r.id, r.registration_number, coalesce(abs(cadastral_area - land_area) > 0.01, false) as has_mismatch,
   case when abs(cadastral_area - land_area) > 0.01 then concat('Area mismatch detected: Incoming Registered Deed specifies ', cast(land_area as varchar),
     ' Acres, while official Cadastral Ground Truth records ', cast(cadastral_area as varchar), ' Acres.') end as mismatch_details
   from reg r left join cad on cad.survey_number = r.survey_number""", "reg", "cad")
def _(v):
    folder = work_folder(v.spark)
    return append(registrations.stream_registrations(_incoming(v, folder), v.cad), folder, "checked").select(
        "id", "registration_number", "has_mismatch", "mismatch_details")


#: Three deliveries of registrations, by day of receipt: the first of all numbers, then copies of them in time, late, or after the
#: watermark has passed the first one, and numbers that are only ever seen late.
DELIVERIES = ["""select id, registration_number, 0 as delivery, cast(substr(registration_number, 5) as int) % 40 as day from reg""",
              """select id, registration_number, 1, case (id div 4) % 3 when 0 then 30 when 1 then 35 else 45 end from reg""",
              """select id, concat(registration_number, '-L'), 1, 20 + cast(substr(registration_number, 5) as int) % 13 from reg""",
              """select id, registration_number, 2, case (id div 4) % 2 when 0 then 38 else 50 end from reg"""]
RECEIVED = "timestamp '2024-01-01' + day * interval 1 day"
DELAY_DAYS = 7
WATERMARK = f"(select max(day) - {DELAY_DAYS} from incoming where delivery < %s)"


@q("ST02_stream_unique_registrations", f"""with incoming as ({' union all '.join(DELIVERIES).replace(' div ', ' // ')}),
   first0 as (select registration_number, min(day) as day from incoming where delivery = 0 group by 1),
   first1 as (select registration_number, min(i.day) as day from incoming i where delivery = 1 and i.day > {WATERMARK % 1}
     and not exists (select 1 from first0 f where f.registration_number = i.registration_number and f.day + {DELAY_DAYS} > {WATERMARK % 1}) group by 1),
   first2 as (select registration_number, min(i.day) as day from incoming i where delivery = 2 and i.day > {WATERMARK % 2}
     and not exists (select 1 from first1 f where f.registration_number = i.registration_number and f.day + {DELAY_DAYS} > {WATERMARK % 2})
     and not exists (select 1 from first0 f where f.registration_number = i.registration_number and f.day + {DELAY_DAYS} > {WATERMARK % 2}) group by 1)
   select registration_number, 0 as delivery from first0 union all select registration_number, 1 from first1
   union all select registration_number, 2 from first2""", "reg")
def _(v):
    """Three deliveries in turn, each after a restart from the checkpoint, so the watermark of one judges the rows of the next."""
    folder = work_folder(v.spark)
    incoming = v.spark.sql(" union all ".join(DELIVERIES).replace("from reg", "from {reg}"), reg=v.reg).withColumn("received_at", F.expr(RECEIVED)).drop("day")
    incoming.write.partitionBy("delivery").parquet(f"{folder}/all")
    for turn in range(3):
        part = v.spark.read.parquet(f"{folder}/all").where(F.col("delivery") == turn)
        part.write.mode("append").parquet(f"{folder}/incoming")
        stream = v.spark.readStream.schema(part.schema).parquet(f"{folder}/incoming")
        out = append(registrations.stream_unique_registrations(stream, f"{DELAY_DAYS} days"), folder, "unique")
    return out.select("registration_number", "delivery")


@q("ST03_stream_apply_actions", f"""with d as ({DONE.replace(MIXED, 'action')}) select l.id, coalesce(new_status, l.status) as status, coalesce(new_is_public, l.is_public) as is_public,
   case when synced then coalesce(cadastral_area, land_area) else land_area end as land_area from lr l left join d on d.record_id = l.id left join cad on cad.survey_number = l.survey_number""",
   "lr", "cad", "actions")
def _(v):
    folder = work_folder(v.spark)
    v.actions.write.parquet(f"{folder}/actions")
    stream = review.read_events(v.spark, f"{folder}/actions")
    run(review.stream_apply_actions(stream, f"{folder}/last", f"{folder}/checkpoint"))
    return review.records_after(f"{folder}/last", v.lr, v.cad).select("id", "status", "is_public", "land_area")


@q("ST04_stream_language_telemetry", TELEMETRY_SQL.replace("end as accuracy", "end / 100.0::double as accuracy"), "verifications")
def _(v):
    """Three deliveries in turn, each after a restart; events come up to 16 hours late."""
    folder = work_folder(v.spark)
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 3 * 8 * 3600
    low, high = v.verifications.agg(F.min(arrival), F.max(arrival)).first()
    delivery = F.least(F.lit(2), F.floor((arrival - low) * 3 / ((high or 0) - (low or 0) + 1)))
    v.verifications.withColumns({"delivery": delivery, "ts": F.col("ts").cast("timestamp")}).write.partitionBy("delivery").parquet(f"{folder}/all")
    for turn in range(3):
        part = v.spark.read.schema(schemas.VERIFICATION).option("basePath", f"{folder}/all").parquet(f"{folder}/all").where(F.col("delivery") == turn)
        part.drop("delivery").write.mode("append").parquet(f"{folder}/events")
        run(review.stream_language_telemetry(review.read_events(v.spark, f"{folder}/events", schemas.VERIFICATION), f"{folder}/state",
                                             f"{folder}/checkpoint", "1 day"))
    return review.telemetry_after(v.spark, f"{folder}/state").drop("pending").withColumn("accuracy", F.col("accuracy") / 100)
