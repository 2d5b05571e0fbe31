"""Review events as a stream: each micro-batch writes its own part of a table, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from landq import dims, schemas
from landq.operators.telemetry import HIGH, LOW, known_language, start_state
from landq.operators.workflow import apply_actions, known_actions


def read_events(spark: SparkSession, folder: str, schema=schemas.ACTION, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


LAST = "record_id bigint, action string, last struct<ts: timestamp, event_id: bigint>"


def stream_apply_actions(stream: DataFrame, folder: str, checkpoint: str):
    """Keep the last of each kind of action per record in keyed state, and append what a batch changed to `folder`.

    An action's effect depends on its kind alone, so these settle a record whatever the batches and their order. A batch
    that runs again overwrites its own part. Gives the query writer; `records_after` reads the outcome.
    """
    last = known_actions(stream).groupBy("record_id", "action").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    stream.sparkSession.createDataFrame([], LAST).write.mode("overwrite").parquet(f"{folder}/batch=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return last.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def records_after(folder: str, records: DataFrame, parcels: DataFrame) -> DataFrame:
    """`records` after the actions that `stream_apply_actions` has kept in `folder`."""
    kept = records.sparkSession.read.schema(LAST).parquet(f"{folder}/batch=*")
    return apply_actions(records, kept.select("record_id", "action", "last.ts", "last.event_id"), parcels)


#: What a language's state holds and what it gives out.
TELEMETRY = "code string, accuracy bigint, processed bigint, corrections bigint, pending bigint"


#: Verifications that wait are kept by the hour, in microseconds, and rows of a batch are put there this many at a time.
HOUR, HELD = 3_600_000_000, 200_000


class LanguageFold(StatefulProcessor):
    """The telemetry of one language in event time: verifications below the watermark are folded into one triple, those above
    it are kept by time and id, since one that arrives later may still come before them.

    An hour's verifications are one value of the state, sorted, so state is read and written once an hour and not for each row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "accuracy bigint, processed bigint, corrections bigint")
        self.pending = handle.getMapState(
            "pending", "hour bigint", "waiting array<struct<micros: bigint, event_id: bigint, corrections: bigint, copies: bigint>>")
        self.handle = handle

    def _start(self, code: str) -> tuple[int, int, int]:
        return tuple(self.settled.get()) if self.settled.exists() else ({c: a for c, _, a in dims.LANGUAGE_ACCURACY}[code], 0, 0)

    def _hours(self) -> list[int]:
        return sorted(k[0] for k in self.pending.keys())

    def _waiting(self, hour: int) -> list[tuple]:
        return [tuple(w) for w in self.pending.getValue((hour,))[0]]

    def _keep(self, fresh: dict[int, dict]) -> None:
        for hour, found in fresh.items():
            known = {w[:2]: w[2:] for w in self._waiting(hour)} if self.pending.containsKey((hour,)) else {}
            for at, (c, copies) in found.items():
                known[at] = (c, known.get(at, (c, 0))[1] + copies)
            self.pending.updateValue((hour,), ([(*at, *known[at]) for at in sorted(known)],))

    @staticmethod
    def _fold(state: tuple[int, int, int], waiting: list[tuple]) -> tuple[int, int, int]:
        accuracy, processed, corrections = state
        for _, _, c, copies in waiting:
            for _ in range(copies):
                processed, corrections = processed + 1, corrections + c
                accuracy = max(LOW, min(HIGH, accuracy + 5 * processed - 2 * corrections))
        return accuracy, processed, corrections

    def _report(self, code: str) -> Row:
        state, n = self._start(code), 0
        for hour in self._hours():
            waiting = self._waiting(hour)
            state, n = self._fold(state, waiting), n + len(waiting)
        return Row(code=code, accuracy=state[0], processed=state[1], corrections=state[2], pending=n)

    def handleInputRows(self, key, rows, timerValues):
        fresh, n = {}, 0
        for r in rows:
            hour, at = fresh.setdefault(r.micros // HOUR, {}), (r.micros, r.event_id)
            hour[at] = (r.c, hour.get(at, (0, 0))[1] + 1)
            n += 1
            if n % HELD == 0:
                self._keep(fresh)
                fresh = {}
        self._keep(fresh)
        hours = self._hours()
        if hours and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(self._waiting(hours[0])[0][0] // 1000 + 1)
        yield self._report(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        state, first = self._start(key[0]), None
        for hour in self._hours():
            if hour * HOUR >= mark and first is not None:
                break
            waiting = self._waiting(hour)
            past = [w for w in waiting if w[0] < mark]
            state = self._fold(state, past)
            if len(past) == len(waiting):
                self.pending.removeKey((hour,))
            else:
                first = waiting[len(past)][0] if first is None else first
                if past:
                    self.pending.updateValue((hour,), (waiting[len(past):],))
        self.settled.update(state)
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._report(key[0])

    def close(self) -> None:
        pass


def stream_language_telemetry(stream: DataFrame, folder: str, checkpoint: str, delay: str = "30 days"):
    """Language accuracy in the order of event time, whatever the order of files and batches.

    A verification may arrive up to `delay` after the newest one; what is later is left out, as a watermark does. State is keyed
    by language and lies in RocksDB: one triple for all that is settled, and the verifications of the last `delay`, so it
    doesn't grow with the log. Rows with equal time and id must be equal. Every batch writes the languages it changed to its
    own part of `folder`, so a batch that runs again changes nothing. Gives the query writer; `telemetry_after` reads the outcome.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([], TELEMETRY).write.mode("overwrite").parquet(f"{folder}/batch=-1")
    events = stream.select(known_language().alias("code"), "ts", F.unix_micros("ts").alias("micros"), "event_id",
                           F.coalesce("corrections", F.lit(0)).cast("bigint").alias("c"))
    states = events.withWatermark("ts", delay).groupBy("code").transformWithState(
        LanguageFold(), outputStructType=TELEMETRY, outputMode="Update", timeMode="EventTime")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return states.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def telemetry_after(spark: SparkSession, folder: str) -> DataFrame:
    """The languages' state after the newest batch of `stream_language_telemetry`; a language without events is as at the start.

    Columns: code, language, accuracy (hundredths), processed, corrections, pending (verifications not yet settled).
    """
    kept = spark.read.schema(f"{TELEMETRY}, batch bigint").parquet(folder)
    order = F.struct("batch", "processed", -F.col("pending"))
    last = kept.groupBy("code").agg(F.max_by(F.struct("accuracy", "processed", "corrections", "pending"), order).alias("s"))
    start = start_state(spark).select("code", "language", F.col("accuracy").alias("start"))
    return start.join(last, "code", "left").select(
        "code", "language", F.coalesce("s.accuracy", "start").alias("accuracy"),
        *[F.coalesce(f"s.{c}", F.lit(0)).alias(c) for c in ("processed", "corrections", "pending")])
