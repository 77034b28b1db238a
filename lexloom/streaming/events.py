"""Event logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lexloom.sources.wordlists import parsed_line


def stream_event_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events (``node_id, kind, ts``) of each node and kind in tumbling windows: ``window_start, node_id, kind, n``.

    On a stream in append mode a window comes out once the watermark, ``delay`` behind the latest event, has
    passed its end; later events of it are left out. Rows with a null ``ts`` belong to no window.
    """
    timed = events.where("ts is not null").withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window), "node_id", "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "node_id", "kind", "n")


def read_events(spark, sf_dir: str) -> DataFrame:
    """The stream of the ``events`` table: one micro-batch for the files that are there."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A stream reads a folder: the table is a file in it, or a folder of files.
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("node_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run ``stream`` over all that is there now, into a Parquet table in ``folder``, and read it back."""
    out = f"{folder}/out"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_whole(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an aggregated ``stream`` over all that is there now, and give its last row of each key.

    Windows that the watermark has not closed yet are part of it, so that the counts of a finished input are
    whole. Each micro-batch writes what it changed to a folder of its own, so that a repeated one overwrites itself.
    """
    out = f"{folder}/batches"

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/number={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(f"{', '.join(f'{n} {t}' for n, t in stream.dtypes)}, number long").parquet(out)
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("number", *others)).alias("_l")).select(*[c if c in keys else F.col(f"_l.{c}").alias(c) for c in stream.columns])


def stream_json_lines(spark: SparkSession, path: str, schema: str, folder: str, files_a_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Take in the JSON lines of all files that ``path`` holds now and that were not taken in before into ``folder``.

    Returns the records of the schema, and the lines that are none with their ``source_file``, of this and all former
    calls. Each micro-batch writes its own folder, so one that is repeated after a failure overwrites itself; files that come
    later are taken in by the next call.
    """
    options = {"recursiveFileLookup": True} | ({"maxFilesPerTrigger": files_a_batch} if files_a_batch else {})
    lines = spark.readStream.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.trim("value") != "")
    lines = lines.select(parsed_line(F.col("value"), schema).alias("e"), "value", "source_file")
    good, bad = f"{folder}/good", f"{folder}/bad"

    def write(batch: DataFrame, number: int) -> None:
        # The lines are parsed once for both tables.
        both = batch.persist(StorageLevel.DISK_ONLY)
        both.where("e is not null").select("e.*").write.mode("overwrite").parquet(f"{good}/number={number}")
        both.where("e is null").select("source_file", "value").write.mode("overwrite").parquet(f"{bad}/number={number}")
        both.unpersist()

    lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.schema(f"{fields}, number long").parquet(out).drop("number") for fields, out in ((schema, good), ("source_file string, value string", bad)))


# The calls of a micro-batch are one entry; its arrays hold an element a call.
CALLS = "event_id array<long>, us array<long>, tool array<string>, code array<string>, rejected array<boolean>"
WINDOW = "signatures array<string>, protocol array<boolean>, corrected array<string>, saturated boolean, last_ms long"
INTERVENTIONS = "session_id long, event_id long, occurrences int, failures int, reason string, action string"


class FailureWindows(StatefulProcessor):
    """The calls of a session, held until the watermark has passed them, then taken in the order of ``ts, event_id``.

    Two states: calls that wait, and the window with what was corrected. One timer: the first call that waits, or else the
    end of the session's idle time, at which its state goes.
    """

    def __init__(self, width: int, least: int, most: int, exploratory: tuple[str, ...], idle_ms: int):
        self.width, self.least, self.most, self.exploratory, self.idle_ms = width, least, most, exploratory, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", CALLS)
        self.window = handle.getValueState("window", WINDOW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        us = new.ts.astype("datetime64[us]").astype("int64")
        self.waiting.appendValue((new.event_id.tolist(), us.tolist(), new.tool.tolist(), new.code.tolist(), [bool(r) for r in new.rejected]))
        self._wake(int(us.min()) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        calls = [call for entry in self.waiting.get() for call in zip(*entry, strict=True)]
        due = [c for c in calls if c[1] // 1000 < now]
        rest = [c for c in calls if c[1] // 1000 >= now]
        signatures, protocol, corrected, saturated, last = self.window.get() or ([], [], [], False, 0)
        signatures, protocol, corrected = list(signatures), list(protocol), list(corrected)
        rows = []
        for event, us, tool, code, rejected in sorted(due, key=lambda c: (c[1], c[0])):
            last = max(last, us // 1000)
            own = f"{tool}|{code}" if rejected else ""
            signatures = [*signatures, own][-self.width :]
            protocol = [*protocol, rejected and code not in self.exploratory][-self.width :]
            n, failures = signatures.count(own), sum(protocol)
            if own and n >= self.least:
                rows.append((key[0], event, n, failures, "repeated", "stall" if own in corrected else "correct"))
                corrected = corrected if own in corrected else [*corrected, own]
            elif own and failures >= self.most:
                rows.append((key[0], event, n, failures, "window", "stall" if saturated else "correct"))
                saturated = True
        if rest:
            self.waiting.put([tuple(map(list, zip(*rest, strict=True)))])
        else:
            self.waiting.clear()
        if not rest and last + self.idle_ms < now:
            self.window.clear()
        else:
            self.window.update((signatures, protocol, corrected, saturated, last))
            self._wake(min(c[1] for c in rest) // 1000 if rest else last + self.idle_ms)
        yield pd.DataFrame(rows, columns=["session_id", "event_id", "occurrences", "failures", "reason", "action"])

    def _wake(self, at: int) -> None:
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)


def stream_failure_windows(calls: DataFrame, width: int = 12, least: int = 2, most: int = 6, exploratory: tuple[str, ...] = (), delay: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """Interventions of a stream of calls (``session_id, event_id, ts, tool, code, rejected``), from state kept by session.

    A rejected call is met when its own (tool, code) occurs ``least`` times among the last ``width`` calls
    (``repeated``), or else when ``most`` of these calls broke the protocol (``window``; codes in ``exploratory`` do not):
    with ``correct`` the first time, for that signature or for the window, and with ``stall`` later. Calls wait until the
    watermark, ``delay`` behind the latest call, has passed them, and are taken in the order of ``ts, event_id``, however
    they came; later ones are left out. A session without calls for ``idle`` is forgotten. Rows without ``ts`` are left out.
    """
    spark = calls.sparkSession
    # Lists and timers need this store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = calls.where("ts is not null").withWatermark("ts", delay).groupBy("session_id")
    processor = FailureWindows(width, least, most, exploratory, idle_ms)
    return timed.transformWithStateInPandas(processor, StructType.fromDDL(INTERVENTIONS), "Append", "EventTime")


def read_calls(spark, sf_dir: str) -> DataFrame:
    """The stream of tool calls of the ``events`` table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    code = F.concat(F.lit("schema:f"), (F.get_json_object("props", "$.k").cast("long") % 4).cast("string"))
    return raw.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), code.alias("code"), (F.col("event_type") == "error").alias("rejected"))
