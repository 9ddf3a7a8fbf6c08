"""Streaming jobs: incremental refresh, windowed KPIs, rate limit and audit counts.

Late rows are dropped one hour behind the newest event. Every job takes its
checkpoint folder from the caller, who keeps it on shared storage.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, StructType

WATERMARK = "1 hour"


def stream_table(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                 files_per_trigger: int | None = 100) -> DataFrame:
    """Parquet files of a folder as they arrive; without a number per trigger, all that are there make one batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def incremental_refresh(source: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append what is new in the source to a table folder, one folder per batch.

    A batch that runs again overwrites its own folder, so nothing is stored twice.
    ``every`` polls at that pace; without it the job takes all there is and stops.
    """
    def persist(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = source.writeStream.foreachBatch(persist).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def window_kpis(events: DataFrame, time: str = "ts", window: str = "1 day", key: str = "event_type", value: str = "value") -> DataFrame:
    """Events and totals per tumbling window and key; for batch and stream alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, WATERMARK)
    amount = F.col(value).cast("decimal(18,4)")
    return rows.groupBy(F.window(time, window), key).agg(
        F.count(F.lit(1)).alias("eventos"), F.sum(amount).alias("total")
    ).select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fim"), key, "eventos",
             F.col("total").cast("double").alias("total"))


def rolling_kpis(events: DataFrame, time: str = "ts", size: str = "7 days", slide: str = "1 day", key: str = "event_type", value: str = "value", who: str = "user_id") -> DataFrame:
    """Events, totals and about how many different `who` per rolling window and key; for batch and stream alike.

    Events are first summed by pane, a tumbling window of one slide, so each event is read into one sum;
    rolling windows then share the sums and sketches of their panes. On a stream, panes and windows
    leave the state once the watermark is past their end, and every window comes out once (``append``).
    Events without a time belong to no window.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, WATERMARK)
    panes = rows.where(F.col(time).isNotNull()).groupBy(F.window(time, slide).alias("pane"), key).agg(
        F.count(F.lit(1)).alias("eventos"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"), F.hll_sketch_agg(who).alias("quem"))
    shared = panes.groupBy(F.window(F.window_time("pane"), size, slide).alias("janela"), key).agg(
        F.sum("eventos").alias("eventos"), F.sum("total").cast("double").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("quem")).alias("pessoas"))
    return shared.select(F.col("janela.start").alias("inicio"), F.col("janela.end").alias("fim"), key, "eventos", "total", "pessoas")


def write_stream(frame: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming frame over all available input into a Parquet folder."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        return writer.foreachBatch(replace).start()
    return writer.format("parquet").option("path", target).start()


def audit_counts(lines: DataFrame) -> DataFrame:
    """Allowed and denied accesses per user, from parsed audit lines."""
    return lines.groupBy("usuario").agg(
        F.count_if(F.col("permitido")).alias("permitidos"), F.count_if(~F.col("permitido")).alias("negados"))


@contextlib.contextmanager
def keyed_state(spark: SparkSession, more: bool = False) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state by key and slice needs.

    With ``more`` the stream goes on from its checkpoint later: what falls due then waits for the next batch of rows.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if more:
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


class _Limiter(StatefulProcessor):
    """Windows of one group of keys. Events wait by slice of event time; a timer decides a slice once the watermark is past its end.

    State is read and written by slice of a group: calls to it grow with groups and slices, not with keys.
    """

    def __init__(self, id_type: DataType, window: int, length: int, limit: int):
        self.id_type, self.window, self.length, self.limit = id_type, window, length, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = pa.schema([("chave", pa.string()), ("id", to_arrow_type(self.id_type)), ("t", pa.int64())])
        # The windows that are open at the end of the slices decided so far, by key, and the number of the next part.
        self.open = handle.getValueState("aberta", "janelas binary")
        self.parts = handle.getValueState("partes", "n bigint")
        # A batch adds parts; what waits already is neither read nor written again.
        self.waiting = handle.getMapState("espera", "fatia bigint, parte bigint", "eventos binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = self.parts.get()[0] if self.parts.exists() else 0
        due = set()
        for frame in rows:
            for number, slice_ in frame.groupby(frame["t"] // self.length):
                events = pa.Table.from_pandas(slice_[self.rows.names], self.rows, preserve_index=False)
                self.waiting.updateValue((int(number), part), (_packed(events),))
                due.add(int(number))
                part += 1
        self.parts.update((part,))
        for number in due:
            self.handle.registerTimer((number + 1) * self.length // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.length - 1
        held = list(self.waiting.keys())
        parts = [p for p in held if p[0] == number]
        opened = {}
        if self.open.exists():
            windows = _unpacked(bytes(self.open.get()[0]))
            opened = {k: (at, seen) for k, at, seen in zip(*(windows[c].to_pylist() for c in ("chave", "aberta", "vistos")))}
        if parts:
            events = pa.concat_tables([_unpacked(bytes(self.waiting.getValue(p)[0])) for p in parts])
            events = events.sort_by([("t", "ascending"), ("id", "ascending")])
            starts, order = [], []
            for k, moment in zip(events["chave"].to_pylist(), events["t"].to_pylist()):
                at, seen = opened.get(k, (None, 0))
                if at is None or moment - at > self.window:
                    at, seen = moment, 0
                opened[k] = (at, seen + 1)
                starts.append(at)
                order.append(seen + 1)
            for p in parts:
                self.waiting.removeKey(p)
            decided = events.to_pandas()
            yield decided.assign(aberta=starts, ordem=order, accepted=[n <= self.limit for n in order])
        # A window that ends before the next slice is forgotten; a timer looks again where others are left.
        end = (number + 1) * self.length
        left = {k: w for k, w in opened.items() if w[0] + self.window >= end}
        if left:
            windows = pa.table({"chave": pa.array(left, pa.string()), "aberta": [w[0] for w in left.values()], "vistos": [w[1] for w in left.values()]})
            self.open.update((_packed(windows),))
            last = max(w[0] for w in left.values()) + self.window
            self.handle.registerTimer((last // self.length + 1) * self.length // 1000)
        else:
            self.open.clear()
            if len(parts) == len(held):
                self.parts.clear()

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str, time: str, event_id: str, limit: int = 100, window: int = 60,
                      late: str = WATERMARK, slice_seconds: int | None = None, groups: int = 1024) -> DataFrame:
    """Fixed-window rate limit over a stream, decided in event-time order whatever the batches.

    Events wait by slice of event time (an hour or ten windows, whichever is longer, unless given). A
    timer decides a slice once the watermark, ``late`` behind the newest event, is past its end: no
    earlier event can come then, and the windows open at the end of the slice before are handed on. Keys
    are dealt into ``groups`` by their hash; a task holds one slice of one group, and the state holds what
    came since the watermark. Events without a time are left out, events behind the watermark are dropped.
    Start it inside `keyed_state`.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    length = (slice_seconds or max(3600, 10 * window)) * 1_000_000
    rows = events.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("grupo"), F.col(key).cast("string").alias("chave"), F.col(event_id).alias("id"),
        F.col(time).cast("timestamp").alias("momento")).where("momento IS NOT NULL").withWatermark("momento", late)
    decided = rows.withColumn("t", F.unix_micros("momento")).groupBy("grupo").transformWithStateInPandas(
        statefulProcessor=_Limiter(events.schema[event_id].dataType, window * 1_000_000, length, limit),
        outputStructType=f"chave string, id {kinds[event_id]}, t bigint, aberta bigint, ordem bigint, accepted boolean",
        outputMode="Append", timeMode="EventTime")
    return decided.select(
        F.col("chave").cast(kinds[key]).alias(key), F.col("id").alias(event_id), F.timestamp_micros("t").alias(time), F.timestamp_micros("aberta").alias("window_start"),
        F.col("ordem").alias("position"), "accepted")
