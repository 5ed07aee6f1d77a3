"""Usage logs: the same aggregates in batch and as Structured Streaming, and a rate limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, lateness: str = "1 day") -> DataFrame:
    """Events of a folder's parquet files as a stream with a watermark."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def daily(events: DataFrame) -> DataFrame:
    day = F.window(F.col("ts").cast("timestamp"), "1 day") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.window("ts", "1 day")
    out = events.groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("v").cast("double").alias("v"))


def sliding_counts(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Each event with how many of its user's fall into the seconds up to it, by an interval RANGE frame."""
    frame = f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
    return events.select("event_id", "user_id", F.expr(frame).alias("recent"))


def admit(accepted: list[int], t: int, seconds: int, limit: int) -> bool:
    """Whether a request at t (microseconds) passes, after the last accepted ones, which are kept up to date in place: no more than limit of them, as older ones can't matter. A limit below 1 is none."""
    if limit < 1:
        return True
    if len(accepted) == limit and accepted[0] >= t - seconds * 1_000_000:
        return False
    accepted.append(t)
    del accepted[:-limit]
    return True


def rate_limited(events: DataFrame, seconds: int = 60, limit: int = 2) -> DataFrame:
    """Each event with whether it is let through: at most ``limit`` accepted ones of a user within seconds, both ends included. Rejected ones don't count.

    Whether a request passes hangs on all before it, so a user's events go through one task in order, with
    ``limit`` times as state; users are spread by key. Null users count as one; events without a time are left out.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ordered = events.where("ts is not null").select("event_id", "user_id", micros.alias("t")).repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, accepted = object(), []
        for batch in batches:
            out = []
            users = batch["user_id"].astype(object).where(batch["user_id"].notna(), None)
            for who, t in zip(users, batch["t"], strict=True):
                if who != user:
                    user, accepted = who, []
                out.append(admit(accepted, t, seconds, limit))
            yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user_id"], "accepted": out})

    return ordered.mapInPandas(stream, "event_id long, user_id long, accepted boolean")


class _Limiter(StatefulProcessor):
    """A user's state: the last accepted times, and the events that wait for the watermark, by millisecond, each with a timer."""

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "t array<long>")
        self.waiting = handle.getMapState("waiting", "ms long", "t array<long>, id array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            for ms, part in pd.DataFrame({"t": micros, "id": batch["event_id"]}).groupby(micros // 1000):
                # a timer fires once the watermark has passed it
                if self.waiting.containsKey((int(ms),)):
                    t, ids = self.waiting.getValue((int(ms),))
                else:
                    t, ids = [], []
                    self.handle.registerTimer(int(ms) + 1)
                self.waiting.updateValue((int(ms),), ([*t, *map(int, part["t"])], [*ids, *map(int, part["id"])]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        t, ids = self.waiting.getValue((ms,))
        self.waiting.removeKey((ms,))
        accepted = list(self.accepted.get()[0]) if self.accepted.exists() else []
        out = [(i, key[0], admit(accepted, at, self.seconds, self.limit)) for at, i in sorted(zip(t, ids, strict=True))]
        self.accepted.update((accepted,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted"])

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, seconds: int = 60, limit: int = 2) -> DataFrame:
    """rate_limited() of a stream with a watermark on ts (read_stream): an event is decided once the watermark has passed it, so that earlier ones may still come in.

    Later events than the watermark allows are left out, as everywhere in streams. Needs Spark's RocksDB state store
    (spark.sql.streaming.stateStore.providerClass); state survives a restart with the query's checkpoint.
    """
    rows = events.where("ts is not null and user_id is not null").select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_Limiter(seconds, limit), outputStructType="event_id long, user_id long, accepted boolean", outputMode="append", timeMode="eventTime")


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(user_id, session, started, ended, n): a new session after a pause longer than minutes; lag and a running sum."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {minutes} MINUTES")
    marked = events.withColumn("new", F.coalesce(pause.cast("int"), F.lit(0))).withColumn("session", F.sum("new").over(order))
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def log_summary(events: DataFrame, keep: int = 2000, show: int = 20) -> DataFrame:
    """The last ``show`` of the last ``keep`` events: a top-k, not a sort of all."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(keep, show)).select("event_id", "user_id", "event_type")
