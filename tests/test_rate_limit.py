"""The rate limiter as a stream: equal to the batch plan and to a plain loop, out of order, with a hot user, late events and a restart."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.streaming import usage

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 1, 1)


def plain(rows, seconds, limit):
    out, hits = {}, defaultdict(list)
    for event, user, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [x for x in hits[user] if x >= t - dt.timedelta(seconds=seconds)]
        out[event] = limit < 1 or len(own) < limit
        hits[user] = [*own, t] if out[event] else own
    return out


def events(spark, rows):
    return spark.createDataFrame([(e, t, u, "x", 1.0, "") for e, u, t in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def made(n, seed):
    r = random.Random(seed)
    return [(i, 1 if r.random() < 0.5 else r.randrange(2, 9), START + dt.timedelta(seconds=r.randrange(0, 1200), microseconds=r.choice((0, 0, 7, 500_000)))) for i in range(n)]


def test_batch_is_the_plain_loop(spark):
    rows = [*made(400, 1), (1000, 50, START), (1001, 50, START + dt.timedelta(seconds=60)), (1002, 50, START + dt.timedelta(seconds=60, microseconds=1)), (1003, None, START), (1004, None, START)]
    for seconds, limit in ((60, 1), (60, 3), (30, 0)):
        got = {r["event_id"]: r["accepted"] for r in usage.rate_limited(events(spark, rows), seconds, limit).collect()}
        assert got == plain(rows, seconds, limit)


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(made(300, 2), key=lambda r: r[2])
        folder, r = tmp_path / "in", random.Random(3)
        parts = [rows[:120], rows[120:260], rows[260:]]
        for part in parts:
            r.shuffle(part)  # within a file, events come in any order
        late = (5000, 1, START - dt.timedelta(days=9))
        closing = (6000, 99, START + dt.timedelta(days=40))
        for i, part in enumerate([parts[0], [*parts[1], late], [*parts[2]], [closing], [(6001, 99, START + dt.timedelta(days=41))]]):
            events(spark, part).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(folder / f"b{i}" / "events.parquet"))
            source = stream_of(spark, folder)
            query = usage.rate_limited_stream(source, 60, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)  # each file is a query of its own, which goes on from the last one's checkpoint
            assert query.exception() is None
        got = {x["event_id"]: x["accepted"] for x in spark.read.parquet(str(tmp_path / "out")).collect()}
        got = {k: v for k, v in got.items() if k < 5000}
        assert got == plain(rows, 60, 2)
    finally:
        spark.conf.set(PROVIDER, before)


def stream_of(spark, folder):
    rows = spark.readStream.schema(usage.EVENTS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
