"""Streams over split event files against their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislewise.operators import gates as G
from aislewise.operators.fusion import consolidate_products
from aislewise.plans import session_queries as Q
from aislewise.plans.stream_queries import gate_rows
from aislewise.plans.views import VIEWS, _K, table, view
from aislewise.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """The events in time order as four files."""
    folder = tmp_path_factory.mktemp("events")
    events = table(spark, SF, "events")
    size = events.agg(F.max("event_id")).first()[0] // 4 + 1
    for k in range(4):  # written one after the other, as a stream reads files by their time
        events.filter(F.floor(F.col("event_id") / size) == k).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, split):
    schema = table(spark, SF, "events").schema
    return J.file_stream(spark, split, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def same(a, b, keys):
    a, b = (d.sort_values(keys).reset_index(drop=True)[sorted(d.columns)] for d in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_gate_stream_equals_batch(spark, split):
    drained = J.drain(J.recalibration_stream(gate_rows(stream(spark, split)), "400 days"))
    batch = G.recalibration_gate(gate_rows(view(spark, SF, "events")), "device", ["at", "event_id"]).drop("at")
    assert drained.select("batch").distinct().count() == 4
    same(drained.drop("batch").toPandas(), batch.toPandas(), ["device", "event_id"])


def clock(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def in_batches(spark, folder, batches, schema):
    """A stream that reads each list of rows as one micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return J.file_stream(spark, str(folder), spark.createDataFrame([], schema).schema)


def test_sessions_are_numbered_over_chunks_and_closed(spark, tmp_path):
    schema = "session long, batch_no int, is_last boolean, ts timestamp, x double, z double"
    first = [(1, k % 3, False, clock(k % 50), float(k), 0.0) for k in range(500)] + [(2, 0, False, clock(1), 1.0, 1.0)]
    second = [(1, 9, True, clock(55), -1.0, 0.0), (3, 0, False, clock(400), 5.0, 5.0)]
    third = [(1, 0, False, clock(410), -7.0, 0.0), (3, 1, False, clock(402), 6.0, 5.0)]
    last = [(4, 0, False, clock(900), 0.0, 0.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = J.drain(J.assemble_session(in_batches(spark, tmp_path / "s", [first, second, third, last], schema), "2 hours"))
        rows = out.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = rows[(rows.session == 1) & rows.frame.notna() & (rows.batch == rows.batch.min())].sort_values("frame")
    wanted = sorted(((b, t, x) for _, b, _, t, x, _ in first[:-1]))
    assert one.frame.tolist() == list(range(500)) and one.x.tolist() == [x for _, _, x in wanted]
    end = rows[(rows.session == 1) & rows.complete]
    assert end.frame.tolist() == [500] and end.x.tolist() == [-1.0]
    silent = rows[rows.timed_out].session.tolist()
    assert silent.count(2) == 1 and set(silent) >= {2, 1, 3} and rows[rows.timed_out].frame.isna().all()
    again = rows[(rows.session == 1) & (rows.x == -7.0)]
    assert again.frame.tolist() == [0]  # a closed session starts anew
    assert sorted(rows[(rows.session == 3) & rows.frame.notna()].frame) == [0, 1]


def test_gate_state_expires(spark, tmp_path):
    schema = "device long, event_id long, at double, kind string, t array<double>, inliers int, tracking string"
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0]
    hour = 3600.0
    batches = [
        [(1, 1, 0.0, "pose", eye, 0, "normal"), (1, 2, 1.0, "vps", eye, 90, "normal")],
        [(2, 3, 500 * hour, "pose", eye, 0, "normal")],
        [(1, 4, 500 * hour + 1, "pose", eye, 0, "normal"), (2, 5, 500 * hour + 2, "pose", eye, 0, "normal")],
    ]
    short = J.drain(J.recalibration_stream(in_batches(spark, tmp_path / "a", batches, schema), "10 hours")).toPandas()
    long = J.drain(J.recalibration_stream(in_batches(spark, tmp_path / "b", batches, schema), "4000 hours")).toPandas()
    payload = [c for c in short.columns if c not in ("device", "event_id", "batch")]
    pick = lambda d, e: d[d.event_id == e][payload].astype(str).values.tolist()
    assert pick(short, 2) == pick(long, 2) and pick(short, 4) != pick(long, 4)
    assert pick(short, 4) == pick(short, 3)  # like a device that never had a fix


def test_latest_rows_die(spark, tmp_path):
    schema = "device long, event_id long, ts timestamp"
    batches = [
        [(1, 1, clock(0)), (1, 3, clock(5)), (2, 2, clock(6))],
        [(1, 4, clock(50)), (2, 1, clock(49))],  # an older row of 2 changes nothing
        [(3, 9, clock(300))],
        [(3, 10, clock(301))],
    ]
    out = J.drain(J.latest_until(in_batches(spark, tmp_path / "l", batches, schema), "device", "event_id", "ts", "60 minutes"), "update")
    final = {r["device"]: r for r in J.last_update(out, ["device"]).collect()}
    assert {k: (r["event_id"], r["alive"]) for k, r in final.items()} == {1: (4, False), 2: (2, False), 3: (10, True)}


def test_latest_and_lifecycle_over_batches(spark, split):
    kinds = Q.lifecycle_events(stream(spark, split))
    got = J.last_update(J.drain(Q.S.lifecycle_state(kinds, "session_id", ["event_id"]), "update"), ["session_id"])
    want = Q.S.lifecycle_state(Q.lifecycle_events(view(spark, SF, "events")), "session_id", ["event_id"])
    same(got.toPandas(), want.toPandas(), ["session_id"])


def test_assembled_frames_have_no_gaps(spark, split):
    uploads = stream(spark, split).select(
        F.col("user_id").alias("session"),
        F.lit(0).alias("batch_no"),
        F.lit(False).alias("is_last"),
        "ts",
        F.col("value").alias("x"),
        F.col("value").alias("z"),
    )
    out = J.drain(J.assemble_session(uploads, "400 days"))
    rows = out.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.max("frame").alias("top"), F.count_distinct("frame").alias("d")
    ).collect()
    assert rows and all(r["n"] == r["d"] == r["top"] + 1 for r in rows)


def test_incremental_consolidation_equals_full(spark, split, tmp_path):
    text = VIEWS["observation"].replace("{k}", _K["spark"])
    cols = ["map_id", "product_id", "ord", "name", "x", "y", "z", "confidence", "score"]
    rows = spark.sql(text, events=stream(spark, split)).select(*cols)
    snapshot = str(tmp_path / "snapshot")
    J.consolidate_stream(rows, str(tmp_path / "log"), snapshot, str(tmp_path / "offsets")).awaitTermination()
    got = spark.read.parquet(snapshot).drop("bucket").toPandas()
    want = consolidate_products(view(spark, SF, "observation").select(*cols), ["map_id", "product_id"]).toPandas()
    same(got, want, ["map_id", "product_id", "cluster"])
