"""Structured Streaming jobs; every one has a batch twin with the same result.

Event time, watermarks and the late-row rule are additions of this library: rows later than
the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aislewise.operators.fusion import consolidate_products
from aislewise.operators.gates import FRESH, GATE_DDL, run_gate
from aislewise.sources.sinks import replace_table, scratch_path


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run everything available now and return all emitted rows with their batch number."""
    spark = stream.sparkSession
    out = scratch_path(spark, "drained")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch bigint").option("basePath", out).parquet(f"{out}/batch=*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def last_update(drained: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode stream."""
    rest = [c for c in drained.columns if c not in (*keys, "batch")]
    return drained.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, "_l.*")


def flag_windows(flags: DataFrame, needed: int = 3, size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Products with at least ``needed`` open reports in a sliding window; batch or stream."""
    return (
        flags.groupBy("product_id", F.window("ts", size, slide).alias("_w"))
        .agg(F.count(F.lit(1)).alias("reports"))
        .filter(F.col("reports") >= needed)
        .select("product_id", F.col("_w.start").alias("window_start"), "reports")
    )


def _whole(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows a key has in a micro-batch, in order.  The trigger's limits bound them, not the stream's length."""
    return pd.concat(list(chunks)).sort_values(order, kind="stable")


def _gone(state: GroupState, seen_ms: int) -> bool:
    """A key whose time is out, though new rows came before Spark told it so."""
    return state.getCurrentWatermarkMs() > seen_ms


def _time_out_after(state: GroupState, last_ms: int) -> None:
    """Time out once the watermark, the latest time less the allowed lateness, has passed ``last_ms``."""
    state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs() + 1))


def assemble_session(batches: DataFrame, late: str = "2 hours") -> DataFrame:
    """Uploads of one scan become one numbered track.

    Stream: session, batch_no, is_last, ts, x, z (one row per frame).  Frames are numbered on across uploads, inside a
    micro-batch by (batch_no, ts, x, z); the row that closes the session carries ``complete``.  The state is a counter
    and a time, so a very long scan does not grow it.  A session that is silent for ``late`` of event time is closed by
    a row of its own without a frame, ``timed_out``, and its state is dropped; its next row opens a new session.
    """
    schema = "session bigint, frame bigint, x double, z double, complete boolean, timed_out boolean"

    def number(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, seen = state.get if state.exists else (0, 0)
        if state.hasTimedOut or (state.exists and _gone(state, seen)):
            closing = {"session": [key[0]], "frame": [None], "x": [None], "z": [None], "complete": [False], "timed_out": [True]}
            yield pd.DataFrame(closing).astype({"frame": "Int64", "x": float, "z": float})
            count, seen = 0, 0
        if state.hasTimedOut:
            state.remove()
            return
        rows = _whole(chunks, ["batch_no", "ts", "x", "z"])
        last = rows["is_last"].to_numpy()
        yield pd.DataFrame(
            {
                "session": key[0],
                "frame": range(count, count + len(rows)),
                "x": rows["x"].to_numpy(),
                "z": rows["z"].to_numpy(),
                "complete": last,
                "timed_out": False,
            }
        )
        if last.any():
            state.remove()
            return
        seen = max(seen, int(rows["_ms"].max()))
        state.update((count + len(rows), seen))
        _time_out_after(state, seen)

    return (
        batches.withColumn("_ms", F.unix_millis("ts"))
        .withWatermark("ts", late)
        .groupBy("session")
        .applyInPandasWithState(number, schema, "count bigint, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def recalibration_stream(rows: DataFrame, idle: str = "7 days") -> DataFrame:
    """Stream twin of the recalibration gate: device, event_id, at (seconds), kind, t, inliers, tracking.

    A device that is silent for ``idle`` of event time starts afresh, as rows later than that are dropped.
    """

    def gate(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        packed, seen = state.get if state.exists and not _gone(state, state.get[1]) else (None, 0)
        data = _whole(chunks, ["at", "event_id"])
        made, now = run_gate(data, json.loads(packed) if packed else FRESH)
        seen = max(seen, int(data["at"].max() * 1000))
        state.update((json.dumps(now), seen))
        _time_out_after(state, seen)
        head = data[["event_id"]].copy()
        head.insert(0, "device", key[0])
        yield pd.concat([head, made], axis=1)

    timed = rows.withColumn("_ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_ts", idle)
    return timed.groupBy("device").applyInPandasWithState(
        gate,
        f"device bigint, event_id bigint, {GATE_DDL}",
        "packed string, seen bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row per key; on a stream use update mode.  One row of state per key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(key, "_l.*")


def latest_until(rows: DataFrame, key: str, order: str, ts: str, ttl: str) -> DataFrame:
    """(key, order, ts, alive) of each key's latest row by ``order``, as a stream in update mode.

    A key whose latest ``ts`` the stream's time has passed by ``ttl`` leaves with a row that is not ``alive``, and its
    state goes with it.  Rows later than ``ttl`` are dropped: they would be dead on arrival.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{ts}` timestamp, alive boolean"

    def keep(name, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            best, seen = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], order: [best], ts: [pd.Timestamp(seen, unit="us", tz="UTC")], "alive": [False]})
            return
        best, seen = state.get if state.exists and not _gone(state, state.get[1] // 1000) else (None, 0)
        for chunk in chunks:
            top = chunk.loc[chunk[order].idxmax()]
            if best is None or top[order] > best:
                best, seen = top[order].item(), int(top["_us"])
        state.update((best, seen))
        _time_out_after(state, seen // 1000)
        yield pd.DataFrame({key: [name[0]], order: [best], ts: [pd.Timestamp(seen, unit="us", tz="UTC")], "alive": [True]})

    timed = rows.select(key, order, ts, F.unix_micros(F.col(ts)).alias("_us")).withWatermark(ts, ttl)
    return timed.groupBy(key).applyInPandasWithState(
        keep, schema, f"best {kinds[order]}, seen bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def append_sightings(sightings: DataFrame, table: str, checkpoint: str, place):
    """Place each micro-batch of label readings with ``place(batch)`` and add the sightings."""

    def write(batch: DataFrame, number: int) -> None:
        # One partition per batch: a repeated batch replaces itself instead of adding rows.
        replace_table(place(batch).withColumn("batch", F.lit(number).cast("long")), table, ("batch",))

    return (
        sightings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def consolidate_stream(
    sightings: DataFrame, log: str, snapshot: str, checkpoint: str, keys: tuple[str, ...] = ("map_id", "product_id")
):
    """Add new sightings to ``log`` and recompute only the partitions of products they touch.

    The snapshot is partitioned by map and a product bucket; a batch reads the log of its own
    buckets and replaces those partitions.
    """
    buckets = 64

    def write(batch: DataFrame, number: int) -> None:
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(keys[1]), F.lit(buckets)).cast("int")).withColumn(
            "batch", F.lit(number).cast("long")
        )
        # The batch number is a partition of the log, so a repeated batch replaces itself.
        whole = replace_table(bucketed, log, (keys[0], "bucket", "batch")).drop("batch")
        touched = bucketed.select(keys[0], "bucket").distinct()
        rows = whole.join(touched, [keys[0], "bucket"], "left_semi")
        merged = consolidate_products(rows, [keys[0], "bucket", keys[1]])
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(keys[0], "bucket").parquet(
            snapshot
        )

    return (
        sightings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
