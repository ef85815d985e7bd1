"""Camera tracks: lengths, loop closure, sampling, nearest frames, dead reckoning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.numeric import planar
from aislewise.operators.ordered import ROWS_PER_SLICE, Sequence


def path_length(track: DataFrame, key: str = "session", order: str = "frame", rows_per_slice: int = ROWS_PER_SLICE):
    """Running planar distance along each track, 0 on its first row (column ``path``)."""
    seq = Sequence(track, [key], [order], rows_per_slice)
    seq.lag(_px=F.col("x"), _pz=F.col("z"))
    step = F.coalesce(planar(F.col("x") - F.col("_px"), F.col("z") - F.col("_pz")), F.lit(0.0))
    return seq.running_sum(path=step).df.drop("_px", "_pz")


def _ends(track: DataFrame, key: str, order: str) -> DataFrame:
    return track.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("x", "z"), order).alias("first"),
        F.max_by(F.struct("x", "z"), order).alias("last"),
    )


def detect_loop_closure(
    track: DataFrame, key: str = "session", order: str = "frame", threshold: float = 1.5, min_rows: int = 10
) -> DataFrame:
    """Tracks that end where they began: drift components and size."""
    drift = _ends(track, key, order).select(
        key,
        "n",
        (F.col("last.x") - F.col("first.x")).alias("drift_x"),
        (F.col("last.z") - F.col("first.z")).alias("drift_z"),
    )
    return drift.withColumn("drift", planar(F.col("drift_x"), F.col("drift_z"))).filter(
        (F.col("n") >= min_rows) & (F.col("drift") <= threshold)
    )


def correct_loop_closure(
    track: DataFrame, key: str = "session", order: str = "frame", threshold: float = 1.5, min_length: float = 0.1
) -> DataFrame:
    """Spread the end drift over the track with a smoothstep of the travelled share."""
    lengths = path_length(track, key, order)
    totals = lengths.groupBy(key).agg(F.max("path").alias("_total"))
    closure = detect_loop_closure(track, key, order, threshold).select(key, "drift_x", "drift_z")
    plan = closure.join(totals, key).filter(F.col("_total") >= min_length)
    t = F.col("path") / F.col("_total")
    s = t * t * (F.lit(3) - F.lit(2) * t)
    joined = lengths.join(plan, key, "left")
    return (
        joined.withColumn("corrected", F.col("_total").isNotNull())
        .withColumn("x", F.when(F.col("corrected"), F.col("x") - F.col("drift_x") * s).otherwise(F.col("x")))
        .withColumn("z", F.when(F.col("corrected"), F.col("z") - F.col("drift_z") * s).otherwise(F.col("z")))
        .drop("_total", "drift_x", "drift_z")
    )


def drift_from_start(track: DataFrame, key: str, order: str, minutes: float = 5.0, metres: float = 3.0) -> DataFrame:
    """Distance from the first row, and whether to remind the user to walk back."""
    start = track.groupBy(key).agg(
        F.min_by(F.struct("x", "z"), order).alias("_at"), F.min_by("ts", order).alias("_began")
    )
    rows = track.join(start, key)
    distance = planar(F.col("x") - F.col("_at.x"), F.col("z") - F.col("_at.z"))
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_began").cast("timestamp"))
    return (
        rows.withColumn("from_start", distance)
        .withColumn("remind", (elapsed > minutes * 60e6) & (distance > metres))
        .drop("_at", "_began")
    )


def stride_sample(
    track: DataFrame, key: str, order: str, stride: int | None = None, target: int | None = None, keep_ends: bool = False
) -> DataFrame:
    """Every n-th row in order; with ``target`` n = max(1, rows // target) and at most
    ``target`` picks.  ``keep_ends`` always keeps the first and the last row."""
    seq = Sequence(track, [key], [order]).index("_i")
    rows = seq.df
    if target is not None or keep_ends:
        rows = rows.join(track.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    step = F.lit(stride) if stride else F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    pick = (F.col("_i") - 1) % step == 0
    if target is not None:
        pick = pick & (F.floor((F.col("_i") - 1) / step) < target)
    if keep_ends:
        pick = pick | (F.col("_i") == 1) | (F.col("_i") == F.col("_n"))
    return rows.filter(pick).drop("_i", "_n")


BUCKET_DIGITS = 4  # hex digits: 65,536 buckets of a hash per key


def downsample(points: DataFrame, key: str, point: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` points per key, the first in the order of a seeded hash, then of ``point``.

    A count of hash buckets per key finds the bucket in which the last point lies: all buckets before it stay whole,
    and only the rows of that one are put in order.  So any ``most`` costs one pass, whatever a key holds.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(point).cast("string")).cast("binary"))
    rows = points.withColumn("_h", digest).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    counts = rows.groupBy(F.col(key).alias("_key"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_bucket"))
    edge = counts.withColumn("_upto", upto).filter((F.col("_upto") >= most) & (F.col("_upto") - F.col("_n") < most))
    edge = edge.select("_key", F.col("_bucket").alias("_edge"), (most - F.col("_upto") + F.col("_n")).alias("_left"))
    met = rows.join(edge, F.col(key).eqNullSafe(F.col("_key")), "left")
    whole = met.filter(F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    order = Window.partitionBy(key).orderBy("_h", point)
    cut = met.filter(F.col("_bucket") == F.col("_edge")).withColumn("_r", F.row_number().over(order))
    return whole.select(*points.columns).unionByName(cut.filter(F.col("_r") <= F.col("_left")).select(*points.columns))


def nearest_frame(track: DataFrame, requests: DataFrame, key: str = "session", frame: str = "frame") -> DataFrame:
    """Closest frame of the same track for each (request_id, key, wanted); the lower frame
    wins ties.  One union and two forward fills instead of pairing rows."""
    rows = track.select(
        key,
        F.lit(None).cast("long").alias("request_id"),
        F.col(frame).cast("double").alias("_pos"),
        F.lit(0).alias("_ask"),
        F.col(frame).alias("_frame"),
    ).unionByName(
        requests.select(
            key,
            F.col("request_id").cast("long").alias("request_id"),
            F.col("wanted").cast("double").alias("_pos"),
            F.lit(1).alias("_ask"),
            F.lit(None).cast(track.schema[frame].dataType).alias("_frame"),
        )
    )
    seq = Sequence(rows, [key], ["_pos", "_ask"]).fill_forward(_low=F.col("_frame"))
    seq = Sequence(seq.df.withColumn("_neg", -F.col("_pos")), [key], ["_neg", "_ask"]).fill_forward(_high=F.col("_frame"))
    low, high = F.col("_low"), F.col("_high")
    closest = (
        F.when(low.isNull(), high)
        .when(high.isNull(), low)
        .when(F.col("_pos") - low <= high - F.col("_pos"), low)
        .otherwise(high)
    )
    return seq.df.filter("_ask = 1").select(key, "request_id", closest.alias("nearest"))


def gap_groups(rows: DataFrame, key: str, position: str, tie: str, gap: float = 50.0) -> DataFrame:
    """0-based group number down the page; a gap larger than ``gap`` starts a new group."""
    seq = Sequence(rows, [key], [position, tie]).lag(_prev=F.col(position))
    breaks = F.when(F.col(position) - F.col("_prev") > gap, 1).otherwise(0)
    return seq.running_sum(group_no=breaks).df.drop("_prev")


def depth_filter(
    points: DataFrame,
    frame: str,
    order: str,
    near: float = 0.1,
    far: float = 5.0,
    min_confidence: int = 1,
    per_frame: int | None = None,
    total: int | None = None,
    scan: str | None = None,
) -> DataFrame:
    """Usable depth points; where a phone's upload limits are asked for, the first ``per_frame`` of each
    frame in scan order and the first ``total`` of each scan."""
    good = points.filter(
        (F.col("depth") > near) & (F.col("depth") < far) & (F.col("confidence") >= min_confidence)
    )
    scan_keys = [scan] if scan else []
    if per_frame is not None:
        good = Sequence(good, [*scan_keys, frame], [order]).index("_i").df.filter(F.col("_i") <= per_frame).drop("_i")
    if total is None:
        return good
    if scan is None:
        good = good.withColumn("_all", F.lit(0))
    return Sequence(good, [scan or "_all"], [order]).index("_t").df.filter(F.col("_t") <= total).drop("_t", "_all")


def wrap_angle(angle: Column) -> Column:
    """Angle brought into [-pi, pi)."""
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def distance_bearing(
    x: Column, z: Column, yaw: Column, target_x: Column, target_z: Column, arrived_within: float = 2.0
) -> tuple[Column, Column, Column]:
    dx, dz = target_x - x, target_z - z
    distance = planar(dx, dz)
    return distance, distance < arrived_within, wrap_angle(F.atan2(dx, -dz) - yaw)


def dead_reckoning(rows: DataFrame, device: str, order: list[str], min_inliers: int = 25) -> DataFrame:
    """Map position between accepted fixes: last fix plus the rotated tracking delta.

    Rows carry track_x/z/yaw; fix rows also map fix_x/z/yaw.  Rows before the first
    accepted fix have no position.
    """
    accepted = F.col("is_fix") & (F.col("inliers") >= min_inliers)
    fix = F.when(
        accepted,
        F.struct(
            "fix_x",
            "fix_z",
            (F.col("track_yaw") - F.col("fix_yaw")).alias("offset"),
            F.col("track_x").alias("ref_x"),
            F.col("track_z").alias("ref_z"),
        ),
    )
    out = Sequence(rows, [device], order).fill_forward(_fix=fix).df
    dx, dz = F.col("track_x") - F.col("_fix.ref_x"), F.col("track_z") - F.col("_fix.ref_z")
    c, s = F.cos("_fix.offset"), F.sin("_fix.offset")
    return (
        out.withColumn("map_x", F.col("_fix.fix_x") + dx * c + dz * s)
        .withColumn("map_z", F.col("_fix.fix_z") - dx * s + dz * c)
        .drop("_fix")
    )


def near_any_previous(
    rows: DataFrame, order: str = "ord", radius: float = 3.0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """True when an earlier row of the same ``keys`` lies within ``radius`` (and for their very first row).

    Cells have a diagonal of ``radius``: every row but the first of its cell is near by
    construction, so only one row per cell looks at the 24 surrounding cells.
    """
    cell = radius / math.sqrt(2.0)
    cells = rows.withColumn("_i", F.floor(F.col("x") / cell)).withColumn("_j", F.floor(F.col("z") / cell))
    first = cells.groupBy(*keys, "_i", "_j").agg(F.min(F.struct(order, "x", "z")).alias("_f"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                       for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)])
    ask, place = [*keys, "_ord"], [*keys, "_i", "_j"]
    asks = first.select(
        *keys,
        F.col(f"_f.{order}").alias("_ord"),
        F.col("_f.x").alias("_x"),
        F.col("_f.z").alias("_z"),
        "_i",
        "_j",
        F.explode(around).alias("_d"),
    ).withColumn("_i", F.col("_i") + F.col("_d.a")).withColumn("_j", F.col("_j") + F.col("_d.b"))
    hits = (
        asks.join(cells.select(*place, F.col(order).alias("_o"), "x", "z"), place)
        .filter(
            (F.col("_o") < F.col("_ord")) & (planar(F.col("x") - F.col("_x"), F.col("z") - F.col("_z")) < radius)
        )
        .select(*ask)
        .distinct()
    )
    begin = rows.groupBy(*keys).agg(F.min(order).alias("_ord"))
    lonely = (
        first.select(*keys, F.col(f"_f.{order}").alias("_ord"))
        .join(hits, ask, "left_anti")
        .join(begin, ask, "left_anti")
        .withColumn("_lonely", F.lit(True))
    )
    return (
        rows.withColumn("_ord", F.col(order))
        .join(lonely, ask, "left")
        .withColumn("near", F.col("_lonely").isNull())
        .drop("_ord", "_lonely")
    )


def nearest_to_target(track: DataFrame, key: str, frame: str, x: float, z: float) -> DataFrame:
    distance = planar(F.col("x") - x, F.col("z") - z)
    return track.groupBy(key).agg(
        F.min(F.struct(distance.alias("distance"), F.col(frame).alias("frame"))).alias("_best")
    ).select(key, "_best.frame", "_best.distance")


def coverage_loops_gaps(
    track: DataFrame,
    key: str,
    order: str,
    cell: float = 1.0,
    loop_within: float = 1.5,
    loop_apart: int = 10,
    gap: float = 1.0,
) -> DataFrame:
    """Per track: visited cells, frames that come back near a frame at least ``loop_apart``
    positions earlier, and consecutive frames further apart than ``gap``.

    Fine cells (diagonal = ``loop_within``) carry only their first position; a frame is a
    return when its own cell was entered early enough, or a surrounding cell holds an early
    enough frame within reach.  Only surrounding cells in reach of the frame are asked, and no
    side is broadcast: the planner takes an exploded table for as small as its source.
    """
    seq = Sequence(track, [key], [order]).index("_n")
    seq.lag(_px=F.col("x"), _pz=F.col("z"))
    side = loop_within / math.sqrt(2.0)
    rows = (
        seq.df.withColumn("_i", F.floor(F.col("x") / side))
        .withColumn("_j", F.floor(F.col("z") / side))
        .withColumn("_jump", planar(F.col("x") - F.col("_px"), F.col("z") - F.col("_pz")))
    )
    summary = rows.groupBy(key).agg(
        F.count_distinct(F.floor(F.col("x") / cell), F.floor(F.col("z") / cell)).alias("cells"),
        F.count_if(F.col("_jump") > gap).alias("gaps"),
    )
    first = rows.groupBy(key, "_i", "_j").agg(F.min("_n").alias("_first"))
    marked = rows.select(key, "_n", "x", "z", "_i", "_j").join(first.hint("merge"), [key, "_i", "_j"])
    same = F.col("_n") - F.col("_first") >= loop_apart
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                       for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)])

    def beyond(value: Column, cell_no: Column) -> Column:
        return F.greatest(cell_no * side - value, value - (cell_no + 1) * side, F.lit(0.0))

    asks = (
        marked.filter(~same)
        .select(key, "_n", "x", "z", "_i", "_j", F.explode(around).alias("_d"))
        .select(key, "_n", "x", "z", (F.col("_i") + F.col("_d.a")).alias("_i"), (F.col("_j") + F.col("_d.b")).alias("_j"))
        .filter(planar(beyond(F.col("x"), F.col("_i")), beyond(F.col("z"), F.col("_j"))) < 1.001 * loop_within)
    )
    other = rows.select(
        key, F.col("_n").alias("_m"), F.col("x").alias("_ox"), F.col("z").alias("_oz"), "_i", "_j"
    )
    found = (
        asks.join(other.hint("merge"), [key, "_i", "_j"])
        .filter(
            (F.col("_n") - F.col("_m") >= loop_apart)
            & (planar(F.col("x") - F.col("_ox"), F.col("z") - F.col("_oz")) < loop_within)
        )
        .select(key, "_n")
        .distinct()
    )
    returns = (
        marked.filter(same).select(key, "_n").unionByName(found).groupBy(key).agg(F.count(F.lit(1)).alias("returns"))
    )
    return summary.join(returns.hint("merge"), key, "left").select(
        key, "cells", "gaps", F.coalesce("returns", F.lit(0)).alias("returns")
    )
