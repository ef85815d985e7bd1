"""Scan sessions: status, merging, overlap, flags and the batch side of online state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.operators.ordered import Sequence, top_per_group
from aislewise.session import cut_lineage

FINISHED = ("klar", "pausad")


def with_status(sessions: DataFrame, wanted: tuple[str, ...] = FINISHED, column: str = "status") -> DataFrame:
    return sessions.filter(F.col(column).isin(*wanted))


def frame_offsets(sessions: DataFrame, frames: DataFrame, store: str, spacing: int = 10) -> DataFrame:
    """Offset per finished session: sum of (highest frame + spacing) of earlier ones of the store."""
    highest = frames.groupBy("session_id").agg(F.max("frame").alias("_max"))
    rows = with_status(sessions).select(store, "session_id").join(highest, "session_id", "left")
    size = F.coalesce("_max", F.lit(0)) + spacing
    seq = Sequence(rows.withColumn("_size", size), [store], ["session_id"]).running_sum(_sum=F.col("_size"))
    return seq.df.select(store, "session_id", (F.col("_sum") - F.col("_size")).alias("offset"))


def union_sessions(sessions: DataFrame, frames: DataFrame, store: str, spacing: int = 10) -> DataFrame:
    """Frames of all finished sessions in one numbering, tagged with their session."""
    offsets = frame_offsets(sessions, frames, store, spacing)
    return frames.join(offsets, "session_id").withColumn("frame", F.col("frame") + F.col("offset")).drop("offset")


def remap_frame_ids(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number incoming frames after the highest existing one, per map, in order."""
    top = existing.groupBy(key).agg(F.max("frame").alias("_top"))
    seq = Sequence(incoming, [key], order).index("_i")
    return (
        seq.df.join(top, key, "left")
        .withColumn("new_frame", F.coalesce("_top", F.lit(-1)) + F.col("_i"))
        .drop("_top", "_i")
    )


def overlap_pairs(
    sessions: DataFrame, margin: float = 2.0, cell: float = 32.0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs of sessions of one store (``keys``) whose start-end boxes touch when one is grown by ``margin``.

    Boxes are spread over grid cells; a pair is reported only in the cell that holds the
    lower corner of its intersection, so no second shuffle removes duplicates.
    """
    box = sessions.select(
        *keys,
        "session_id",
        F.least("start_x", "end_x").alias("x0"),
        F.greatest("start_x", "end_x").alias("x1"),
        F.least("start_z", "end_z").alias("z0"),
        F.greatest("start_z", "end_z").alias("z1"),
    )

    def cells(df: DataFrame, grow: float) -> DataFrame:
        xs = F.sequence(F.floor((F.col("x0") - grow) / cell), F.floor((F.col("x1") + grow) / cell))
        zs = F.sequence(F.floor((F.col("z0") - grow) / cell), F.floor((F.col("z1") + grow) / cell))
        return df.withColumn("_cx", F.explode(xs)).withColumn("_cz", F.explode(zs))

    a = cells(box, margin).alias("a")
    b = cells(box, 0.0).alias("b")
    lower_x = F.greatest(F.col("a.x0") - margin, F.col("b.x0"))
    lower_z = F.greatest(F.col("a.z0") - margin, F.col("b.z0"))
    touch = (
        (F.col("a.x0") - margin < F.col("b.x1"))
        & (F.col("a.x1") + margin > F.col("b.x0"))
        & (F.col("a.z0") - margin < F.col("b.z1"))
        & (F.col("a.z1") + margin > F.col("b.z0"))
    )
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(
        b,
        same
        & (F.col("a._cx") == F.col("b._cx"))
        & (F.col("a._cz") == F.col("b._cz"))
        & (F.col("a.session_id") != F.col("b.session_id"))
        & touch
        & (F.floor(lower_x / cell) == F.col("a._cx"))
        & (F.floor(lower_z / cell) == F.col("a._cz")),
    ).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col("a.session_id").alias("session_id"),
        F.col("b.session_id").alias("other_id"),
    )


NEWEST = 32  # boxes on a cell's list
CELLS_PER_BOX = 16  # beyond which cells are not cut any finer


def replace_overlapped(
    sessions: DataFrame, margin: float = 2.0, keys: tuple[str, ...] = (), cell: float = 32.0, newest: int = NEWEST
) -> DataFrame:
    """Sessions left after every session has replaced the older ones of its store that it overlaps.

    No pairs are listed.  A box meets the ``newest`` boxes of each of its cells: one that a newer one touches is
    replaced, one older than nothing left off the lists stays.  The rest goes on to cells a quarter as wide, as long as
    boxes are small enough for those, and at last looks for any newer box of its cells that touches it.
    """
    box = cut_lineage(
        sessions.select(
            *keys,
            "session_id",
            F.struct("started", "session_id").alias("at"),
            F.least("start_x", "end_x").alias("x0"),
            F.greatest("start_x", "end_x").alias("x1"),
            F.least("start_z", "end_z").alias("z0"),
            F.greatest("start_z", "end_z").alias("z1"),
        )
    )
    by_cell = [*keys, "_cx", "_cz"]

    def spans(side: float, grow: float) -> list[tuple[str, Column, Column]]:
        return [
            (c, F.floor((F.col(f"{a}0") - grow) / side), F.floor((F.col(f"{a}1") + grow) / side))
            for c, a in (("_cx", "x"), ("_cz", "z"))
        ]

    def cells(df: DataFrame, side: float, grow: float) -> DataFrame:
        for c, low, high in spans(side, grow):
            df = df.withColumn(c, F.explode(F.sequence(low, high)))
        return df

    def fine_enough(side: float) -> bool:
        area = F.lit(1.0)
        for _, low, high in spans(side, margin):
            area = area * (high - low + 1)
        return (box.agg(F.avg(area)).first()[0] or 0.0) <= CELLS_PER_BOX

    def replaces(new, old) -> Column:
        """Whether ``new`` is newer and touches ``old``; both give a column by its name."""
        return (
            (new("at") > old("at"))
            & (new("x0") - margin < old("x1"))
            & (new("x1") + margin > old("x0"))
            & (new("z0") - margin < old("z1"))
            & (new("z1") + margin > old("z0"))
        )

    fields = ["at", "x0", "x1", "z0", "z1"]
    left, gone, side = box, [], cell
    while True:
        few = top_per_group(cells(box, side, margin).select(*by_cell, *fields), by_cell, [F.desc("at")], newest)
        lists = few.groupBy(*by_cell).agg(F.collect_list(F.struct(*fields)).alias("_new"))
        met = cells(left, side, 0.0).join(lists.hint("merge"), by_cell)
        hit = F.exists("_new", lambda n: replaces(lambda c: n[c], F.col))
        seen = (F.size("_new") < newest) | (F.array_min(F.transform("_new", lambda n: n["at"])) <= F.col("at"))
        told = cut_lineage(met.groupBy("session_id").agg(F.bool_or(hit).alias("hit"), F.bool_and(seen).alias("seen")))
        gone.append(told.filter("hit").select("session_id"))
        open_ids = told.filter(F.coalesce(~F.col("hit"), F.lit(True)) & ~F.coalesce("seen", F.lit(False)))
        left = cut_lineage(left.join(open_ids.select("session_id").hint("merge"), "session_id", "left_semi"))
        if left.isEmpty():
            break
        if not fine_enough(side / 4):
            o, n = cells(left, side, 0.0).alias("o"), cells(box, side, margin).alias("n")
            same = replaces(lambda c: F.col(f"n.{c}"), lambda c: F.col(f"o.{c}"))
            for k in by_cell:
                same = same & (F.col(f"n.{k}") == F.col(f"o.{k}"))
            gone.append(o.join(n.hint("merge"), same, "left_semi").select("session_id"))
            break
        side /= 4
    dead = gone[0]
    for part in gone[1:]:
        dead = dead.unionByName(part)
    return sessions.join(dead.distinct().hint("merge"), "session_id", "left_anti")


def needs_rebuild(sessions: DataFrame, builds: DataFrame, key: str) -> DataFrame:
    """Per store: a finished session ended after the last build, or any session if never built."""
    newer = (F.col("status") == "klar") & F.coalesce(F.col("ended") > F.col("built_at"), F.lit(True))
    return (
        sessions.join(builds, key, "left")
        .groupBy(key)
        .agg(F.bool_or(F.col("built_at").isNull() | newer).alias("rebuild"))
    )


def escalate_flags(flags: DataFrame, needed: int = 3, hours: float = 24.0) -> DataFrame:
    """Marks the report that makes it ``needed`` open reports of one product within the window.

    Looks back ``needed - 1`` reports instead of counting a range, so it works slice by slice.
    """
    seq = Sequence(flags.filter(~F.col("handled")), ["product_id"], ["ts", "flag_id"]).lag(_t1=F.col("ts"))
    for i in range(2, needed):
        seq.lag(**{f"_t{i}": F.col(f"_t{i - 1}")})
    back = F.col(f"_t{needed - 1}")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(back.cast("timestamp"))
    out = seq.df.withColumn("escalated", F.coalesce(age < hours * 3600e6, F.lit(False)))
    return out.drop(*[f"_t{i}" for i in range(1, needed)])


def lifecycle_state(events: DataFrame, key: str, order: list[str], kind: str = "kind") -> DataFrame:
    """Final status after start / pause / resume / stop events; resume only revives a paused session."""
    place = F.struct(*order)
    folded = events.groupBy(key).agg(
        F.max_by(kind, F.when(F.col(kind) != "resume", place)).alias("_last"),
        F.max(F.when(F.col(kind) != "resume", place)).alias("_at"),
        F.max(F.when(F.col(kind) == "resume", place)).alias("_resumed"),
    )
    status = (
        F.when((F.col("_last") == "pause") & (F.col("_resumed") > F.col("_at")), "aktiv")
        .when(F.col("_last") == "start", "aktiv")
        .when(F.col("_last") == "pause", "pausad")
        .when(F.col("_last") == "stop", "klar")
    )
    return folded.select(key, status.alias("status")).filter(F.col("status").isNotNull())


def attempts_until(
    attempts: DataFrame, device: str, order: list[str], outcome: str, unknown_after: int = 5, error_after: int = 8
) -> DataFrame:
    """First attempt that ends the search: a match, an unknown place from attempt 5, an error from attempt 8."""
    numbered = Sequence(attempts, [device], order).index("attempt").df
    ends = (
        (F.col(outcome) == "match")
        | ((F.col(outcome) == "unknown") & (F.col("attempt") >= unknown_after))
        | ((F.col(outcome) == "error") & (F.col("attempt") >= error_after))
    )
    return (
        numbered.filter(ends)
        .groupBy(device)
        .agg(F.min(F.struct("attempt", F.col(outcome).alias("outcome"))).alias("_e"))
        .select(device, "_e.attempt", "_e.outcome")
    )


def position_stale(fixes: DataFrame, device: str, order: list[str], stale_s: float = 30.0) -> DataFrame:
    """Each fix with the silence before it, and whether the position had gone stale."""
    seq = Sequence(fixes, [device], order).lag(_prev=F.col("ts"))
    silent = (
        F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
    ) / F.lit(1e6)
    return seq.df.withColumn("silent_s", silent).withColumn("stale", F.coalesce(silent > stale_s, F.lit(False))).drop(
        "_prev"
    )


def latest_with_ttl(rows: DataFrame, key: str, order: list[str], now: Column, ttl_s: float = 8.0) -> DataFrame:
    """Latest row per key, dropped when older than ``ttl_s`` at ``now``."""
    rest = [c for c in rows.columns if c != key]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_l.ts").cast("timestamp"))
    return latest.filter(age <= ttl_s * 1e6).select(key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def localisation_metrics(fixes: DataFrame, key: str, confidence: Column) -> DataFrame:
    """Hit rate, mean planar error of hits and the most common confidence (name breaks ties)."""
    error = F.sqrt(
        F.pow(F.col("est_x") - F.col("true_x"), F.lit(2)) + F.pow(F.col("est_z") - F.col("true_z"), F.lit(2))
    )
    rows = fixes.withColumn("_conf", confidence).withColumn("_err", F.when(F.col("hit"), error))
    parts = rows.groupBy(key, "_conf").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("hit").alias("_hits"),
        F.sum("_err").alias("_err"),
    )
    return parts.groupBy(key).agg(
        (F.sum("_hits") / F.sum("_n")).alias("hit_rate"),
        (F.coalesce(F.sum("_err"), F.lit(0.0)) / F.greatest(F.sum("_hits"), F.lit(1))).alias("mean_error"),
        F.min_by("_conf", F.struct((-F.col("_n")).alias("n"), "_conf")).alias("confidence"),
    )


def best_map(fixes: DataFrame, key: str, map_col: str, hit: str, inliers: str, needed: int = 50) -> DataFrame:
    """Map with most inliers among good hits (lowest map id wins ties); unknown place otherwise."""
    good = F.col(hit) & (F.col(inliers) >= needed)
    best = fixes.groupBy(key).agg(
        F.max_by(
            F.struct(F.col(map_col).alias("map"), F.col(inliers).alias("n")),
            F.when(good, F.struct(F.col(inliers), (-F.col(map_col)).alias("m"))),
        ).alias("_b"),
    )
    return best.select(
        key,
        F.when(F.col("_b").isNull(), "okänd_plats").otherwise("match").alias("status"),
        F.col("_b.map").alias("map_id"),
        F.col("_b.n").alias("inliers"),
    )


def pose_confidence(inliers: Column, ratio: Column) -> Column:
    return (
        F.when((inliers >= 40) & (ratio > 0.5), "hög")
        .when((inliers >= 20) & (ratio > 0.3), "medium")
        .otherwise("låg")
    )
