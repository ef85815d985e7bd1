"""Sessions, flags, localisation fixes and the batch twins of online state."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.operators import sessions as S
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add


def frames(spark, sf):
    return view(spark, sf, "wide_track").withColumnRenamed("session", "session_id")


def stores(spark, sf):
    return view(spark, sf, "session").withColumn("store", F.col("session_id") % 4)


OFFSET_SQL = """with s as (select session_id, session_id % 4 as store from {session} where status in ('klar', 'pausad')),
     m as (select session as session_id, max(frame) as top from {wide_track} group by 1),
     z as (select store, session_id, coalesce(top, 0) + 10 as size from s left join m using (session_id)),
     o as (select store, session_id, (sum(size) over (partition by store order by session_id) - size)::bigint as "offset"
           from z)"""


@add("frame_offsets", OFFSET_SQL + ' select store, session_id, "offset" from o')
def frame_offsets(spark, sf):
    return S.frame_offsets(stores(spark, sf), frames(spark, sf), "store")


@add("union_sessions", OFFSET_SQL + ' select t.session as session_id, store, frame + "offset" as frame '
     "from {wide_track} t join o on o.session_id = t.session")
def union_sessions(spark, sf):
    return S.union_sessions(stores(spark, sf), frames(spark, sf), "store").select("session_id", "store", "frame")


@add("remap_frame_ids", """with t as (select session % 4 as map_id, session, frame from {track}),
     top as (select map_id, max(frame) as top from t where session % 3 = 0 group by map_id)
     select t.map_id, session as origin, frame as old_frame,
        coalesce(top, -1) + row_number() over (partition by t.map_id order by session, frame) as new_frame
     from t left join top on top.map_id = t.map_id where session % 3 <> 0""")
def remap_frame_ids(spark, sf):
    track = view(spark, sf, "track").select((F.col("session") % 4).alias("map_id"), "session", "frame")
    old, new = track.filter("session % 3 = 0"), track.filter("session % 3 <> 0")
    return S.remap_frame_ids(old, new, "map_id", ["session", "frame"]).select(
        "map_id", F.col("session").alias("origin"), F.col("frame").alias("old_frame"), "new_frame"
    )


@add("union_all_sessions", """select 'track' as kind, session as session_id, frame from {wide_track}
     union all select 'point', map_id, point_id from {point}""")
def union_all_sessions(spark, sf):
    a = view(spark, sf, "wide_track").select(
        F.lit("track").alias("kind"), F.col("session").alias("session_id"), "frame"
    )
    b = view(spark, sf, "point").select(
        F.lit("point").alias("kind"),
        F.col("map_id").cast("long").alias("session_id"),
        F.col("point_id").alias("frame"),
    )
    return a.unionByName(b)


@add("status_filter_sessions", "select o_orderkey, o_orderstatus from {orders} where o_orderstatus in ('F', 'P')")
def status_filter_sessions(spark, sf):
    return S.with_status(
        view(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ("F", "P"), "o_orderstatus"
    )


@add("coverage_points", f"""select s.session_id, {r('t.x')} as x, {r('t.z')} as z, n_frames
     from {{session}} s join {{wide_track}} t on t.session = s.session_id where status in ('klar', 'pausad')""")
def coverage_points(spark, sf):
    done = S.with_status(view(spark, sf, "session")).select("session_id", "n_frames")
    return frames(spark, sf).join(done, "session_id").select(
        "session_id", rounded("x").alias("x"), rounded("z").alias("z"), "n_frames"
    )


BOX_SQL = """b as (select session_id % 4 as store, session_id, started, least(start_x, end_x) as x0, greatest(start_x, end_x) as x1,
      least(start_z, end_z) as z0, greatest(start_z, end_z) as z1 from {session})"""
TOUCH = "a.store = o.store and a.x0 - 2 < o.x1 and a.x1 + 2 > o.x0 and a.z0 - 2 < o.z1 and a.z1 + 2 > o.z0"


@add("session_overlap", f"""with {BOX_SQL} select a.store, a.session_id, o.session_id as other_id
     from b a join b o on a.session_id <> o.session_id and {TOUCH}""")
def session_overlap(spark, sf):
    return S.overlap_pairs(stores(spark, sf), keys=("store",))


@add("replace_overlapped", f"""with {BOX_SQL} select session_id from b o where not exists (
     select 1 from b a where a.session_id <> o.session_id and {TOUCH}
       and (a.started > o.started or (a.started = o.started and a.session_id > o.session_id)))""")
def replace_overlapped(spark, sf):
    return S.replace_overlapped(stores(spark, sf), keys=("store",)).select("session_id")


@add("map_status", """with s as (select cast(session_id % 4 as varchar) as map_id, n_frames, status from {session})
     select coalesce(map_id, 'total') as map_id, count(*) as sessions, cast(sum(n_frames) as bigint) as frames,
       count(*) filter (status = 'klar') as finished from s group by rollup (map_id)""")
def map_status(spark, sf):
    rows = view(spark, sf, "session").withColumn("map_id", (F.col("session_id") % 4).cast("string"))
    return (
        rows.rollup("map_id")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum("n_frames").alias("frames"),
            F.count_if(F.col("status") == "klar").alias("finished"),
        )
        .withColumn("map_id", F.coalesce("map_id", F.lit("total")))
    )


@add("needs_rebuild", """with s as (select *, session_id % 4 as store from {session}),
     b as (select cast(n_nationkey as bigint) as store, timestamp '2024-01-30 20:00:00' + n_nationkey * interval 1 hour as built_at
           from {nation} where n_nationkey > 0)
     select store, bool_or(built_at is null or (status = 'klar' and ended > built_at)) as rebuild
     from s left join b using (store) group by store""")
def needs_rebuild(spark, sf):
    builds = view(spark, sf, "nation").filter("n_nationkey > 0").select(
        F.col("n_nationkey").cast("long").alias("store"),
        F.expr("timestamp_ntz '2024-01-30 20:00:00' + make_dt_interval(0, n_nationkey)").alias("built_at"),
    )
    return S.needs_rebuild(stores(spark, sf), builds, "store")


@add("overlap_sessions_latest", """select session_id % 4 as map_id, max_by(session_id, (ended, session_id)) as session_id
     from {session} group by 1""")
def overlap_sessions_latest(spark, sf):
    return (
        stores(spark, sf)
        .groupBy(F.col("store").alias("map_id"))
        .agg(F.max_by("session_id", F.struct("ended", "session_id")).alias("session_id"))
    )


@add("open_flags", """select flag_id, product_id, c_name, epoch_us(ts) as at_us from {flag}
     join {customer} on c_custkey = product_id where not handled""")
def open_flags(spark, sf):
    customers = view(spark, sf, "customer").select(F.col("c_custkey").alias("product_id"), "c_name")
    return (
        view(spark, sf, "flag")
        .filter("not handled")
        .join(customers, "product_id")
        .select("flag_id", "product_id", "c_name", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
        .orderBy(F.desc("at_us"), "flag_id")
    )


@add("flag_escalation", """select flag_id, product_id, count(*) over (partition by product_id order by ts
       range between interval 1 day preceding and current row) >= 3 as escalated from {flag} where not handled""")
def flag_escalation(spark, sf):
    return S.escalate_flags(view(spark, sf, "flag")).select("flag_id", "product_id", "escalated")


@add("localization_metrics", f"""with l as (select *, case when inliers >= 40 and inlier_ratio > 0.5e0 then 'hög'
        when inliers >= 20 and inlier_ratio > 0.3e0 then 'medium' else 'låg' end as conf,
        sqrt((est_x - true_x) ** 2 + (est_z - true_z) ** 2) as err from {{localisation}}),
     c as (select map_id, conf, count(*) as n from l group by 1, 2),
     m as (select map_id, conf, row_number() over (partition by map_id order by n desc, conf) as rn from c)
     select l.map_id, {r('avg(cast(hit as int))')} as hit_rate, {r('avg(err) filter (hit)')} as mean_error,
       min(m.conf) as confidence from l join m on m.map_id = l.map_id and rn = 1 group by l.map_id""")
def localization_metrics(spark, sf):
    out = S.localisation_metrics(
        view(spark, sf, "localisation"), "map_id", S.pose_confidence(F.col("inliers"), F.col("inlier_ratio"))
    )
    return out.select(
        "map_id", rounded("hit_rate").alias("hit_rate"), rounded("mean_error").alias("mean_error"), "confidence"
    )


@add("pose_confidence", """select fix_id, case when inliers >= 40 and inlier_ratio > 0.5e0 then 'hög'
     when inliers >= 20 and inlier_ratio > 0.3e0 then 'medium' else 'låg' end as confidence from {localisation}""")
def pose_confidence(spark, sf):
    return view(spark, sf, "localisation").select(
        "fix_id", S.pose_confidence(F.col("inliers"), F.col("inlier_ratio")).alias("confidence")
    )


@add("best_map", """with g as (select device, map_id, inliers, row_number() over (partition by device
        order by inliers desc, map_id) as rn from (select device, fix_id % 5 as map_id, inliers, hit from {localisation})
        where hit and inliers >= 50)
     select d.device, case when g.device is null then 'okänd_plats' else 'match' end as status, g.map_id, g.inliers
     from (select distinct device from {localisation}) d left join g on g.device = d.device and rn = 1""")
def best_map(spark, sf):
    fixes = view(spark, sf, "localisation").withColumn("map_id", F.col("fix_id") % 5)
    return S.best_map(fixes, "device", "map_id", "hit", "inliers")


@add("session_lifecycle", """with e as (select user_id as session_id, event_id, case event_type when 'signup' then 'start'
        when 'view' then 'pause' when 'click' then 'resume' when 'purchase' then 'stop' end as kind
        from {events} where event_type <> 'error'),
     l as (select session_id, max_by(kind, event_id) filter (kind <> 'resume') as last_kind,
        max(event_id) filter (kind <> 'resume') as placed, max(event_id) filter (kind = 'resume') as resumed
        from e group by session_id)
     select session_id, case when last_kind = 'pause' and resumed > placed then 'aktiv' when last_kind = 'start' then 'aktiv'
        when last_kind = 'pause' then 'pausad' else 'klar' end as status from l where last_kind is not null""")
def session_lifecycle(spark, sf):
    return S.lifecycle_state(lifecycle_events(view(spark, sf, "events")), "session_id", ["event_id"])


def lifecycle_events(events):
    kind = (
        F.when(F.col("event_type") == "signup", "start")
        .when(F.col("event_type") == "view", "pause")
        .when(F.col("event_type") == "click", "resume")
        .when(F.col("event_type") == "purchase", "stop")
    )
    return events.select(F.col("user_id").alias("session_id"), "event_id", "ts", kind.alias("kind")).filter(
        "kind is not null"
    )


@add("attempts_until", """with a as (select user_id as device, event_id, case event_type when 'purchase' then 'match'
        when 'error' then 'error' else 'unknown' end as outcome,
        row_number() over (partition by user_id order by event_id) as attempt from {events}),
     e as (select *, row_number() over (partition by device order by attempt) as rn from a
        where outcome = 'match' or (outcome = 'unknown' and attempt >= 5) or (outcome = 'error' and attempt >= 8))
     select device, attempt, outcome from e where rn = 1""")
def attempts_until(spark, sf):
    outcome = (
        F.when(F.col("event_type") == "purchase", "match")
        .when(F.col("event_type") == "error", "error")
        .otherwise("unknown")
    )
    rows = view(spark, sf, "events").select(F.col("user_id").alias("device"), "event_id", outcome.alias("outcome"))
    return S.attempts_until(rows, "device", ["event_id"], "outcome")


@add("position_stale", f"""with l as (select device, event_id, (epoch_us(ts) - lag(epoch_us(ts)) over
        (partition by device order by ts, event_id)) / 1e6 as silent from {{tracking}} where is_fix)
     select device, event_id, {r('silent', 2)} as silent_s, coalesce(silent > 30, false) as stale from l""")
def position_stale(spark, sf):
    fixes = view(spark, sf, "tracking").filter("is_fix").select("device", "event_id", "ts")
    return S.position_stale(fixes, "device", ["ts", "event_id"]).select(
        "device", "event_id", rounded("silent_s", 2).alias("silent_s"), "stale"
    )


@add("latest_with_ttl", """with m as (select max(ts) as now from {tracking}),
     l as (select device, max_by(event_id, event_id) as event_id, max(ts) as ts from {tracking} group by device)
     select device, event_id from l, m where epoch_us(now) - epoch_us(ts) <= 28800000000""")
def latest_with_ttl(spark, sf):
    rows = view(spark, sf, "tracking").select("device", "event_id", "ts")
    now = rows.agg(F.max("ts")).scalar()
    return S.latest_with_ttl(rows, "device", ["event_id"], now, ttl_s=8 * 3600.0).select("device", "event_id")


@add("live_position", f"""with p as (select user_id % 4 as map_id, event_id, ts, value / 10e0 as cx,
        cast(props->>'k' as int) / 10e0 as cz, radians(cast(event_id % 360 as double)) as yaw from {{events}}),
     l as (select map_id, max_by((cx, cz, yaw, event_id), event_id) as b from p group by map_id)
     select map_id, b[4] as event_id,
        {r("cos(0.5e0) * b[1] + sin(0.5e0) * b[2] + 1e0")} as x,
        {r("-sin(0.5e0) * b[1] + cos(0.5e0) * b[2] + 3e0")} as z,
        {r("atan2(-sin(b[3] + 0.5e0), -cos(b[3] + 0.5e0))")} as yaw from l""")
def live_position(spark, sf):
    from aislewise.operators.poses import live_position as op

    return op(camera_rows(view(spark, sf, "events")), "map_id", ["event_id"]).select(
        "map_id", "event_id", rounded("x").alias("x"), rounded("z").alias("z"), rounded("yaw").alias("yaw")
    )


def camera_rows(events):
    """Poses turned by the event id with a fixed map transform (0.5 rad about y, then 1, 2, 3)."""
    import math

    k = F.get_json_object("props", "$.k").cast("int")
    a = F.radians((F.col("event_id") % 360).cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    camera = F.array(
        F.cos(a), zero, -F.sin(a), zero,
        zero, one, zero, zero,
        F.sin(a), zero, F.cos(a), zero,
        F.col("value") / 10.0, zero, k / 10.0, one,
    )
    c, s = math.cos(0.5), math.sin(0.5)
    to_map = [c, 0.0, -s, 0.0, 0.0, 1.0, 0.0, 0.0, s, 0.0, c, 0.0, 1.0, 2.0, 3.0, 1.0]
    return events.select(
        (F.col("user_id") % 4).alias("map_id"),
        "event_id",
        "ts",
        camera.alias("camera"),
        F.array(*[F.lit(v) for v in to_map]).alias("to_map"),
    )


@add("tracking_gate", """select user_id as device, count(*) filter (event_type in ('view', 'click', 'purchase')) as passed,
     count(*) filter (event_type not in ('view', 'click', 'purchase')) as skipped from {events} group by 1""")
def tracking_gate(spark, sf):
    normal = F.col("event_type").isin("view", "click", "purchase")
    return (
        view(spark, sf, "events")
        .groupBy(F.col("user_id").alias("device"))
        .agg(F.count_if(normal).alias("passed"), F.count_if(~normal).alias("skipped"))
    )


@add("throttle", """select user_id as device, min(event_id) as event_id from {events}
     group by user_id, epoch_us(ts) // 3600000000""")
def throttle(spark, sf):
    bins = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    return (
        view(spark, sf, "events")
        .groupBy(F.col("user_id").alias("device"), bins.alias("_bin"))
        .agg(F.min("event_id").alias("event_id"))
        .drop("_bin")
    )


@add("flag_window", """with h as (select user_id as product_id, epoch_us(ts) as t from {events}
        where event_type = 'error' and value <= 200),
     w as (select product_id, (t // 3600000000 - o) * 3600000000 as start from h, range(24) r(o))
     select product_id, start as window_start_us, count(*) as reports from w group by 1, 2 having count(*) >= 3""")
def flag_window(spark, sf):
    from aislewise.streaming.jobs import flag_windows

    flags = view(spark, sf, "flag").filter("not handled").withColumn("ts", F.col("ts").cast("timestamp"))
    return flag_windows(flags).select(
        "product_id", F.unix_micros("window_start").alias("window_start_us"), "reports"
    )
