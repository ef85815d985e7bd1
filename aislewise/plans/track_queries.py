"""Tracks: one row per event of a user, in event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.operators import tracks as T
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add

PATH_SQL = """
    select *, coalesce(sum(sqrt((x - px) * (x - px) + (z - pz) * (z - pz)))
                 over (partition by session order by frame rows unbounded preceding), 0e0) as path
    from (select *, lag(x) over w as px, lag(z) over w as pz from {track}
          window w as (partition by session order by frame))"""

CLOSE_SQL = """
    select *, sqrt(drift_x * drift_x + drift_z * drift_z) as drift from (
      select session, count(*) as n, max_by(x, frame) - min_by(x, frame) as drift_x,
             max_by(z, frame) - min_by(z, frame) as drift_z from {track} group by session)"""


@add("path_length", f"select session, frame, {r('path')} as path from ({PATH_SQL})")
def path_length(spark, sf):
    return T.path_length(view(spark, sf, "track").select("session", "frame", "x", "z")).select(
        "session", "frame", rounded("path").alias("path")
    )


@add("loop_closure_detect", f"""select session, n, {r('drift_x')} as drift_x, {r('drift_z')} as drift_z,
     {r('drift')} as drift from ({CLOSE_SQL}) where n >= 10 and drift <= 1.5e0""")
def loop_closure_detect(spark, sf):
    out = T.detect_loop_closure(view(spark, sf, "track"))
    return out.select("session", "n", *[rounded(c).alias(c) for c in ("drift_x", "drift_z", "drift")])


@add("loop_closure_correct", f"""with lengths as ({PATH_SQL}), closing as ({CLOSE_SQL}),
     plan as (select c.session, drift_x, drift_z, max(path) as total
              from closing c join lengths l on l.session = c.session
              where n >= 10 and drift <= 1.5e0 group by all having max(path) >= 0.1e0),
     t as (select l.session, l.frame, l.x, l.z, p.drift_x, p.drift_z, l.path / p.total as t, p.total is not null as corrected
           from lengths l left join plan p on p.session = l.session)
     select session, frame, corrected,
       {r('case when corrected then x - drift_x * (t * t * (3 - 2 * t)) else x end')} as x,
       {r('case when corrected then z - drift_z * (t * t * (3 - 2 * t)) else z end')} as z from t""")
def loop_closure_correct(spark, sf):
    out = T.correct_loop_closure(view(spark, sf, "track").select("session", "frame", "x", "z"))
    return out.select("session", "frame", "corrected", rounded("x").alias("x"), rounded("z").alias("z"))


@add("drift_from_start", f"""with s as (select session, frame, ts, x, z, first_value(x) over w as sx,
        first_value(z) over w as sz, first_value(ts) over w as st from {{track}}
        window w as (partition by session order by frame))
     select session, frame, {r('sqrt((x - sx) * (x - sx) + (z - sz) * (z - sz))')} as from_start,
        (epoch_us(ts) - epoch_us(st)) > 300000000 and sqrt((x - sx) * (x - sx) + (z - sz) * (z - sz)) > 3 as remind
     from s""")
def drift_from_start(spark, sf):
    return T.drift_from_start(view(spark, sf, "track"), "session", "frame").select(
        "session", "frame", rounded("from_start").alias("from_start"), "remind"
    )


@add("stride_sample", """with n as (select session, frame, row_number() over (partition by session order by frame) as i,
        count(*) over (partition by session) as n from {track}),
     s as (select *, greatest(1, n // 20) as step from n)
     select session, frame from s
     where ((i - 1) % step = 0 and (i - 1) // step < 20) or i = 1 or i = n""")
def stride_sample(spark, sf):
    track = view(spark, sf, "track").select("session", "frame")
    return T.stride_sample(track, "session", "frame", target=20, keep_ends=True)


@add("nearest_frame", """with ask as (select o_orderkey as request_id, o_custkey as session,
          o_orderkey as wanted from {orders}),
     lo as (select a.*, t.frame as low from ask a asof left join {track} t
            on a.session = t.session and a.wanted >= t.frame),
     both_sides as (select l.*, t.frame as high from lo l asof left join {track} t
            on l.session = t.session and l.wanted <= t.frame)
     select session, request_id, case when low is null then high when high is null then low
        when wanted - low <= high - wanted then low else high end as nearest
     from both_sides where low is not null or high is not null""")
def nearest_frame(spark, sf):
    asks = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("wanted")
    )
    return T.nearest_frame(view(spark, sf, "track").select("session", "frame"), asks).filter("nearest is not null")


@add("gap_groups", """with s as (select frame, point_id, v, lag(v) over (partition by frame order by v, point_id) as p
        from {point})
     select frame, point_id, coalesce(sum(case when v - p > 50 then 1 else 0 end)
        over (partition by frame order by v, point_id rows unbounded preceding), 0)::bigint as group_no from s""")
def gap_groups(spark, sf):
    return T.gap_groups(view(spark, sf, "point").select("frame", "point_id", "v"), "frame", "v", "point_id").select(
        "frame", "point_id", F.col("group_no").cast("long").alias("group_no")
    )


@add("depth_point_filter", """with good as (select * from {point}
        where depth > 0.1e0 and depth < 5 and confidence >= 1),
     capped as (select *, row_number() over (partition by map_id, frame order by point_id) as i from good),
     totals as (select *, row_number() over (partition by map_id order by point_id) as t from capped where i <= 12)
     select map_id, frame, point_id from totals where t <= 500000""")
def depth_point_filter(spark, sf):
    points = view(spark, sf, "point").select("map_id", "frame", "point_id", "depth", "confidence")
    return T.depth_filter(points, "frame", "point_id", per_frame=12, total=500_000, scan="map_id").select("map_id", "frame", "point_id")


DEAD_SQL = """select *, is_fix and inliers >= 25 as ok, x + 1e0 as fix_x, z * 0.5e0 as fix_z,
     yaw * 0.5e0 as fix_yaw from {tracking}"""


@add("dead_reckoning", f"""with b as ({DEAD_SQL}),
     f as (select *, max(case when ok then event_id end) over (partition by device order by ts, event_id) as fix_id from b),
     j as (select f.event_id, f.device, f.x - g.x as dx, f.z - g.z as dz, g.fix_x as gx, g.fix_z as gz,
                  g.yaw - g.fix_yaw as o
           from f left join b g on g.event_id = f.fix_id)
     select event_id, {r('gx + dx * cos(o) + dz * sin(o)')} as map_x,
            {r('gz - dx * sin(o) + dz * cos(o)')} as map_z from j where gx is not null""")
def dead_reckoning(spark, sf):
    rows = view(spark, sf, "tracking").select(
        "event_id",
        "device",
        "ts",
        "is_fix",
        "inliers",
        F.col("x").alias("track_x"),
        F.col("z").alias("track_z"),
        F.col("yaw").alias("track_yaw"),
        (F.col("x") + 1.0).alias("fix_x"),
        (F.col("z") * 0.5).alias("fix_z"),
        (F.col("yaw") * 0.5).alias("fix_yaw"),
    )
    out = T.dead_reckoning(rows, "device", ["ts", "event_id"]).filter("map_x is not null")
    return out.select("event_id", rounded("map_x").alias("map_x"), rounded("map_z").alias("map_z"))


@add("distance_bearing", f"""with b as (select session, frame, rot_y, 2.5e0 - x as dx, 1.25e0 - z as dz from {{track}}),
     a as (select *, atan2(dx, -dz) - rot_y as a from b)
     select session, frame, {r('sqrt(dx * dx + dz * dz)')} as distance, sqrt(dx * dx + dz * dz) < 2 as arrived,
       {r('a - 2 * pi() * floor((a + pi()) / (2 * pi()))')} as bearing from a""")
def distance_bearing(spark, sf):
    distance, arrived, bearing = T.distance_bearing(F.col("x"), F.col("z"), F.col("rot_y"), F.lit(2.5), F.lit(1.25))
    return view(spark, sf, "track").select(
        "session",
        "frame",
        rounded(distance).alias("distance"),
        arrived.alias("arrived"),
        rounded(bearing).alias("bearing"),
    )


@add("near_any_previous", """with t as (select session % 4 as store, frame as ord, x, z from {wide_track})
     select a.store, a.ord, a.ord = (select min(ord) from t b where b.store = a.store) or exists (
        select 1 from t b where b.store = a.store and b.ord < a.ord and sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) < 3) as near
     from t a""")
def near_any_previous(spark, sf):
    rows = view(spark, sf, "wide_track").select((F.col("session") % 4).alias("store"), F.col("frame").alias("ord"), "x", "z")
    return T.near_any_previous(rows, keys=("store",)).select("store", "ord", "near")


@add("nearest_to_target", f"""with d as (select session, frame,
        sqrt((x - 1) * (x - 1) + (z - 0.5e0) * (z - 0.5e0)) as d from {{track}}),
     q as (select *, row_number() over (partition by session order by d, frame) as rn from d)
     select session, frame, {r('d')} as distance from q where rn = 1""")
def nearest_to_target(spark, sf):
    return T.nearest_to_target(view(spark, sf, "track"), "session", "frame", 1.0, 0.5).select(
        "session", "frame", rounded("distance").alias("distance")
    )


@add("coverage_loops_gaps", """with n as (select session, x, z, row_number() over w as n,
        lag(x) over w as px, lag(z) over w as pz from {wide_track} window w as (partition by session order by frame)),
     s as (select session, count(distinct (floor(x), floor(z))) as cells,
             count(*) filter (sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) > 1) as gaps from n group by session),
     b as (select distinct a.session, a.n from n a join n b on a.session = b.session and a.n - b.n >= 10
             and sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) < 1.5e0)
     select s.*, (select count(*) from b where b.session = s.session) as returns from s""")
def coverage_loops_gaps(spark, sf):
    return T.coverage_loops_gaps(view(spark, sf, "wide_track").drop("ts"), "session", "frame")


@add("mean_camera_height", f"""with s as (select session % 4 as map_id, session, max(ts) as ended, avg(y) as h
        from {{track}} group by 1, 2),
     q as (select *, row_number() over (partition by map_id order by ended desc, session desc) as rn from s)
     select map_id, {r('coalesce(h, 0e0)')} as height from q where rn = 1""")
def mean_camera_height(spark, sf):
    per_session = (
        view(spark, sf, "track")
        .groupBy((F.col("session") % 4).alias("map_id"), "session")
        .agg(F.max("ts").alias("ended"), F.avg("y").alias("h"))
    )
    return per_session.groupBy("map_id").agg(
        rounded(F.coalesce(F.max_by("h", F.struct("ended", "session")), F.lit(0.0))).alias("height")
    )


@add("downsample_random", """select map_id, point_id, x, y, z from {point}
   qualify row_number() over (partition by map_id order by md5('7:' || point_id), point_id) <= 1000""")
def downsample_random(spark, sf):
    return T.downsample(view(spark, sf, "point"), "map_id", "point_id", 1000, seed=7).select("map_id", "point_id", "x", "y", "z")
