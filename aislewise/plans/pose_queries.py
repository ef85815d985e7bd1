"""Pose, projection and calibration expressions on events read as camera poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.operators import poses as P
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add

# Pose: turn a about y, then tilt q about x; place (tx, ty, tz).  Point (px, py, pz).
POSE_SQL = """p as (select event_id, radians(cast(event_id % 360 as double)) as a, radians(cast(event_id % 20 as double) - 10) as q,
   value / 10e0 as tx, cast(event_id % 250 as double) / 100 as ty, cast(props->>'k' as int) / 10e0 as tz,
   value / 25e0 as px, cast(event_id % 30 as double) / 10 as py, cast(event_id % 70 as double) / 5 as pz from {events}),
 m as (select *, cos(a) as r00, sin(a) * sin(q) as r01, sin(a) * cos(q) as r02, 0e0 as r10, cos(q) as r11, -sin(q) as r12,
   -sin(a) as r20, cos(a) * sin(q) as r21, cos(a) * cos(q) as r22 from p)"""


def poses(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    rows = view(spark, sf, "events").select(
        "event_id",
        F.radians((e % 360).cast("double")).alias("a"),
        F.radians((e % 20).cast("double") - 10).alias("q"),
        (F.col("value") / 10.0).alias("tx"),
        ((e % 250).cast("double") / 100).alias("ty"),
        (k / 10.0).alias("tz"),
        (F.col("value") / 25.0).alias("px"),
        ((e % 30).cast("double") / 10).alias("py"),
        ((e % 70).cast("double") / 5).alias("pz"),
    )
    ca, sa, cq, sq = F.cos("a"), F.sin("a"), F.cos("q"), F.sin("q")
    zero = F.lit(0.0)
    t = F.array(
        ca, zero, -sa, zero, sa * sq, cq, ca * sq, zero, sa * cq, -sq, ca * cq, zero, "tx", "ty", "tz", F.lit(1.0)
    )
    return rows.withColumn("t", t)


def out(df, *key, **cols):
    return df.select(*key, *[rounded(c).alias(n) for n, c in cols.items()])


def cols(**exprs):
    return ", ".join(f"{r(e)} as {n}" for n, e in exprs.items())


def px():
    return F.col("px")


def py():
    return F.col("py")


def pz():
    return F.col("pz")



@add("transform_points", f"with {POSE_SQL} select event_id, " + cols(
    x="case when event_id % 6 = 0 then px else r00 * px + r01 * py + r02 * pz + tx end",
    z="case when event_id % 6 = 0 then pz else r20 * px + r21 * py + r22 * pz + tz end") + " from m")
def transform_points(spark, sf):
    rows = poses(spark, sf)
    points = rows.select(
        "event_id",
        F.col("px").alias("x"),
        F.when(F.col("event_id") % 6 > 0, F.col("py")).alias("y"),
        F.col("pz").alias("z"),
    )
    moved = P.transform_points(points, rows.select("event_id", "t"), "event_id", "t")
    return out(moved, "event_id", x=F.col("x"), z=F.col("z"))


@add("rigid_inverse", f"with {POSE_SQL} select event_id, " + cols(
    m02="r20", m10="r01", ix="-(r00 * tx + r10 * ty + r20 * tz)", iy="-(r01 * tx + r11 * ty + r21 * tz)",
    iz="-(r02 * tx + r12 * ty + r22 * tz)") + " from m")
def rigid_inverse(spark, sf):
    rows = poses(spark, sf).withColumn("i", P.rigid_inverse("t"))
    i = F.col("i")
    return out(rows, "event_id", m02=i[8], m10=i[1], ix=i[12], iy=i[13], iz=i[14])


@add("camera_centre", f"with {POSE_SQL} select event_id, " + cols(
    x="-(r00 * tx + r10 * ty + r20 * tz)", y="-(r01 * tx + r11 * ty + r21 * tz)", z="-(r02 * tx + r12 * ty + r22 * tz)")
    + " from m")
def camera_centre(spark, sf):
    x, y, z = P.camera_centre("t")
    return out(poses(spark, sf), "event_id", x=x, y=y, z=z)


@add("project_points", f"""with {POSE_SQL}, c as (select event_id, px - tx as x, py - ty as y, pz - tz as z, m.* exclude (event_id) from m),
   v as (select event_id, r00 * x + r10 * y + r20 * z as cx, r01 * x + r11 * y + r21 * z as cy, -(r02 * x + r12 * y + r22 * z) as d from c)
   select event_id, """ + cols(u="1440 - (900 * -cy / d + 720)", v="910 * cx / d + 960", depth="d") + " from v where d > 0.1e0")
def project_points(spark, sf):
    rows = poses(spark, sf).withColumn("i", P.rigid_inverse("t"))
    u, v, d = P.project_to_portrait(
        "i", px(), py(), pz(), F.lit(910.0), F.lit(900.0), F.lit(960.0), F.lit(720.0), F.lit(1440.0)
    )
    seen = rows.select("event_id", u.alias("u"), v.alias("v"), d.alias("depth")).filter("depth > 0.1")
    return out(seen, "event_id", u=F.col("u"), v=F.col("v"), depth=F.col("depth"))


@add("backproject_box", f"""with {POSE_SQL}, c as (select *, (px * 20 - 960) * (1 + py) / 910 as cx,
     -((1440 - pz * 50) - 720) * (1 + py) / 900 as cy, -(1 + py) as cz from m) select event_id, """ + cols(
    x="r00 * cx + r01 * cy + r02 * cz + tx", y="r10 * cx + r11 * cy + r12 * cz + ty", z="r20 * cx + r21 * cy + r22 * cz + tz")
    + " from c")
def backproject_box(spark, sf):
    x, y, z = P.backproject(
        "t", pz() * 50, px() * 20, py() + 1, F.lit(910.0), F.lit(900.0), F.lit(960.0), F.lit(720.0), F.lit(1440.0)
    )
    return out(poses(spark, sf), "event_id", x=x, y=y, z=z)


@add("yaw_of", f"with {POSE_SQL} select event_id, " + cols(yaw="atan2(-r02 + 0e0, -r22 + 0e0)") + " from m")
def yaw_of(spark, sf):
    return out(poses(spark, sf), "event_id", yaw=P.yaw_of("t"))


@add("fallback_place", f"with {POSE_SQL}, y as (select *, atan2(-r02 + 0e0, -r22 + 0e0) as yaw from m) select event_id, " + cols(
    x="tx + (1 + py) * sin(yaw)", y="ty - 0.3e0", z="tz + (1 + py) * cos(yaw)") + " from y")
def fallback_place(spark, sf):
    x, y, z = P.fallback_place("t", py() + 1)
    return out(poses(spark, sf), "event_id", x=x, y=y, z=z)


@add("yaw_only_map", f"""with {POSE_SQL}, y as (select *, atan2(-r02 + 0e0, -r22 + 0e0) as yaw, px - 1 as dx, pz - 2 as dz from m) select event_id, """ + cols(
    x="r00 * 1 + r01 * 1.5e0 + r02 * 2 + tx + cos(yaw) * dx + sin(yaw) * dz", y="0.75e0 + (py - 1.5e0)",
    z="r20 * 1 + r21 * 1.5e0 + r22 * 2 + tz - sin(yaw) * dx + cos(yaw) * dz") + " from y")
def yaw_only_map(spark, sf):
    x, y, z = P.yaw_only_map("t", (px(), py(), pz()), (F.lit(1.0), F.lit(1.5), F.lit(2.0)), F.lit(0.75))
    return out(poses(spark, sf), "event_id", x=x, y=y, z=z)


@add("yaw_lock", f"""with {POSE_SQL}, y as (select *, atan2(r02 - r20, r00 + r22) as w from m) select event_id, """ + cols(
    c="cos(w)", s="sin(w)", x="tx - (cos(w) * px + sin(w) * pz)", y="ty - py", z="tz - (-sin(w) * px + cos(w) * pz)") + " from y")
def yaw_lock(spark, sf):
    rows = poses(spark, sf).withColumn(
        "l", P.yaw_lock("t", (px(), py(), pz()), (F.col("tx"), F.col("ty"), F.col("tz")))
    )
    m = F.col("l")
    return out(rows, "event_id", c=m[0], s=m[8], x=m[12], y=m[13], z=m[14])


@add("euler_angles", f"""with {POSE_SQL}, e as (select *, sqrt(r00 * r00 + r10 * r10) as sy from m) select event_id, """ + cols(
    roll="case when sy > 1e-6 then atan2(r21 + 0e0, r22 + 0e0) else atan2(-r12 + 0e0, r11) end", pitch="atan2(-r20 + 0e0, sy)",
    yaw="case when sy > 1e-6 then atan2(-r20 + 0e0, -r22 + 0e0) else 0e0 end") + " from e where sy > 1e-4")
def euler_angles(spark, sf):
    # A camera seen exactly edge-on has no stable roll; both sides leave those rows out.
    t = F.col("t")
    rows = poses(spark, sf).filter(F.sqrt(t[0] * t[0] + t[1] * t[1]) > 1e-4)
    roll, pitch, yaw = P.euler_angles("t")
    return out(rows, "event_id", roll=roll, pitch=pitch, yaw=yaw)


@add("tilt_degrees", f"with {POSE_SQL} select event_id, " + cols(tilt="degrees(acos(greatest(-1e0, least(1e0, r11))))")
     + " from m where r11 < 0.99999e0")
def tilt_degrees(spark, sf):
    return out(poses(spark, sf).filter(F.col("t")[5] < 0.99999), "event_id", tilt=P.tilt_degrees("t"))


@add("pose_axes_flip", f"with {POSE_SQL} select event_id, " + cols(
    m00="r00", m01="-r01", m02="-r02", m22="-r22", tx="tx") + " from m")
def pose_axes_flip(spark, sf):
    rows = poses(spark, sf).withColumn("f", P.axes_flip("t"))
    m = F.col("f")
    return out(rows, "event_id", m00=m[0], m01=m[4], m02=m[8], m22=m[10], tx=m[12])


@add("quaternion_roundtrip", f"with {POSE_SQL} select event_id, " + cols(
    m00="r00", m02="r02", m11="r11", m12="r12", m21="r21", norm="1e0") + " from m")
def quaternion_roundtrip(spark, sf):
    rows = poses(spark, sf).withColumn("quat", P.to_quaternion("t")).withColumn("b", P.from_quaternion("quat"))
    b = F.col("b")
    norm = F.aggregate("quat", F.lit(0.0), lambda acc, v: acc + v * v)
    return out(rows, "event_id", m00=b[0], m02=b[6], m11=b[4], m12=b[7], m21=b[5], norm=norm)


@add("camera_to_map_euler", f"""with {POSE_SQL}, o as (select event_id, tx, ty, tz, degrees(q) as roll, cast(event_id % 40 as double) as pitch,
     degrees(a) as yaw, px, py, pz from m),
   s1 as (select *, px as x1, cos(radians(roll)) * py - sin(radians(roll)) * pz as y1, sin(radians(roll)) * py + cos(radians(roll)) * pz as z1 from o),
   s2 as (select *, cos(radians(pitch)) * x1 + sin(radians(pitch)) * z1 as x2, -sin(radians(pitch)) * x1 + cos(radians(pitch)) * z1 as z2 from s1)
   select event_id, """ + cols(x="cos(radians(yaw)) * x2 - sin(radians(yaw)) * y1 + tx",
                               y="sin(radians(yaw)) * x2 + cos(radians(yaw)) * y1 + ty", z="z2 + tz") + " from s2")
def camera_to_map_euler(spark, sf):
    x, y, z = P.euler_to_map(
        F.degrees("q"),
        (F.col("event_id") % 40).cast("double"),
        F.degrees("a"),
        (F.col("tx"), F.col("ty"), F.col("tz")),
        (px(), py(), pz()),
    )
    return out(poses(spark, sf), "event_id", x=x, y=y, z=z)


@add("shelf_position", f"with {POSE_SQL} select event_id, " + cols(
    x="case when py > 0.1e0 then tx + py * sin(a) else tx end", z="case when py > 0.1e0 then tz + py * cos(a) else tz end") + " from m")
def shelf_position(spark, sf):
    x, z = P.shelf_position(F.col("tx"), F.col("tz"), F.col("a"), py())
    return out(poses(spark, sf), "event_id", x=x, z=z)


@add("drift_precision", f"""with {POSE_SQL}, d as (select *, ty as l, ty + (event_id % 7) / 10e0 as rr,
     ty > 0.1e0 and ty + (event_id % 7) / 10e0 > 0.1e0 and abs(ty - (ty + (event_id % 7) / 10e0)) < 0.3e0 and py > 0.1e0 as par from m)
   select event_id, case when par then 'hög' when py > 0.1e0 then 'medium' else 'låg' end as level, """ + cols(
    x="case when par then tx + least(l, rr, py) * sin(a) else tx end") + " from d")
def drift_precision(spark, sf):
    right = F.col("ty") + (F.col("event_id") % 7) / F.lit(10.0)
    x, _, level = P.drift_corrected(F.col("tx"), F.col("tz"), F.col("a"), F.col("ty"), right, py())
    return poses(spark, sf).select("event_id", level.alias("level"), rounded(x).alias("x"))


# Calibration: every supplier marks points of its store; the map is known.
AFFINE = [50.0, 2.0, 100.0, -3.0, -50.0, 500.0]
HOMOGRAPHY = [50.0, 2.0, 100.0, -3.0, -50.0, 500.0, 0.001, 0.002, 1.0]


def literal(values):
    return F.array(*[F.lit(v) for v in values])


@add("apply_affine", f"with {POSE_SQL} select event_id, " + cols(
    u="50 * px + 2 * pz + 100", v="-3 * px - 50 * pz + 500", x="px", z="pz") + " from m")
def apply_affine(spark, sf):
    rows = poses(spark, sf).withColumn("m", literal(AFFINE)).withColumn("i", P.affine_inverse("m"))
    u, v = P.affine_apply("m", px(), pz())
    rows = rows.withColumn("u", u).withColumn("v", v)
    x, z = P.affine_apply("i", F.col("u"), F.col("v"))
    return out(rows, "event_id", u=F.col("u"), v=F.col("v"), x=x, z=z)


@add("apply_homography", f"with {POSE_SQL}, w as (select *, 0.001e0 * px + 0.002e0 * pz + 1 as w from m) select event_id, " + cols(
    u="(50 * px + 2 * pz + 100) / w", v="(-3 * px - 50 * pz + 500) / w", x="px", z="pz") + " from w")
def apply_homography(spark, sf):
    rows = poses(spark, sf).withColumn("m", literal(HOMOGRAPHY)).withColumn("i", P.homography_inverse("m"))
    u, v = P.homography_apply("m", px(), pz())
    rows = rows.withColumn("u", u).withColumn("v", v)
    x, z = P.homography_apply("i", F.col("u"), F.col("v"))
    return out(rows, "event_id", u=F.col("u"), v=F.col("v"), x=x, z=z)


@add("fit_affine3", "select s_suppkey, " + cols(
    a="50e0 + s_nationkey", b="2e0", c="100e0 + s_suppkey % 9", d="-3e0", e="-50e0", f="500e0") + " from {supplier}")
def fit_affine3(spark, sf):
    rows = view(spark, sf, "supplier")
    a, c = F.lit(50.0) + F.col("s_nationkey"), F.lit(100.0) + F.col("s_suppkey") % 9

    def at(x, y):
        return a * x + 2.0 * y + c, F.lit(-3.0 * x - 50.0 * y + 500.0)

    spots = [(0.0, 0.0), (10.0, 0.0), (0.0, 8.0)]
    fit = P.fit_affine([(F.lit(x), F.lit(y)) for x, y in spots], [at(x, y) for x, y in spots])
    rows = rows.withColumn("m", fit)
    m = F.col("m")
    return out(rows, "s_suppkey", **{n: m[i] for i, n in enumerate("abcdef")})


MARK_SQL = """marks as (select s_nationkey as store, s_suppkey, cast(s_suppkey % 17 as double) as x, cast(s_suppkey % 13 as double) as y,
   50 * cast(s_suppkey % 17 as double) + 2 * cast(s_suppkey % 13 as double) + 100 as pu,
   -3 * cast(s_suppkey % 17 as double) - 50 * cast(s_suppkey % 13 as double) + 500 as pv, cast(s_suppkey % 41 as double) as off from {supplier})"""


def marks(spark, sf):
    k = F.col("s_suppkey")
    rows = view(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("store"),
        (k % 17).cast("double").alias("x"),
        (k % 13).cast("double").alias("y"),
        (k % 41).cast("double").alias("off"),
    )
    pu, pv = P.affine_apply(literal(AFFINE), F.col("x"), F.col("y"))
    return rows.withColumn("pu", pu).withColumn("pv", pv)


@add("calibration_error", f"""with {MARK_SQL}, s as (select store, avg(off) as m, max(off) as x from marks group by 1)
   select store, {r('m')} as mean_error, {r('x')} as max_error,
     case when m < 10 then 'bra' when m < 30 then 'ok' when m < 60 then 'svag' else 'dålig' end as quality from s""")
def calibration_error(spark, sf):
    rows = marks(spark, sf).withColumn("u", F.col("pu") + F.col("off") * 0.6).withColumn(
        "v", F.col("pv") - F.col("off") * 0.8
    )
    res = P.calibration_error(rows, "store")
    return res.select(
        "store", rounded("mean_error").alias("mean_error"), rounded("max_error").alias("max_error"), "quality"
    )


@add("fit_homography")
def fit_homography(spark, sf):
    rows = marks(spark, sf)
    u, v = P.homography_apply(literal(HOMOGRAPHY), F.col("x"), F.col("y"))
    fit = P.fit_homography(rows.select("store", "x", "y", u.alias("u"), v.alias("v")), "store")
    m = F.col("matrix")
    return fit.select("store", "n", *[rounded(m[i], 2).alias(f"m{i}") for i in range(8)])


@add("store_status", f"""with {MARK_SQL}, s as (select store, count(*) as n, avg(off) as m from marks group by 1)
   select n_nationkey as store, n_nationkey % 3 = 0 as has_image, n >= 3 as calibrated, coalesce(n, 0) as points,
     {r('coalesce(m, -1e0)')} as quality from (select n_nationkey, coalesce(n, 0) as n, m from {{nation}} left join s on s.store = n_nationkey)""")
def store_status(spark, sf):
    points = marks(spark, sf).groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.avg("off").alias("m"))
    nation = view(spark, sf, "nation").select(F.col("n_nationkey").alias("store"))
    images = nation.filter("store % 3 = 0").withColumn("_img", F.lit(True))
    rows = nation.join(images, "store", "left").join(points, "store", "left")
    return rows.select(
        "store",
        F.col("_img").isNotNull().alias("has_image"),
        (F.coalesce("n", F.lit(0)) >= 3).alias("calibrated"),
        F.coalesce("n", F.lit(0)).alias("points"),
        rounded(F.coalesce("m", F.lit(-1.0))).alias("quality"),
    )


