"""Descriptors: the embeddings table as frames of ten maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.functions.similarity import token_set_ratio
from aislewise.operators import alignment as A
from aislewise.operators import vectors as V
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add

UNIT_SQL = """u as (select frame, map_id, list_transform(vec, lambda v: cast(v as double) /
     sqrt(list_inner_product(cast(vec as double[]), cast(vec as double[])))) as vec from {descriptor})"""
PAIR_SQL = f"""with {UNIT_SQL}, s as (select a.frame as query_id, b.frame as base_id, b.map_id,
     list_inner_product(a.vec, b.vec) as score from u a join u b on a.frame <> b.frame),
   k as (select *, cast(row_number() over (partition by query_id order by score desc, base_id) as int) as rank from s)"""


def frames(spark, sf):
    return view(spark, sf, "descriptor")


def sides(spark, sf):
    rows = frames(spark, sf)
    return rows.select(F.col("frame").alias("query_id"), "vec"), rows.select(F.col("frame").alias("base_id"), "vec")


@add("vector_topk", PAIR_SQL + f" select query_id, base_id, {r('score')} as score, rank from k where rank <= 8")
def vector_topk(spark, sf):
    return V.vector_topk(*sides(spark, sf), 8, skip_self=True).withColumn("score", rounded("score"))


@add("ratio_test_2nn", PAIR_SQL + f""" select a.query_id, a.base_id, {r('a.score')} as s1, {r('b.score')} as s2
   from k a join k b on a.query_id = b.query_id and a.rank = 1 and b.rank = 2
   where a.score > 0.5e0 and b.score > 0.001e0 and a.score / b.score > 1.02e0""")
def ratio_test_2nn(spark, sf):
    out = V.ratio_test(*sides(spark, sf), skip_self=True, ratio=1.02)
    return out.select("query_id", "base_id", rounded("s1").alias("s1"), rounded("s2").alias("s2"))


@add("mean_descriptor", f"""with e as (select map_id, unnest(vec) as v, unnest(range(len(vec))) as pos from {{descriptor}}),
   m as (select map_id, pos, avg(cast(v as double)) as v from e group by 1, 2),
   n as (select map_id, sqrt(sum(v * v)) as norm from m group by 1)
   select map_id, pos, {r('v / norm')} as value from m join n using (map_id)""")
def mean_descriptor(spark, sf):
    out = V.mean_descriptor(frames(spark, sf), "map_id")
    return out.select("map_id", F.posexplode("vec").alias("pos", "v")).select(
        "map_id", F.col("pos").cast("long").alias("pos"), rounded("v").alias("value")
    )


@add("image_vector_match", PAIR_SQL + f""" select query_id, base_id, {r('score')} as similarity,
   case when score >= 0.83e0 and query_id % 10 = base_id % 10 then 'hög' when score >= 0.80e0 then 'medium'
        when 50 + query_id % 50 >= 90 then 'medium' else 'låg' end as level from k where rank = 1""")
def image_vector_match(spark, sf):
    best = V.vector_topk(*sides(spark, sf), 3, skip_self=True).filter("rank = 1")

    def name(i):
        # Names agree exactly or not at all: one word spelled from the last digit.
        return F.repeat(F.substring(F.lit("abcdefghij"), (i % 10 + 1).cast("int"), F.lit(1)), F.lit(6))

    agreement = token_set_ratio(name(F.col("query_id")), name(F.col("base_id")))
    rows = best.withColumn("_agree", agreement)
    level = V.fused_confidence(F.col("score"), F.col("_agree"), F.lit(50) + F.col("query_id") % 50)
    return rows.select("query_id", "base_id", rounded("score").alias("similarity"), level.alias("level"))


@add("frame_match_pool", PAIR_SQL + """, c as (select query_id, map_id as frame, count(*) as n from k
      where rank <= 40 group by 1, 2),
   b as (select query_id, max(n) as best from c group by 1)
   select c.query_id, cast(coalesce(sum(n) filter (n >= 6 and n >= greatest(8, best // 2)), 0) as bigint) as pooled,
     count(*) filter (n >= 6 and n >= greatest(8, best // 2)) as frames,
     coalesce(sum(n) filter (n >= 6 and n >= greatest(8, best // 2)), 0) >= 10 as found
   from c join b using (query_id) group by 1""")
def frame_match_pool(spark, sf):
    hits = V.vector_topk(*sides(spark, sf), 40, skip_self=True)
    maps = frames(spark, sf).select(F.col("frame").alias("base_id"), F.col("map_id").alias("frame"))
    counts = hits.join(maps, "base_id").groupBy("query_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return V.frame_match_pool(counts)


@add("correspondence_pairs", f"""with {UNIT_SQL}, l as (select * from u where map_id < 5), q as (select * from u where map_id >= 5),
   s as (select l.frame as left_id, q.frame as right_id, list_inner_product(l.vec, q.vec) as score,
     l.vec[1] as sx, q.vec[1] as dx from l, q),
   a as (select *, row_number() over (partition by left_id order by score desc, right_id) as ra,
     row_number() over (partition by right_id order by score desc, left_id) as rb from s)
   select left_id, right_id, {r('score')} as score from a where ra = 1 and rb = 1 and left_id % 7 > 0""")
def correspondence_pairs(spark, sf):
    rows = frames(spark, sf).select(
        F.col("frame").alias("id"),
        "map_id",
        "vec",
        F.when(F.col("frame") % 7 > 0, F.col("vec")[0]).alias("x"),
        F.col("vec")[1].alias("y"),
        F.col("vec")[2].alias("z"),
    )
    right = rows.filter("map_id >= 5").withColumn("x", F.col("vec")[0])
    out = V.correspondence_pairs(rows.filter("map_id < 5").drop("map_id"), right.drop("map_id"))
    return out.select("left_id", "right_id", rounded("score").alias("score"))


def pairs(spark, sf, noisy: bool):
    """First three numbers as source; the target is turned 0.5 rad about y and moved by (1, 2, 3)."""
    c, s = math.cos(0.5), math.sin(0.5)
    rows = frames(spark, sf).select(
        F.col("map_id").cast("long").alias("session"),
        F.col("frame").alias("pair_id"),
        *[(F.col("vec")[i].cast("double") * 10).alias(n) for i, n in enumerate(("sx", "sy", "sz"))],
        (F.col("vec")[3].cast("double") * 5).alias("off"),
    )
    bad = (F.col("pair_id") % 5 == 0) | ((F.col("session") == 9) & (F.col("pair_id") % 4 > 0)) if noisy else F.lit(False)
    off = F.when(bad, F.col("off") + 4.0).otherwise(0.0)
    return rows.select(
        "session",
        "pair_id",
        "sx",
        "sy",
        "sz",
        (c * F.col("sx") + s * F.col("sz") + 1.0 + off).alias("dx"),
        (F.col("sy") + 2.0 + off).alias("dy"),
        (-s * F.col("sx") + c * F.col("sz") + 3.0 - off).alias("dz"),
    )


@add("rigid_fit_sums", f"""with p as (select map_id, cast(vec[1] as double) * 10 as sx, cast(vec[2] as double) * 10 as sy,
      cast(vec[3] as double) * 10 as sz from {{descriptor}}),
   d as (select *, cos(0.5e0) * sx + sin(0.5e0) * sz + 1 as dx, sy + 2 as dy, -sin(0.5e0) * sx + cos(0.5e0) * sz + 3 as dz from p)
   select cast(map_id as bigint) as session, count(*) as n, {r('sum(sx)')} as s_sx, {r('sum(dz)')} as s_dz,
     {r('sum(sx * dx)')} as p_sxdx, {r('sum(sz * dy)')} as p_szdy from d group by map_id""")
def rigid_fit_sums(spark, sf):
    sums = A.fit_sums(pairs(spark, sf, False), "session")
    return sums.select("session", "n", *[rounded(c).alias(c) for c in ("s_sx", "s_dz", "p_sxdx", "p_szdy")])


@add("rigid_fit", f"""select cast(map_id as bigint) as session, count(*) as n, {r('cos(0.5e0)')} as r00, {r('sin(0.5e0)')} as r02,
   {r('1e0')} as tx, {r('2e0')} as ty, {r('3e0')} as tz from {{descriptor}} group by map_id having count(*) >= 3""")
def rigid_fit(spark, sf):
    out = A.rigid_fit(pairs(spark, sf, False), "session")
    t = F.col("transform")
    return out.select(
        "session",
        "n",
        *[rounded(t[i]).alias(n) for i, n in ((0, "r00"), (8, "r02"), (12, "tx"), (13, "ty"), (14, "tz"))],
    )


@add("ransac_rigid")
def ransac_rigid(spark, sf):
    out = A.ransac_rigid(pairs(spark, sf, True), "session", "pair_id")
    return out.withColumn("tx", rounded(F.col("transform")[12])).drop("transform")


@add("merge_session")
def merge_session(spark, sf):
    noisy = pairs(spark, sf, True)
    incoming = noisy.select(
        "session", F.col("pair_id").alias("frame"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")
    )
    existing = view(spark, sf, "point").select(F.col("point_id").alias("frame"), "x", "y", "z")
    merged, log = A.merge_session(existing, incoming, noisy)
    counts = merged.filter("session is not null").groupBy("session").agg(
        F.count(F.lit(1)).alias("merged"), F.min("frame").alias("first_frame")
    )
    return log.join(counts, "session", "left")
