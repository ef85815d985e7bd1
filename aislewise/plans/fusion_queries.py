"""Sightings of products: events read as observations, parts as label boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.operators import clusters as C
from aislewise.operators import fusion as U
from aislewise.operators.seeds import greedy_seeds
from aislewise.operators import neighbours as N
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add

GRID_ROWS = """g as (select *, map_id || '_' || cast(floor(x / 2) as int) || '_' || cast(floor(z / 2) as int) as place,
     case confidence when 'hög' then 3 when 'medium' then 2 else 1 end as w from {observation})"""

VOTE_SQL = f"""with {GRID_ROWS},
    n as (select place, name, sum(w) as votes, min(ord) as first_ord from g group by 1, 2),
    win as (select *, row_number() over (partition by place order by votes desc, first_ord) as rn from n),
    det as (select place, name, confidence, row_number() over (partition by place, name order by w desc, ord) as rn from g),
    t as (select place, count(*) as seen, avg(x) as x, avg(y) as y, avg(z) as z, sum(w) as all_votes,
                 count(distinct name) as n_names from g group by 1),
    voted as (select t.place, win.name, det.confidence, x, y, z, cast(win.votes as bigint) as votes, seen,
            win.votes / cast(all_votes as double) as share, n_names
     from t join win on win.place = t.place and win.rn = 1
     join det on det.place = t.place and det.name = win.name and det.rn = 1)"""


def grid_rows(spark, sf):
    place = F.concat_ws(
        "_",
        "map_id",
        F.floor(F.col("x") / 2).cast("int").cast("string"),
        F.floor(F.col("z") / 2).cast("int").cast("string"),
    )
    return view(spark, sf, "observation").withColumn("place", place)


@add("weighted_vote", VOTE_SQL + f""" select place, name, confidence, {r('x')} as x, {r('y')} as y, {r('z')} as z,
     votes, seen, {r('share')} as share, n_names from voted""")
def weighted_vote(spark, sf):
    out = U.weighted_vote(grid_rows(spark, sf), ["place"])
    return out.select(
        "place",
        "name",
        "confidence",
        *[rounded(c).alias(c) for c in "xyz"],
        F.col("votes").cast("long").alias("votes"),
        "seen",
        rounded("share").alias("share"),
        F.size("candidates").cast("long").alias("n_names"),
    )


@add("confidence_buckets", VOTE_SQL + """ select split_part(place, '_', 1) as map_id, count(*) filter (share > 0.7e0) as high,
     count(*) filter (share > 0.4e0 and share <= 0.7e0) as medium, count(*) filter (share <= 0.4e0) as low
     from voted group by 1""")
def confidence_buckets(spark, sf):
    voted = U.weighted_vote(grid_rows(spark, sf), ["place"])
    return U.confidence_buckets(voted.withColumn("map_id", F.split_part("place", F.lit("_"), F.lit(1))), ["map_id"])


@add("consolidate", f"""with g as (select *, cast(floor(x / 3) as int) as cluster,
        case confidence when 'hög' then 3 when 'medium' then 2 else 1 end as rank,
        greatest(score, 0.001e0) as w from {{observation}}),
     m as (select map_id, product_id, cluster, max(rank) as top, count(*) as n_seen from g group by all)
     select map_id, product_id, cluster, min_by(name, ord) as name, {r('sum(w * x) / sum(w)')} as x,
        {r('sum(w * y) / sum(w)')} as y, {r('sum(w * z) / sum(w)')} as z,
        case top when 3 then 'hög' when 2 then 'medium' else 'låg' end as confidence,
        n_seen, count(*) as n_used, max(score) as best_score
     from g join m using (map_id, product_id, cluster) where rank = top
     group by map_id, product_id, cluster, top, n_seen""")
def consolidate(spark, sf):
    rows = view(spark, sf, "observation").withColumn("cluster", F.floor(F.col("x") / 3).cast("int"))
    out = U.consolidate(rows, ["map_id", "product_id", "cluster"])
    return out.select(
        "map_id",
        "product_id",
        "cluster",
        "name",
        *[rounded(c).alias(c) for c in "xyz"],
        "confidence",
        "n_seen",
        "n_used",
        "best_score",
    )


@add("spatial_cluster")
def spatial_cluster(spark, sf):
    return C.spatial_cluster(view(spark, sf, "observation"), ["map_id", "product_id"]).select(
        "map_id", "product_id", "ord", "cluster"
    )


@add("consolidate_places")
def consolidate_places(spark, sf):
    return U.consolidate_products(view(spark, sf, "observation"), ["map_id", "product_id"])


def seeds_sql(rows, radius, axes):
    """Recursive rounds: an open row without an earlier open or seed row in reach is a seed, one that a seed reaches is
    covered.  Ends in ``g`` (map_id, ord, seed)."""
    near = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in axes)
    return f"""p as materialized ({rows}),
   e as materialized (select a.map_id, a.ord as early, b.ord as late from p a join p b on a.map_id = b.map_id and a.ord < b.ord
      and b.x between a.x - {radius} and a.x + {radius} and {near} < {radius}e0 * {radius}e0),
   st(map_id, ord, state) using key (map_id, ord) as (
      select map_id, ord, case when ord in (select late from e) then 0 else 1 end from p
      union
      select r.map_id, r.ord, case when bool_or(o.state = 1) then 2 else 1 end from recurring.st r
        join e on e.map_id = r.map_id and e.late = r.ord join recurring.st o on o.map_id = e.map_id and o.ord = e.early
      where r.state = 0 group by 1, 2 having bool_or(o.state = 1) or bool_and(o.state = 2)),
   g as (select s.map_id, s.ord, coalesce(min(o.ord), s.ord) as seed from st s left join (select e.map_id, early, late from e
      join st on st.map_id = e.map_id and st.ord = early and state = 1) f on f.map_id = s.map_id and f.late = s.ord
      left join st o on o.map_id = f.map_id and o.ord = f.early group by 1, s.ord)"""


SEEN_SQL = seeds_sql("select map_id, ord, x, z from {observation}", 0.5, "xz")


@add("radius_group", f"with recursive {SEEN_SQL} select map_id, ord, seed from g")
def radius_group(spark, sf):
    return greedy_seeds(view(spark, sf, "observation"), ["map_id"]).select("map_id", "ord", "seed")


@add("vote_places")
def vote_places(spark, sf):
    return U.vote_places(view(spark, sf, "observation"), ["map_id"]).drop("candidates")


@add("multi_view_points", f"""with recursive {seeds_sql("select map_id, point_id as ord, x, y, z from {point}", 0.05, "xyz")}
   select g.map_id, seed, count(*) as n_seen, min_by(x, p.ord) as x, min_by(y, p.ord) as y, min_by(z, p.ord) as z
   from g join p on p.map_id = g.map_id and p.ord = g.ord group by 1, 2 having count(*) >= 2""")
def multi_view_points(spark, sf):
    points = view(spark, sf, "point").select("map_id", F.col("point_id").alias("ord"), "x", "y", "z", "frame")
    seeds = greedy_seeds(points, ["map_id"], "ord", 0.05, ("x", "y", "z"))
    return (
        points.join(seeds.select("map_id", "ord", "seed").hint("merge"), ["map_id", "ord"])
        .groupBy("map_id", "seed")
        .agg(F.count(F.lit(1)).alias("n_seen"), F.min_by(F.struct("x", "y", "z"), "ord").alias("_p"))
        .filter("n_seen >= 2")
        .select("map_id", "seed", "n_seen", "_p.*")
    )


@add("merge_nearby_same_name")
def merge_nearby_same_name(spark, sf):
    return U.merged_places(view(spark, sf, "observation"), ["map_id", "name"])


@add("apply_corrections", f"""with p as (select map_id || '/' || product_id as position_id, min_by(name, ord) as name,
        avg(x) as x, avg(z) as z, max(confidence) as confidence from {{observation}} group by 1),
     c as (select map_id || '/' || product_id as position_id, max_by(name || '!', ord) filter (frame % 3 = 0) as name,
        max_by(z, ord) filter (frame % 2 = 0) as x, cast(null as double) as z
        from {{observation}} where confidence = 'hög' and frame % 10 < 5 and map_id <> 'm3' group by 1)
     select position_id, coalesce(c.name, p.name) as name, {r('coalesce(c.x, p.x)')} as x, {r('p.z')} as z,
        c.position_id is not null as corrected, case when c.position_id is not null then 'hög' else confidence end as confidence
     from p left join c using (position_id)""")
def apply_corrections(spark, sf):
    rows = view(spark, sf, "observation").withColumn("position_id", F.concat_ws("/", "map_id", "product_id"))
    placed = rows.groupBy("position_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.avg("x").alias("x"),
        F.avg("z").alias("z"),
        F.max("confidence").alias("confidence"),
    )
    log = rows.filter("confidence = 'hög' and frame % 10 < 5 and map_id <> 'm3'").select(
        "position_id",
        "ord",
        F.when(F.col("frame") % 3 == 0, F.concat("name", F.lit("!"))).alias("name"),
        F.when(F.col("frame") % 2 == 0, F.col("z")).alias("x"),
        F.lit(None).cast("double").alias("z"),
    )
    fields = ("name", "x", "z")
    out = U.apply_corrections(placed, U.fold_corrections(log, "position_id", "ord", fields), "position_id", fields)
    return out.select("position_id", "name", rounded("x").alias("x"), rounded("z").alias("z"), "corrected", "confidence")


@add("alias_union", """with a as (select product_id, name || '-' || cast(frame % 5 as varchar) as alias, min(ord) as first_at
        from {observation} group by 1, 2)
     select a.product_id, string_agg(alias, ',' order by first_at, alias) as aliases,
        (select min_by(o.map_id, o.ord) from {observation} o where o.product_id = a.product_id) as first_map
     from a group by a.product_id""")
def alias_union(spark, sf):
    rows = view(spark, sf, "observation").withColumn(
        "alias", F.concat("name", F.lit("-"), (F.col("frame") % 5).cast("string"))
    )
    return U.alias_union(rows, "product_id", "alias", "ord", ("map_id",)).select(
        "product_id", F.array_join("aliases", ",").alias("aliases"), F.col("map_id").alias("first_map")
    )


@add("upsert_products", f"""with e as (select event_id, 'p' || cast(cast(props->>'k' as int) % 40 as varchar) as product_id,
        case when event_type in ('purchase', 'click') then 'personal' else 'kund' end as source, value as x,
        case when event_id % 4 > 0 then cast(event_id % 90 as double) end as z, epoch_us(ts) as seen,
        'a' || cast(event_id % 3 as varchar) as alias from {{events}}),
     s as (select 'p' || cast(n_nationkey as varchar) as product_id, cast(n_nationkey as double) as x,
        cast(n_regionkey as double) as z, 5 as points, 'base' as alias, 'Slut' as status from {{nation}}),
     f as (select product_id, max_by(x, event_id) filter (source = 'personal') as sx,
        max_by(z, event_id) filter (source = 'personal' and z is not null) as sz,
        count(*) filter (source = 'personal') as staff, min_by(x, event_id) as fx,
        min_by(source, event_id) as fs, max(seen) as seen from e group by 1),
     fz as (select product_id, z from (select *, row_number() over (partition by product_id order by event_id) as rn from e) where rn = 1),
     al as (select product_id, alias from s union select product_id, alias from e where source = 'personal'
            union select product_id, alias from (select e.*, row_number() over (partition by product_id order by event_id) as rn
                from e) where rn = 1 and product_id not in (select product_id from s)),
     j as (select coalesce(s.product_id, f.product_id) as product_id, s.product_id is not null as known, s.x as ox, s.z as oz,
        s.points, s.status, f.* exclude (product_id) from s full outer join f on f.product_id = s.product_id)
     select j.product_id, {r('coalesce(sx, case when known then ox else fx end, 0e0)')} as x,
        {r('coalesce(sz, case when known then oz else fz.z end, 2.5e0)')} as z,
        case when known and coalesce(staff, 0) = 0 then status else 'I lager' end as status,
        cast(case when known then points + coalesce(staff, 0) else 1 + staff - (case when fs = 'personal' then 1 else 0 end) end as bigint) as points,
        (select string_agg(alias, ',' order by alias) from al where al.product_id = j.product_id) as aliases, seen as seen_us
     from j left join fz on fz.product_id = j.product_id""")
def upsert_products(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    events = view(spark, sf, "events").select(
        F.concat(F.lit("p"), (k % 40).cast("string")).alias("product_id"),
        "event_id",
        F.when(F.col("event_type").isin("purchase", "click"), "personal").otherwise("kund").alias("source"),
        F.col("value").alias("x"),
        F.lit(0.0).alias("y"),
        F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 90).cast("double")).alias("z"),
        F.lit("medium").alias("confidence"),
        F.array(F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string"))).alias("aliases"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    snapshot = view(spark, sf, "nation").select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("product_id"),
        F.col("n_nationkey").cast("double").alias("x"),
        F.lit(0.0).alias("y"),
        F.col("n_regionkey").cast("double").alias("z"),
        F.lit("Slut").alias("status"),
        F.lit("låg").alias("confidence"),
        F.lit(5).cast("long").alias("points"),
        F.lit(None).cast("timestamp").alias("last_seen"),
        F.array(F.lit("base")).alias("aliases"),
    )
    out = U.upsert_products(snapshot, events)
    return out.select(
        "product_id",
        rounded("x").alias("x"),
        rounded("z").alias("z"),
        "status",
        "points",
        F.array_join(F.array_sort("aliases"), ",").alias("aliases"),
        F.unix_micros("last_seen").alias("seen_us"),
    )


@add("delete_products", """select p_partkey, p_name from {part} where p_type <> 'PROMO'
     and p_partkey not in (select l_partkey from {lineitem} where l_returnflag = 'R' and l_discount > 0.08e0)""")
def delete_products(spark, sf):
    gone = view(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_discount > 0.08").select(
        F.col("l_partkey").alias("p_partkey")
    )
    parts = view(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return U.delete_products(parts, gone, "p_partkey", "p_type", "PROMO").drop("p_type")


@add("points_in_bbox", f"""with h as (select b.box_id, count(*) as hits, quantile_cont(depth, 0.5) as mid from {{box}} b
        join {{point}} p on p.frame = b.frame and u between x1 and x2 and v between y1 and y2
        where x2 > x1 and y2 > y1 group by 1),
     f as (select frame, quantile_cont(depth, 0.5) filter (depth > 0.3e0 and depth < 5) as med from {{point}} group by 1)
     select b.box_id, b.frame, coalesce(hits, 0) as hits, coalesce(hits >= 3 and mid > 0.2e0 and mid < 10, false) as from_box,
        {r('case when hits >= 3 and mid > 0.2e0 and mid < 10 then mid else coalesce(med, 1.5e0) end')} as depth
     from {{box}} b left join h on h.box_id = b.box_id left join f on f.frame = b.frame""")
def points_in_bbox(spark, sf):
    return U.points_in_boxes(view(spark, sf, "point"), view(spark, sf, "box")).withColumn("depth", rounded("depth"))


@add("median_depth", f"""select frame, {r("coalesce(quantile_cont(depth, 0.5) filter (depth > 0.3e0 and depth < 5), 1.5e0)")}
     as median_depth from {{point}} group by frame""")
def median_depth(spark, sf):
    return U.frame_median_depth(view(spark, sf, "point")).withColumn("median_depth", rounded("median_depth"))


@add("observation_confidence", """select ord, case when frame % 2 = 0 and score > 80 then 'hög' when score > 80 then 'medium'
     else 'låg' end as level from {observation}""")
def observation_confidence(spark, sf):
    return view(spark, sf, "observation").select(
        "ord", U.observation_confidence(F.col("frame") % 2 == 0, F.col("score")).alias("level")
    )


@add("dedupe_first", """select frame, name, min(ord) as ord from {observation} where name <> '' group by frame, name""")
def dedupe_first(spark, sf):
    rows = view(spark, sf, "observation").filter("name <> ''")
    return rows.groupBy("frame", "name").agg(F.min("ord").alias("ord"))


CAM = "select session, session % 3 as map_id, frame, x * 50 as cam_x, y as cam_y, z * 100 as cam_z, rot_y from {track}"


@add("visible_products", f"""with c as ({CAM}),
     p as (select p_partkey, p_partkey % 3 as map_id, p_size * 5e0 as x, 1.2e0 as y, cast(p_partkey % 100 as double) as z,
        cast(p_partkey % 10 as double) / 10 as share from {{part}}),
     j as (select frame, share, x - cam_x as dx, y - cam_y as dy, z - cam_z as dz, rot_y from c join p using (map_id)
        where abs(x - cam_x) <= 6 and abs(z - cam_z) <= 6
          and sqrt((x - cam_x) * (x - cam_x) + (z - cam_z) * (z - cam_z)) <= 6),
     l as (select *, dx * cos(-rot_y) - dz * sin(-rot_y) as lx, dx * sin(-rot_y) + dz * cos(-rot_y) as lz from j),
     s as (select *, (1000 * lx / lz + 960) / 1920 * 100 as sx, (1000 * -dy / lz + 540) / 1080 * 100 as sy from l where lz > 0.2e0)
     select frame, count(*) as shown, count(*) filter (share > 0.7e0) as high,
        count(*) filter (share > 0.4e0 and share <= 0.7e0) as med
     from s where sx between 2 and 98 and sy between 2 and 98 group by frame""")
def visible_products(spark, sf):
    cameras = view(spark, sf, "track").select(
        (F.col("session") % 3).alias("map_id"),
        F.col("frame").alias("camera_id"),
        (F.col("x") * 50).alias("cam_x"),
        F.col("y").alias("cam_y"),
        (F.col("z") * 100).alias("cam_z"),
        "rot_y",
    )
    products = view(spark, sf, "part").select(
        (F.col("p_partkey") % 3).alias("map_id"),
        F.col("p_partkey").alias("product_id"),
        (F.col("p_size") * 5.0).alias("x"),
        F.lit(1.2).alias("y"),
        (F.col("p_partkey") % 100).cast("double").alias("z"),
        ((F.col("p_partkey") % 10).cast("double") / 10).alias("share"),
    )
    # Products that stand at one place with one share are looked at together and counted by their number.
    places = products.groupBy("map_id", "x", "y", "z", "share").agg(
        F.min("product_id").alias("product_id"), F.count(F.lit(1)).alias("n")
    )
    seen = N.visible_products(cameras, places, keys=("map_id",), carry=("n",))

    def counted(kind):
        return F.coalesce(F.sum(F.when(F.col("class") == kind, F.col("n"))), F.lit(0))

    return seen.groupBy(F.col("camera_id").alias("frame")).agg(
        F.sum("n").alias("shown"), counted("high").alias("high"), counted("med").alias("med")
    )


@add("idw_lift_3d", f"""with k as (select p_partkey as kp_id, p_partkey % 500 as frame, p_size * 20e0 as u,
        cast(p_partkey % 100 as double) * 5 as v from {{part}}),
     d as (select kp_id, p.x, p.y, p.z, point_id, sqrt((p.u - k.u) * (p.u - k.u) + (p.v - k.v) * (p.v - k.v)) as d
        from k join {{point}} p on p.frame = k.frame),
     q as (select *, row_number() over (partition by kp_id order by d, point_id) as rn, min(d) over (partition by kp_id) as near from d)
     select kp_id, {r('min(near)')} as nearest, {r('sum(x / (d + 1e-6)) / sum(1 / (d + 1e-6))')} as x,
        {r('sum(y / (d + 1e-6)) / sum(1 / (d + 1e-6))')} as y, {r('sum(z / (d + 1e-6)) / sum(1 / (d + 1e-6))')} as z
     from q where rn <= 4 and near < 30 group by kp_id""")
def idw_lift_3d(spark, sf):
    keypoints = view(spark, sf, "part").select(
        F.col("p_partkey").alias("kp_id"),
        (F.col("p_partkey") % 500).cast("int").alias("frame"),
        (F.col("p_size") * 20.0).alias("u"),
        ((F.col("p_partkey") % 100).cast("double") * 5).alias("v"),
    )
    out = N.idw_lift(keypoints, view(spark, sf, "point"))
    return out.select("kp_id", *[rounded(c).alias(c) for c in ("nearest", "x", "y", "z")])


@add("aisle_groups", """select n_name as aisle, n_regionkey * 10e0 as offset_x, count(s_suppkey) as n_products,
     coalesce(string_agg(s_name, ',' order by s_suppkey), '') as products
     from {nation} full outer join {supplier} on s_nationkey = n_nationkey group by n_name, n_regionkey""")
def aisle_groups(spark, sf):
    nation, supplier = view(spark, sf, "nation"), view(spark, sf, "supplier")
    grouped = supplier.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"]).alias("names"),
    )
    return nation.join(grouped, nation.n_nationkey == grouped.s_nationkey, "full_outer").select(
        F.col("n_name").alias("aisle"),
        (F.col("n_regionkey") * 10.0).alias("offset_x"),
        F.coalesce("n_products", F.lit(0)).alias("n_products"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("products"),
    )


@add("aisle_offsets_upsert", f"""with u as (select user_id % 30 as aisle, max_by(value, event_id) as dx, max(event_id) as at
        from {{events}} where event_type = 'click' group by 1)
     select n_nationkey as aisle_id, {r('coalesce(dx, 0e0)')} as offset_x from {{nation}} left join u on u.aisle = n_nationkey""")
def aisle_offsets_upsert(spark, sf):
    last = (
        view(spark, sf, "events")
        .filter("event_type = 'click'")
        .groupBy((F.col("user_id") % 30).alias("aisle"))
        .agg(F.max_by("value", "event_id").alias("dx"))
    )
    nation = view(spark, sf, "nation")
    return nation.join(last, nation.n_nationkey == last.aisle, "left").select(
        F.col("n_nationkey").alias("aisle_id"), rounded(F.coalesce("dx", F.lit(0.0))).alias("offset_x")
    )
