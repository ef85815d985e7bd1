"""Events as a file stream, run until everything available is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.operators import gates as G
from aislewise.operators import sessions as S
from aislewise.operators.poses import live_columns
from aislewise.plans import session_queries as Q
from aislewise.plans.views import VIEWS, _K, Registry, sql_round as r, table, view
from aislewise.sources.sinks import scratch_path
from aislewise.streaming import jobs as J

REGISTRY = Registry()
add = REGISTRY.add


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return J.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_view(spark, sf, name):
    """A view over the events stream instead of the events table."""
    return spark.sql(VIEWS[name].replace("{k}", _K["spark"]), events=events_stream(spark, sf))


@add("stream_live_position", Q.REGISTRY.sql["live_position"])
def stream_live_position(spark, sf):
    cols = live_columns()
    placed = Q.camera_rows(events_stream(spark, sf)).select("map_id", "event_id", *[c.alias(n) for n, c in cols.items()])
    latest = J.last_update(J.drain(J.latest_per_key(placed, "map_id", ["event_id"]), "update"), ["map_id"])
    return latest.select("map_id", "event_id", *[rounded(c).alias(c) for c in ("x", "z", "yaw")])


@add("stream_flag_window", Q.REGISTRY.sql["flag_window"])
def stream_flag_window(spark, sf):
    flags = stream_view(spark, sf, "flag").filter("not handled").withWatermark("ts", "1 day")
    final = J.last_update(J.drain(J.flag_windows(flags), "update"), ["product_id", "window_start"])
    return final.select("product_id", F.unix_micros("window_start").alias("window_start_us"), "reports")


@add("stream_session_lifecycle", Q.REGISTRY.sql["session_lifecycle"])
def stream_session_lifecycle(spark, sf):
    kinds = Q.lifecycle_events(events_stream(spark, sf))
    states = S.lifecycle_state(kinds, "session_id", ["event_id"])
    return J.last_update(J.drain(states, "update"), ["session_id"])


@add("stream_latest_with_ttl", Q.REGISTRY.sql["latest_with_ttl"])
def stream_latest_with_ttl(spark, sf):
    rows = stream_view(spark, sf, "tracking").select("device", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    latest = J.last_update(J.drain(J.latest_until(rows, "device", "event_id", "ts", "8 hours"), "update"), ["device"])
    now = latest.agg(F.max("ts")).scalar()
    latest = latest.filter("alive")
    return S.latest_with_ttl(latest, "device", ["event_id"], now, ttl_s=8 * 3600.0).select("device", "event_id")


@add("assemble_session", """select user_id as session, count(*) as frames, count(*) filter (event_type = 'purchase') as closings
     from {events} group by 1""")
def assemble_session(spark, sf):
    uploads = events_stream(spark, sf).select(
        F.col("user_id").alias("session"),
        F.hour("ts").alias("batch_no"),
        (F.col("event_type") == "purchase").alias("is_last"),
        "ts",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("z"),
    )
    out = J.drain(J.assemble_session(uploads))
    return out.groupBy("session").agg(
        F.count_distinct("batch", "frame").alias("frames"), F.count_if("complete").alias("closings")
    )


def gate_rows(events):
    """Fixes of the signup events against poses of all others; tracking is lost on errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    a = F.radians((F.col("event_id") % 40).cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    t = F.array(
        F.cos(a), zero, -F.sin(a), zero, zero, one, zero, zero, F.sin(a), zero, F.cos(a), zero,
        F.col("value") / 80.0, zero, k / 100.0, one,
    )
    return events.select(
        F.col("user_id").alias("device"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"),
        F.when(F.col("event_type") == "signup", "vps").otherwise("pose").alias("kind"),
        t.alias("t"),
        k.alias("inliers"),
        F.when(F.col("event_type") == "error", "limited").otherwise("normal").alias("tracking"),
    )


@add("recalibration_gate")
def recalibration_gate(spark, sf):
    return G.recalibration_gate(gate_rows(view(spark, sf, "events")), "device", ["at", "event_id"]).drop("at")


@add("stream_recalibration_gate")
def stream_recalibration_gate(spark, sf):
    return J.drain(J.recalibration_stream(gate_rows(events_stream(spark, sf)), "60 days")).drop("batch")


@add("throttle_exact", """with recursive e as (select user_id as device, event_id, epoch_us(ts) as t,
      row_number() over (partition by user_id order by ts, event_id) as n from {events}),
   k as (select device, n, event_id, t, t as last from e where n = 1
     union all select e.device, e.n, e.event_id, e.t, case when e.t - k.last >= 3600000000 then e.t else k.last end
       from k join e on e.device = k.device and e.n = k.n + 1)
   select device, event_id from k where last = t""")
def throttle_exact(spark, sf):
    rows = view(spark, sf, "events").select(
        F.col("user_id").alias("device"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"),
        "event_id",
    )
    return G.throttle_exact(rows, "device", ["at", "event_id"], 3600e6).select("device", "event_id")


@add("consolidate_incremental")
def consolidate_incremental(spark, sf):
    log, snapshot = scratch_path(spark, "sightings"), scratch_path(spark, "consolidated")
    rows = stream_view(spark, sf, "observation").select(
        "map_id", "product_id", "ord", "name", "x", "y", "z", "confidence", "score"
    )
    J.consolidate_stream(rows, log, snapshot, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(snapshot).drop("bucket")


def scan_inputs(spark, sf):
    """Boxes as label readings, points as they are, one camera per frame."""
    import math

    point = view(spark, sf, "point")
    a = F.radians((F.col("frame") % 360).cast("double"))
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(
        F.cos(a), zero, -F.sin(a), zero, zero, one, zero, zero, F.sin(a), zero, F.cos(a), zero,
        (F.col("frame") % 20).cast("double"), F.lit(1.2), (F.col("frame") % 15).cast("double"), one,
    )
    c, s = math.cos(0.5), math.sin(0.5)
    to_map = F.array(*[F.lit(v) for v in (c, 0.0, -s, 0.0, 0.0, 1.0, 0.0, 0.0, s, 0.0, c, 0.0, 1.0, 2.0, 3.0, 1.0)])
    lens = {"fx": 300.0, "fy": 300.0, "cx": 400.0, "cy": 250.0, "height": 500.0}
    cameras = point.select("frame").distinct().select(
        "frame", pose.alias("pose"), to_map.alias("to_map"), *[F.lit(v).alias(n) for n, v in lens.items()]
    )
    return view(spark, sf, "box"), point.select("frame", "x", "y", "z"), cameras


@add("shelf_scan")
def shelf_scan(spark, sf):
    from aislewise.operators.shelf_scan import shelf_scan as op
    from aislewise.plans.search_queries import LEX

    labels, points, cameras = scan_inputs(spark, sf)
    return op(labels, points, cameras, view(spark, sf, "catalogue"), LEX)


@add("observation_stream")
def observation_stream(spark, sf):
    from aislewise.operators.shelf_scan import shelf_scan as op
    from aislewise.plans.search_queries import LEX

    _, points, cameras = scan_inputs(spark, sf)
    catalogue = view(spark, sf, "catalogue")
    schema = table(spark, sf, "part").schema
    stream = spark.sql(VIEWS["box"], part=J.file_stream(spark, sf, schema, "part.parquet"))
    path = scratch_path(spark, "sightings")
    J.append_sightings(
        stream, path, scratch_path(spark, "offsets"), lambda batch: op(batch, points, cameras, catalogue, LEX)
    ).awaitTermination()
    return spark.read.parquet(path).drop("batch")




@add("recipe_filters", """select recipe_id from {recipe} where source like '%-%' and recipe_id % 17 > 0 and recipe_id % 5 > 0
     and recipe_id % 13 > 0 and not coalesce(kcal < 250, false) and not coalesce(time_min > 45, false)
     and recipe_id % 3 = 1""")
def recipe_filters(spark, sf):
    from aislewise.functions.recipes import contains_all
    from aislewise.operators.recipe_search import recipe_filters as op

    key = F.col("recipe_id")
    rows = view(spark, sf, "recipe").select(
        key,
        "kcal",
        "time_min",
        contains_all(F.col("source"), F.array(F.lit("-"))).alias("has_words"),
        (key % 17 == 0).alias("beauty"),
        (key % 5 == 0).alias("non_meal"),
        (key % 13 == 0).alias("drink"),
        F.lit(True).alias("diet_ok"),
        F.when(key % 3 == 0, "enkelt").when(key % 3 == 1, "medel").otherwise("avancerat").alias("difficulty"),
    )
    return op(rows, max_minutes=45, difficulty="medel").select("recipe_id")


def _recipe_sql():
    from aislewise.plans.basket_queries import PRICE_SQL, REL_SQL, SCORE_SQL

    return f"""with price as (select * from ({PRICE_SQL}) where n_priced > 0), score as ({SCORE_SQL}), all_rel as ({REL_SQL}),
   rel as (select *, weighted_saving / regular_total as share from all_rel where not coalesce(kcal < 250, false)
      and not coalesce(time_min > 60, false) and total > 0 and n_priced >= 3 and regular_total > 0),
   counts as (select count(*) filter (n_promo >= 3 and share >= 0.1e0) as t0, count(*) filter (n_promo >= 2 and share >= 0.1e0) as t1,
      count(*) filter (n_promo >= 1 and share >= 0.1e0) as t2 from rel),
   pick as (select case when t0 >= 15 then 0 when t1 >= 15 then 1 when t2 >= 15 then 2 else 3 end as tier from counts),
   kept as (select rel.* from rel, pick where (tier = 0 and n_promo >= 3 and share >= 0.1e0) or (tier = 1 and n_promo >= 2 and share >= 0.1e0)
      or (tier = 2 and n_promo >= 1 and share >= 0.1e0) or (tier = 3 and n_promo >= 1)),
   dealt as (select *, cast(row_number() over (partition by source order by promo_score desc, recipe_id) as int) as round from kept),
   top as (select * from dealt order by round, promo_score desc, recipe_id limit 15)
   select recipe_id, source, round, {r('total')} as total, {r('promo_score')} as promo_score,
     (select count(*) from {{ingredient}} i where i.recipe_id = top.recipe_id) as n_lines from top"""


@add("recipe_search", _recipe_sql())
def recipe_search(spark, sf):
    from aislewise.operators.recipe_search import recipe_search as op

    recipes = view(spark, sf, "recipe").filter("not coalesce(kcal < 250, false) and not coalesce(time_min > 60, false)")
    recipes = recipes.withColumn("protein", F.col("rating"))
    out = op(recipes, view(spark, sf, "ingredient"))
    return out.select(
        "recipe_id",
        "source",
        "round",
        rounded("total").alias("total"),
        rounded("promo_score").alias("promo_score"),
        F.size("lines").cast("long").alias("n_lines"),
    )
