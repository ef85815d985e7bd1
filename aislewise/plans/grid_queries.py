"""Grids from the point view: four maps, cells of a quarter to half a metre."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.operators import grid as G
from aislewise.operators import routes as R
from aislewise.plans.views import Registry, sql_round as r, view
from aislewise.session import cut_lineage

REGISTRY = Registry()
add = REGISTRY.add

CELL = 0.5

META_SQL = f"""q as (select map_id, quantile_cont(y, 0.05) as floor_y, quantile_cont(y, 0.95) as ceil_y,
     min(x) - 1 as x_min, max(x) + 1 as x_max, min(z) - 1 as z_min, max(z) + 1 as z_max, count(*) as n_points
     from {{point}} group by 1),
   meta as (select *, floor_y + 0.3e0 as lo, least(floor_y + 2e0, ceil_y - 0.2e0) as hi,
     cast(ceil((x_max - x_min) / {CELL}e0) as int) as nx, cast(ceil((z_max - z_min) / {CELL}e0) as int) as nz from q)"""
WALL_SQL = META_SQL + f""", walls as (select p.map_id,
     cast(greatest(0, least(nx - 1, trunc((x - x_min) / {CELL}e0))) as int) as ix,
     cast(greatest(0, least(nz - 1, trunc((z - z_min) / {CELL}e0))) as int) as iz, count(*) as n
   from {{point}} p join meta m on m.map_id = p.map_id where y > lo and y < hi group by 1, 2, 3)"""
# A round kernel of radius 1 is a plus sign.
GROWN_SQL = WALL_SQL + """, grown as (select distinct w.map_id, ix + a as ix, iz + b as iz from walls w,
     (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(a, b) join meta on true
     where meta.map_id = w.map_id and ix + a between 0 and nx - 1 and iz + b between 0 and nz - 1)"""
FREE_SQL = GROWN_SQL + """, cells as (select map_id, nx, unnest(range(nx)) as ix, nz from meta),
   allc as (select map_id, nx, ix, unnest(range(nz)) as iz from cells),
   free as (select map_id, cast(ix as int) as ix, cast(iz as int) as iz, iz * nx + ix as num from allc a where not exists
     (select 1 from grown g where g.map_id = a.map_id and g.ix = a.ix and g.iz = a.iz))"""
LABEL_SQL = FREE_SQL + """, lab(map_id, ix, iz, label) using key (map_id, ix, iz) as (
     select map_id, ix, iz, num from free
     union
     select f.map_id, f.ix, f.iz, min(l.label) from free f join lab l on l.map_id = f.map_id
       and abs(l.ix - f.ix) + abs(l.iz - f.iz) = 1
       and l.ix between f.ix - 1 and f.ix + 1 and l.iz between f.iz - 1 and f.iz + 1
       join recurring.lab r on r.map_id = f.map_id and r.ix = f.ix and r.iz = f.iz and l.label < r.label
     group by f.map_id, f.ix, f.iz)"""


def points(spark, sf):
    return view(spark, sf, "point").select("map_id", "point_id", "x", "y", "z")


def occupancy(spark, sf, cell=CELL):
    walls, meta = G.occupancy_grid(points(spark, sf), "map_id", cell)
    meta = cut_lineage(meta)
    return walls, meta


def grown(spark, sf):
    walls, meta = occupancy(spark, sf)
    return cut_lineage(G.dilate_cells(walls, meta, "map_id", 1)), meta


@add("height_band", f"with {META_SQL} select p.point_id, p.map_id from {{point}} p join meta m on m.map_id = p.map_id where y > lo and y < hi")
def height_band(spark, sf):
    return G.height_band(points(spark, sf), "map_id").select("point_id", "map_id")


@add("map_bounds", f"""select map_id, {r('min(x) - 1')} as x_min, {r('min(z) - 1')} as z_min, {r('max(x) + 1')} as x_max,
     {r('max(z) + 1')} as z_max, count(*) as n_points from {{point}} group by 1""")
def map_bounds(spark, sf):
    out = G.map_bounds(points(spark, sf), "map_id")
    return out.select("map_id", *[rounded(c).alias(c) for c in ("x_min", "z_min", "x_max", "z_max")], "n_points")


@add("occupancy_grid", f"with {WALL_SQL} select map_id, ix, iz, n from walls")
def occupancy_grid(spark, sf):
    return occupancy(spark, sf)[0]


@add("occupancy_meta", f"""with {WALL_SQL} select map_id, nx, nz, {r('floor_y')} as floor, {r('ceil_y')} as ceiling,
     {r('lo')} as band_low, {r('hi')} as band_high, n_points >= 100 as ok from meta""")
def occupancy_meta(spark, sf):
    meta = occupancy(spark, sf)[1]
    cols = ("floor", "ceiling", "band_low", "band_high")
    return meta.select("map_id", "nx", "nz", *[rounded(c).alias(c) for c in cols], "ok")


@add("dilate_cells", f"with {GROWN_SQL} select map_id, ix, iz from grown")
def dilate_cells(spark, sf):
    walls, meta = occupancy(spark, sf)
    return G.dilate_cells(walls, meta, "map_id", 1)


@add("cell_density", """with b as (select map_id, min(x) - 1 as x_min, min(z) - 1 as z_min from {point} group by 1)
   select p.map_id, cast(trunc((x - x_min) / 1e0) as int) as ix, cast(trunc((z - z_min) / 1e0) as int) as iz, count(*) as n
   from {point} p join b on b.map_id = p.map_id group by 1, 2, 3 having count(*) > 8""")
def cell_density(spark, sf):
    return G.cell_density(points(spark, sf), "map_id", cell=1.0)[0]


@add("world_to_cell", f"""with b as (select map_id, min(x) - 1 as x_min, min(z) - 1 as z_min from {{point}} group by 1),
   c as (select p.point_id, x_min, z_min, cast(trunc((x - x_min) / 0.1e0) as int) as ix, cast(trunc((z - z_min) / 0.1e0) as int) as iz
     from {{point}} p join b on b.map_id = p.map_id)
   select point_id, ix, iz, {r('x_min + (ix + 0.5e0) * 0.1e0')} as x, {r('z_min + (iz + 0.5e0) * 0.1e0')} as z from c""")
def world_to_cell(spark, sf):
    rows = points(spark, sf)
    cells = rows.join(G.map_bounds(rows, "map_id"), "map_id").select(
        "point_id",
        "x_min",
        "z_min",
        G.world_to_cell(F.col("x"), F.col("x_min"), 0.1).alias("ix"),
        G.world_to_cell(F.col("z"), F.col("z_min"), 0.1).alias("iz"),
    )
    return cells.select(
        "point_id",
        "ix",
        "iz",
        rounded(G.cell_to_world(F.col("ix"), F.col("x_min"), 0.1)).alias("x"),
        rounded(G.cell_to_world(F.col("iz"), F.col("z_min"), 0.1)).alias("z"),
    )


@add("free_components", f"""with recursive {LABEL_SQL}, s as (select map_id, label, count(*) as n from lab group by 1, 2),
   m as (select map_id, label, row_number() over (partition by map_id order by n desc, label) as rn from s)
   select l.map_id, l.ix, l.iz, l.label, m.rn = 1 as walkable from lab l join m on m.map_id = l.map_id and m.label = l.label""")
def free_components(spark, sf):
    return G.free_components(*grown(spark, sf), "map_id")


@add("snap_to_free", f"""with recursive {LABEL_SQL}, s as (select map_id, label, count(*) as n from lab group by 1, 2),
   m as (select map_id, label, row_number() over (partition by map_id order by n desc, label) as rn from s),
   walk as (select l.map_id, l.ix, l.iz from lab l join m on m.map_id = l.map_id and m.label = l.label and rn = 1),
   asks as (select distinct p.map_id, cast(trunc((x - x_min) / {CELL}e0) as int) as ix, cast(trunc((z - z_min) / {CELL}e0) as int) as iz
     from {{point}} p join meta on meta.map_id = p.map_id),
   o as (select a.map_id, a.ix, a.iz, w.ix as to_ix, w.iz as to_iz, row_number() over (partition by a.map_id, a.ix, a.iz
      order by greatest(abs(w.ix - a.ix), abs(w.iz - a.iz)), w.ix - a.ix, w.iz - a.iz) as rn from asks a join walk w
      on w.map_id = a.map_id and abs(w.ix - a.ix) <= 50 and abs(w.iz - a.iz) <= 50)
   select map_id, ix, iz, to_ix, to_iz from o where rn = 1""")
def snap_to_free(spark, sf):
    walls, meta = grown(spark, sf)
    cells = cut_lineage(G.free_components(walls, meta, "map_id"))
    rows = points(spark, sf).join(meta.select("map_id", "x_min", "z_min"), "map_id")
    asks = rows.select(
        "map_id",
        G.world_to_cell(F.col("x"), F.col("x_min"), CELL).alias("ix"),
        G.world_to_cell(F.col("z"), F.col("z_min"), CELL).alias("iz"),
    )
    return G.snap_to_free(asks, cells, "map_id")


def route_asks(spark, sf):
    """From every session's first to its last point, on the point scale."""
    rows = view(spark, sf, "point").join(
        view(spark, sf, "events").select(F.col("event_id").alias("point_id"), "user_id"), "point_id"
    )
    ends = rows.groupBy(F.col("user_id").alias("ask_id"), "map_id").agg(
        F.min_by(F.struct("x", "z"), "point_id").alias("s"), F.max_by(F.struct("x", "z"), "point_id").alias("g")
    )
    return ends.select(
        "ask_id",
        "map_id",
        F.col("s.x").alias("start_x"),
        F.col("s.z").alias("start_z"),
        F.col("g.x").alias("goal_x"),
        F.col("g.z").alias("goal_z"),
    )


def ring_sql(asks, targets):
    """Nearest target of each ask by ring, then x offset, then z offset."""
    return f"""select a.map_id, a.ix, a.iz, w.ix as to_ix, w.iz as to_iz from {asks} a join {targets} w on w.map_id = a.map_id
        qualify row_number() over (partition by a.map_id, a.ix, a.iz
          order by greatest(abs(w.ix - a.ix), abs(w.iz - a.iz)), w.ix - a.ix, w.iz - a.iz) = 1"""


ROUTE_SQL = f"""with recursive {LABEL_SQL}, s as (select map_id, label, count(*) as n from lab group by 1, 2),
   m as (select map_id, label, row_number() over (partition by map_id order by n desc, label) as rn from s),
   walk as (select l.map_id, l.ix, l.iz from lab l join m on m.map_id = l.map_id and m.label = l.label and rn = 1),
   placed as (select user_id as ask_id, p.map_id, nx, point_id, cast(trunc((x - x_min) / {CELL}e0) as int) as ix,
      cast(trunc((z - z_min) / {CELL}e0) as int) as iz from {{point}} p join {{events}} e on e.event_id = p.point_id join meta on meta.map_id = p.map_id),
   ends as (select ask_id, map_id, any_value(nx) as nx, min_by(ix, point_id) as sx, min_by(iz, point_id) as sz,
      max_by(ix, point_id) as gx, max_by(iz, point_id) as gz from placed group by 1, 2),
   cellasks as (select map_id, sx as ix, sz as iz from ends union select map_id, gx, gz from ends),
   snap as ({ring_sql("cellasks", "walk")}),
   r as materialized (select ask_id, e.map_id, a.to_iz * nx + a.to_ix as start_node, b.to_iz * nx + b.to_ix as goal_node from ends e
      join snap a on a.map_id = e.map_id and a.ix = sx and a.iz = sz join snap b on b.map_id = e.map_id and b.ix = gx and b.iz = gz),
   near as materialized (select a.map_id, a.num, b.num as other, case when a.ix <> b.ix and a.iz <> b.iz then sqrt(2e0) else 1e0 end as w
      from free a join free b on b.map_id = a.map_id and b.ix between a.ix - 1 and a.ix + 1 and b.iz between a.iz - 1 and a.iz + 1 and b.num <> a.num),
   dist(map_id, src, num, d) using key (map_id, src, num) as (
     select distinct map_id, start_node, start_node, 0e0 from r
     union
     select n.map_id, n.src, n.num, n.d from (select t.map_id, t.src, near.other as num, min(t.d + near.w) as d
        from dist t join near on near.map_id = t.map_id and near.num = t.num group by 1, 2, 3) n
       left join recurring.dist o on o.map_id = n.map_id and o.src = n.src and o.num = n.num
     where o.d is null or n.d < o.d - 1e-9)
   select ask_id, r.map_id, d is not null as ok, case when d is null then 'no way' end as reason, {r(f"d * {CELL}e0")} as length_m,
     start_node, goal_node from r left join dist on dist.map_id = r.map_id and dist.src = start_node and dist.num = goal_node"""


@add("route_length", ROUTE_SQL)
def route_length(spark, sf):
    """From every session's first to its last point; all of them lie on their map and find a free cell."""
    walls, meta = grown(spark, sf)
    out = R.route_length(route_asks(spark, sf), walls, meta, "map_id", CELL)
    return out.withColumn("length_m", rounded("length_m"))


@add("line_of_sight", f"""with {GROWN_SQL}, a as (select p.point_id, p.map_id, nx, nz, cast(trunc((x - x_min) / {CELL}e0) as int) as x0,
      cast(trunc((z - z_min) / {CELL}e0) as int) as z0 from {{point}} p join meta on meta.map_id = p.map_id),
   b as (select *, x0 + point_id % 9 - 4 as x1, z0 + point_id % 7 - 3 as z1 from a),
   c as (select *, greatest(abs(x1 - x0), abs(z1 - z0)) as most, least(abs(x1 - x0), abs(z1 - z0)) as least from b),
   d as (select *, unnest(range(most + 1)) as k from c),
   e as (select *, case when most = 0 then 0 else (2 * k * least + most - 1) // (2 * most) end as m from d),
   f as (select point_id, map_id, nx, nz, x0 + sign(x1 - x0) * case when abs(x1 - x0) >= abs(z1 - z0) then k else m end as ix,
      z0 + sign(z1 - z0) * case when abs(x1 - x0) >= abs(z1 - z0) then m else k end as iz from e)
   select f.point_id as pair_id, bool_and(g.ix is null and f.ix between 0 and nx - 1 and f.iz between 0 and nz - 1) as visible
   from f left join grown g on g.map_id = f.map_id and g.ix = f.ix and g.iz = f.iz group by 1""")
def line_of_sight(spark, sf):
    walls, meta = grown(spark, sf)
    rows = points(spark, sf).join(meta.select("map_id", "x_min", "z_min"), "map_id").select(
        F.col("point_id").alias("pair_id"),
        "map_id",
        G.world_to_cell(F.col("x"), F.col("x_min"), CELL).alias("x0"),
        G.world_to_cell(F.col("z"), F.col("z_min"), CELL).alias("z0"),
    )
    pairs = rows.withColumn("x1", F.col("x0") + (F.col("pair_id") % 9).cast("int") - 4).withColumn(
        "z1", F.col("z0") + (F.col("pair_id") % 7).cast("int") - 3
    )
    return G.line_of_sight(pairs, walls, meta, "map_id")


@add("route_waypoints")
def route_waypoints(spark, sf):
    walls, meta = grown(spark, sf)
    out = R.routes(route_asks(spark, sf), walls, meta, "map_id", CELL)
    return out.select("ask_id", "ok", rounded("length_m").alias("length_m"), "waypoints")


@add("simplify_routes")
def simplify_routes(spark, sf):
    walls, meta = grown(spark, sf)
    users = view(spark, sf, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("route_id"))
    routes = (
        points(spark, sf)
        .join(users, "point_id")
        .join(meta.select("map_id", "x_min", "z_min"), "map_id")
        .select(
            "route_id",
            "map_id",
            F.col("point_id").alias("step"),
            G.world_to_cell(F.col("x"), F.col("x_min"), CELL).alias("ix"),
            G.world_to_cell(F.col("z"), F.col("z_min"), CELL).alias("iz"),
        )
    )
    return G.simplify_routes(routes, walls, "map_id")


@add("shelf_rectangles")
def shelf_rectangles(spark, sf):
    out = G.shelf_rectangles(points(spark, sf), "map_id", cell=1.0, more_than=8)
    return out.select("map_id", *[rounded(c).alias(c) for c in ("x", "z", "width", "depth")])


@add("find_product")
def find_product(spark, sf):
    from aislewise.operators.find import find_products
    from aislewise.plans.search_queries import LEX

    walls, meta = grown(spark, sf)
    placed = (
        view(spark, sf, "point")
        .join(view(spark, sf, "events").select(F.col("event_id").alias("point_id"), "user_id"), "point_id")
        .groupBy("map_id", F.col("user_id").alias("product_id"))
        .agg(F.avg("x").alias("x"), F.avg("z").alias("z"), F.min("point_id").alias("ord"))
        .join(view(spark, sf, "catalogue").select("product_id", "name"), "product_id")
    )
    asks = route_asks(spark, sf).select(
        "ask_id",
        "map_id",
        F.when(F.col("ask_id") % 2 == 0, F.col("ask_id")).alias("product_id"),
        F.when(F.col("ask_id") % 3 == 0, "gear").when(F.col("ask_id") % 3 == 1, "bolt").otherwise("finns ej").alias("name"),
        F.col("start_x"),
        F.col("start_z"),
    )
    return find_products(asks, placed, walls, meta, "map_id", CELL, view(spark, sf, "catalogue"), LEX)
