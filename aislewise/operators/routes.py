"""Shortest walks over grids of any size: lengths and way-points.

A map is cut into tiles.  Inside a tile, walks between border cells are found at once; over the borders, distances
spread from every distinct start in rounds, and only improved nodes go on.  Every node keeps the node it was reached
from, so a route is read backwards from its goal and filled in, tile by tile, afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.operators.grid import (
    TILE,
    _STEPS,
    _free_mask,
    _fresh,
    _inside,
    _tile_grid,
    _with_tile,
    cell_to_world,
    free_components,
    simplify_routes,
    snap_to_free,
    world_to_cell,
)
from aislewise.session import cut_lineage, written


def _spread(free: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distance of every cell of a tile from each start (8 neighbours), for all starts at once."""
    d = np.full((len(starts), TILE, TILE), np.inf)
    d[np.arange(len(starts)), starts[:, 1], starts[:, 0]] = 0.0
    while True:
        new = d.copy()
        for i, j in _STEPS:
            cost = math.sqrt(2.0) if i and j else 1.0
            zs, zt = slice(max(0, -j), TILE - max(0, j)), slice(max(0, j), TILE - max(0, -j))
            xs, xt = slice(max(0, -i), TILE - max(0, i)), slice(max(0, i), TILE - max(0, -i))
            np.minimum(new[:, zt, xt], d[:, zs, xs] + cost, out=new[:, zt, xt])
        new[:, ~free] = np.inf
        if (new == d).all():
            return d
        d = new


def tile_roads(walls: DataFrame, meta: DataFrame, stops: DataFrame, key: str) -> DataFrame:
    """Edges (key, a, b, w) between border cells and ``stops`` (key, ix, iz) of the same tile,
    plus the steps between neighbouring tiles.  Nodes are cell numbers iz * nx + ix."""
    kind = meta.schema[key].dataType.simpleString()
    keys = [key, "tx", "tz"]
    marked = (
        walls.select(key, "ix", "iz", F.lit(0).alias("stop"))
        .unionByName(stops.select(key, "ix", "iz").distinct().withColumn("stop", F.lit(1)))
    )

    def inner(tile_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({key: pd.Series(dtype=object), "a": [], "b": [], "w": []})
        if tile_rows.empty:
            return empty
        tile = tile_rows.iloc[0]
        free = _free_mask(tile, rows[rows["stop"] == 0])
        node = np.zeros_like(free)
        node[0, :] = node[-1, :] = node[:, 0] = node[:, -1] = True
        picked = rows[rows["stop"] == 1]
        node[picked["iz"].to_numpy() - tile["tz"] * TILE, picked["ix"].to_numpy() - tile["tx"] * TILE] = True
        z, x = np.nonzero(node & free)
        if len(x) < 2:
            return empty
        d = _spread(free, np.column_stack([x, z]))[:, z, x]
        number = (tile["tz"] * TILE + z).astype("int64") * int(tile["nx"]) + tile["tx"] * TILE + x
        i, j = np.nonzero(np.triu(np.isfinite(d), 1))
        return pd.DataFrame({key: tile[key], "a": number[i], "b": number[j], "w": d[i, j]})

    roads = (
        _tile_grid(meta, key)
        .groupBy(*keys)
        .cogroup(_with_tile(_fresh(marked)).groupBy(*keys))
        .applyInPandas(inner, f"`{key}` {kind}, a bigint, b bigint, w double")
    )
    size = meta.select(key, "nx", "nz")
    edge_cells = _tile_grid(meta, key).select(
        key,
        F.col("tx") * TILE,
        F.col("tz") * TILE,
        F.explode(F.sequence(F.lit(0), F.lit(TILE - 1))).alias("_k"),
    ).toDF(key, "_x0", "_z0", "_k")
    sides = F.array(
        F.struct((F.col("_x0") + TILE - 1).alias("ix"), (F.col("_z0") + F.col("_k")).alias("iz")),
        F.struct(F.col("_x0").alias("ix"), (F.col("_z0") + F.col("_k")).alias("iz")),
        F.struct((F.col("_x0") + F.col("_k")).alias("ix"), (F.col("_z0") + TILE - 1).alias("iz")),
        F.struct((F.col("_x0") + F.col("_k")).alias("ix"), F.col("_z0").alias("iz")),
    )
    rim = edge_cells.select(key, F.inline(sides)).distinct()
    rim = _inside(rim, size, key).join(walls.select(key, "ix", "iz"), [key, "ix", "iz"], "left_anti")
    steps = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1))]
    )
    crossing = (
        rim.withColumn("_d", F.explode(steps))
        .select(key, F.col("ix").alias("_ix"), F.col("iz").alias("_iz"), "_d")
        .withColumn("ix", F.col("_ix") + F.col("_d.a"))
        .withColumn("iz", F.col("_iz") + F.col("_d.b"))
        .filter(
            (F.floor(F.col("ix") / TILE) != F.floor(F.col("_ix") / TILE))
            | (F.floor(F.col("iz") / TILE) != F.floor(F.col("_iz") / TILE))
        )
        .join(rim, [key, "ix", "iz"])
        .join(size.select(key, "nx"), key)
        .select(
            key,
            (F.col("_iz").cast("long") * F.col("nx") + F.col("_ix")).alias("a"),
            (F.col("iz").cast("long") * F.col("nx") + F.col("ix")).alias("b"),
            F.when(F.abs("_d.a") + F.abs("_d.b") == 2, math.sqrt(2.0)).otherwise(1.0).alias("w"),
        )
    )
    return roads.unionByName(crossing)


def _away(node: Column, nx: Column, low_x: Column, high_x: Column, low_z: Column, high_z: Column) -> Column:
    """Straight distance of a node's cell from a box of cells."""
    x, z = node % nx, F.floor(node / nx)
    zero = F.lit(0)
    return F.hypot(F.greatest(low_x - x, x - high_x, zero), F.greatest(low_z - z, z - high_z, zero))


def _ends(asks: DataFrame, cells: DataFrame, meta: DataFrame, key: str, cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All asks with the reason that refuses them, the others with their snapped nodes, and the snapped cells."""
    maps = meta.filter("ok") if "ok" in meta.columns else meta
    rows = asks.join(maps.select(key, "nx", "nz", "x_min", "z_min"), key, "left")
    for end in ("start", "goal"):
        rows = rows.withColumn(f"{end}_ix", world_to_cell(F.col(f"{end}_x"), F.col("x_min"), cell)).withColumn(
            f"{end}_iz", world_to_cell(F.col(f"{end}_z"), F.col("z_min"), cell)
        )

    def inside(end: str):
        return F.coalesce(
            F.col(f"{end}_ix").between(0, F.col("nx") - 1) & F.col(f"{end}_iz").between(0, F.col("nz") - 1), F.lit(False)
        )

    refused = (
        F.when(F.col("nx").isNull(), "no map")
        .when(~inside("start"), "start outside")
        .when(~inside("goal"), "goal outside")
    )
    every = cut_lineage(rows.withColumn("reason", refused))
    rows = every.filter("reason is null")
    wanted = rows.select(key, F.col("start_ix").alias("ix"), F.col("start_iz").alias("iz")).unionByName(
        rows.select(key, F.col("goal_ix").alias("ix"), F.col("goal_iz").alias("iz"))
    )
    snapped = cut_lineage(snap_to_free(wanted, cells, key).filter("to_ix is not null"))
    for end in ("start", "goal"):
        rows = rows.join(
            snapped.select(
                key,
                F.col("ix").alias(f"{end}_ix"),
                F.col("iz").alias(f"{end}_iz"),
                F.struct("to_ix", "to_iz").alias(f"_{end}"),
            ),
            [key, f"{end}_ix", f"{end}_iz"],
        )
        rows = rows.withColumn(
            f"{end}_node", F.col(f"_{end}.to_iz").cast("long") * F.col("nx") + F.col(f"_{end}.to_ix")
        )
    return every, cut_lineage(rows.select("ask_id", key, "nx", "start_node", "goal_node")), snapped


def _distances(rows: DataFrame, roads: DataFrame, key: str) -> DataFrame:
    """(key, src, node, d, hops, back): distance of nodes from each distinct start, and the node before.

    Of equally long ways the one of fewest hops counts.  Two hops a round.  Once all goals of a start are reached, nodes whose distance and straight way on to the box of
    those goals exceed the longest of them go no further.
    """
    goals = cut_lineage(rows.select(key, "nx", F.col("start_node").alias("src"), F.col("goal_node").alias("node")).distinct())
    x, z = F.col("node") % F.col("nx"), F.floor(F.col("node") / F.col("nx"))
    boxes = goals.groupBy(key, "src", "nx").agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(z).alias("_z0"), F.max(z).alias("_z1"), F.count(F.lit(1)).alias("_goals")
    )
    boxes = cut_lineage(boxes)
    best = cut_lineage(
        boxes.select(
            key, "src", F.col("src").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("hops"),
            F.lit(None).cast("long").alias("back"), F.lit(True).alias("fresh"),
        )
    )
    cost = F.struct(F.round("d", 6).alias("near"), "hops", "d", "back")

    def hop(front: DataFrame) -> DataFrame:
        return (
            front.select(key, "src", F.col("node").alias("back"), F.col("d").alias("_d"), (F.col("hops") + 1).alias("hops"))
            .join(roads.withColumnRenamed("a", "back"), [key, "back"])
            .withColumn("d", F.col("_d") + F.col("w"))
            .groupBy(key, "src", F.col("b").alias("node"))
            .agg(F.min(cost).alias("_o"))
            .select(key, "src", "node", "_o.d", "_o.hops", "_o.back")
        )

    def promising(front: DataFrame) -> DataFrame:
        met = goals.join(best.select(key, "src", "node", "d"), [key, "src", "node"])
        longest = met.groupBy(key, "src").agg(F.max("d").alias("_most"), F.count(F.lit(1)).alias("_met"))
        bound = boxes.join(longest, [key, "src"], "left")
        limit = F.when(F.col("_met") == F.col("_goals"), F.col("_most") + 1e-6)
        box = [F.col(c) for c in ("nx", "_x0", "_x1", "_z0", "_z1")]
        ahead = F.col("d") + _away(F.col("node"), *box)
        kept = front.join(bound.withColumn("_limit", limit), [key, "src"])
        return kept.filter(F.col("_limit").isNull() | (ahead <= F.col("_limit"))).select(key, "src", "node", "d", "hops")

    while True:  # a node's distance only falls, so this ends
        front = cut_lineage(promising(best.filter("fresh")))
        if front.isEmpty():
            return best.drop("fresh")
        once = hop(front)
        offers = once.unionByName(hop(once))
        merged = (
            best.select(key, "src", "node", "d", "hops", "back", F.lit(True).alias("known"))
            .unionByName(offers.withColumn("known", F.lit(False)))
            .groupBy(key, "src", "node")
            .agg(F.min(F.when(F.col("known"), cost)).alias("_was"), F.min(F.when(~F.col("known"), cost)).alias("_new"))
        )
        was, new = F.col("_was"), F.col("_new")
        less = (new["near"] < was["near"]) | ((new["near"] == was["near"]) & (new["hops"] < was["hops"]))
        better = F.coalesce(less, was.isNull())
        chosen = F.when(better, new).otherwise(was)
        best = cut_lineage(
            merged.select(key, "src", "node", *(chosen[c].alias(c) for c in ("d", "hops", "back")), better.alias("fresh"))
        )


def _searched(
    asks: DataFrame, walls: DataFrame, meta: DataFrame, key: str, cell: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answered asks, the asks with nodes, and the distances."""
    cells = cut_lineage(free_components(walls, meta, key))
    every, rows, snapped = _ends(asks, cells, meta, key, cell)
    stops = snapped.select(key, F.col("to_ix").alias("ix"), F.col("to_iz").alias("iz"))
    roads = tile_roads(walls, meta, stops, key)
    roads = cut_lineage(
        roads.unionByName(roads.select(key, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        .repartition(key, "a")
    )
    best = _distances(rows, roads, key)
    reached = best.select(key, F.col("src").alias("start_node"), F.col("node").alias("goal_node"), "d")
    routes = rows.join(reached, [key, "start_node", "goal_node"], "left").drop(key, "nx")
    answered = every.select("ask_id", key, "reason").join(routes, "ask_id", "left")
    reason = F.coalesce(
        "reason", F.when(F.col("start_node").isNull(), "no free cell"), F.when(F.col("d").isNull(), "no way")
    )
    answered = answered.select(
        "ask_id",
        key,
        F.col("d").isNotNull().alias("ok"),
        reason.alias("reason"),
        (F.col("d") * cell).alias("length_m"),
        "start_node",
        "goal_node",
    )
    return answered, rows, best


def route_length(asks: DataFrame, walls: DataFrame, meta: DataFrame, key: str, cell: float) -> DataFrame:
    """Shortest walking length in metres for (ask_id, key, start_x, start_z, goal_x, goal_z), a row per ask.

    ``reason`` says why an ask has no route: 'no map', 'start outside', 'goal outside', 'no free cell' or
    'no way'.  Ends are snapped to the walkable region.
    """
    return _searched(asks, walls, meta, key, cell)[0]


def _borders(answered: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """(ask_id, key, hop, a, b): the pieces of each route, read backwards, with hop 0 the last."""
    back = best.filter("back is not null").select(
        key, F.col("src").alias("start_node"), F.col("node").alias("b"), F.col("back").alias("a")
    )
    back = written(back, "route-backs")
    at = answered.filter("ok and start_node <> goal_node").select("ask_id", key, "start_node", F.col("goal_node").alias("b"))
    out: DataFrame | None = None
    hop = 0
    while True:
        pieces: DataFrame | None = None
        for _ in range(4):  # hops a round
            step = at.join(back, [key, "start_node", "b"]).withColumn("hop", F.lit(hop))
            pieces = step if pieces is None else pieces.unionByName(step)
            at = step.filter("a <> start_node").select("ask_id", key, "start_node", F.col("a").alias("b"))
            hop += 1
        pieces = written(pieces, "route-pieces")
        out = pieces if out is None else out.unionByName(pieces)
        last = pieces.filter((F.col("hop") == hop - 1) & (F.col("a") != F.col("start_node")))
        if last.isEmpty():
            return out.select("ask_id", key, "hop", "a", "b")
        at = last.select("ask_id", key, "start_node", F.col("a").alias("b"))


def _walk(d: np.ndarray, x: int, z: int) -> list[tuple[int, int]]:
    """Cells from the start of the distances ``d`` of a tile to (x, z); of equal ways the first step in scan order."""
    out = [(x, z)]
    while d[z, x] > 0:
        ways = []
        for i, j in sorted(_STEPS, key=lambda s: (s[1], s[0])):
            if 0 <= x + i < TILE and 0 <= z + j < TILE:
                ways.append((round(d[z + j, x + i] + (math.sqrt(2.0) if i and j else 1.0), 9), len(ways), x + i, z + j))
        _, _, x, z = min(ways)
        out.append((x, z))
    return out[::-1]


def route_cells(answered: DataFrame, best: DataFrame, walls: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """(route_id, key, step, ix, iz): every cell of every route found, steps rising from start to goal.

    Equal pieces of different routes are walked once.
    """
    kind = meta.schema[key].dataType.simpleString()
    pieces = cut_lineage(_borders(answered, best, key).join(meta.select(key, "nx"), key))

    def place(node: str) -> tuple[Column, Column]:
        return (F.col(node) % F.col("nx")).cast("int"), F.floor(F.col(node) / F.col("nx")).cast("int")

    (ax, az), (bx, bz) = place("a"), place("b")
    ends = pieces.select(key, "a", "b", ax.alias("ix"), az.alias("iz"), bx.alias("bx"), bz.alias("bz")).distinct()
    ends = _with_tile(ends)
    within = (F.floor(F.col("bx") / TILE) == F.col("tx")) & (F.floor(F.col("bz") / TILE) == F.col("tz"))
    keys = [key, "tx", "tz"]
    asked = ends.filter(within)
    tiles = _tile_grid(meta, key).join(asked.select(*keys).distinct(), keys, "left_semi")
    rows = asked.select(*keys, "a", "b", "ix", "iz", "bx", "bz", F.lit(False).alias("wall")).unionByName(
        _with_tile(_fresh(walls.select(key, "ix", "iz"))).withColumn("wall", F.lit(True)), allowMissingColumns=True
    )

    def fill(tile_rows: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {key: [], "a": [], "b": [], "k": [], "ix": [], "iz": []}
        if not tile_rows.empty:
            tile = tile_rows.iloc[0]
            x0, z0 = int(tile["tx"]) * TILE, int(tile["tz"]) * TILE
            free = _free_mask(tile, both[both["wall"]])
            for a, mine in both[~both["wall"]].groupby("a"):
                start = mine.iloc[0]
                d = _spread(free, np.array([[int(start["ix"]) - x0, int(start["iz"]) - z0]]))[0]
                for b, x, z in zip(mine["b"], mine["bx"], mine["bz"], strict=True):
                    cells = _walk(d, int(x) - x0, int(z) - z0)[1:]
                    out["a"] += [int(a)] * len(cells)
                    out["b"] += [int(b)] * len(cells)
                    out["k"] += range(len(cells))
                    out["ix"] += [c[0] + x0 for c in cells]
                    out["iz"] += [c[1] + z0 for c in cells]
            out[key] = [tile[key]] * len(out["a"])
        return pd.DataFrame({n: pd.Series(v, dtype=object if n == key else "int64") for n, v in out.items()})

    filled = (
        tiles.groupBy(*keys)
        .cogroup(_fresh(rows).groupBy(*keys))
        .applyInPandas(fill, f"`{key}` {kind}, a bigint, b bigint, k int, ix int, iz int")
    )
    crossed = ends.filter(~within).select(key, "a", "b", F.lit(0).alias("k"), F.col("bx").alias("ix"), F.col("bz").alias("iz"))
    walked = pieces.select("ask_id", key, "hop", "a", "b").join(filled.unionByName(crossed), [key, "a", "b"])
    # Hops count from the goal; a piece inside a tile has fewer cells than the tile.
    step = (-F.col("hop").cast("long")) * (TILE * TILE) + F.col("k") + 1
    sx, sz = place("start_node")
    firsts = answered.filter("ok").join(meta.select(key, "nx"), key)
    firsts = firsts.select("ask_id", key, F.lit(-(1 << 62)).alias("step"), sx.alias("ix"), sz.alias("iz"))
    out = walked.select("ask_id", key, step.alias("step"), "ix", "iz").unionByName(firsts)
    return out.withColumnRenamed("ask_id", "route_id")


def routes(
    asks: DataFrame, walls: DataFrame, meta: DataFrame, key: str, cell: float, simplify: bool = True
) -> DataFrame:
    """As :func:`route_length`, with ``waypoints``: an array of (x, z) from start to goal, null without a route.

    ``simplify`` leaves only the points a walker turns at; else every cell of the route is one.
    """
    answered, _, best = _searched(asks, walls, meta, key, cell)
    answered = cut_lineage(answered)
    cells = cut_lineage(route_cells(answered, best, walls, meta, key))
    if simplify:
        cells = simplify_routes(cells, walls, key)
    placed = cells.join(meta.select(key, "x_min", "z_min"), key).select(
        F.col("route_id").alias("ask_id"),
        "step",
        cell_to_world(F.col("ix"), F.col("x_min"), cell).alias("x"),
        cell_to_world(F.col("iz"), F.col("z_min"), cell).alias("z"),
    )
    points = placed.groupBy("ask_id").agg(F.array_sort(F.collect_list(F.struct("step", "x", "z"))).alias("_p"))
    points = points.select("ask_id", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"))).alias("waypoints"))
    return answered.join(points, "ask_id", "left")
