"""Point clouds to walkable grids: occupancy, dilation, regions, snapping and routes.

Cells are integers (ix, iz) per map.  Dense work is done in square tiles: a tile holds at
most TILE * TILE cells whatever the data, so it is a safe unit for NumPy; tiles exchange
only their borders, through joins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.operators.graph import components
from aislewise.operators.quantiles import quantiles
from aislewise.session import cut_lineage

TILE = 32
_STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def _fresh(df: DataFrame) -> DataFrame:
    """Same columns under new identities, so a table can meet a relative of itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def world_to_cell(value: Column, low: Column, cell: float) -> Column:
    """Truncated towards zero."""
    return ((value - low) / F.lit(cell)).cast("int")


def cell_to_world(index: Column, low: Column, cell: float) -> Column:
    return low + (index + F.lit(0.5)) * F.lit(cell)


def height_bounds(
    points: DataFrame, key: str, above_min: float = 0.30, above_max: float = 2.00, below_ceiling: float = 0.2
) -> DataFrame:
    """Floor (5 %), ceiling (95 %) and the obstacle band between them per map."""
    found = quantiles(points.select(key, "y"), [key], "y", {"floor": 0.05, "ceiling": 0.95})
    return found.withColumn("band_low", F.col("floor") + above_min).withColumn(
        "band_high", F.least(F.col("floor") + above_max, F.col("ceiling") - below_ceiling)
    )


def height_band(points: DataFrame, key: str, inclusive: bool = False, **how) -> DataFrame:
    rows = points.join(height_bounds(points, key, **how), key)
    y = F.col("y")
    inside = (
        y.between(F.col("band_low"), F.col("band_high"))
        if inclusive
        else (y > F.col("band_low")) & (y < F.col("band_high"))
    )
    return rows.filter(inside).drop("floor", "ceiling", "band_low", "band_high")


def map_bounds(points: DataFrame, key: str, margin: float = 1.0) -> DataFrame:
    return points.groupBy(key).agg(
        *[(F.min(a) - margin).alias(f"{a}_min") for a in "xz"],
        *[(F.max(a) + margin).alias(f"{a}_max") for a in "xz"],
        F.count(F.lit(1)).alias("n_points"),
    )


def occupancy_grid(
    points: DataFrame,
    key: str,
    cell: float = 0.10,
    margin: float = 1.0,
    min_points: int = 100,
    max_cells: int | None = None,
    **band,
) -> tuple[DataFrame, DataFrame]:
    """(obstacle cells, one meta row per map).  Maps with too few points, or above ``max_cells``
    where that is asked for, have ``ok`` false and no cells."""
    bounds = map_bounds(points, key, margin).join(height_bounds(points, key, **band), key)
    meta = (
        bounds.withColumn("nx", F.ceil((F.col("x_max") - F.col("x_min")) / cell).cast("int"))
        .withColumn("nz", F.ceil((F.col("z_max") - F.col("z_min")) / cell).cast("int"))
        .withColumn(
            "ok",
            (F.col("n_points") >= min_points)
            & (F.col("nx") > 0)
            & (F.col("nz") > 0)
            & (F.lit(True) if max_cells is None else F.col("nx").cast("long") * F.col("nz") <= max_cells),
        )
    )
    rows = points.select(key, "x", "y", "z").join(meta.filter("ok"), key)
    inside = rows.filter((F.col("y") > F.col("band_low")) & (F.col("y") < F.col("band_high")))
    ix = F.greatest(F.lit(0), F.least(F.col("nx") - 1, world_to_cell(F.col("x"), F.col("x_min"), cell)))
    iz = F.greatest(F.lit(0), F.least(F.col("nz") - 1, world_to_cell(F.col("z"), F.col("z_min"), cell)))
    cells = inside.groupBy(key, ix.alias("ix"), iz.alias("iz")).agg(F.count(F.lit(1)).alias("n"))
    return cells, meta


def ellipse_offsets(radius: int) -> list[tuple[int, int]]:
    """Cells of a round kernel of the given radius."""
    out = []
    for dz in range(-radius, radius + 1):
        reach = round(math.sqrt(radius * radius - dz * dz)) if radius else 0
        out += [(dx, dz) for dx in range(-reach, reach + 1)]
    return out


def _shifted(cells: DataFrame, key: str, offsets: list[tuple[int, int]]) -> DataFrame:
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    return cells.select(key, "ix", "iz", F.explode(table).alias("_d")).select(
        key, (F.col("ix") + F.col("_d.a")).alias("ix"), (F.col("iz") + F.col("_d.b")).alias("iz")
    )


def _inside(cells: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    bounded = cells.join(meta.select(key, "nx", "nz"), key)
    return bounded.filter(
        (F.col("ix") >= 0) & (F.col("iz") >= 0) & (F.col("ix") < F.col("nx")) & (F.col("iz") < F.col("nz"))
    ).drop("nx", "nz")


def dilate_cells(cells: DataFrame, meta: DataFrame, key: str, radius: int) -> DataFrame:
    grown = _shifted(cells.select(key, "ix", "iz").distinct(), key, ellipse_offsets(radius)).distinct()
    return _inside(grown, meta, key)


_SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _grow(cells: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    return _inside(_shifted(cells, key, _SQUARE).distinct(), meta, key)


def _shrink(cells: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Cells whose whole 3 x 3 neighbourhood is set; outside the grid counts as set."""
    votes = _shifted(cells, key, _SQUARE).groupBy(key, "ix", "iz").agg(F.count(F.lit(1)).alias("n"))
    bounded = votes.join(meta.select(key, "nx", "nz"), key)
    wide = F.lit(3) - (F.col("ix") == 0).cast("int") - (F.col("ix") == F.col("nx") - 1).cast("int")
    tall = F.lit(3) - (F.col("iz") == 0).cast("int") - (F.col("iz") == F.col("nz") - 1).cast("int")
    kept = (F.col("n") == wide * tall) & F.col("ix").between(0, F.col("nx") - 1) & F.col("iz").between(
        0, F.col("nz") - 1
    )
    return bounded.filter(kept).select(key, "ix", "iz")


def cell_density(points: DataFrame, key: str, cell: float = 0.10, more_than: int = 8, padding: float = 1.0):
    """(dense cells with counts, meta) of points already cut to shelf height."""
    meta = (
        map_bounds(points, key, padding)
        .withColumn("nx", ((F.col("x_max") - F.col("x_min")) / cell).cast("int") + 1)
        .withColumn("nz", ((F.col("z_max") - F.col("z_min")) / cell).cast("int") + 1)
    )
    rows = points.select(key, "x", "z").join(meta, key)
    cells = rows.groupBy(
        key,
        world_to_cell(F.col("x"), F.col("x_min"), cell).alias("ix"),
        world_to_cell(F.col("z"), F.col("z_min"), cell).alias("iz"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return cells.filter(F.col("n") > more_than), meta


def shelf_rectangles(
    points: DataFrame,
    key: str,
    cell: float = 0.10,
    more_than: int = 8,
    min_area: float = 0.2,
    padding: float = 1.0,
) -> DataFrame:
    """Bounding boxes of dense blobs after closing and opening with a 3 x 3 square.

    A blob lying inside a hole of another one is not reported.
    """
    dense, meta = cell_density(points, key, cell, more_than, padding)
    meta = cut_lineage(meta)
    closed = _shrink(_grow(dense.select(key, "ix", "iz"), meta, key), meta, key)
    opened = cut_lineage(_grow(_shrink(closed, meta, key), meta, key))
    node = F.col("iz").cast("long") * 10_000_000 + F.col("ix")
    nodes = opened.select(key, "ix", "iz", node.alias("node"))
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(1, 0), (0, 1), (1, 1), (1, -1)]])
    edges = (
        nodes.select(key, F.col("node").alias("a"), "ix", "iz", F.explode(table).alias("_d"))
        .select(key, "a", (F.col("ix") + F.col("_d.a")).alias("ix"), (F.col("iz") + F.col("_d.b")).alias("iz"))
        .join(nodes.withColumnRenamed("node", "b"), [key, "ix", "iz"])
        .select(key, "a", "b")
    )
    labels = components(nodes.select(key, "node"), edges, key)
    blobs = nodes.join(labels, [key, "node"])
    outside = _reached_from_outside(blobs.select(key, "ix", "iz", "label"), meta, key)
    boxes = (
        blobs.join(outside, [key, "label"], "left_semi")
        .groupBy(key, "label")
        .agg(*[f(a).alias(f"{a}_{n}") for a in ("ix", "iz") for n, f in (("lo", F.min), ("hi", F.max))])
        .join(meta.select(key, "x_min", "z_min"), key)
    )
    wide, tall = F.col("ix_hi") - F.col("ix_lo") + 1, F.col("iz_hi") - F.col("iz_lo") + 1
    return boxes.filter(wide * tall >= min_area / (cell * cell)).select(
        key,
        (F.col("x_min") + F.col("ix_lo") * cell).alias("x"),
        (F.col("z_min") + F.col("iz_lo") * cell).alias("z"),
        (wide * cell).alias("width"),
        (tall * cell).alias("depth"),
    )


def _reached_from_outside(blobs: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Labels of blobs touching the background region that surrounds the grid."""
    padded = meta.select(key, (F.col("nx") + 2).alias("nx"), (F.col("nz") + 2).alias("nz"))
    moved = blobs.select(key, (F.col("ix") + 1).alias("ix"), (F.col("iz") + 1).alias("iz"), "label")
    tiles = label_tiles(moved.select(key, "ix", "iz"), padded, key)
    free = open_tiles(tiles, key)
    border = free.filter("label = 0").select(key, "ix", "iz")
    touching = (
        moved.select(key, "ix", "iz", "label")
        .withColumn("_d", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                                              for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])))
        .select(key, "label", (F.col("ix") + F.col("_d.a")).alias("ix"), (F.col("iz") + F.col("_d.b")).alias("iz"))
        .join(border, [key, "ix", "iz"])
    )
    return touching.select(key, "label").distinct()


# Regions -----------------------------------------------------------------------------


def _tile_grid(meta: DataFrame, key: str) -> DataFrame:
    last = lambda n: F.floor((F.col(n) - 1) / TILE).cast("int")
    return (
        meta.select(key, "nx", "nz")
        .withColumn("tx", F.explode(F.sequence(F.lit(0), last("nx"))))
        .withColumn("tz", F.explode(F.sequence(F.lit(0), last("nz"))))
    )


def _with_tile(cells: DataFrame) -> DataFrame:
    return cells.withColumn("tx", F.floor(F.col("ix") / TILE).cast("int")).withColumn(
        "tz", F.floor(F.col("iz") / TILE).cast("int")
    )


def _free_mask(tile: pd.Series, walls: pd.DataFrame) -> np.ndarray:
    """free[z, x] of one tile; cells beyond the grid are not free."""
    free = np.zeros((TILE, TILE), dtype=bool)
    free[: max(0, min(TILE, tile["nz"] - tile["tz"] * TILE)), : max(0, min(TILE, tile["nx"] - tile["tx"] * TILE))] = True
    if len(walls):
        free[walls["iz"].to_numpy() - tile["tz"] * TILE, walls["ix"].to_numpy() - tile["tx"] * TILE] = False
    return free


def _local_labels(free: np.ndarray) -> np.ndarray:
    """4-connected regions of one tile, labelled by their lowest cell number, -1 elsewhere."""
    lab = np.where(free, np.arange(free.size).reshape(free.shape), -1)
    big = free.size
    while True:
        work = np.where(free, lab, big)
        low = work.copy()
        low[1:] = np.minimum(low[1:], work[:-1])
        low[:-1] = np.minimum(low[:-1], work[1:])
        low[:, 1:] = np.minimum(low[:, 1:], work[:, :-1])
        low[:, :-1] = np.minimum(low[:, :-1], work[:, 1:])
        new = np.where(free, low, -1)
        # Follow labels to the label of their own cell, which halves long corridors.
        flat_new = new.ravel()
        inside = flat_new >= 0
        flat_new[inside] = flat_new[flat_new[inside]]
        if (new == lab).all():
            return lab
        lab = new


def label_tiles(walls: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """(key, nx, tx, tz, labels): one row per tile with the region label of each of its cells.

    A label is the lowest cell number (iz * nx + ix) of the whole region, -1 for walls.
    """
    kind = meta.schema[key].dataType.simpleString()
    tiles = _tile_grid(meta, key)

    def local(tile_rows: pd.DataFrame, wall_rows: pd.DataFrame) -> pd.DataFrame:
        if tile_rows.empty:
            return pd.DataFrame(columns=[key, "nx", "tx", "tz", "labels"])
        tile = tile_rows.iloc[0]
        lab = _local_labels(_free_mask(tile, wall_rows))
        number = (tile["tz"] * TILE + lab // TILE) * np.int64(tile["nx"]) + tile["tx"] * TILE + lab % TILE
        flat = np.where(lab >= 0, number, -1).ravel()
        out = tile_rows[[key, "nx", "tx", "tz"]].copy()
        out["labels"] = [flat.tolist()]
        return out

    keys = [key, "tx", "tz"]
    found = cut_lineage(
        tiles.groupBy(*keys)
        .cogroup(_with_tile(_fresh(walls.select(key, "ix", "iz"))).groupBy(*keys))
        .applyInPandas(local, f"`{key}` {kind}, nx int, tx int, tz int, labels array<bigint>")
    )
    cells = open_tiles(found, key)
    nodes = cells.select(key, F.col("label").alias("node")).distinct()
    right = cells.filter(F.col("ix") % TILE == TILE - 1).select(
        key, (F.col("ix") + 1).alias("ix"), "iz", F.col("label").alias("a")
    )
    below = cells.filter(F.col("iz") % TILE == TILE - 1).select(
        key, "ix", (F.col("iz") + 1).alias("iz"), F.col("label").alias("a")
    )
    first = cells.filter((F.col("ix") % TILE == 0) | (F.col("iz") % TILE == 0)).withColumnRenamed("label", "b")
    edges = right.unionByName(below).join(first, [key, "ix", "iz"]).select(key, "a", "b").distinct()
    joined = components(nodes, edges, key)
    local_labels = found.select(*keys, F.explode(F.array_distinct("labels")).alias("node")).filter("node >= 0")
    renamed = (
        local_labels.join(joined, [key, "node"])
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("node", "label"))).alias("_m"))
    )
    return found.join(renamed, keys, "left").select(
        key,
        "nx",
        "tx",
        "tz",
        F.transform("labels", lambda v: F.when(v < 0, v).otherwise(F.try_element_at("_m", v))).alias("labels"),
    )


def open_tiles(tiles: DataFrame, key: str) -> DataFrame:
    """Free cells (key, ix, iz, label) of tile rows."""
    cells = tiles.select(key, "tx", "tz", F.posexplode("labels").alias("_i", "label")).filter("label >= 0")
    return cells.select(
        key,
        (F.col("tx") * TILE + F.col("_i") % TILE).alias("ix"),
        (F.col("tz") * TILE + F.floor(F.col("_i") / TILE)).cast("int").alias("iz"),
        "label",
    )


def free_components(walls: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Every free cell with its region and whether that region is the largest of its map."""
    cells = open_tiles(label_tiles(walls, meta, key), key)
    sizes = cells.groupBy(key, "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy(key).agg(
        F.max_by("label", F.struct("size", (-F.col("label")).alias("first"))).alias("_main")
    )
    return cells.join(largest, key).withColumn("walkable", F.col("label") == F.col("_main")).drop("_main")


RINGS = (1, 6, 18, 50)  # searched around a cell before the search goes on by tiles
_OFFSET = ["ix", "iz"]


def _nearest(todo: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, ix, iz, to_ix, to_iz, r) of the nearest target of each distinct cell whose map has one.

    Rings first; cells with nothing near look for the nearest tile that holds a target, by the same search
    on tiles, and then through the tiles of that ring and the next, where the nearest cell must be.
    """
    todo = cut_lineage(todo.join(targets.select(key).distinct(), key, "left_semi"))
    out: DataFrame | None = None
    low = 0
    for high in RINGS:
        if todo.isEmpty():
            break
        span = F.sequence(F.lit(-high), F.lit(high))
        tried = todo.withColumn("_a", F.explode(span)).withColumn("_b", F.explode(span))
        tried = tried.withColumn("_r", F.greatest(F.abs("_a"), F.abs("_b"))).filter(F.col("_r") >= low)
        tried = tried.withColumn("to_ix", F.col("ix") + F.col("_a")).withColumn("to_iz", F.col("iz") + F.col("_b"))
        best = cut_lineage(_closest(tried.join(targets, [key, "to_ix", "to_iz"]), key))
        out = best if out is None else out.unionByName(best)
        todo = cut_lineage(todo.join(best, [key, "ix", "iz"], "left_anti"))
        low = high + 1
    if not todo.isEmpty():
        tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
        tiled = targets.select(key, tile("to_ix").alias("to_tx"), tile("to_iz").alias("to_tz"), "to_ix", "to_iz")
        tiled = cut_lineage(tiled)
        asked = todo.select(key, *_OFFSET, tile("ix").alias("tx"), tile("iz").alias("tz"))
        by_tile = _nearest(
            asked.select(key, F.col("tx").alias("ix"), F.col("tz").alias("iz")).distinct(),
            tiled.select(key, F.col("to_tx").alias("to_ix"), F.col("to_tz").alias("to_iz")).distinct(),
            key,
        ).select(key, F.col("ix").alias("tx"), F.col("iz").alias("tz"), F.col("r").alias("_ring"))
        near = asked.join(by_tile, [key, "tx", "tz"])
        span = F.sequence(-F.col("_ring") - 1, F.col("_ring") + 1)
        near = near.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))
        near = near.filter(F.greatest(F.abs("_i"), F.abs("_j")) >= F.col("_ring")).select(
            key, *_OFFSET, (F.col("tx") + F.col("_i")).alias("to_tx"), (F.col("tz") + F.col("_j")).alias("to_tz")
        )
        met = near.join(tiled, [key, "to_tx", "to_tz"])
        met = met.withColumn("_a", F.col("to_ix") - F.col("ix")).withColumn("_b", F.col("to_iz") - F.col("iz"))
        far = cut_lineage(_closest(met.withColumn("_r", F.greatest(F.abs("_a"), F.abs("_b"))), key))
        out = far if out is None else out.unionByName(far)
    if out is None:
        return todo.select(key, *_OFFSET, F.col("ix").alias("to_ix"), F.col("iz").alias("to_iz"), F.lit(0).alias("r"))
    return out


def _closest(tried: DataFrame, key: str) -> DataFrame:
    best = tried.groupBy(key, *_OFFSET).agg(F.min(F.struct("_r", "_a", "_b")).alias("_s"))
    return best.select(
        key, *_OFFSET, (F.col("ix") + F.col("_s._a")).alias("to_ix"), (F.col("iz") + F.col("_s._b")).alias("to_iz"),
        F.col("_s._r").alias("r"),
    )


def snap_to_free(asks: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Nearest walkable cell for each distinct (key, ix, iz), however far; any free cell where a map has no
    walkable one, and null where it has no free cell at all.

    Equal rings are ordered by x offset, then z offset.
    """
    todo = cut_lineage(asks.select(key, *_OFFSET).distinct())
    named = cells.select(key, F.col("ix").alias("to_ix"), F.col("iz").alias("to_iz"), "walkable")
    main = _nearest(todo, cut_lineage(named.filter("walkable").drop("walkable")), key)
    rest = todo.join(main, [key, *_OFFSET], "left_anti")
    other = _nearest(rest, cut_lineage(named.drop("walkable")), key)
    return todo.join(main.unionByName(other).drop("r"), [key, *_OFFSET], "left")


# Lines of sight ----------------------------------------------------------------------


def line_cells(x0: int, z0: int, x1: int, z1: int) -> list[tuple[int, int]]:
    """Grid cells on the straight line between two cells, both ends included."""
    dx, dz = abs(x1 - x0), abs(z1 - z0)
    sx, sz = (1 if x0 < x1 else -1), (1 if z0 < z1 else -1)
    lean, out = dx - dz, []
    while True:
        out.append((x0, z0))
        if (x0, z0) == (x1, z1):
            return out
        twice = 2 * lean
        if twice > -dz:
            lean -= dz
            x0 += sx
        if twice < dx:
            lean += dx
            z0 += sz


def line_cells_of(x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    """The cells of :func:`line_cells` as an array of (ix, iz), in closed form.

    Step k goes k cells along the longer side and floor((2 k short + long - 1) / (2 long)) along the shorter one.
    """
    dx, dz = F.abs(x1 - x0), F.abs(z1 - z0)
    long, short = F.greatest(dx, dz), F.least(dx, dz)
    toward = lambda a, b: F.when(a < b, 1).otherwise(-1)

    def cell(k: Column) -> Column:
        part = F.when(long == 0, 0).otherwise(F.floor((2 * k * short + long - 1) / (2 * F.greatest(long, F.lit(1))))).cast("int")
        along, across = k, part
        ix = x0 + toward(x0, x1) * F.when(dx >= dz, along).otherwise(across)
        iz = z0 + toward(z0, z1) * F.when(dx >= dz, across).otherwise(along)
        return F.struct(ix.cast("int").alias("ix"), iz.cast("int").alias("iz"))

    return F.transform(F.sequence(F.lit(0), long), cell)


def line_of_sight(pairs: DataFrame, walls: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Whether the straight cell line of each (pair_id, key, x0, z0, x1, z1) is free and inside.

    A line is inside where both its ends are.
    """
    rows = pairs.join(meta.select(key, "nx", "nz"), key)
    inside = F.lit(True)
    for end in "01":
        inside = inside & F.col(f"x{end}").between(0, F.col("nx") - 1) & F.col(f"z{end}").between(0, F.col("nz") - 1)
    cells = rows.filter(inside).select(
        "pair_id", key, F.inline(line_cells_of(F.col("x0"), F.col("z0"), F.col("x1"), F.col("z1")))
    )
    met = cells.join(walls.select(key, "ix", "iz").distinct(), [key, "ix", "iz"], "left_semi")
    blocked = met.select(F.col("pair_id").alias("_blocked")).distinct()
    seen = rows.withColumn("_inside", inside).join(blocked, F.col("pair_id") == F.col("_blocked"), "left")
    return seen.select("pair_id", (F.col("_inside") & F.col("_blocked").isNull()).alias("visible"))


LINE_CELLS = 1 << 18  # looked at together
PAIRS = 4096  # of a route's cells, likewise
GRID_CELLS = 1 << 25  # of a route's bounding box, up to which its walls are a dense grid


def _wall_test(xs: np.ndarray, zs: np.ndarray, walls_x: np.ndarray, walls_z: np.ndarray):
    """Function of cells inside the box of ``xs``, ``zs``: which of them are walls (sorted by x)."""
    x0, z0, depth = xs.min(), zs.min(), zs.max() - zs.min() + 1
    low, high = np.searchsorted(walls_x, [x0, xs.max() + 1])
    mine = slice(low, high)
    inside = (walls_z[mine] >= z0) & (walls_z[mine] < z0 + depth)
    codes = (walls_x[mine][inside] - x0) * depth + walls_z[mine][inside] - z0
    if (xs.max() - x0 + 1) * depth <= GRID_CELLS:
        grid = np.zeros((xs.max() - x0 + 1) * depth, bool)
        grid[codes] = True
        return lambda x, z: grid[(x - x0) * depth + z - z0]
    codes = np.append(np.unique(codes), -1)

    def met(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        asked = (x - x0) * depth + z - z0
        return codes[np.searchsorted(codes[:-1], asked)] == asked

    return met


def _in_sight(xs: np.ndarray, zs: np.ndarray, i: np.ndarray, j: np.ndarray, is_wall) -> np.ndarray:
    """For pairs of cells, whether no cell of their line (as in ``line_cells_of``) is a wall; blocked lines end early."""
    dx, dz = np.abs(xs[j] - xs[i]), np.abs(zs[j] - zs[i])
    right, up = np.where(xs[j] > xs[i], 1, -1), np.where(zs[j] > zs[i], 1, -1)
    long, short, wide = np.maximum(dx, dz)[:, None], np.minimum(dx, dz)[:, None], (dx >= dz)[:, None]
    x, z, right, up = xs[i][:, None], zs[i][:, None], right[:, None], up[:, None]
    free = np.zeros(len(i), bool)
    rest, at, width = np.arange(len(i)), 0, 4
    while len(rest):
        k = np.minimum(at + np.arange(width), long[rest])
        part = (2 * k * short[rest] + long[rest] - 1) // np.maximum(2 * long[rest], 1)
        part[long[rest][:, 0] == 0] = 0
        line_x = x[rest] + right[rest] * np.where(wide[rest], k, part)
        line_z = z[rest] + up[rest] * np.where(wide[rest], part, k)
        rest = rest[~is_wall(line_x, line_z).any(axis=1)]
        at += width
        whole = long[rest][:, 0] < at
        free[rest[whole]] = True
        rest = rest[~whole]
        width = max(4, min(2 * width, LINE_CELLS // max(len(rest), 1)))
    return free


def _turns(xs: np.ndarray, zs: np.ndarray, is_wall) -> list[int]:
    """From each kept cell on to the last later one in plain sight, or the next."""
    n, keep, i = len(xs), [0], 0
    first, to = 0, np.empty(0, np.int64)  # where the cells from ``first`` go on to
    while i < n - 1:
        if i >= first + len(to):
            first, to = i, np.arange(i, min(n - 1, i + max(1, PAIRS // (n - i)))) + 1
            for end in range(n - 1, i + 1, -PAIRS):
                js = np.arange(end, max(end - PAIRS, i + 1), -1)
                a, b = np.nonzero(js[None, :] > np.arange(i, i + len(to))[:, None] + 1)
                free = _in_sight(xs, zs, a + i, js[b], is_wall)
                np.maximum.at(to, a[free], js[b[free]])
                if len(to) == 1 and free.any():
                    break
        i = int(to[i - first])
        keep.append(i)
    return keep


def simplify_routes(routes: DataFrame, walls: DataFrame, key: str, rows_per_bucket: int = 200_000) -> DataFrame:
    """Keep the cells of each route (route_id, key, step, ix, iz) that a walker must turn at:
    from each kept cell jump to the last later cell in plain sight.

    A route lies in one ``key``.  The routes of a key are dealt into buckets, and a bucket meets the walls of the tiles
    that its routes' bounding boxes cover, each once; the lines of a cell are looked at together.
    """
    kinds = {f: routes.schema[f].dataType.simpleString() for f in ("route_id", key)}
    buckets = -(-routes.count() // rows_per_bucket) or 1
    bucket = F.pmod(F.xxhash64("route_id"), F.lit(buckets)).cast("int").alias("_bucket")
    rows = routes.select("route_id", key, "step", "ix", "iz", bucket)
    box = rows.groupBy("route_id", key, "_bucket").agg(
        *[f(F.floor(F.col(a) / TILE)).alias(f"{a}_{n}") for a in ("ix", "iz") for n, f in (("lo", F.min), ("hi", F.max))]
    )
    tiles = (
        box.select("_bucket", key, "ix_lo", "ix_hi", "iz_lo", "iz_hi")
        .distinct()
        .withColumn("tx", F.explode(F.sequence("ix_lo", "ix_hi")))
        .withColumn("tz", F.explode(F.sequence("iz_lo", "iz_hi")))
        .select("_bucket", key, F.col("tx").cast("int").alias("tx"), F.col("tz").cast("int").alias("tz"))
        .distinct()
    )
    near = _with_tile(walls.select(key, "ix", "iz")).join(tiles.hint("merge"), [key, "tx", "tz"]).select("_bucket", key, "ix", "iz")

    def run(mine: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        names = ["route_id", key, "step", "ix", "iz"]
        if mine.empty:
            return pd.DataFrame(columns=names)
        blocks = blocks.sort_values("ix")
        walls_x, walls_z = blocks["ix"].to_numpy(np.int64), blocks["iz"].to_numpy(np.int64)
        mine = mine.sort_values(["route_id", "step"], kind="stable", ignore_index=True)
        keep = []
        for at in mine.groupby("route_id", sort=False, dropna=False).indices.values():
            xs, zs = mine["ix"].to_numpy(np.int64)[at], mine["iz"].to_numpy(np.int64)[at]
            keep.append(at[_turns(xs, zs, _wall_test(xs, zs, walls_x, walls_z))])
        return mine.loc[np.concatenate(keep), names]

    return (
        rows.groupBy(key, "_bucket")
        .cogroup(_fresh(near).groupBy(key, "_bucket"))
        .applyInPandas(run, f"route_id {kinds['route_id']}, `{key}` {kinds[key]}, step bigint, ix int, iz int")
    )
