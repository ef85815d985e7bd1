"""Radius and nearest-neighbour joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import planar
from aislewise.operators.ordered import top_per_group
from aislewise.session import cut_lineage, written


def _around(reach: int = 1) -> Column:
    span = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in span for b in span])


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def radius_pairs(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    a: tuple[str, str],
    b: tuple[str, str],
    strict: bool = False,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of rows of the same ``keys`` closer than ``radius`` in the plane; ``left`` is the side copied
    to the nine surrounding cells.  Other column names of both sides must differ.

    No side is broadcast: the planner takes the ninefold side for as small as its source."""
    probes = (
        left.withColumn("_d", F.explode(_around()))
        .withColumn("_ci", cell_of(F.col(a[0]), radius) + F.col("_d.a"))
        .withColumn("_cj", cell_of(F.col(a[1]), radius) + F.col("_d.b"))
        .drop("_d")
    )
    targets = right.withColumn("_ci", cell_of(F.col(b[0]), radius)).withColumn("_cj", cell_of(F.col(b[1]), radius))
    distance = planar(F.col(b[0]) - F.col(a[0]), F.col(b[1]) - F.col(a[1]))
    near = distance < radius if strict else distance <= radius
    return probes.join(targets.hint("merge"), [*keys, "_ci", "_cj"]).withColumn("distance", distance).filter(near).drop("_ci", "_cj")


def visible_products(
    cameras: DataFrame,
    products: DataFrame,
    reach: float = 6.0,
    fx: float = 1000.0,
    fy: float = 1000.0,
    cx: float = 960.0,
    cy: float = 540.0,
    keys: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Products of the camera's map (``keys``) in front of it that land inside 2..98 % of the picture.

    Cameras: camera_id, cam_x, cam_y, cam_z, rot_y.  Products: product_id, x, y, z, share, and any columns to ``carry``.
    """
    pairs = radius_pairs(products, cameras, reach, ("x", "z"), ("cam_x", "cam_z"), keys=keys)
    dx, dy, dz = F.col("x") - F.col("cam_x"), F.col("y") - F.col("cam_y"), F.col("z") - F.col("cam_z")
    c, s = F.cos(-F.col("rot_y")), F.sin(-F.col("rot_y"))
    ahead = dx * s + dz * c
    seen = pairs.withColumn("_lx", dx * c - dz * s).withColumn("_lz", ahead).filter(F.col("_lz") > 0.2)
    across = (fx * F.col("_lx") / F.col("_lz") + cx) / (cx * 2) * 100
    down = (fy * -dy / F.col("_lz") + cy) / (cy * 2) * 100
    shown = F.when(F.col("share") > 0.7, "high").when(F.col("share") > 0.4, "med").otherwise("low")
    return (
        seen.withColumn("across", across)
        .withColumn("down", down)
        .filter(F.col("across").between(2, 98) & F.col("down").between(2, 98))
        .withColumn("class", shown)
        .select(*keys, "camera_id", "product_id", "across", "down", "class", *carry)
    )


def idw_lift(
    keypoints: DataFrame, points: DataFrame, radius: float = 30.0, k: int = 4, growth: float = 4.0
) -> DataFrame:
    """3-D place of each keypoint: inverse-distance mean of its ``k`` nearest depth points of
    the frame, for keypoints whose nearest one is closer than ``radius`` pixels.

    Keypoints: kp_id, frame, u, v.  Points: point_id, frame, u, v, x, y, z.
    Of points at one pixel only the first ``k`` can count, and keypoints at one pixel are lifted
    once.  The first pass looks at the nine cells around each keypoint, cells that hold about
    ``k / 2`` points in a frame of even density, so a crowded frame meets no more points per keypoint
    than an empty one.  A keypoint whose k-th neighbour is not proven by that area goes on to cells
    ``growth`` times larger; the last pass covers the whole frame, so the result is exact.
    """
    pixel = ["frame", "u", "v"]
    spots = top_per_group(points.select("point_id", *pixel, "x", "y", "z"), pixel, ["point_id"], k)
    spots = written(spots.withColumnsRenamed({"u": "_pu", "v": "_pv"}), "idw-points")
    frames = cut_lineage(_first_cells(spots, radius, k))
    targets = spots.join(frames.select("frame", "_cell"), "frame")
    open_rows = cut_lineage(keypoints.select(*pixel).distinct().join(frames, "frame"))
    scale, done = 1.0, []
    while True:
        cell = F.col("_cell") * scale
        probes = (
            open_rows.withColumn("_d", F.explode(_around()))
            .withColumn("_ci", F.floor(F.col("u") / cell) + F.col("_d.a"))
            .withColumn("_cj", F.floor(F.col("v") / cell) + F.col("_d.b"))
            .select(*pixel, "_ci", "_cj")
        )
        placed = targets.withColumn("_ci", F.floor(F.col("_pu") / cell)).withColumn("_cj", F.floor(F.col("_pv") / cell))
        pairs = probes.join(placed.drop("_cell").hint("merge"), ["frame", "_ci", "_cj"]).withColumn(
            "_dist", planar(F.col("_pu") - F.col("u"), F.col("_pv") - F.col("v"))
        )
        looked = pairs.groupBy(*pixel).agg(F.count(F.lit(1)).alias("_looked"))
        near = top_per_group(pairs, pixel, ["_dist", "point_id"], k)
        weight = 1.0 / (F.col("_dist") + 1e-6)
        lifted = near.groupBy(*pixel).agg(
            F.min("_dist").alias("nearest"),
            F.max("_dist").alias("_far"),
            F.count(F.lit(1)).alias("_k"),
            *[(F.sum(weight * F.col(a)) / F.sum(weight)).alias(a) for a in "xyz"],
        )
        rows = open_rows.join(lifted.hint("merge"), pixel, "left").join(looked.hint("merge"), pixel, "left")
        proven = ((F.col("_k") == k) & (F.col("_far") <= cell)) | (F.col("_looked") == F.col("_total"))
        empty = (cell >= radius) & ~F.coalesce(F.col("nearest") < radius, F.lit(False))
        rows = cut_lineage(rows.withColumn("_proven", F.coalesce(proven, F.lit(False))).filter(~empty))
        done.append(rows.filter(F.col("_proven") & (F.col("nearest") < radius)).select(*pixel, "nearest", "x", "y", "z"))
        open_rows = rows.filter("not _proven").select(*pixel, "_total", "_cell")
        if open_rows.isEmpty():
            break
        scale *= growth
        if not math.isfinite(radius * scale):
            raise RuntimeError("pixel coordinates out of range")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return keypoints.select("kp_id", *pixel).join(out.hint("merge"), pixel).select("kp_id", "nearest", "x", "y", "z")


def _first_cells(spots: DataFrame, radius: float, k: int) -> DataFrame:
    """(frame, _total, _cell): a side on which the inner nine tenths of a frame's points would hold k / 2 a cell,
    halved from ``radius`` at most eight times."""
    ends = [F.percentile_approx(f"_p{a}", [0.05, 0.95], 1000).alias(f"_{a}") for a in "uv"]
    frames = spots.groupBy("frame").agg(F.count(F.lit(1)).alias("_total"), *ends)
    sides = [F.greatest(F.col(f"_{a}")[1] - F.col(f"_{a}")[0], F.lit(radius / 256)) for a in "uv"]
    side = F.sqrt(sides[0] * sides[1] * (k / 2) / F.col("_total"))
    halvings = F.least(F.greatest(F.ceil(F.log2(radius / side)), F.lit(0)), F.lit(8))
    cell = F.coalesce(radius / F.pow(F.lit(2.0), halvings), F.lit(float(radius)))
    return frames.select("frame", "_total", cell.alias("_cell"))
