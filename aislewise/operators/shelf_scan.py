"""One pass from shelf-label readings to placed, confidence-rated product sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.operators.fusion import observation_confidence, points_in_boxes
from aislewise.operators.ordered import top_per_group
from aislewise.operators.poses import (
    backproject,
    element,
    fallback_place,
    project_to_portrait,
    rigid_inverse,
    yaw_only_map,
)
from aislewise.operators.search import fuzzy_match_top1
from aislewise.session import cut_lineage


def _lens(name: str):
    return F.col(f"cam.{name}")


def project_points(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(frame, u, v, depth) of world points in front of their frame's camera."""
    rows = points.select("frame", "x", "y", "z").join(cameras, "frame")
    rows = rows.withColumn("cam", F.struct("fx", "fy", "cx", "cy", "height")).withColumn("_i", rigid_inverse("pose"))
    u, v, depth = project_to_portrait(
        "_i", F.col("x"), F.col("y"), F.col("z"), *[_lens(n) for n in ("fx", "fy", "cx", "cy", "height")]
    )
    return rows.select("frame", u.alias("u"), v.alias("v"), depth.alias("depth")).filter("depth > 0.1")


def shelf_scan(
    labels: DataFrame,
    points: DataFrame,
    cameras: DataFrame,
    catalogue: DataFrame,
    lex: Lexicon,
    path_height: float = 0.0,
    min_score: float = 70.0,
) -> DataFrame:
    """Sightings from labels (box_id, frame, name, x1, y1, x2, y2), points (frame, x, y, z) and
    cameras (frame, pose, to_map, fx, fy, cx, cy, height).

    The first label of a name per frame counts.  Names are matched once each; labels without a
    product at ``min_score`` are left out.
    """
    named = labels.filter(F.col("name").isNotNull() & (F.col("name") != ""))
    unique = top_per_group(named, ["frame", "name"], ["box_id"], 1)
    names = unique.select(F.col("name").alias("query_id"), F.col("name").alias("query")).distinct()
    matches = fuzzy_match_top1(names, catalogue, lex, min_score).withColumnRenamed("query_id", "name")
    matched = cut_lineage(unique.join(matches, "name"))
    depths = points_in_boxes(
        cut_lineage(project_points(points, cameras)), matched.select("box_id", "frame", "x1", "y1", "x2", "y2")
    ).drop("frame")
    rows = matched.join(depths, "box_id").join(cameras, "frame")
    rows = rows.withColumn("cam", F.struct("fx", "fy", "cx", "cy", "height"))
    lens = [_lens(n) for n in ("fx", "fy", "cx", "cy", "height")]
    inside = backproject(
        "pose", (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("depth"), *lens
    )
    ahead = fallback_place("pose", F.col("depth"))
    place = [F.when(F.col("from_box"), a).otherwise(b) for a, b in zip(inside, ahead)]
    for n, c in zip(("_wx", "_wy", "_wz"), place):
        rows = rows.withColumn(n, c)
    camera = tuple(element("pose", i, 3) for i in range(3))
    mapped = yaw_only_map("to_map", (F.col("_wx"), F.col("_wy"), F.col("_wz")), camera, F.lit(path_height))
    keep = F.col("to_map").isNotNull()
    return rows.select(
        F.col("box_id").alias("ord"),
        "frame",
        "name",
        "product_id",
        "score",
        "hits",
        "from_box",
        *[F.when(keep, m).otherwise(F.col(w)).alias(n) for n, m, w in zip("xyz", mapped, ("_wx", "_wy", "_wz"))],
        observation_confidence(F.col("from_box"), F.col("score")).alias("confidence"),
    )
