"""Poses as flat column-major 16-arrays: element (row, col) is ``t[col * 4 + row]``.

The camera frame is +X right, +Y up, +Z backwards.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element(t: Column | str, row: int, col: int) -> Column:
    m = F.col(t) if isinstance(t, str) else t
    return F.get(m, col * 4 + row)


def transform_point(t: Column | str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(
        element(t, i, 0) * x + element(t, i, 1) * y + element(t, i, 2) * z + element(t, i, 3) for i in range(3)
    )


def rotate_vector(t: Column | str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(element(t, i, 0) * x + element(t, i, 1) * y + element(t, i, 2) * z for i in range(3))


def rigid_inverse(t: Column | str) -> Column:
    """Inverse of a rotation plus translation: transpose, and minus transpose times t."""
    back = [
        -(
            element(t, 0, i) * element(t, 0, 3)
            + element(t, 1, i) * element(t, 1, 3)
            + element(t, 2, i) * element(t, 2, 3)
        )
        for i in range(3)
    ]
    cells: list[Column] = []
    for col in range(3):
        cells += [element(t, col, row) for row in range(3)] + [F.lit(0.0)]
    return F.array(*cells, *back, F.lit(1.0))


def transform_points(points: DataFrame, matrices: DataFrame, key: str, matrix: str) -> DataFrame:
    """Move x, y, z by the matrix of their key; rows with a missing coordinate stay untouched."""
    joined = points.join(matrices.select(key, matrix), key)
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    for name in ("x", "y", "z"):
        if dict(points.dtypes)[name] in ("double", "float"):
            whole = whole & ~F.isnan(name)
    moved = F.struct(
        *[c.alias(n) for n, c in zip("xyz", transform_point(matrix, F.col("x"), F.col("y"), F.col("z")))]
    )
    out = joined.withColumn("_p", F.when(whole, moved).otherwise(F.struct("x", "y", "z")))
    for n in "xyz":
        out = out.withColumn(n, F.col(f"_p.{n}"))
    return out.drop("_p", matrix)


def project_to_portrait(
    inverse: Column | str, x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column, height: Column
) -> tuple[Column, Column, Column]:
    """World point to portrait pixel (u, v) and forward depth; depth <= 0.1 means behind the camera."""
    cam = transform_point(inverse, x, y, z)
    depth = -cam[2]
    u_land = fx * cam[0] / depth + cx
    v_land = fy * -cam[1] / depth + cy
    return height - v_land, u_land, depth


def backproject(
    t: Column | str, u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column, height: Column
) -> tuple[Column, Column, Column]:
    """Portrait pixel and forward depth back to the world."""
    x_cam = (v - cx) * depth / fx
    y_cam = -((height - u) - cy) * depth / fy
    return transform_point(t, x_cam, y_cam, -depth)


def yaw_of(t: Column | str) -> Column:
    """Heading of the camera: direction of minus its Z axis in the floor plane."""
    return F.atan2(-element(t, 0, 2), -element(t, 2, 2))


def fallback_place(t: Column | str, depth: Column) -> tuple[Column, Column, Column]:
    """Straight ahead of the camera at ``depth``, a little below it."""
    yaw = yaw_of(t)
    return (
        element(t, 0, 3) + depth * F.sin(yaw),
        element(t, 1, 3) - 0.3,
        element(t, 2, 3) + depth * F.cos(yaw),
    )


def yaw_only_map(
    to_map: Column | str, point: tuple[Column, Column, Column], camera: tuple[Column, Column, Column], path_height: Column
) -> tuple[Column, Column, Column]:
    """Map position that keeps only the heading of ``to_map``, anchored at the camera."""
    yaw = yaw_of(to_map)
    at = transform_point(to_map, *camera)
    dx, dz = point[0] - camera[0], point[2] - camera[2]
    return (
        at[0] + F.cos(yaw) * dx + F.sin(yaw) * dz,
        path_height + (point[1] - camera[1]),
        at[2] - F.sin(yaw) * dx + F.cos(yaw) * dz,
    )


def yaw_lock(t: Column | str, camera: tuple[Column, Column, Column], at: tuple[Column, Column, Column]) -> Column:
    """Closest pure rotation about y, re-anchored so that ``camera`` lands on ``at``."""
    yaw = F.atan2(element(t, 0, 2) - element(t, 2, 0), element(t, 0, 0) + element(t, 2, 2))
    c, s = F.cos(yaw), F.sin(yaw)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        c, zero, -s, zero,
        zero, one, zero, zero,
        s, zero, c, zero,
        at[0] - (c * camera[0] + s * camera[2]),
        at[1] - camera[1],
        at[2] - (-s * camera[0] + c * camera[2]),
        one,
    )


def camera_centre(t: Column | str) -> tuple[Column, Column, Column]:
    """Camera position of a camera-from-world transform."""
    inverse = rigid_inverse(t)
    return tuple(F.get(inverse, 12 + i) for i in range(3))


def euler_angles(t: Column | str) -> tuple[Column, Column, Column]:
    """Roll, pitch and heading (radians) of a camera-from-world transform."""
    sy = F.sqrt(element(t, 0, 0) * element(t, 0, 0) + element(t, 1, 0) * element(t, 1, 0))
    regular = sy > 1e-6
    roll = F.when(regular, F.atan2(element(t, 2, 1), element(t, 2, 2))).otherwise(
        F.atan2(-element(t, 1, 2), element(t, 1, 1))
    )
    pitch = F.atan2(-element(t, 2, 0), sy)
    yaw = F.when(regular, F.atan2(-element(t, 2, 0), -element(t, 2, 2))).otherwise(F.lit(0.0))
    return roll, pitch, yaw


def tilt_degrees(t: Column | str) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), element(t, 1, 1)))))


def euler_to_map(
    roll: Column, pitch: Column, yaw: Column, at: tuple[Column, Column, Column], p: tuple[Column, Column, Column]
) -> tuple[Column, Column, Column]:
    """Rz(yaw) Ry(pitch) Rx(roll) p + at, angles in degrees."""
    r, q, w = F.radians(roll), F.radians(pitch), F.radians(yaw)
    x1, y1, z1 = p[0], F.cos(r) * p[1] - F.sin(r) * p[2], F.sin(r) * p[1] + F.cos(r) * p[2]
    x2, y2, z2 = F.cos(q) * x1 + F.sin(q) * z1, y1, -F.sin(q) * x1 + F.cos(q) * z1
    return (
        F.cos(w) * x2 - F.sin(w) * y2 + at[0],
        F.sin(w) * x2 + F.cos(w) * y2 + at[1],
        z2 + at[2],
    )


def axes_flip(t: Column | str) -> Column:
    """Flip the camera's Y and Z axes (the other common camera convention)."""
    signs = [1, -1, -1, 1]
    return F.array(*[element(t, row, col) * float(signs[col]) for col in range(4) for row in range(4)])


def to_quaternion(t: Column | str) -> Column:
    """Rotation part as (w, x, y, z), branching on the largest diagonal term."""
    m = {(i, j): element(t, i, j) for i in range(3) for j in range(3)}
    trace = m[0, 0] + m[1, 1] + m[2, 2]

    def pick(i: int, j: int, k: int) -> Column:
        size = 2.0 * F.sqrt(1.0 + m[i, i] - m[j, j] - m[k, k])
        part = {
            i: 0.25 * size,
            j: (m[i, j] + m[j, i]) / size,
            k: (m[i, k] + m[k, i]) / size,
        }
        return F.array((m[k, j] - m[j, k]) / size, part[0], part[1], part[2])

    size = 2.0 * F.sqrt(1.0 + trace)
    upright = F.array(
        0.25 * size, (m[2, 1] - m[1, 2]) / size, (m[0, 2] - m[2, 0]) / size, (m[1, 0] - m[0, 1]) / size
    )
    return (
        F.when(trace > 0, upright)
        .when((m[0, 0] > m[1, 1]) & (m[0, 0] > m[2, 2]), pick(0, 1, 2))
        .when(m[1, 1] > m[2, 2], pick(1, 2, 0))
        .otherwise(pick(2, 0, 1))
    )


def from_quaternion(q: Column | str) -> Column:
    """Column-major 3x3 rotation (9 values) of (w, x, y, z)."""
    w, x, y, z = (F.get(F.col(q) if isinstance(q, str) else q, i) for i in range(4))
    return F.array(
        1 - 2 * y * y - 2 * z * z, 2 * x * y + 2 * z * w, 2 * x * z - 2 * y * w,
        2 * x * y - 2 * z * w, 1 - 2 * x * x - 2 * z * z, 2 * y * z + 2 * x * w,
        2 * x * z + 2 * y * w, 2 * y * z - 2 * x * w, 1 - 2 * x * x - 2 * y * y,
    )


def live_columns(camera: str = "camera", to_map: str = "to_map") -> dict[str, Column]:
    """Map position and heading of a camera pose under a map transform."""
    place = transform_point(to_map, *[element(camera, i, 3) for i in range(3)])
    back = rotate_vector(to_map, *[element(camera, i, 2) for i in range(3)])
    return {"x": place[0], "y": place[1], "z": place[2], "yaw": F.atan2(-back[0], -back[2])}


def live_position(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest map position per key."""
    cols = live_columns()
    keep = [c for c in rows.columns if c not in (key, "camera", "to_map")]
    placed = rows.select(key, *keep, *[c.alias(n) for n, c in cols.items()])
    names = [*keep, *cols]
    return placed.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_l")).select(
        key, *[F.col(f"_l.{n}").alias(n) for n in names]
    )


def affine_apply(m: Column | str, x: Column, y: Column) -> tuple[Column, Column]:
    """Row-major 2x3 affine map."""
    e = [F.get(F.col(m) if isinstance(m, str) else m, i) for i in range(6)]
    return e[0] * x + e[1] * y + e[2], e[3] * x + e[4] * y + e[5]


def affine_inverse(m: Column | str) -> Column:
    a, b, c, d, e, f = (F.get(F.col(m) if isinstance(m, str) else m, i) for i in range(6))
    det = a * e - b * d
    return F.array(e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def homography_apply(h: Column | str, x: Column, y: Column) -> tuple[Column, Column]:
    """Row-major 3x3 perspective map."""
    e = [F.get(F.col(h) if isinstance(h, str) else h, i) for i in range(9)]
    w = e[6] * x + e[7] * y + e[8]
    return (e[0] * x + e[1] * y + e[2]) / w, (e[3] * x + e[4] * y + e[5]) / w


def homography_inverse(h: Column | str) -> Column:
    """Adjugate; a homography is only defined up to scale."""
    a, b, c, d, e, f, g, i, j = (F.get(F.col(h) if isinstance(h, str) else h, n) for n in range(9))
    return F.array(
        e * j - f * i, c * i - b * j, b * f - c * e,
        f * g - d * j, a * j - c * g, c * d - a * f,
        d * i - e * g, b * g - a * i, a * e - b * d,
    )


def fit_affine(p: list[tuple[Column, Column]], q: list[tuple[Column, Column]]) -> Column:
    """Exact 2x3 affine map from three point pairs, by Cramer's rule."""
    (x0, y0), (x1, y1), (x2, y2) = p
    det = x0 * (y1 - y2) - y0 * (x1 - x2) + (x1 * y2 - x2 * y1)
    rows: list[Column] = []
    for axis in range(2):
        u0, u1, u2 = q[0][axis], q[1][axis], q[2][axis]
        rows += [
            (u0 * (y1 - y2) + u1 * (y2 - y0) + u2 * (y0 - y1)) / det,
            (x0 * (u1 - u2) + x1 * (u2 - u0) + x2 * (u0 - u1)) / det,
            (u0 * (x1 * y2 - x2 * y1) + u1 * (x2 * y0 - x0 * y2) + u2 * (x0 * y1 - x1 * y0)) / det,
        ]
    return F.array(*rows)


def calibration_quality(mean_error: Column) -> Column:
    return (
        F.when(mean_error < 10, "bra").when(mean_error < 30, "ok").when(mean_error < 60, "svag").otherwise("dålig")
    )




def shelf_position(x: Column, z: Column, yaw: Column, ahead: Column) -> tuple[Column, Column]:
    """Place ``ahead`` metres in front; unchanged without a usable depth."""
    usable = F.coalesce(ahead, F.lit(0.0)) > 0.1
    return F.when(usable, x + ahead * F.sin(yaw)).otherwise(x), F.when(usable, z + ahead * F.cos(yaw)).otherwise(z)


def drift_corrected(
    x: Column, z: Column, yaw: Column, left: Column, right: Column, ahead: Column
) -> tuple[Column, Column, Column]:
    """Corrected x and z with a precision level: parallel to the shelf, depth only, or neither."""
    left, right, ahead = (F.coalesce(c, F.lit(0.0)) for c in (left, right, ahead))
    parallel = (left > 0.1) & (right > 0.1) & (F.abs(left - right) < 0.3) & (ahead > 0.1)
    reach = F.least(left, right, ahead)
    level = F.when(parallel, "hög").when(ahead > 0.1, "medium").otherwise("låg")
    return (
        F.when(parallel, x + reach * F.sin(yaw)).otherwise(x),
        F.when(parallel, z + reach * F.cos(yaw)).otherwise(z),
        level,
    )


def fit_homography(rows: DataFrame, key: str) -> DataFrame:
    """Least-squares perspective map per key from four or more points (x, y) -> (u, v).

    The 8 x 8 normal equations are Spark sums; one row per key is solved with NumPy.
    """
    import numpy as np
    import pandas as pd

    x, y, u, v = (F.col(c) for c in ("x", "y", "u", "v"))
    one, zero = F.lit(1.0), F.lit(0.0)
    first = [x, y, one, zero, zero, zero, -u * x, -u * y]
    second = [zero, zero, zero, x, y, one, -v * x, -v * y]
    sums = [
        F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"m{i}{j}") for i in range(8) for j in range(i, 8)
    ]
    sums += [F.sum(first[i] * u + second[i] * v).alias(f"b{i}") for i in range(8)]
    kind = rows.schema[key].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m = np.array([[r[f"m{min(i, j)}{max(i, j)}"] for j in range(8)] for i in range(8)], dtype=float)
                b = np.array([r[f"b{i}"] for i in range(8)], dtype=float)
                out.append([*np.linalg.lstsq(m, b, rcond=None)[0].tolist(), 1.0])
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "matrix": out})

    grouped = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *sums).filter("n >= 4")
    return grouped.mapInPandas(solve, f"`{key}` {kind}, n bigint, matrix array<double>")


def calibration_error(rows: DataFrame, key: str) -> DataFrame:
    """Mean and largest distance between predicted (pu, pv) and marked (u, v) pixels, with a band."""
    miss = F.hypot(F.col("pu") - F.col("u"), F.col("pv") - F.col("v"))
    out = rows.groupBy(key).agg(F.avg(miss).alias("mean_error"), F.max(miss).alias("max_error"))
    return out.withColumn("quality", calibration_quality(F.col("mean_error")))
