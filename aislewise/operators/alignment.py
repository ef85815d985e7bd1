"""Rigid alignment of 3-D point pairs per group.

Sums per group are Spark aggregates; only one row of sums per group reaches NumPy.  The
robust fit draws its hypotheses per group, counts their inliers block by block in parallel
and adds the counts, so the pairs of one big group are never in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.operators.ordered import Sequence
from aislewise.session import cut_lineage

BLOCK = 20_000
SRC, DST = ("sx", "sy", "sz"), ("dx", "dy", "dz")


def fit_sums(pairs: DataFrame, key: str) -> DataFrame:
    """Count, centroids and cross products: everything a least-squares rigid fit needs."""
    return pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in (*SRC, *DST)],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}{b}") for a in SRC for b in DST],
    )


def solve(cross: np.ndarray, src_mean: np.ndarray, dst_mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and translations from centred cross products, for a stack of groups."""
    u, _, vt = np.linalg.svd(cross)
    v = np.swapaxes(vt, -1, -2)
    sign = np.where(np.linalg.det(v @ np.swapaxes(u, -1, -2)) < 0, -1.0, 1.0)
    v[..., :, 2] *= sign[..., None]
    rotation = v @ np.swapaxes(u, -1, -2)
    shift = dst_mean - np.einsum("...ij,...j->...i", rotation, src_mean)
    return rotation, shift


def flat(rotation: np.ndarray, shift: np.ndarray) -> list[list[float]]:
    """Column-major 16-arrays."""
    out = np.zeros((len(rotation), 4, 4))
    out[:, :3, :3], out[:, :3, 3], out[:, 3, 3] = rotation, shift, 1.0
    return np.swapaxes(out, 1, 2).reshape(len(out), 16).tolist()


def rigid_fit(pairs: DataFrame, key: str) -> DataFrame:
    """Least-squares rotation and translation per group of three or more pairs."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy(float)
            s = pdf[[f"s_{c}" for c in SRC]].to_numpy(float) / n[:, None]
            d = pdf[[f"s_{c}" for c in DST]].to_numpy(float) / n[:, None]
            cross = pdf[[f"p_{a}{b}" for a in SRC for b in DST]].to_numpy(float).reshape(-1, 3, 3)
            cross = cross - n[:, None, None] * s[:, :, None] * d[:, None, :]
            rotation, shift = solve(cross, s, d)
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "transform": flat(rotation, shift)})

    return fit_sums(pairs, key).filter("n >= 3").mapInPandas(run, f"`{key}` {kind}, n bigint, transform array<double>")


def ransac_rigid(
    pairs: DataFrame,
    key: str,
    order: str,
    hypotheses: int = 2000,
    seed: int = 42,
    threshold: float = 0.3,
    min_inliers: int = 30,
    max_error: float = 0.5,
    max_tilt: float = 30.0,
    block: int = BLOCK,
) -> DataFrame:
    """Robust rigid fit: (key, ok, reason, inliers, mean_error, transform).

    Every hypothesis solves three pairs of the group; the first with most inliers wins and
    is solved again on its inliers.
    """
    kind = pairs.schema[key].dataType.simpleString()
    rows = Sequence(pairs.select(key, order, *SRC, *DST), [key], [order]).index("_i").df
    rows = rows.withColumn("_i", F.col("_i") - 1)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def draw(batches):
        for pdf in batches:
            for group, n in zip(pdf[key], pdf["n"]):
                rng = np.random.default_rng(seed)
                picks = np.stack([rng.choice(n, 3, replace=False) for _ in range(hypotheses)])
                yield pd.DataFrame(
                    {
                        key: group,
                        "h": np.repeat(np.arange(hypotheses), 3),
                        "c": np.tile(np.arange(3), hypotheses),
                        "_i": picks.ravel(),
                    }
                )

    drawn = sizes.filter("n >= 3").mapInPandas(draw, f"`{key}` {kind}, h int, c int, _i bigint")
    corners = drawn.join(rows, [key, "_i"])
    triples = corners.groupBy(key, "h").agg(
        *[F.max(F.when(F.col("c") == i, F.col(a))).alias(f"{a}{i}") for i in range(3) for a in (*SRC, *DST)]
    )

    def solve_triples(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            s = np.stack([pdf[[f"{a}{i}" for a in SRC]].to_numpy(float) for i in range(3)], axis=1)
            d = np.stack([pdf[[f"{a}{i}" for a in DST]].to_numpy(float) for i in range(3)], axis=1)
            sm, dm = s.mean(axis=1), d.mean(axis=1)
            cross = np.einsum("npi,npj->nij", s - sm[:, None], d - dm[:, None])
            rotation, shift = solve(cross, sm, dm)
            yield pd.DataFrame({key: pdf[key], "h": pdf["h"], "transform": flat(rotation, shift)})

    models = cut_lineage(triples.mapInPandas(solve_triples, f"`{key}` {kind}, h int, transform array<double>"))
    parts = sizes.withColumn("_parts", F.ceil(F.col("n") / block).cast("int"))
    left = rows.join(parts.select(key, "_parts"), key).select(
        key, *SRC, *DST, (F.col("_i") % F.col("_parts")).cast("int").alias("_b")
    )
    copies = parts.select(key, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_b"))
    right = models.join(copies, key)

    def count(points: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if points.empty or fits.empty:
            return pd.DataFrame({key: pd.Series(dtype=object), "h": [], "inliers": []})
        s, d = points[list(SRC)].to_numpy(float), points[list(DST)].to_numpy(float)
        t = np.stack(fits["transform"]).reshape(-1, 4, 4)
        hits = np.empty(len(t), dtype=np.int64)
        for i, m in enumerate(t):
            moved = s @ m[:3, :3] + m[3, :3]
            hits[i] = (((moved - d) ** 2).sum(axis=1) < threshold * threshold).sum()
        return pd.DataFrame({key: fits[key].to_numpy(), "h": fits["h"].to_numpy(), "inliers": hits})

    counted = (
        left.groupBy(key, "_b")
        .cogroup(right.groupBy(key, "_b"))
        .applyInPandas(count, f"`{key}` {kind}, h int, inliers bigint")
        .groupBy(key, "h")
        .agg(F.sum("inliers").alias("inliers"))
    )
    best = counted.groupBy(key).agg(F.max(F.struct("inliers", (-F.col("h")).alias("neg"))).alias("_b")).select(
        key, (-F.col("_b.neg")).alias("h"), F.col("_b.inliers").alias("inliers")
    )
    chosen = cut_lineage(best.join(models, [key, "h"]).select(key, "inliers", "transform"))
    inside = _with_error(rows, chosen.drop("inliers"), key).filter(F.col("_err") < threshold)
    refit = rigid_fit(inside.select(key, *SRC, *DST), key).select(key, F.col("transform").alias("_refit"))
    fitted = chosen.join(refit, key, "left").select(
        key,
        "inliers",
        F.when(F.col("inliers") >= min_inliers, F.coalesce("_refit", "transform")).otherwise(F.col("transform")).alias(
            "transform"
        ),
    )
    errors = (
        _with_error(inside.select(key, "_i", *SRC, *DST), fitted.select(key, "transform"), key)
        .groupBy(key)
        .agg(F.avg("_err").alias("mean_error"))
    )
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get("transform", 5)))))
    full = sizes.join(fitted, key, "left").join(errors, key, "left").withColumn("tilt", tilt)
    reason = (
        F.when(F.col("n") < min_inliers, "few pairs")
        .when(F.coalesce("inliers", F.lit(0)) < min_inliers, "few inliers")
        .when(F.col("mean_error") > max_error, "error")
        .when(F.col("tilt") > max_tilt, "tilt")
        .otherwise("ok")
    )
    return full.withColumn("reason", reason).select(
        key, (F.col("reason") == "ok").alias("ok"), "reason", "n", "inliers", "mean_error", "tilt", "transform"
    )


def _with_error(rows: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """Distance of every moved source point from its target."""
    joined = rows.join(fits, key)
    total = F.lit(0.0)
    for i, target in enumerate(DST):
        moved = F.get("transform", 12 + i)
        for j, source in enumerate(SRC):
            moved = moved + F.get("transform", j * 4 + i) * F.col(source)
        total = total + (moved - F.col(target)) * (moved - F.col(target))
    return joined.withColumn("_err", F.sqrt(total)).drop("transform")


def merge_session(existing: DataFrame, incoming: DataFrame, pairs: DataFrame, **gates) -> tuple[DataFrame, DataFrame]:
    """Align each session to the map, move and renumber its frames and append them.

    Existing: frame, x, y, z.  Incoming: session, frame, x, y, z.  Pairs: session, pair_id and
    source / target places.  Returns the merged map and a log with the reason per session;
    sessions that fail stay out of the map.
    """
    from aislewise.operators.poses import transform_points
    from aislewise.operators.sessions import remap_frame_ids

    fits = ransac_rigid(pairs, "session", "pair_id", **gates)
    good = fits.filter("ok").select("session", "transform")
    moved = transform_points(incoming, good, "session", "transform").withColumn("_map", F.lit(0))
    numbered = remap_frame_ids(existing.withColumn("_map", F.lit(0)), moved, "_map", ["session", "frame"])
    merged = existing.select(F.lit(None).cast(incoming.schema["session"].dataType).alias("session"), "frame", "x", "y", "z").unionByName(
        numbered.select("session", F.col("new_frame").alias("frame"), "x", "y", "z")
    )
    log = fits.join(incoming.groupBy("session").agg(F.count(F.lit(1)).alias("frames")), "session", "left")
    return merged, log.select("session", "ok", "reason", "inliers", "mean_error", "frames")
