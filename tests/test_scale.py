"""Joins that must not pass an exploded side through the driver, and short lists in place of long scans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from aislewise.operators import clusters as C
from aislewise.operators import fusion as U
from aislewise.operators import grid as G
from aislewise.operators import neighbours as N
from aislewise.operators import sessions as S
from aislewise.operators import tracks as T
from aislewise.operators import vectors as V
from aislewise.operators.seeds import greedy_seeds


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage_broadcasts_nothing(spark):
    rows = [(s, n, float(n % 20), 0.2 * s) for s in range(2) for n in range(60)]
    out = T.coverage_loops_gaps(spark.createDataFrame(rows, "session long, frame long, x double, z double"), "session", "frame")
    assert "Broadcast" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 20, 2, 40), (1, 20, 2, 40)]


def test_boxes_are_met_without_broadcast_and_equal_ones_once(spark, monkeypatch):
    points = spark.createDataFrame([(0, 10.0 * i, 5.0, 0.1 * i) for i in range(40)] * 2, "frame int, u double, v double, depth double")
    boxes = spark.createDataFrame(
        [(b, 0, 0.0, 300.0, 0.0, 9.0) for b in range(5)] + [(9, 1, 0.0, 300.0, 0.0, 9.0)],
        "box_id long, frame int, x1 double, x2 double, y1 double, y2 double",
    )
    met, keep = [], U.cut_lineage
    monkeypatch.setattr(U, "cut_lineage", lambda df: met.append(df) or keep(df))
    got = sorted((r["box_id"], r["hits"], r["from_box"], round(r["depth"], 6)) for r in U.points_in_boxes(points, boxes).collect())
    assert got == [(b, 62, True, 1.5) for b in range(5)] + [(9, 0, False, 1.5)]
    assert "Broadcast" not in plan(met[0]) and met[0].count() == 31


def test_seeds_broadcast_nothing(spark):
    rows = spark.createDataFrame([("a", i, 0.1 * i, 0.0, 0.0) for i in range(30)], "m string, ord long, x double, y double, z double")
    out = greedy_seeds(rows, ["m"], radius=0.25, axes=("x", "y", "z"))
    assert "Broadcast" not in plan(out)
    assert {r["ord"]: r["seed"] for r in out.collect()} == {i: i // 3 * 3 for i in range(30)}


def test_visible_products_broadcast_nothing(spark):
    cameras = spark.createDataFrame([(1, 7, 0.0, 1.2, 0.0, 0.0)], "m int, camera_id long, cam_x double, cam_y double, cam_z double, rot_y double")
    products = spark.range(4).select(
        F.lit(1).alias("m"), F.col("id").alias("product_id"), F.lit(0.0).alias("x"), F.lit(1.2).alias("y"),
        (F.col("id") * 2.0).alias("z"), F.lit(0.5).alias("share"), F.lit(3).alias("n"),
    )
    out = N.visible_products(cameras, products, keys=("m",), carry=("n",))
    assert "Broadcast" not in plan(out)
    assert sorted((r["product_id"], r["n"]) for r in out.collect()) == [(1, 3), (2, 3), (3, 3)]


def test_keypoints_of_a_crowded_frame(spark):
    """Points at one pixel, crowded and lonely frames, against all pairs."""
    rnd = random.Random(5)
    rows = [(0, float(rnd.randrange(40)), float(rnd.randrange(40))) for _ in range(900)]
    rows += [(1, 10.0 * i, 0.0) for i in range(6)] + [(2, 5.0, 5.0)] * 9 + [(3, 900.0, 900.0), (4, 3.0, 29.0), (4, 5000.0, 1.0)]
    points = spark.createDataFrame(
        [(i, *r, float(i), float(i % 7), 1.0) for i, r in enumerate(rows)],
        "point_id long, frame int, u double, v double, x double, y double, z double",
    )
    kps = [(i, f, u, v) for i, (f, u, v) in enumerate((f, u, v) for f in range(5) for u, v in ((0.0, 0.0), (20.5, 20.0), (55.0, 3.0), (0.0, 0.0)))]
    keypoints = spark.createDataFrame(kps, "kp_id long, frame int, u double, v double")
    got = {r["kp_id"]: tuple(round(r[c], 6) for c in ("nearest", "x", "y", "z")) for r in N.idw_lift(keypoints, points).collect()}
    want = {}
    for kp, f, u, v in kps:
        mine = sorted((((u - r[1]) ** 2 + (v - r[2]) ** 2) ** 0.5, i) for i, r in enumerate(rows) if r[0] == f)[:4]
        if mine and mine[0][0] < 30:
            w = [1 / (d + 1e-6) for d, _ in mine]
            want[kp] = tuple(round(n, 6) for n in (mine[0][0], *(sum(a * b for a, b in zip(w, c)) / sum(w) for c in
                             ([float(i) for _, i in mine], [float(i % 7) for _, i in mine], [1.0] * len(mine)))))
    assert got == want and len(want) > 8


def test_replaced_sessions_without_pairs(spark, monkeypatch):
    """Wide boxes on top of each other and many small ones in one cell, against all pairs."""
    rnd = random.Random(3)
    rows = [(k % 2, k, rnd.randrange(40), x := rnd.uniform(0, 60), z := rnd.uniform(0, 60), x + rnd.choice((0.1, 0.5, 30)), z + 0.2)
            for k in range(300)]
    names = "store long, session_id long, started long, start_x double, start_z double, end_x double, end_z double"
    monkeypatch.setattr(S, "overlap_pairs", None, raising=True)
    for newest, margin in ((1, 0.3), (2, 2.0), (32, 0.3)):
        out = S.replace_overlapped(spark.createDataFrame(rows, names), margin, keys=("store",), newest=newest)
        want = [
            o[1] for o in rows
            if not any(a[0] == o[0] and (a[2], a[1]) > (o[2], o[1]) and a[3] - margin < o[5] and a[5] + margin > o[3]
                       and a[4] - margin < o[6] and a[6] + margin > o[4] for a in rows)
        ]
        assert sorted(r["session_id"] for r in out.collect()) == want


def test_best_vectors_make_no_table_a_query(monkeypatch):
    """Ties keep the lowest ids, and a block of queries is one table."""
    import numpy as np

    made, frame = [], V.pd.DataFrame
    monkeypatch.setattr(V.pd, "DataFrame", lambda *a, **b: made.append(1) or frame(*a, **b))
    rng = np.random.default_rng(1)
    x = V.unit(list(rng.integers(-2, 3, (600, 5)) + 0.001))
    ids, scores = np.arange(600) * 3, np.round(x @ x.T, V.DIGITS)
    np.fill_diagonal(scores, -np.inf)
    for k in (1, 4, 40):
        best = V._Best(ids, x, k, True)
        for at in range(0, 600, 64):
            best.meet(ids[at : at + 64], x[at : at + 64])
        got = best.result()["base_id"].to_numpy().reshape(600, k)
        assert (got == ids[np.argsort(-scores, axis=1, kind="stable")[:, :k]]).all()
    assert len(made) == 3


def test_routes_meet_the_walls_of_a_bucket_once(spark):
    rnd = random.Random(4)
    rows = [(r, r % 2, s, rnd.randrange(40), rnd.randrange(12)) for r in range(30) for s in range(rnd.randrange(1, 40))]
    walls = {(m, rnd.randrange(40), rnd.randrange(12)) for m in (0, 1) for _ in range(60)}
    want = []
    for r in range(30):
        cells, keep, i = [(x, z) for q, _, _, x, z in rows if q == r], [0], 0
        while i < len(cells) - 1:
            j = len(cells) - 1
            while j > i + 1 and any((r % 2, *c) in walls for c in G.line_cells(*cells[i], *cells[j])):
                j -= 1
            keep.append(j)
            i = j
        want += [(r, r % 2, s, *cells[s]) for s in keep]
    df = spark.createDataFrame(rows, "route_id long, m int, step long, ix int, iz int")
    wall = spark.createDataFrame(sorted(walls), "m int, ix int, iz int")
    for per_bucket in (200_000, 100):
        assert sorted(tuple(r) for r in G.simplify_routes(df, wall, "m", per_bucket).collect()) == want


def test_merged_places_look_around_only(spark):
    """Against the first place within the tolerance, in a scan over all places."""
    rnd = random.Random(6)
    rows = [("a", i, rnd.uniform(0, 3), rnd.uniform(0, 1), rnd.uniform(-1, 1)) for i in range(800)] + [("a", 800, None, 0.0, 0.0)]
    places, want = [], []
    for _, n, x, y, z in rows[:-1]:
        i = next((i for i, p in enumerate(places) if (p[0] - x) ** 2 + (p[1] - y) ** 2 + (p[2] - z) ** 2 < 0.4 * 0.4), len(places))
        if i == len(places):
            places.append((x, y, z, 1))
        else:
            p = places[i]
            places[i] = ((p[0] + x) / 2, (p[1] + y) / 2, (p[2] + z) / 2, p[3] + 1)
        want.append((n, i, *places[i]))
    df = spark.createDataFrame(rows, "k string, ord long, x double, y double, z double")
    for most in (2_000_000, 150):
        got = C.merge_nearby(df, ["k"], rows_per_slice=most).orderBy("ord").collect()
        assert [tuple(r)[1:] for r in got[:-1]] == want
        assert got[-1]["place"] == len(places)
