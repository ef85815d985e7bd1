from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from aislewise.operators import catalogue as K
from aislewise.operators import poses as P
from aislewise.plans.views import view

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["product_id"], r["rank"], r["better_id"], round(r["score"], 1)) for r in df.collect())


def test_healthier_is_the_same_in_small_blocks(spark):
    catalogue = view(spark, SF, "catalogue")
    assert rows(K.healthier_products(catalogue, 3, block=9)) == rows(K.healthier_products(catalogue, 3))


def test_similar_never_lists_itself_and_fills_up(spark):
    out = K.similar_products(view(spark, SF, "catalogue"), 4)
    assert out.filter("product_id = similar_id").count() == 0
    assert out.groupBy("product_id").count().filter("count <> 4").count() == 0


def test_projection_round_trip(spark):
    poses = []
    for yaw, tilt in ((0.0, 0.0), (math.pi / 2, 0.0), (0.7, 0.3)):
        c, s, ct, st = math.cos(yaw), math.sin(yaw), math.cos(tilt), math.sin(tilt)
        poses.append([c, 0.0, -s, 0.0, s * st, ct, c * st, 0.0, s * ct, -st, c * ct, 0.0, 1.0, 1.5, -2.0, 1.0])
    df = spark.createDataFrame([(i, p) for i, p in enumerate(poses)], "i int, t array<double>")
    lens = [F.lit(v) for v in (900.0, 910.0, 960.0, 720.0, 1440.0)]
    point = P.backproject("t", F.lit(700.0), F.lit(1000.0), F.lit(2.5), *lens)
    seen = df.select("t", *[c.alias(n) for n, c in zip("xyz", point)]).withColumn("inv", P.rigid_inverse("t"))
    u, v, d = P.project_to_portrait("inv", F.col("x"), F.col("y"), F.col("z"), *lens)
    for r in seen.select(u.alias("u"), v.alias("v"), d.alias("d")).collect():
        assert abs(r["u"] - 700) < 1e-6 and abs(r["v"] - 1000) < 1e-6 and abs(r["d"] - 2.5) < 1e-9


def test_calibration_golden_points(spark):
    spots = [((0.0, 0.0), (100.0, 500.0)), ((10.0, 0.0), (600.0, 500.0)), ((0.0, 8.0), (100.0, 100.0))]
    fit = P.fit_affine(
        [(F.lit(a), F.lit(b)) for (a, b), _ in spots], [(F.lit(u), F.lit(v)) for _, (u, v) in spots]
    )
    df = spark.range(1).select(fit.alias("m")).withColumn("i", P.affine_inverse("m"))
    u, v = P.affine_apply("m", F.lit(5.0), F.lit(4.0))
    x, z = P.affine_apply("i", F.lit(350.0), F.lit(300.0))
    assert [round(c, 9) for c in df.select(u, v, x, z).first()] == [350.0, 300.0, 5.0, 4.0]


def test_dealt_slices(spark):
    from aislewise.operators.basket import deal_slices

    def order(ids, seed):
        return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))

    for n, slices, each in ((100, 7, 5), (100, 3, 40), (3, 5, 2), (1, 4, 9), (0, 3, 2)):
        pool = spark.createDataFrame([(i,) for i in range(n)], "p long").repartition(3)
        got = {}
        for r in deal_slices(pool, "p", slices, each, seed=4).collect():
            got.setdefault(r["slice"], []).append((r["place"], r["p"]))
        shuffled = order(range(n), 4)
        want = {k: (shuffled[k::slices] or shuffled)[:each] for k in range(slices)}
        assert {k: [p for _, p in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
