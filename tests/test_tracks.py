from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.operators import tracks as T
from aislewise.plans.views import view

SF = "/root/testdata/sf0.001"


def test_downsample_is_repeatable_and_bounded(spark):
    points = view(spark, SF, "point")
    a = T.downsample(points, "map_id", "point_id", 50, seed=3).select("point_id").collect()
    b = T.downsample(points.repartition(7), "map_id", "point_id", 50, seed=3).select("point_id").collect()
    c = T.downsample(points, "map_id", "point_id", 50, seed=4).select("point_id").collect()
    assert sorted(a) == sorted(b) and sorted(a) != sorted(c) and len(a) == 200


def test_downsample_takes_the_first_hashes(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(T, "BUCKET_DIGITS", 1)
    rows = [(k % 3 or None, k, float(k)) for k in range(400)] + [(9, 1000 + k, 0.0) for k in range(5)]
    df = spark.createDataFrame(rows, "m long, p long, x double")
    for most in (1, 5, 77, 1000):
        got = sorted((str(r["m"]), r["p"]) for r in T.downsample(df, "m", "p", most, seed=2).collect())
        want = []
        for m in (None, 1, 2, 9):
            mine = sorted((hashlib.md5(f"2:{p}".encode()).hexdigest(), p) for n, p, _ in rows if n == m)
            want += [(str(m), p) for _, p in mine[:most]]
        assert got == sorted(want)
    assert T.downsample(df.limit(0), "m", "p", 3).count() == 0


def test_closed_loop_ends_where_it_began(spark):
    rows = [(1, i, float(i % 6) * 0.5 + 0.01 * i, 0.0 if i < 6 else 1.0) for i in range(12)] + [(1, 12, 0.5, 0.2)]
    track = spark.createDataFrame(rows, "session long, frame long, x double, z double")
    out = T.correct_loop_closure(track).orderBy("frame").collect()
    assert all(r["corrected"] for r in out)
    assert abs(out[-1]["x"] - out[0]["x"]) < 1e-9 and abs(out[-1]["z"] - out[0]["z"]) < 1e-9
    short = track.filter("frame < 5")
    assert T.correct_loop_closure(short).filter("corrected").count() == 0


def test_wrapped_bearing(spark):
    df = spark.range(1).select(
        *T.distance_bearing(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(-1.0), F.lit(0.0))
    )
    distance, arrived, bearing = df.first()
    assert distance == 1.0 and arrived and -3.1416 <= bearing < 3.1416
