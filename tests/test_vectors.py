from __future__ import annotations

import numpy as np
import pytest

from aislewise.operators import alignment as A
from aislewise.operators import vectors as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(size=(160, 6)) + 3 * rng.normal(size=(8, 6)).repeat(20, 0), np.ones((60, 6))])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(m)]
    return m, spark.createDataFrame(rows, "id long, vec array<double>").cache()


def brute(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return {i: sorted(s[i], reverse=True)[:k] for i in range(len(m))}


@pytest.mark.parametrize("how", [{}, {"per_task": 70, "block": 16}])
def test_topk_equals_brute_force(data, how):
    m, df = data
    q, b = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "base_id")
    got = V.vector_topk(q, b, 4, skip_self=True, **how).toPandas()
    want = brute(m, 4)
    assert len(got) == 4 * len(m)
    assert (got["query_id"] != got["base_id"]).all()
    for i, part in got.sort_values("rank").groupby("query_id"):
        assert np.allclose(part["score"], want[i], atol=1e-9)
    copies = got[got["query_id"] == 200].sort_values("rank")
    assert copies["base_id"].tolist() == [160, 161, 162, 163]


def test_mean_descriptor_is_unit(data):
    _, df = data
    row = V.mean_descriptor(df.selectExpr("id % 3 as g", "vec"), "g").collect()
    assert all(abs(sum(v * v for v in r["vec"]) - 1) < 1e-9 for r in row)


def noisy_pairs(spark):
    rng = np.random.default_rng(1)
    a = 0.4
    rot = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    src = rng.uniform(-5, 5, size=(100, 3))
    dst = src @ rot.T + [1.0, 2.0, 3.0]
    dst[60:] += rng.uniform(2, 6, size=(40, 3))
    rows = [("s", i, *map(float, src[i]), *map(float, dst[i])) for i in range(100)]
    tilted = np.array([[1, 0, 0], [0, np.cos(1), -np.sin(1)], [0, np.sin(1), np.cos(1)]])
    rows += [("tilted", i, *map(float, src[i]), *map(float, src[i] @ tilted.T)) for i in range(50)]
    rows += [("small", i, *map(float, src[i]), *map(float, src[i])) for i in range(10)]
    return spark.createDataFrame(rows, "g string, i long, sx double, sy double, sz double, dx double, dy double, dz double"), rot


@pytest.mark.parametrize("block", [20_000, 9])
def test_ransac_finds_the_motion(spark, block):
    df, rot = noisy_pairs(spark)
    out = {r["g"]: r for r in A.ransac_rigid(df, "g", "i", hypotheses=200, block=block).collect()}
    good = out["s"]
    assert good["ok"] and good["inliers"] == 60 and good["mean_error"] < 1e-6
    m = np.array(good["transform"]).reshape(4, 4).T
    assert np.allclose(m[:3, :3], rot, atol=1e-6) and np.allclose(m[:3, 3], [1, 2, 3], atol=1e-6)
    assert out["tilted"]["reason"] == "tilt" and out["small"]["reason"] == "few pairs"


def test_rigid_fit_never_mirrors(spark):
    rows = [("g", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("g", 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("g", 0.0, 1.0, 0.0, 0.0, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, sx double, sy double, sz double, dx double, dy double, dz double")
    m = np.array(A.rigid_fit(df, "g").first()["transform"]).reshape(4, 4).T
    assert np.linalg.det(m[:3, :3]) > 0.99
