"""Sliced groups must give exactly what one pass gives."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislewise.operators import clusters as C
from aislewise.operators.seeds import greedy_seeds
from aislewise.operators import gates as G
from aislewise.operators.ordered import Sequence, add_slices
from aislewise.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}"
        rows.append((key, i, rng.uniform(0, 8), rng.uniform(0, 2), rng.uniform(0, 8), rng.choice([None, 1.0, 2.0])))
    return spark.createDataFrame(rows, "k string, ord long, x double, y double, z double, v double").cache()


def by_ord(df, *cols):
    return df.select("k", "ord", *cols).toPandas().sort_values(["k", "ord"]).reset_index(drop=True)


def test_sequence_slices_equal_plain_windows(skewed):
    def run(limit):
        seq = Sequence(skewed, ["k"], ["ord"], limit).index("i")
        seq.lag(prev=F.col("v"), px=F.col("x")).running_sum(total=F.col("x")).fill_forward(last=F.col("v"))
        return seq

    plain, cut = run(10_000), run(50)
    assert not plain.cut and cut.cut
    cols = ("i", "prev", "px", "total", "last")
    pd.testing.assert_frame_equal(by_ord(plain.df, *cols), by_ord(cut.df, *cols), check_exact=False)


def test_slices_are_even_whatever_the_values(spark):
    rows = [("hot", float(i)) for i in range(10_000)] + [("hot", 1e15), ("small", 1.0), ("mid", 3.0)] + [("mid", 1e9 * i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    sliced, cut = add_slices(df, ["k"], "v", 300)
    sizes = sliced.groupBy("k", "_slice").count().toPandas()
    assert cut and sizes["count"].max() <= 600
    hot = sizes[sizes["k"] == "hot"]
    assert len(hot) >= 25 and hot["count"].min() >= 1
    order = sliced.filter("k = 'hot'").toPandas().sort_values("v")["_slice"].tolist()
    assert order == sorted(order)


def test_quantiles_slices_equal_numpy(skewed):
    want = skewed.toPandas().groupby("k")["x"].quantile([0.05, 0.5, 0.95]).unstack()
    for limit in (10_000, 40):
        got = quantiles(skewed, ["k"], "x", {"a": 0.05, "b": 0.5, "c": 0.95}, limit, count_as="n").toPandas().set_index("k")
        for name, share in (("a", 0.05), ("b", 0.5), ("c", 0.95)):
            assert (got[name].sort_index() - want[share].sort_index()).abs().max() < 1e-9
        assert got["n"].sum() == 900


def python_clusters(rows, threshold):
    sums, out = [], []
    for x, y, z in rows:
        for c, s in enumerate(sums):
            n = s[0]
            if ((x - s[1] / n) ** 2 + (y - s[2] / n) ** 2 + (z - s[3] / n) ** 2) ** 0.5 < threshold:
                sums[c] = [n + 1, s[1] + x, s[2] + y, s[3] + z]
                out.append(c)
                break
        else:
            sums.append([1, x, y, z])
            out.append(len(sums) - 1)
    return out


@pytest.mark.parametrize("limit", [10_000, 60])
def test_spatial_cluster_equals_one_pass(skewed, limit):
    got = by_ord(C.spatial_cluster(skewed, ["k"], "ord", 1.5, limit), "cluster")
    rows = by_ord(skewed, "x", "y", "z")
    for key, part in rows.groupby("k"):
        want = python_clusters(part[["x", "y", "z"]].itertuples(index=False), 1.5)
        assert got[got["k"] == key]["cluster"].tolist() == want


@pytest.mark.parametrize("limit", [10_000, 60])
def test_greedy_seeds_equals_one_pass(skewed, limit):
    got = by_ord(greedy_seeds(skewed, ["k"], "ord", 0.5, ("x", "z"), limit), "seed")
    rows = by_ord(skewed, "x", "z")
    for key, part in rows.groupby("k"):
        used, seed = set(), {}
        items = list(part[["ord", "x", "z"]].itertuples(index=False))
        for i, a in enumerate(items):
            if a.ord in used:
                continue
            for b in items[i:]:
                if b.ord not in used and ((a.x - b.x) ** 2 + (a.z - b.z) ** 2) ** 0.5 < 0.5:
                    used.add(b.ord)
                    seed[b.ord] = a.ord
        mine = got[got["k"] == key]
        assert dict(zip(mine["ord"], mine["seed"])) == seed


@pytest.mark.parametrize("limit", [10_000, 80, 3])
def test_seeds_along_a_path_and_odd_rows(spark, monkeypatch, limit):
    from aislewise.operators import seeds as module

    monkeypatch.setattr(module, "CELL_ROUNDS", 1)
    rows = [(1, i, 0.11 * i, 0.02 * (i % 3), 0.0) for i in range(60)] + [(1, 100 + i, 0.11 * (59 - i), 0.3, 0.1) for i in range(60)]
    rows += [(2, 1, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 0.1, 0.0, 0.0)]
    rows += [(2, 3, None, 0.0, 0.0), (2, 4, float("nan"), 0.0, 0.0), (2, 5, 50.0, 0.0, -3.0)]
    df = spark.createDataFrame(rows, "k long, ord long, x double, y double, z double")
    for axes in (("x", "z"), ("x", "y", "z")):
        at = [0, 2] if len(axes) == 2 else [0, 1, 2]
        seeds, want = {}, []  # by key
        for k, o, *p in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            odd = p[0] is None or p[0] != p[0]
            near = [] if odd else [s for s, q in seeds.get(k, []) if sum((p[i] - q[i]) ** 2 for i in at) < 0.25]
            if not near and not odd:
                seeds.setdefault(k, []).append((o, p))
            want.append((k, o, min(near, default=o)))
        got = [(r["k"], r["ord"], r["seed"]) for r in greedy_seeds(df, ["k"], "ord", 0.5, axes, limit).collect()]
        # Null keys never meet: each such row stands alone.
        assert sorted(g for g in got if g[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert greedy_seeds(df.limit(0), ["k"]).count() == 0


def test_merge_nearby_slices(skewed):
    cols = ("place", "x", "y", "z", "seen")
    one = by_ord(C.merge_nearby(skewed, ["k"], "ord", 0.6), *cols)
    many = by_ord(C.merge_nearby(skewed, ["k"], "ord", 0.6, 70), *cols)
    pd.testing.assert_frame_equal(one, many)
    first = one[one["k"] == "k1"].iloc[0]
    assert first["place"] == 0 and first["seen"] == 1


def test_throttle_keeps_since_last_kept(skewed):
    rows = skewed.withColumn("at", F.col("ord") * 0.4)
    for limit in (10_000, 50):
        got = by_ord(G.throttle_exact(rows, "k", ["ord"], 3.0, limit))
        for key, part in by_ord(skewed).groupby("k"):
            last, want = None, []
            for o in part["ord"]:
                if last is None or o * 0.4 - last >= 3.0:
                    want.append(o)
                    last = o * 0.4
            assert got[got["k"] == key]["ord"].tolist() == want


def pose(x, z, turn=1.0):
    return [turn, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, turn, 0.0, float(x), 0.0, float(z), 1.0]


def test_recalibration_rules():
    state, got = G.FRESH, []
    events = [
        (0.0, "pose", None, 0, "normal"),
        (1.0, "vps", pose(0, 0), 90, "normal"),
        (2.0, "vps", pose(1, 0), 50, "normal"),
        (3.0, "vps", pose(1, 0), 70, "normal"),
        (3.25, "pose", None, 0, "normal"),
        (4.0, "pose", None, 0, "normal"),
        (5.0, "vps", pose(9, 0), 99, "normal"),
        (6.0, "vps", pose(1, 0, -1.0), 99, "normal"),
        (7.0, "pose", None, 0, "limited"),
        (8.0, "pose", None, 0, "normal"),
        (9.0, "vps", pose(9, 0), 79, "normal"),
        (10.0, "pose", None, 0, "limited"),
        (10.5, "pose", None, 0, "normal"),
        (11.0, "vps", pose(9, 0), 80, "normal"),
    ]
    for e in events:
        state, accepted = G.recalibrate(state, *e)
        got.append((accepted, None if state[0] is None else round(state[0][12], 3)))
    assert got[1] == (True, 0.0)
    assert got[2][0] is False and got[3] == (True, 0.0)
    assert got[4][1] == 0.5 and got[5][1] == 1.0
    assert got[6][0] is False and got[7][0] is False
    assert got[10][0] is False and got[13] == (True, 9)
    assert state[6:] == [3, 4]


def test_gate_slices_equal_one_pass(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        device = 1 if rng.random() < 0.7 else 2
        kind = rng.choice(["pose", "vps"])
        rows.append(
            (device, i, i * 0.2, kind, pose(rng.uniform(0, 2), 0), rng.randrange(100), rng.choice(["normal"] * 4 + ["limited"]))
        )
    df = spark.createDataFrame(
        rows, "device long, ord long, at double, kind string, t array<double>, inliers int, tracking string"
    )
    def table(limit):
        out = G.recalibration_gate(df, "device", ["ord"], limit).toPandas()
        return out.sort_values(["device", "ord"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(table(10_000), table(40))
