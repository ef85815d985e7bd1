from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from aislewise.operators import grid as G
from aislewise.operators import routes as R

NX, NZ = 70, 45


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    walls = {(x, z) for x in range(NX) for z in range(NZ) if rng.random() < 0.28}
    walls |= {(35, z) for z in range(NZ) if z not in (3, 40)}
    cells = spark.createDataFrame([(1, x, z) for x, z in walls], "m int, ix int, iz int").cache()
    meta = spark.createDataFrame([(1, NX, NZ, 0.0, 0.0)], "m int, nx int, nz int, x_min double, z_min double").cache()
    return walls, cells, meta


def regions(walls):
    seen, out = {}, []
    for z in range(NZ):
        for x in range(NX):
            if (x, z) in walls or (x, z) in seen:
                continue
            todo, members = [(x, z)], []
            seen[(x, z)] = len(out)
            while todo:
                a, b = todo.pop()
                members.append((a, b))
                for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= n[0] < NX and 0 <= n[1] < NZ and n not in walls and n not in seen:
                        seen[n] = len(out)
                        todo.append(n)
            out.append(members)
    return out


def test_components_equal_flood_fill(world):
    walls, cells, meta = world
    got = {(r["ix"], r["iz"]): (r["label"], r["walkable"]) for r in G.free_components(cells, meta, "m").collect()}
    groups = regions(walls)
    main = max(groups, key=len)
    want = {}
    for g in groups:
        low = min(z * NX + x for x, z in g)
        want.update({c: (low, g is main) for c in g})
    assert got == want


def dijkstra(walls, start, goal):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (x, z) = heapq.heappop(heap)
        if (x, z) == goal:
            return d
        if d > best[(x, z)]:
            continue
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                n = (x + i, z + j)
                if (i or j) and 0 <= n[0] < NX and 0 <= n[1] < NZ and n not in walls:
                    nd = d + (math.sqrt(2) if i and j else 1.0)
                    if nd < best.get(n, math.inf) - 1e-12:
                        best[n] = nd
                        heapq.heappush(heap, (nd, n))
    return None


def test_route_lengths_equal_dijkstra(spark, world):
    walls, cells, meta = world
    main = sorted(max(regions(walls), key=len))
    rng = random.Random(2)
    asks = []
    for i in range(12):
        a, b = rng.choice(main), rng.choice(main)
        asks.append((i, 1, a[0] * 0.5 + 0.2, a[1] * 0.5 + 0.2, b[0] * 0.5 + 0.2, b[1] * 0.5 + 0.2, a, b))
    df = spark.createDataFrame(
        [r[:6] for r in asks], "ask_id long, m int, start_x double, start_z double, goal_x double, goal_z double"
    )
    got = {r["ask_id"]: r for r in R.route_length(df, cells, meta, "m", 0.5).collect()}
    for ask in asks:
        assert got[ask[0]]["ok"]
        assert abs(got[ask[0]]["length_m"] - 0.5 * dijkstra(walls, ask[6], ask[7])) < 1e-6


def test_snap_prefers_ring_then_scan_order(spark):
    cells = spark.createDataFrame([(1, 3, 5, 0, True), (1, 5, 3, 0, True), (1, 4, 4, 9, False)], "m int, ix int, iz int, label long, walkable boolean")
    asks = spark.createDataFrame([(1, 4, 4), (1, 5, 3)], "m int, ix int, iz int")
    got = {(r["ix"], r["iz"]): (r["to_ix"], r["to_iz"]) for r in G.snap_to_free(asks, cells, "m").collect()}
    assert got == {(4, 4): (3, 5), (5, 3): (5, 3)}


def test_snap_reaches_far_cells_and_keeps_every_ask(spark):
    schema = "m int, ix int, iz int, label long, walkable boolean"
    cells = spark.createDataFrame([(1, 900, 10, 0, True), (1, 10, 905, 0, True), (1, 0, 3, 7, False), (3, 5, 5, 1, False)], schema)
    asks = spark.createDataFrame([(1, 0, 0), (1, 899, 500), (2, 1, 1), (3, 200, 5)], "m int, ix int, iz int")
    got = {(r["m"], r["ix"], r["iz"]): (r["to_ix"], r["to_iz"]) for r in G.snap_to_free(asks, cells, "m").collect()}
    assert got == {(1, 0, 0): (900, 10), (1, 899, 500): (900, 10), (2, 1, 1): (None, None), (3, 200, 5): (5, 5)}


def test_every_route_ask_is_answered(spark, world):
    walls, cells, meta = world
    inside = sorted(max(regions(walls), key=len))[0]
    x, z = inside[0] * 0.5 + 0.2, inside[1] * 0.5 + 0.2
    rows = [(0, 1, x, z, x, z), (1, 1, -50.0, z, x, z), (2, 1, x, z, x, 9e4), (3, 77, x, z, x, z)]
    df = spark.createDataFrame(rows, "ask_id long, m int, start_x double, start_z double, goal_x double, goal_z double")
    got = {r["ask_id"]: (r["ok"], r["reason"]) for r in R.route_length(df, cells, meta, "m", 0.5).collect()}
    assert got == {0: (True, None), 1: (False, "start outside"), 2: (False, "goal outside"), 3: (False, "no map")}


def test_waypoints_walk_the_shortest_way(spark, world):
    walls, cells, meta = world
    main = sorted(max(regions(walls), key=len))
    rng = random.Random(5)
    picked = [(rng.choice(main), rng.choice(main)) for _ in range(25)]
    picked += [(picked[0][0], g) for _, g in picked[:6]] + [(main[0], main[0])]  # shared starts, and a start that is its goal
    at = lambda c: c * 0.5 + 0.2
    rows = [(k, 1, at(a[0]), at(a[1]), at(b[0]), at(b[1])) for k, (a, b) in enumerate(picked)] + [(99, 1, -9.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ask_id long, m int, start_x double, start_z double, goal_x double, goal_z double")
    cell = lambda p: (int(p["x"] / 0.5), int(p["z"] / 0.5))
    whole = {r["ask_id"]: r for r in R.routes(df, cells, meta, "m", 0.5, simplify=False).collect()}
    thin = {r["ask_id"]: r for r in R.routes(df, cells, meta, "m", 0.5).collect()}
    assert whole[99]["waypoints"] is None and whole[99]["reason"] == "start outside"
    for k, (a, b) in enumerate(picked):
        path = [cell(p) for p in whole[k]["waypoints"]]
        assert path[0] == a and path[-1] == b and not walls & set(path)
        steps = [(abs(p[0] - q[0]), abs(p[1] - q[1])) for p, q in zip(path, path[1:])]
        assert all(max(s) == 1 for s in steps)
        assert sum(math.sqrt(2) if min(s) else 1.0 for s in steps) == pytest.approx(dijkstra(walls, a, b))
        kept = [cell(p) for p in thin[k]["waypoints"]]
        assert kept[0] == a and kept[-1] == b and len(kept) <= len(path) and set(kept) <= set(path)
        assert not any(c in walls for p, q in zip(kept, kept[1:]) for c in G.line_cells(*p, *q))


def test_lines_in_closed_form(spark):
    rng = random.Random(2)
    pairs = [(x, z, rng.randrange(-9, 10), rng.randrange(-9, 10)) for x in range(-9, 10) for z in range(-9, 10)]
    df = spark.createDataFrame(pairs, "x0 int, z0 int, x1 int, z1 int")
    lines = G.line_cells_of(*(F.col(c) for c in ("x0", "z0", "x1", "z1")))
    for r in df.withColumn("line", lines).collect():
        assert [(c["ix"], c["iz"]) for c in r["line"]] == G.line_cells(r["x0"], r["z0"], r["x1"], r["z1"])


def test_find_product_tiers(spark, world):
    from aislewise.functions.lexicon import Lexicon
    from aislewise.operators.find import find_products

    walls, cells, meta = world
    main = sorted(max(regions(walls), key=len))
    spots = {1: main[3], 2: main[len(main) // 2], 3: main[-1]}
    at = lambda c: (c[0] * 0.5 + 0.2, c[1] * 0.5 + 0.2)
    placed = spark.createDataFrame(
        [(1, k, n, k, *at(spots[k])) for k, n in ((1, "Hylla Ketchup"), (2, "Pasta"), (3, "Rödlök"))],
        "m int, product_id long, name string, ord long, x double, z double",
    )
    catalogue = spark.createDataFrame(
        [(3, 1, "Rödlök", "", "Lök"), (9, 2, "Ostkniv", "", "Tillbehör")], "product_id long, ord long, name string, brand string, category string"
    )
    x, z = at(main[0])
    asks = [(1, 1, 2, None), (2, 1, None, "ketchup"), (3, 1, None, "rödlökar"), (4, 1, None, "ostkniv"), (5, 1, 77, None), (6, 1, None, None)]
    df = spark.createDataFrame([(*a, x, z) for a in asks], "ask_id long, m int, product_id long, name string, start_x double, start_z double")
    got = {r["ask_id"]: r for r in find_products(df, placed, cells, meta, "m", 0.5, catalogue, Lexicon()).collect()}
    assert {k: r["product_id"] for k, r in got.items()} == {1: 2, 2: 1, 3: 3, 4: None, 5: None, 6: None}
    for k, spot in ((1, spots[2]), (2, spots[1]), (3, spots[3])):
        assert got[k]["found"] and got[k]["route_ok"]
        assert got[k]["length_m"] == pytest.approx(0.5 * dijkstra(walls, main[0], spot))
        last = got[k]["waypoints"][-1]
        assert (int(last["x"] / 0.5), int(last["z"] / 0.5)) == spot
    assert not got[4]["found"] and got[4]["waypoints"] is None


def test_line_of_sight(spark, world):
    _, cells, meta = world
    free = spark.createDataFrame([(1, 2, 2)], "m int, ix int, iz int")
    pairs = spark.createDataFrame(
        [(1, 1, 0, 0, 5, 5), (2, 1, 0, 1, 6, 1), (3, 1, 0, 0, 0, 60)], "pair_id long, m int, x0 int, z0 int, x1 int, z1 int"
    )
    got = {r["pair_id"]: r["visible"] for r in G.line_of_sight(pairs, free, meta, "m").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_simplify_keeps_turns(spark):
    wall = spark.createDataFrame([(1, x, 1) for x in range(0, 5)], "m int, ix int, iz int")
    path = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1), (5, 2), (4, 2), (3, 2)]
    df = spark.createDataFrame([(7, 1, i, x, z) for i, (x, z) in enumerate(path)], "route_id long, m int, step long, ix int, iz int")
    got = [(r["ix"], r["iz"]) for r in G.simplify_routes(df, wall, "m").orderBy("step").collect()]
    assert got[0] == (0, 0) and got[-1] == (3, 2) and len(got) < len(path)
    for a, b in zip(got, got[1:]):
        assert not any(c in {(x, 1) for x in range(5)} for c in G.line_cells(*a, *b))


def test_ellipse_matches_round_kernel():
    assert len(G.ellipse_offsets(0)) == 1
    assert set(G.ellipse_offsets(1)) == {(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)}
    assert (4, 0) in G.ellipse_offsets(4) and (4, 1) in G.ellipse_offsets(4) and (4, 4) not in G.ellipse_offsets(4)


def test_shelf_rectangles_ignores_blob_in_hole(spark):
    art = [
        "............",
        ".#########..",
        ".#########..",
        ".#########..",
        ".###...###..",
        ".###...###..",
        ".###...###..",
        ".#########..",
        ".#########..",
        ".#########..",
        "............",
    ]
    rows = []
    for z, line in enumerate(art):
        for x, ch in enumerate(line):
            rows += [(1, x + 0.5, z + 0.5)] * (3 if ch == "#" else 0)
    rows += [(1, 20.5 + i, 2.5 + j) for i in range(3) for j in range(4) for _ in range(3)]
    df = spark.createDataFrame(rows, "m int, x double, z double")
    got = sorted(
        (round(r["x"], 2), round(r["z"], 2), r["width"], r["depth"])
        for r in G.shelf_rectangles(df, "m", cell=1.0, more_than=2, min_area=0.2, padding=3.0).collect()
    )
    assert [g[2:] for g in got] == [(9.0, 9.0), (3.0, 4.0)]


def test_dilation_stays_inside(world):
    _, cells, meta = world
    grown = G.dilate_cells(cells, meta, "m", 2)
    assert grown.filter((F.col("ix") < 0) | (F.col("iz") >= NZ)).count() == 0
    assert grown.count() >= cells.count()
