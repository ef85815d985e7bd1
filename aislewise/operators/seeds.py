"""Greedy seeds as rounds of independent sets over small cells.

In order of arrival, a row within the radius of an earlier seed belongs to the first of them, any other row is a
seed.  Cells are twice as wide as the radius, so they hold a few seeds at most; a seed goes to the cells its square (cube)
touches, 4 (8) of them, and each row meets the seeds of its own cell.  In a round, the first open row of every quarter
(eighth) of a cell asks whether an earlier open row lies within the radius; where none
does, it is a seed and closes the rows around it.  All rows of a cell meet one short list, so no group of rows is
gathered and a crowded cell may be split over tasks.  A few rounds close nearly all rows of a crowded map.

Where the open rows of every key fit in a task (``PER_TASK``), one pass in order ends the work.  Where they never do,
rows along a path would close one after the other; so, after ``CELL_ROUNDS`` rounds, wide tiles take their rows in
order, each with the open rows around it, and leave open only what depends on an open row outside.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.session import cut_lineage, written

PER_TASK = 20_000
TILE = 16  # radii
CELL_ROUNDS = 6


def _cells(axes: tuple[str, ...], side: float, prefix: str) -> list[Column]:
    return [F.floor(F.col(a) / side).cast("long").alias(f"{prefix}{i}") for i, a in enumerate(axes)]


def _shifted(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each row once for its own cell and every one beside it."""
    steps = F.array(*[F.array(*[F.lit(d) for d in s]) for s in product((-1, 0, 1), repeat=len(names))])
    out = rows.withColumn("_s", F.explode(steps))
    for i, n in enumerate(names):
        out = out.withColumn(n, F.col(n) + F.col("_s")[i])
    return out.drop("_s")


def greedy_seeds(
    rows: DataFrame,
    keys: list[str],
    order: str = "ord",
    radius: float = 0.5,
    axes: tuple[str, ...] = ("x", "z"),
    per_task: int = PER_TASK,
) -> DataFrame:
    """Adds ``seed``: order value of the first earlier seed within ``radius``, or the row's
    own when there is none (it then is a seed itself).

    Rows of equal order stand by their coordinates, equal rows share their seed.  A row with a null key or a null or
    non-finite coordinate is its own seed and nobody else's.
    """
    dims = len(axes)
    side = 2.002 * radius
    cells = [f"_c{i}" for i in range(dims)]
    place = F.struct(F.col(order).alias("o"), *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate(axes)])
    finite = F.lit(True)
    for a in axes:
        finite = finite & F.coalesce(F.abs(a) < float("inf"), F.lit(False))
    for k in keys:
        finite = finite & F.col(k).isNotNull()
    every = rows.select(*keys, order, *axes)
    all_rows = every.filter(finite).select("*", *_cells(axes, side, "_c"), place.alias("_p"))
    by_cell = [*keys, *cells]

    def within(a: Column, b: Column) -> Column:
        return sum(((a[f"p{i}"] - b[f"p{i}"]) * (a[f"p{i}"] - b[f"p{i}"]) for i in range(1, dims)),
                   (a["p0"] - b["p0"]) * (a["p0"] - b["p0"])) < radius * radius

    def around(few: DataFrame) -> DataFrame:
        """Per cell the list of ``few`` (a few per cell at most) within the radius of it.  Never broadcast: the
        planner takes the copies for as small as their source."""
        out = few.select(*keys, "_p")
        for i, c in enumerate(cells):
            low, high = (F.floor((F.col(f"_p.p{i}") + d * 1.001 * radius) / side).cast("long") for d in (-1, 1))
            out = out.withColumn(c, F.explode(F.sequence(low, high)))
        return out.groupBy(*by_cell).agg(F.collect_list("_p").alias("_near")).hint("merge")

    def uncovered(left: DataFrame, seeds: DataFrame) -> DataFrame:
        met = left.join(around(seeds), by_cell, "left")
        covered = F.exists("_near", lambda s: within(s, F.col("_p")) & (s <= F.col("_p")))
        return met.filter(~F.coalesce(covered, F.lit(False))).drop("_near")

    def cell_round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        parts = [F.floor(F.col(f"_p.p{i}") / (side / 2)) for i in range(dims)]
        first = cut_lineage(left.groupBy(*by_cell, *parts).agg(F.min("_p").alias("_p")).select(*by_cell, "_p"))
        held = left.join(around(first), by_cell).select(
            *keys, F.explode(F.filter("_near", lambda c: within(c, F.col("_p")) & (F.col("_p") < c))).alias("_p")
        )
        seeds = cut_lineage(first.join(held.distinct().hint("merge"), [*keys, "_p"], "left_anti"))
        return uncovered(left, seeds), seeds

    def in_order(left: DataFrame, tiles: list[str]) -> tuple[DataFrame, DataFrame]:
        """One pass over each key, or over each of its tiles with the rows around it."""
        copies = left.select(*by_cell, "_p", F.lit(True).alias("_home"))
        for i, t in enumerate(tiles):
            copies = copies.withColumn(t, F.floor(F.col(f"_p.p{i}") / (TILE * radius)).cast("long"))
        if tiles:
            copies = _shifted(copies.select("*", F.struct(*tiles).alias("_at")), tiles)
            near = F.lit(True)
            for i, t in enumerate(tiles):
                beyond = F.col(f"_p.p{i}") - F.col(t) * (TILE * radius)
                near = near & (beyond > -1.001 * radius) & (beyond < (TILE + 1.001) * radius)
            copies = copies.filter(near).withColumn("_home", F.col("_at") == F.struct(*tiles))
        copies = copies.select(*by_cell, *tiles, "_home", "_p.*")
        names = ["o", *[f"p{i}" for i in range(dims)]]
        shifts = list(product((-1, 0, 1), repeat=dims))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(names, kind="stable")
            grid: dict[tuple, list] = {}
            states = np.zeros(len(pdf), np.int64)  # 0 open, 1 seed, 2 covered
            points = pdf[names[1:]].to_numpy(float)
            spots = np.floor(points / radius).astype(np.int64).tolist()
            for k, (at, spot_, mine) in enumerate(zip(points.tolist(), spots, pdf["_home"].tolist(), strict=True)):
                state = 1 if mine else 0
                for s in shifts:
                    for kind, other in grid.get(tuple(c + d for c, d in zip(spot_, s, strict=True)), ()):
                        if state != 2 and sum((a - b) ** 2 for a, b in zip(other, at, strict=True)) < radius * radius:
                            state = 2 if kind == 1 else 0
                    if state == 2:
                        break
                states[k] = state
                if state != 2:
                    grid.setdefault(tuple(spot_), []).append((state, at))
            out = pdf.assign(_state=states)
            return out[out["_home"] & (out["_state"] != 2)][[*by_cell, *names, "_state"]]

        kinds = {f: left.schema[f].dataType.simpleString() for f in by_cell}
        kind = left.schema["_p"].dataType["o"].dataType.simpleString()
        ddl = ", ".join([*(f"`{n}` {t}" for n, t in kinds.items()), f"o {kind}", *(f"{n} double" for n in names[1:])])
        done = written(copies.groupBy(*keys, *tiles).applyInPandas(run, ddl + ", _state bigint"), "seed-tiles")
        done = done.select(*by_cell, F.struct(*names).alias("_p"), "_state")
        seeds = done.filter("_state = 1").drop("_state")
        return uncovered(done.filter("_state = 0").drop("_state"), seeds), seeds

    def crowd(left: DataFrame, tiles: list[str]) -> int:
        spot = [F.floor(F.col(f"_p.p{i}") / (TILE * radius)).alias(t) for i, t in enumerate(tiles)]
        return left.groupBy(*keys, *spot).count().agg(F.max("count")).first()[0] or 0

    left = written(all_rows.select(*by_cell, "_p").distinct(), "open-rows")
    found: DataFrame | None = None
    rounds, tiles = 0, [f"_t{i}" for i in range(dims)]
    while (most := crowd(left, [])) > 0:
        if most <= per_task:
            left, seeds = in_order(left, [])
        elif rounds >= CELL_ROUNDS and crowd(left, tiles) <= per_task:
            left, seeds = in_order(left, tiles)
        else:
            left, seeds = cell_round(left)
        left = written(left, "open-rows")
        found = seeds if found is None else found.unionByName(seeds)
        rounds += 1
    others = every.filter(~finite).withColumn("seed", F.col(order))
    if found is None:
        return others
    met = all_rows.join(around(found), by_cell, "left")
    mine = F.filter("_near", lambda s: within(s, F.col("_p")) & (s <= F.col("_p")))
    seed = F.array_min(F.transform(mine, lambda s: s["o"]))
    return met.select(*keys, order, *axes, F.coalesce(seed, F.col(order)).alias("seed")).unionByName(others)
