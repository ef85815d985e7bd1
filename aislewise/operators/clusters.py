"""Arrival-order greedy clustering on top of ``ordered_scan``.

The state between slices is one short record per cluster, never the members.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from aislewise.operators.ordered import ROWS_PER_SLICE, ordered_scan


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def spatial_cluster(
    observations: DataFrame,
    keys: list[str],
    order: str = "ord",
    threshold: float = 1.5,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Adds ``cluster``: each row joins the first cluster of its key whose running centroid
    is closer than ``threshold`` (3-D), else it opens the next one."""
    columns = [*keys, order, "x", "y", "z"]
    limit = threshold * threshold

    def step(rows: pd.DataFrame, state: list) -> tuple[pd.DataFrame, list]:
        sums = [list(s) for s in state]
        centres = [[s[1] / s[0], s[2] / s[0], s[3] / s[0]] for s in sums]
        picked = np.empty(len(rows), dtype=np.int64)
        points = rows[["x", "y", "z"]].fillna(0.0).to_numpy(float)
        for i, (x, y, z) in enumerate(points.tolist()):
            for c, (cx, cy, cz) in enumerate(centres):
                if (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 < limit:
                    s = sums[c]
                    s[0] += 1
                    s[1] += x
                    s[2] += y
                    s[3] += z
                    centres[c] = [s[1] / s[0], s[2] / s[0], s[3] / s[0]]
                    picked[i] = c
                    break
            else:
                picked[i] = len(sums)
                sums.append([1, x, y, z])
                centres.append([x, y, z])
        added = np.zeros((len(sums), 4))
        if len(rows):
            np.add.at(added, picked, np.column_stack([np.ones(len(rows)), points]))
        out = rows[columns].copy()
        out["cluster"] = picked
        return out, [len(state), added.tolist()]

    def merge(state: list, delta: list) -> list:
        known, added = delta
        out = [list(s) for s in state]
        for i, inc in enumerate(added):
            if i < known and i < len(out):
                out[i] = [a + b for a, b in zip(out[i], inc)]
            elif i >= known:
                out.append(list(inc))
        return out

    schema = f"{_ddl(observations, columns)}, cluster bigint"
    return ordered_scan(observations.select(*columns), keys, [order], step, merge, schema, rows_per_slice)


def merge_nearby(
    rows: DataFrame,
    keys: list[str],
    order: str = "ord",
    tolerance: float = 0.4,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Each row joins the first place of its key within ``tolerance`` and pulls it halfway;
    otherwise it becomes a new place.  Returns the running place after every row.

    Places are found through cells as wide as the tolerance, so a row meets those around it only.
    """
    columns = [*keys, order]
    limit = tolerance * tolerance
    side = 1.001 * tolerance
    around = list(product((-1, 0, 1), repeat=3))

    def spot(place: list) -> tuple | None:
        at = [c / side for c in place[:3]]
        return tuple(map(math.floor, at)) if all(map(math.isfinite, at)) else None

    def step(data: pd.DataFrame, state: list) -> tuple[pd.DataFrame, list]:
        places = [list(p) for p in state]
        grid: dict[tuple, set] = {}
        for i, p in enumerate(places):
            grid.setdefault(spot(p), set()).add(i)
        out = []
        for x, y, z in data[["x", "y", "z"]].itertuples(index=False):
            here, best = spot([x, y, z]), len(places)
            for a, b, c in around if here is not None else ():
                for i in grid.get((here[0] + a, here[1] + b, here[2] + c), ()):
                    if i < best:
                        p = places[i]
                        if (p[0] - x) ** 2 + (p[1] - y) ** 2 + (p[2] - z) ** 2 < limit:
                            best = i
            i = best
            if i < len(places):
                p = places[i]
                places[i] = [(p[0] + x) / 2, (p[1] + y) / 2, (p[2] + z) / 2, p[3] + 1]
                there = spot(places[i])
                was = spot(p)
                if there != was:
                    grid[was].discard(i)
                    grid.setdefault(there, set()).add(i)
            else:
                places.append([float(x), float(y), float(z), 1])
                grid.setdefault(here, set()).add(i)
            out.append((i, *places[i]))
        result = data[columns].copy()
        result[["place", "x", "y", "z", "seen"]] = pd.DataFrame(
            out, columns=["place", "x", "y", "z", "seen"], index=result.index
        )
        return result, places

    def merge(_state: list, delta: list) -> list:
        return delta

    schema = f"{_ddl(rows, columns)}, place bigint, x double, y double, z double, seen bigint"
    return ordered_scan(rows.select(*columns, "x", "y", "z"), keys, [order], step, merge, schema, rows_per_slice)
