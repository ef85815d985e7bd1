"""Ordered per-device rules that need the state of all earlier rows.

``Gate`` is the rule itself; the batch operators run it through ``ordered_scan`` and the
streaming jobs through keyed state, so both give the same rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from aislewise.operators.ordered import ROWS_PER_SLICE, ordered_scan

FRESH = [None, None, None, None, False, False, 0, 0]


def recalibrate(state: list, at: float, kind: str, t: list | None, inliers: int, tracking: str) -> tuple[list, object]:
    """One row of the recalibration rule; returns (new state, accepted or None).

    State: current, target and blend-start matrices, blend start time, hard flag, whether
    tracking was normal, accepted count, rejected count.
    """
    current, target, origin, began, hard, normal, yes, no = state
    if target is not None:
        share = min((at - began) / 0.5, 1.0)
        if share >= 1.0:
            current, target, origin, began = target, None, None, None
        else:
            current = [a + (b - a) * share for a, b in zip(origin, target)]
    if kind == "pose":
        now = tracking == "normal"
        return [current, target, origin, began, hard or (now and not normal), now, yes, no], None
    was_hard, hard = hard, False
    if t is None or inliers < (80 if was_hard else 60):
        return [current, target, origin, began, hard, normal, yes, no + 1], False
    if was_hard or current is None:
        return [list(t), None, None, None, hard, normal, yes + 1, no], True
    far = math.dist(t[12:15], current[12:15]) > 1.5
    if far or _heading_change(current, t) > math.pi / 3:
        return [current, target, origin, began, hard, normal, yes, no + 1], False
    return [current, list(t), list(current), at, hard, normal, yes + 1, no], True


def _heading_change(a: list, b: list) -> float:
    size_a, size_b = math.hypot(a[0], a[2]), math.hypot(b[0], b[2])
    if size_a <= 0.01 or size_b <= 0.01:
        return 0.0
    return math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[2] * b[2]) / (size_a * size_b))))


GATE_COLUMNS = ["accepted", "x", "z", "n_accepted", "n_rejected"]
GATE_DDL = "accepted boolean, x double, z double, n_accepted bigint, n_rejected bigint"


def run_gate(rows: pd.DataFrame, state: list) -> tuple[pd.DataFrame, list]:
    """Rows (at, kind, t, inliers, tracking) in order to gate columns, and the state after them."""
    out = []
    for at, kind, t, inliers, tracking in rows[["at", "kind", "t", "inliers", "tracking"]].itertuples(index=False):
        t = None if t is None else [float(v) for v in t]
        state, accepted = recalibrate(state, float(at), kind, t, int(inliers), tracking)
        now = state[0]
        out.append((accepted, now[12] if now else None, now[14] if now else None, state[6], state[7]))
    made = pd.DataFrame(out, columns=GATE_COLUMNS, index=rows.index)
    made["accepted"] = made["accepted"].astype("boolean")
    return made, state


def recalibration_gate(
    rows: DataFrame, device: str, order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Gate every row (device, order.., at seconds, kind, t, inliers, tracking)."""
    head = [device, *order]

    def step(data: pd.DataFrame, state: list) -> tuple[pd.DataFrame, list]:
        made, state = run_gate(data, state or FRESH)
        return pd.concat([data[head], made], axis=1), state

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in head)
    columns = list(dict.fromkeys([*head, "at", "kind", "t", "inliers", "tracking"]))
    return ordered_scan(
        rows.select(*columns), [device], order, step, lambda _state, delta: delta, f"{ddl}, {GATE_DDL}", rows_per_slice
    )


def throttle_exact(
    rows: DataFrame, device: str, order: list[str], interval_s: float, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Keep a row only when ``interval_s`` has passed since the last kept row of its device."""
    head = [device, *order]

    def step(data: pd.DataFrame, state: list) -> tuple[pd.DataFrame, list]:
        last = state[0] if state else None
        keep = []
        for at in data["at"]:
            ok = last is None or at - last >= interval_s
            keep.append(ok)
            last = float(at) if ok else last
        return data.loc[keep, head], [] if last is None else [last]

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in head)
    columns = list(dict.fromkeys([*head, "at"]))
    return ordered_scan(
        rows.select(*columns), [device], order, step, lambda _state, delta: delta, ddl, rows_per_slice
    )
