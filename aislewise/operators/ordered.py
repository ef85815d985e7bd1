"""Running computations per key that stay parallel when one key is huge.

``Sequence`` gives lag / running sum / forward fill / row index in the order of
``order`` inside each ``keys`` group.  Groups up to ``rows_per_slice`` rows use
one ordinary window.  Larger groups are cut at quantiles of the first order column, so
slices hold like numbers of rows whatever the values are; every slice is its own window
partition and only one carry row per slice travels between slices.  The carry table has
at most 2 * rows / rows_per_slice rows, which is what makes broadcasting it safe.  Rows
that tie in the first order column stay in one slice.

``ordered_scan`` does the same for step functions that need state from all
earlier rows: ranges run in parallel from an assumed start state and are re-run
until no assumed start changes any more.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.session import cut_lineage

ROWS_PER_SLICE = 2_000_000


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double")


STRIDE = 32  # bounds are looked up in two steps: every 32nd, then the 32 after it


def slice_bounds(df: DataFrame, keys: list[str], lead: str, rows: int) -> DataFrame | None:
    """(keys, _bounds): inner bounds of the slices of each key with more than ``rows`` rows; None without any.

    Counting is one aggregate; only large keys get a quantile sketch.  It is read at as many shares as
    the largest key needs slices, and smaller keys use every so many of them.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    most = counts.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    parts = -(-most // rows)
    shares = [i / parts for i in range(1, parts)]
    large = df.join(F.broadcast(counts), keys)
    sketch = F.percentile_approx(_as_number(df, lead), shares, 100 * parts)
    found = large.groupBy(*keys).agg(sketch.alias("_all"), F.max("_n").alias("_n"))
    own = F.ceil(F.col("_n") / rows).cast("int")
    picked = F.transform(
        F.sequence(F.lit(1), own - 1), lambda i: F.get("_all", (F.floor(i * parts / own) - 1).cast("int"))
    )
    return found.select(*keys, F.array_distinct(picked).alias("_bounds"))


def _slice_of(value: Column) -> Column:
    """How many of the sorted bounds lie below the value."""
    marks = F.filter("_bounds", lambda _, i: i % STRIDE == STRIDE - 1)
    steps = F.size(F.filter(marks, lambda b: b < value)) * STRIDE
    rest = F.slice("_bounds", steps + 1, F.lit(STRIDE))
    return steps + F.size(F.filter(rest, lambda b: b < value))


def add_slices(df: DataFrame, keys: list[str], lead: str, rows: int) -> tuple[DataFrame, bool]:
    """Adds ``_slice`` (0 for ordinary keys) and ``_big``; True when any key was cut."""
    bounds = slice_bounds(df, keys, lead, rows)
    if bounds is None:
        return df.withColumn("_slice", F.lit(0)).withColumn("_big", F.lit(False)), False
    placed = F.when(_as_number(df, lead).isNull(), 0).otherwise(_slice_of(_as_number(df, lead)))
    sliced = (
        df.join(F.broadcast(bounds), keys, "left")
        .withColumn("_big", F.col("_bounds").isNotNull())
        .withColumn("_slice", F.when(F.col("_big"), placed).otherwise(0).cast("int"))
        .drop("_bounds")
    )
    return sliced, True


class Sequence:
    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int = ROWS_PER_SLICE):
        self.keys, self.order = list(keys), list(order)
        self._df, self.cut = add_slices(df, self.keys, self.order[0], rows_per_slice)

    @property
    def _window(self):
        return Window.partitionBy(*self.keys, "_slice").orderBy(*self.order)

    @property
    def _slices(self):
        return Window.partitionBy(*self.keys).orderBy("_slice")

    def _per_slice(self, *aggs: Column) -> DataFrame:
        return self._df.filter("_big").groupBy(*self.keys, "_slice").agg(*aggs)

    def _attach(self, carry: DataFrame) -> None:
        self._df = self._df.join(F.broadcast(carry), [*self.keys, "_slice"], "left")

    def with_columns(self, **columns: Column) -> Sequence:
        for name, value in columns.items():
            self._df = self._df.withColumn(name, value)
        return self

    def index(self, out: str) -> Sequence:
        """1-based position inside the group."""
        return self.running_sum(**{out: F.lit(1).cast("long")})

    def running_sum(self, **columns: Column) -> Sequence:
        frame = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.cut:
            carry = self._per_slice(*[F.sum(c).alias(f"_c_{o}") for o, c in columns.items()])
            before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
            self._attach(
                carry.select(
                    *self.keys, "_slice", *[F.sum(f"_c_{o}").over(before).alias(f"_p_{o}") for o in columns]
                )
            )
        for out, value in columns.items():
            total = F.sum(value).over(frame)
            if self.cut:
                total = total + F.coalesce(F.col(f"_p_{out}"), F.lit(0))
            self._df = self._df.withColumn(out, total)
        self._df = self._df.drop(*[f"_p_{o}" for o in columns])
        return self

    def lag(self, **columns: Column) -> Sequence:
        """Value of the previous row of the group (null on the first)."""
        packed = F.struct(*[c.alias(o) for o, c in columns.items()])
        if self.cut:
            last = F.max_by(packed, F.struct(*self.order)).alias("_last")
            carry = self._per_slice(last)
            self._attach(carry.select(*self.keys, "_slice", F.lag("_last").over(self._slices).alias("_carried")))
        local = F.lag(packed).over(self._window)
        if self.cut:
            local = F.coalesce(local, F.col("_carried"))
        self._df = self._df.withColumn("_before", local)
        for out in columns:
            self._df = self._df.withColumn(out, F.col(f"_before.{out}"))
        self._df = self._df.drop("_before", "_carried")
        return self

    def fill_forward(self, **columns: Column) -> Sequence:
        """Last non-null value at or before the row."""
        frame = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.cut:
            key = F.struct(*self.order)
            carry = self._per_slice(
                *[F.max_by(c, F.when(c.isNotNull(), key)).alias(f"_c_{o}") for o, c in columns.items()]
            )
            before = self._slices.rowsBetween(Window.unboundedPreceding, -1)
            self._attach(
                carry.select(
                    *self.keys,
                    "_slice",
                    *[F.last(f"_c_{o}", ignorenulls=True).over(before).alias(f"_p_{o}") for o in columns],
                )
            )
        for out, value in columns.items():
            filled = F.last(value, ignorenulls=True).over(frame)
            if self.cut:
                filled = F.coalesce(filled, F.col(f"_p_{out}"))
            self._df = self._df.withColumn(out, filled)
        self._df = self._df.drop(*[f"_p_{o}" for o in columns])
        return self

    @property
    def df(self) -> DataFrame:
        return self._df.drop("_slice", "_big")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[pd.DataFrame, list], tuple[pd.DataFrame, list]],
    merge: Callable[[list, list], list],
    schema: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Apply ``step(rows in order, state) -> (rows out, delta)`` along each group.

    ``merge(state, delta)`` gives the state after a slice.  States are plain JSON
    lists.  A group larger than ``rows_per_slice`` is split; slices run side by
    side from assumed start states until those stop changing.  Slice i is right
    after round i + 1 at the latest, so the loop always ends with the same rows
    a single pass would give.
    """
    sliced, cut = add_slices(df, keys, order[0], rows_per_slice)
    sliced = sliced.drop("_big")
    group = [*keys, "_slice"]
    if not cut:

        def once(pdf: pd.DataFrame) -> pd.DataFrame:
            rows, _ = step(pdf.sort_values(order, kind="stable").drop(columns="_slice"), [])
            return rows

        return sliced.groupBy(*group).applyInPandas(once, schema)

    sliced = cut_lineage(sliced)
    key_ddl = ", ".join(f"`{k}` {sliced.schema[k].dataType.simpleString()}" for k in keys)
    starts = sliced.select(*group).distinct().withColumn("start", F.lit("[]"))
    rounds = starts.groupBy(*keys).count().agg(F.max("count")).first()[0] + 1

    def run_delta(pdf: pd.DataFrame) -> pd.DataFrame:
        start = json.loads(pdf["start"].iloc[0])
        rows = pdf.drop(columns=["start", "_slice"]).sort_values(order, kind="stable")
        _, delta = step(rows, start)
        out = pdf[group].head(1).copy()
        out["start"], out["delta"] = pdf["start"].iloc[0], json.dumps(delta)
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice")
        state: list = []
        begins = []
        for delta in pdf["delta"]:
            begins.append(json.dumps(state))
            state = merge(state, json.loads(delta))
        out = pdf[[*group, "start"]].rename(columns={"start": "used"})
        out["start"] = begins
        return out

    for _ in range(int(rounds) + 1):
        deltas = (
            sliced.join(starts, group)
            .groupBy(*group)
            .applyInPandas(run_delta, f"{key_ddl}, _slice int, start string, delta string")
        )
        chained = cut_lineage(
            deltas.groupBy(*keys).applyInPandas(chain, f"{key_ddl}, _slice int, used string, start string")
        )
        moved = chained.filter("used <> start").limit(1).count()
        starts = chained.drop("used")
        if not moved:
            break
    else:
        raise RuntimeError("slice states did not settle; the step function is not deterministic")

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        start = json.loads(pdf["start"].iloc[0])
        rows, _ = step(pdf.drop(columns=["start", "_slice"]).sort_values(order, kind="stable"), start)
        return rows

    return sliced.join(starts, group).groupBy(*group).applyInPandas(emit, schema)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group.  The rank filter is applied per input partition
    before the shuffle, so a huge group ships at most ``n`` rows per partition."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= n
    )
    return ranked if rank else ranked.drop(name)
