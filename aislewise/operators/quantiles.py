"""Exact linear-interpolated quantiles that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.operators.ordered import ROWS_PER_SLICE, Sequence


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, float],
    rows_per_slice: int = ROWS_PER_SLICE,
    count_as: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per key with a column per wanted share (0..1), and the count of values if asked.

    Equal values are counted first and a running count finds the rows holding the two
    ranks around each share, so a huge group is spread over slices of its values.  A row stands
    for as many values as ``weight`` says.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")
    )
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = Sequence(counted, keys, ["_v"], rows_per_slice).running_sum(_upto=F.col("_c")).df
    rows = ranked.join(sizes, keys)
    aggs = []
    for name, share in wanted.items():
        spot = (F.col("_n") - 1) * F.lit(float(share))
        for part, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{name}_{part}"))
        aggs.append(F.max(spot - F.floor(spot)).alias(f"_{name}_w"))
    found = rows.groupBy(*keys).agg(*aggs)
    if count_as:
        found = found.join(sizes.withColumnRenamed("_n", count_as), keys)
    return found.select(
        *keys,
        *([count_as] if count_as else []),
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
            for n in wanted
        ],
    )
