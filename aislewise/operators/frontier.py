"""Best rows under weighted improvements without comparing everything with everything."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.operators.ordered import top_per_group

BLOCK = 2048


def salted(df: DataFrame, key: str, by: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: groups of about ``block`` rows inside each key."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias(f"_n_{out}"))
    return df.join(sizes, key).withColumn(out, F.pmod(F.xxhash64(by), F.col(f"_n_{out}")).cast("int"))


def frontier(rows: DataFrame, key: str, axes: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """Rows that fewer than ``n`` earlier rows of their key match or beat on every axis.

    A missing value never improves on anything.  Blocks of each key are thinned on their
    own, twice; what a block drops has ``n`` better rows in that block already.
    """
    names = ["product_id", "ord", key, *axes]
    schema = rows.select(*names).schema

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[names].sort_values("ord", kind="stable")
        values = pdf[axes].astype(float).fillna(np.inf).to_numpy()
        keep: list[int] = []
        for i, v in enumerate(values):
            if len(keep) >= n and (values[keep] <= v).all(axis=1).sum() >= n:
                continue
            keep.append(i)
        return pdf.iloc[keep]

    out = rows.select(*names)
    for _ in range(2):
        out = salted(out, key, "product_id", "_salt", block).groupBy(key, "_salt").applyInPandas(thin, schema)
    return out


def best_against(
    asks: DataFrame, offers: DataFrame, key: str, axes: list[str], weights: tuple[float, ...], n: int, block: int = BLOCK
) -> DataFrame:
    """Top ``n`` offers per ask by the weighted sum of improvements (one decimal, then ord).

    Asks and offers of a key meet block by block; only the best of each block leaves a task.
    """
    a = salted(asks, key, "ask_id", "_a", block).select(key, "ask_id", *axes, "_a", "_n__a")
    o = salted(offers, key, "product_id", "_o", block).select(key, "product_id", "ord", *axes, "_o", "_n__o")
    a_blocks = a.groupBy(key).agg(F.max("_n__a").alias("_na"))
    o_blocks = o.groupBy(key).agg(F.max("_n__o").alias("_no"))
    left = a.join(o_blocks, key).withColumn("_o", F.explode(F.sequence(F.lit(0), (F.col("_no") - 1).cast("int"))))
    right = o.join(a_blocks, key).withColumn("_a", F.explode(F.sequence(F.lit(0), (F.col("_na") - 1).cast("int"))))

    def score(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        columns = ["ask_id", "better_id", "score", "ord"]
        if mine.empty or theirs.empty:
            return pd.DataFrame(columns=columns)
        theirs = theirs.sort_values("ord", kind="stable")
        total = np.zeros((len(mine), len(theirs)))
        for axis, weight in zip(axes, weights):
            old = mine[axis].astype(float).fillna(-np.inf).to_numpy()[:, None]
            new = theirs[axis].astype(float).fillna(np.inf).to_numpy()[None, :]
            better = new < old
            total += weight * np.where(better, np.where(better, old, 0) - np.where(better, new, 0), 0.0)
        total = np.round(total, 1)
        take = min(n, total.shape[1])
        order = np.argsort(-total, axis=1, kind="stable")[:, :take]
        picked = np.take_along_axis(total, order, axis=1)
        ids, ords = theirs["product_id"].to_numpy(), theirs["ord"].to_numpy()
        out = pd.DataFrame(
            {
                "ask_id": np.repeat(mine["ask_id"].to_numpy(), take),
                "better_id": ids[order].ravel(),
                "score": picked.ravel(),
                "ord": ords[order].ravel(),
            }
        )
        return out[out["score"] > 0]

    pairs = (
        left.groupBy(key, "_a", "_o")
        .cogroup(right.groupBy(key, "_a", "_o"))
        .applyInPandas(score, "ask_id bigint, better_id bigint, score double, ord bigint")
    )
    return top_per_group(pairs, ["ask_id"], [F.desc("score"), "ord"], n, rank="rank").drop("ord")
