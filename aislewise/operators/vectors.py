"""Exact nearest vectors by inner product of unit vectors.

Queries and base are dealt into blocks by a hash of their ids; every pair of blocks meets in one task, which
multiplies them piece by piece and lets only the best ``k`` of each query leave.  Nothing of either side
passes through the driver, and a block's size is fixed, so tasks stay small however large the base is.  All pairs
are scored, which is quadratic; beyond the product, a pair costs one comparison with its query's ``k``-th best so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.operators.ordered import top_per_group

BLOCK = 2048  # queries multiplied at once
PIECE = 512  # with so many of the base
PER_TASK = 65_536  # vectors of each side that one task holds
LEAST_QUERIES = 256  # per task, below which more tasks are not worth their copies of the base
LEAST_BASE = 16_384  # per task, likewise
TASKS_PER_CORE = 3


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


DIGITS = 12  # scores are rounded far below any real difference, so equal vectors tie whatever block they are in


class _Best:
    """Best ``k`` of each of a block of queries over blocks of a base whose ids ascend, so ties keep the lowest id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, skip_self: bool):
        self.ids, self.rows, self.k, self.skip_self = ids, rows, k, skip_self
        self.edge = np.full(len(ids), -np.inf)  # k-th best score so far, or less
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.new: list[tuple] = []
        self.waiting = 0

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        scores = self.rows @ matrix.T
        if self.skip_self:
            low, high = (np.searchsorted(ids, self.ids, side) for side in ("left", "right"))
            for step in range(int((high - low).max(initial=0))):
                own = np.flatnonzero(low + step < high)
                scores[own, low[own] + step] = -np.inf
        # A rounded score passes the edge where the score is half a unit beyond it; the rest is settled below.
        edge = self.edge + 0.4 * 10.0**-DIGITS
        some = np.flatnonzero(~(scores.max(axis=1) <= edge))  # true for NaN too
        q, b = np.nonzero(scores[some] > edge[some, None])
        q = some[q]
        if len(q) > 4 * self.k * len(self.ids) and self.k < scores.shape[1]:
            scores = np.nan_to_num(np.round(scores, DIGITS), nan=-np.inf, neginf=-np.inf)
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            q, b = np.nonzero((scores >= least[:, None]) & (scores > self.edge[:, None]))
        found = np.round(scores[q, b], DIGITS)
        good = np.isfinite(found) & (found > self.edge[q])
        self.new.append((q[good], ids[b[good]], found[good]))
        self.waiting += int(good.sum())
        if self.waiting > self.k * len(self.ids) // 2:
            self.merge()

    def merge(self) -> None:
        q, ids, scores = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        first = rank < self.k
        self.kept, self.new, self.waiting = (q[first], ids[first], scores[first]), [], 0
        last = rank == self.k - 1
        self.edge[q[last]] = scores[last]

    def result(self) -> pd.DataFrame:
        self.merge()
        q, ids, scores = self.kept
        return pd.DataFrame({"query_id": self.ids[q], "base_id": ids, "score": scores})


_EMPTY = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "base_id": pd.Series(dtype="int64"),
                       "score": pd.Series(dtype="float64")})
_HITS = "query_id bigint, base_id bigint, score double"


def vector_topk(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    skip_self: bool = False,
    per_task: int = PER_TASK,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, base_id, score, rank) for queries (query_id, vec) against base (base_id, vec)."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    base = base.select(F.col("base_id").cast("long").alias("base_id"), F.col("vec").cast("array<double>").alias("vec"))
    n_queries, n_base = queries.count(), base.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    q_parts = max(1, -(-n_queries // per_task), min(cores, n_queries // LEAST_QUERIES))
    b_parts = max(1, -(-n_base // per_task), min(TASKS_PER_CORE, n_base // LEAST_BASE))

    def dealt(name: str, parts: int):
        return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")

    def every(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    # Dealt to a number of partitions that is given: the planner would join pairs of blocks, light to move, to a few tasks.
    tasks = 4 * q_parts * b_parts if q_parts * b_parts > 1 else 1
    left = queries.withColumn("_q", dealt("query_id", q_parts)).withColumn("_b", every(b_parts))
    right = base.withColumn("_b", dealt("base_id", b_parts)).withColumn("_q", every(q_parts))
    left, right = left.repartition(tasks, "_q", "_b"), right.repartition(tasks, "_q", "_b")

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return _EMPTY
        theirs = theirs.sort_values("base_id", kind="stable")
        ids, matrix = theirs["base_id"].to_numpy(), unit(theirs["vec"])
        out = []
        for at in range(0, len(mine), block):
            part = mine.iloc[at : at + block]
            asked, rows = part["query_id"].to_numpy(), unit(part["vec"])
            best = _Best(asked, rows, k, skip_self)
            piece = min(block, PIECE)
            for low in range(0, len(ids), piece):
                best.meet(ids[low : low + piece], matrix[low : low + piece])
            out.append(best.result())
        return pd.concat(out, ignore_index=True)

    hits = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(search, _HITS)
    return top_per_group(hits, ["query_id"], [F.desc("score"), "base_id"], k, rank="rank")


def mean_descriptor(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Element-wise mean per key scaled to length one; partial sums stay in the JVM."""
    mean = rows.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
    plain = mean.select(key, vector_to_array("_m").alias("_m"))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda acc, v: acc + v * v))
    return plain.select(key, F.transform("_m", lambda v: v / norm).alias("vec"))


def ratio_test(
    queries: DataFrame, base: DataFrame, skip_self: bool = False, floor: float = 0.5, ratio: float = 1.2, **how
) -> DataFrame:
    """Best hit per query when it clearly beats the second best."""
    two = vector_topk(queries, base, 2, skip_self, **how)
    pair = two.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("base_id", "score"))).alias("_a"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    s1 = F.col("_a.score")
    return pair.filter((s1 > floor) & (F.col("s2") > 0.001) & (s1 / F.col("s2") > ratio)).select(
        "query_id", "_a.base_id", s1.alias("s1"), "s2"
    )


def mutual_matches(left: DataFrame, right: DataFrame, **how) -> DataFrame:
    """Pairs that are each other's best hit.  Both sides: (id, vec)."""
    a = left.select(F.col("id").alias("query_id"), "vec"), right.select(F.col("id").alias("base_id"), "vec")
    b = right.select(F.col("id").alias("query_id"), "vec"), left.select(F.col("id").alias("base_id"), "vec")
    forth = vector_topk(*a, 1, **how).select(F.col("query_id").alias("left_id"), F.col("base_id").alias("right_id"), "score")
    back = vector_topk(*b, 1, **how).select(F.col("base_id").alias("left_id"), F.col("query_id").alias("right_id"))
    return forth.join(back, ["left_id", "right_id"])


def correspondence_pairs(left: DataFrame, right: DataFrame, **how) -> DataFrame:
    """3-D places of mutual matches where both sides have one.  Sides: (id, vec, x, y, z)."""
    pairs = mutual_matches(left.select("id", "vec"), right.select("id", "vec"), **how)

    def side(df: DataFrame, key: str, mark: str) -> DataFrame:
        whole = F.lit(True)
        for a in "xyz":
            whole = whole & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double"))
        return df.filter(whole).select(F.col("id").alias(key), *[F.col(a).alias(f"{mark}{a}") for a in "xyz"])

    return pairs.join(side(left, "left_id", "s"), "left_id").join(side(right, "right_id", "d"), "right_id")


def frame_match_pool(counts: DataFrame, key: str = "query_id") -> DataFrame:
    """Pool matches of the strong frames: at least 6 and at least max(8, best // 2) matches.

    Counts: (key, frame, n).  Fewer than 10 pooled matches means not found.
    """
    best = counts.groupBy(key).agg(F.max("n").alias("_best"))
    limit = F.greatest(F.lit(8), F.floor(F.col("_best") / 2))
    strong = (F.col("n") >= 6) & (F.col("n") >= limit)
    return (
        counts.join(best, key)
        .groupBy(key)
        .agg(
            F.coalesce(F.sum(F.when(strong, F.col("n"))), F.lit(0)).alias("pooled"),
            F.count_if(strong).alias("frames"),
        )
        .withColumn("found", F.col("pooled") >= 10)
    )


def fused_confidence(similarity: Column, name_agreement: Column, text_score: Column) -> Column:
    """Image similarity and text match to one level; a very good text match is never 'låg'."""
    agree = name_agreement >= 55
    level = (
        F.when((similarity >= 0.88) & agree, "hög")
        .when((similarity >= 0.83) & agree, "hög")
        .when(similarity >= 0.80, "medium")
        .otherwise("låg")
    )
    return F.when((level == "låg") & (text_score >= 90), "medium").otherwise(level)
