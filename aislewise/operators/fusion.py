"""Many sightings of a product become one row: voting, consolidation, corrections, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.operators.clusters import merge_nearby, spatial_cluster
from aislewise.operators.quantiles import quantiles
from aislewise.operators.seeds import greedy_seeds
from aislewise.session import cut_lineage


def vote_weight(confidence: Column) -> Column:
    return F.when(confidence == "hög", 3).when(confidence == "medium", 2).otherwise(1)


def confidence_rank(confidence: Column) -> Column:
    return (
        F.when(confidence == "hög", 3)
        .when(confidence.isin("medium", "medel"), 2)
        .when(confidence == "låg", 1)
        .otherwise(0)
    )


def confidence_name(rank: Column) -> Column:
    return F.when(rank >= 3, "hög").when(rank >= 2, "medium").when(rank >= 1, "låg").otherwise("okänd")


def weighted_vote(rows: DataFrame, keys: list[str], order: str = "ord", detail: tuple[str, ...] = ()) -> DataFrame:
    """Winner per group by confidence-weighted votes, first seen name on ties, with the
    winner's most confident row as detail and the mean position of all rows."""
    weight = vote_weight(F.col("confidence"))
    per_name = rows.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(a).alias(f"_{a}") for a in "xyz"],
        F.sum(weight).alias("votes"),
        F.min(order).alias("_first"),
        F.min_by(F.struct("confidence", order, *detail), F.struct((-weight).alias("w"), order)).alias("_detail"),
    )
    named = F.col("name").isNotNull() & (F.col("name") != "")
    standing = F.when(named, F.struct("votes", (-F.col("_first")).alias("f")))
    grouped = per_name.groupBy(*keys).agg(
        F.max_by(F.struct("name", "votes", "_detail"), standing).alias("_win"),
        F.sum("_n").alias("seen"),
        *[(F.sum(f"_{a}") / F.sum("_n")).alias(a) for a in "xyz"],
        F.sum(F.when(named, F.col("votes"))).alias("_all"),
        F.map_from_entries(F.collect_list(F.when(named, F.struct("name", "votes")))).alias("candidates"),
    )
    return grouped.filter(F.col("_win").isNotNull()).select(
        *keys,
        "_win.name",
        "_win._detail.confidence",
        *[F.col(f"_win._detail.{d}").alias(d) for d in detail],
        "x",
        "y",
        "z",
        "_win.votes",
        "seen",
        (F.col("_win.votes") / F.col("_all")).alias("share"),
        "candidates",
        F.format_string("pos_%.2f_%.2f", "x", "z").alias("position_id"),
    )


def vote_places(rows: DataFrame, keys: list[str], order: str = "ord", radius: float = 0.5) -> DataFrame:
    """Group sightings around seeds in arrival order, then vote per place."""
    seeds = greedy_seeds(rows, keys, order, radius).select(*keys, order, "seed")
    return weighted_vote(rows.join(seeds, [*keys, order]), [*keys, "seed"], order)


def confidence_buckets(voted: DataFrame, keys: list[str]) -> DataFrame:
    share = F.col("share")
    return voted.groupBy(*keys).agg(
        F.count_if(share > 0.7).alias("high"),
        F.count_if((share > 0.4) & (share <= 0.7)).alias("medium"),
        F.count_if(share <= 0.4).alias("low"),
    )


def consolidate(rows: DataFrame, keys: list[str], order: str = "ord", names: tuple[str, ...] = ("name",)) -> DataFrame:
    """One row per cluster from its most confident sightings only, weighted by score.

    Sums are built per (cluster, confidence rank) first, so the widest shuffle carries at
    most four rows per cluster and input partition.
    """
    score = F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(1.0))
    weight = F.greatest(score, F.lit(0.001))
    ranked = rows.withColumn("_rank", confidence_rank(F.col("confidence")))
    per_rank = ranked.groupBy(*keys, "_rank").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(weight).alias("_w"),
        *[F.sum(weight * F.col(a)).alias(f"_{a}") for a in "xyz"],
        F.min_by(F.struct(*names), order).alias("_names"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("_best"),
    )
    top = per_rank.groupBy(*keys).agg(
        F.max_by(F.struct("_rank", "_n", "_w", "_x", "_y", "_z", "_names", "_best"), "_rank").alias("_t"),
        F.sum("_n").alias("n_seen"),
    )
    return top.select(
        *keys,
        *[F.col(f"_t._names.{n}").alias(n) for n in names],
        *[(F.col(f"_t._{a}") / F.col("_t._w")).alias(a) for a in "xyz"],
        confidence_name(F.col("_t._rank")).alias("confidence"),
        "n_seen",
        F.col("_t._n").alias("n_used"),
        F.col("_t._best").alias("best_score"),
    )


def consolidate_products(rows: DataFrame, keys: list[str], order: str = "ord", threshold: float = 1.5) -> DataFrame:
    """Cluster every product's sightings, then consolidate each cluster."""
    clusters = spatial_cluster(rows, keys, order, threshold).select(*keys, order, "cluster")
    return consolidate(rows.join(clusters, [*keys, order]), [*keys, "cluster"], order)


def merged_places(rows: DataFrame, keys: list[str], order: str = "ord", tolerance: float = 0.4) -> DataFrame:
    """Final running-average places of ``merge_nearby``."""
    running = merge_nearby(rows, keys, order, tolerance)
    return running.groupBy(*keys, "place").agg(F.max_by(F.struct("x", "y", "z", "seen"), order).alias("_p")).select(
        *keys, "place", "_p.*"
    )


def fold_corrections(events: DataFrame, key: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Correction log to one row per position; the last value given for a field wins."""
    return events.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    )


def apply_corrections(placed: DataFrame, corrections: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    renamed = corrections.select(key, *[F.col(f).alias(f"_c_{f}") for f in fields], F.lit(True).alias("_c"))
    out = placed.join(renamed, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(f"_c_{f}", F.lit("")) if f == "name" else f"_c_{f}", f))
    return (
        out.withColumn("corrected", F.col("_c").isNotNull())
        .withColumn("confidence", F.when(F.col("_c"), "hög").otherwise(F.col("confidence")))
        .drop("_c", *[f"_c_{f}" for f in fields])
    )


def alias_union(rows: DataFrame, key: str, alias: str, order: str, keep: tuple[str, ...]) -> DataFrame:
    """Distinct aliases per product in first-seen order, first row's attributes kept."""
    per_alias = rows.groupBy(key, alias).agg(
        F.min(order).alias("_at"), F.min_by(F.struct(*keep), order).alias("_keep")
    )
    grouped = per_alias.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_at", alias))).alias("_a"), F.min_by("_keep", "_at").alias("_keep")
    )
    return grouped.select(key, F.transform("_a", lambda a: a[alias]).alias("aliases"), "_keep.*")


def upsert_products(snapshot: DataFrame, events: DataFrame, order: str = "event_id") -> DataFrame:
    """Apply a batch of staff / customer reports to the product table.

    Snapshot: product_id, x, y, z, status, confidence, points, last_seen, aliases.
    Events: product_id, event_id, source, x, y, z, confidence, aliases, ts.
    Staff overwrite position and status and add a point and their aliases; customers only
    refresh last_seen; the first report of an unknown product creates it with one point.
    """
    staff = F.col("source") == "personal"
    place = F.col(order)
    folded = events.groupBy("product_id").agg(
        F.count_if(staff).alias("_staff"),
        F.max("ts").alias("_seen"),
        F.min_by(F.struct("source", "x", "y", "z", "confidence", "aliases"), order).alias("_first"),
        *[F.max_by(a, F.when(staff & F.col(a).isNotNull(), place)).alias(f"_{a}") for a in "xyz"],
        F.max_by(F.coalesce("confidence", F.lit("medium")), F.when(staff, place)).alias("_conf"),
    )
    told = (
        events.filter(staff)
        .select("product_id", order, F.explode("aliases").alias("_a"))
        .groupBy("product_id", "_a")
        .agg(F.min(order).alias("_at"))
        .groupBy("product_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_a"))), lambda s: s["_a"]).alias("_aliases"))
    )
    old = snapshot.select("product_id", F.struct(*[c for c in snapshot.columns if c != "product_id"]).alias("_o"))
    rows = old.join(folded.join(told, "product_id", "left"), "product_id", "full_outer")
    known, touched = F.col("_o").isNotNull(), F.col("_seen").isNotNull()
    defaults = {"x": 0.0, "y": 0.0, "z": 2.5}
    by_staff = F.col("_staff") > 0
    empty = F.array().cast("array<string>")
    return rows.select(
        "product_id",
        *[
            F.when(known, F.coalesce(f"_{a}", f"_o.{a}"))
            .otherwise(F.coalesce(f"_{a}", f"_first.{a}", F.lit(defaults[a])))
            .alias(a)
            for a in "xyz"
        ],
        F.when(known & ~F.coalesce(by_staff, F.lit(False)), F.col("_o.status")).otherwise("I lager").alias("status"),
        F.when(known, F.coalesce("_conf", "_o.confidence"))
        .otherwise(F.coalesce("_conf", "_first.confidence", F.lit("medium")))
        .alias("confidence"),
        F.when(known, F.col("_o.points") + F.coalesce("_staff", F.lit(0)))
        .otherwise(F.lit(1) + F.col("_staff") - F.when(F.col("_first.source") == "personal", 1).otherwise(0))
        .cast("long")
        .alias("points"),
        F.when(touched, F.col("_seen")).otherwise(F.col("_o.last_seen")).alias("last_seen"),
        F.array_distinct(
            F.concat(
                F.coalesce("_o.aliases", F.when(known, empty).otherwise(F.coalesce("_first.aliases", empty))),
                F.coalesce("_aliases", empty),
            )
        ).alias("aliases"),
    )


def delete_products(products: DataFrame, ids: DataFrame, key: str, aisle: str | None = None, where: str | None = None):
    """Products without the given ids, and without a whole aisle when one is named."""
    kept = products.join(ids.select(key), key, "left_anti")
    if where is not None:
        kept = kept.filter(~F.col(aisle).eqNullSafe(where))
    return kept


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 128.0) -> DataFrame:
    """Hits and median depth per label box of the same frame, with the frame's own median
    as fallback.  Boxes are spread over image cells, so frame and cell are the join key and
    a crowded frame is split by area.  Equal boxes of a frame are filled once and equal points met
    once with their number; the hits are counted by depth once and stored.  No side is broadcast:
    the planner takes the spread boxes for as small as their source."""
    place = ["frame", "x1", "x2", "y1", "y2"]
    valid = boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(*place).distinct()
    spread = valid.withColumn(
        "_cu", F.explode(F.sequence(F.floor(F.col("x1") / cell), F.floor(F.col("x2") / cell)))
    ).withColumn("_cv", F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell))))
    spots = (
        points.groupBy("frame", "u", "v", "depth")
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_cu", F.floor(F.col("u") / cell))
        .withColumn("_cv", F.floor(F.col("v") / cell))
    )
    hits = spots.join(spread.hint("merge"), ["frame", "_cu", "_cv"]).filter(
        F.col("u").between(F.col("x1"), F.col("x2")) & F.col("v").between(F.col("y1"), F.col("y2"))
    )
    by_depth = cut_lineage(hits.groupBy(*place, "depth").agg(F.sum("_w").alias("_w")))
    medians = quantiles(by_depth, place, "depth", {"mid": 0.5}, count_as="hits", weight="_w")
    frames = frame_median_depth(points)
    good = (F.col("hits") >= 3) & (F.col("mid") > 0.2) & (F.col("mid") < 10.0)
    joined = boxes.join(medians.hint("merge"), place, "left").join(frames, "frame", "left")
    return joined.select(
        "box_id",
        "frame",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce(good, F.lit(False)).alias("from_box"),
        F.when(good, F.col("mid")).otherwise(F.coalesce("median_depth", F.lit(1.5))).alias("depth"),
    )


def frame_median_depth(points: DataFrame, near: float = 0.3, far: float = 5.0, default: float = 1.5) -> DataFrame:
    usable = points.filter((F.col("depth") > near) & (F.col("depth") < far))
    found = quantiles(usable.select("frame", "depth"), ["frame"], "depth", {"median_depth": 0.5})
    return (
        points.select("frame")
        .distinct()
        .join(found, "frame", "left")
        .select("frame", F.coalesce("median_depth", F.lit(default)).alias("median_depth"))
    )


def observation_confidence(from_box: Column, score: Column) -> Column:
    return F.when(from_box & (score > 80), "hög").when(score > 80, "medium").otherwise("låg")
