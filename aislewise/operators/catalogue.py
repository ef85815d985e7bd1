"""Look-ups and relations inside the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.operators.frontier import BLOCK, best_against, frontier
from aislewise.operators.ordered import top_per_group


def similar_products(catalogue: DataFrame, n: int = 5) -> DataFrame:
    """Same category, not itself: 50, +30 same subcategory, +20 same brand; first ``n``.

    The score has four levels, each a coarser grouping.  The first ``n`` + 1 products (by
    catalogue order) of every grouping are enough to fill any product's list, so products
    join those short lists instead of each other.
    """
    rows = catalogue.select("product_id", "ord", "category", "subcategory", "brand")
    levels = (
        ("category", "subcategory", "brand"),
        ("category", "subcategory"),
        ("category", "brand"),
        ("category",),
    )
    offers = rows
    for i, keys in enumerate(levels):
        heads = top_per_group(rows, list(keys), ["ord"], n + 1)
        lists = heads.groupBy(*keys).agg(
            F.collect_list(F.struct("product_id", "ord", "subcategory", "brand")).alias(f"_l{i}")
        )
        offers = offers.join(lists, list(keys), "left")
    every = F.array_distinct(
        F.flatten(F.array(*[F.coalesce(f"_l{i}", F.array().cast(offers.schema[f"_l{i}"].dataType)) for i in range(4)]))
    )
    scored = F.transform(
        F.filter(every, lambda o: o["product_id"] != F.col("product_id")),
        lambda o: F.struct(
            (
                F.lit(-50)
                - F.when(o["subcategory"] == F.col("subcategory"), 30).otherwise(0)
                - F.when(o["brand"] == F.col("brand"), 20).otherwise(0)
            ).alias("down"),
            o["ord"].alias("ord"),
            o["product_id"].alias("id"),
        ),
    )
    best = F.slice(F.array_sort(scored), 1, n)
    return offers.select("product_id", F.posexplode(best).alias("_pos", "_o")).select(
        "product_id",
        F.col("_o.id").alias("similar_id"),
        (-F.col("_o.down")).alias("score"),
        (F.col("_pos") + 1).alias("rank"),
    )


def healthier_products(catalogue: DataFrame, n: int = 5, block: int = BLOCK) -> DataFrame:
    """Same category and better: 3 per gram sugar, 2 per gram fat, 0.1 per kcal less, counted
    only where better; first ``n``.

    Only products beaten on all three values by fewer than ``n`` others of the category can
    appear in a list, so the catalogue is first reduced to those (``frontier``) and products
    then look at the reduced set, one distinct value triple at a time.
    """
    axes = ["sugar", "fat", "kcal"]
    rows = catalogue.select("product_id", "ord", "category", *[F.col(a).cast("double").alias(a) for a in axes])
    offers = frontier(rows, "category", axes, n, block)
    asks = rows.filter(" or ".join(f"{a} is not null" for a in axes)).groupBy("category", *axes).agg(
        F.min("product_id").alias("ask_id")
    )
    found = best_against(asks, offers, "category", axes, (3.0, 2.0, 0.1), n, block)
    same = [rows[a].eqNullSafe(asks[a]) for a in axes]
    members = rows.join(asks, [rows["category"] == asks["category"], *same]).select(rows["product_id"], "ask_id")
    return members.join(found, "ask_id").select("product_id", "better_id", "score", "rank")
