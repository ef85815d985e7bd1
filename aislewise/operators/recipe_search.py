"""Recipes against the catalogue: the match index and the ranked recipe answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.text import search_terms
from aislewise.operators.basket import (
    basket_price,
    candidates_top,
    diversify_round_robin,
    promo_score,
    relax_tiers,
    relevance_score,
    sort_keys,
)
from aislewise.operators.search import fuzzy_search


def match_index(lines: DataFrame, catalogue: DataFrame, lex: Lexicon, n: int = 12) -> DataFrame:
    """Candidate products for every ingredient line (recipe_id, name).

    Each distinct raw name is turned into search terms once, each distinct term searched once,
    and the short candidate lists joined back to the lines.
    """
    names = lines.select("name").distinct().withColumn("term", F.explode(search_terms(F.col("name"), lex)))
    terms = names.select(F.col("term").alias("query_id"), F.col("term").alias("query")).distinct()
    hits = fuzzy_search(terms, catalogue, lex, n=n).withColumnRenamed("query_id", "term")
    scores = names.join(hits, "term").select("name", "product_id", "score")
    top = candidates_top(scores, "name", "product_id", "score", n)
    lists = top.groupBy("name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "product_id", "score"))),
            lambda c: F.struct(c["product_id"].alias("product_id"), c["score"].alias("score")),
        ).alias("candidates")
    )
    return lines.join(lists, "name")


def recipe_filters(
    recipes: DataFrame,
    max_minutes: int | None = None,
    difficulty: str | None = None,
    dessert: bool = False,
    min_kcal: float = 250.0,
) -> DataFrame:
    """Predicate chain before pricing: rows carry has_words, beauty, non_meal, drink, diet_ok,
    kcal, time_min and difficulty columns."""
    keep = F.col("has_words") & ~F.col("beauty") & F.col("diet_ok")
    if not dessert:
        light = F.coalesce(F.col("kcal") < min_kcal, F.lit(False))
        keep = keep & ~F.col("non_meal") & ~F.col("drink") & ~light
    if max_minutes is not None:
        keep = keep & ~F.coalesce(F.col("time_min") > max_minutes, F.lit(False))
    if difficulty is not None:
        keep = keep & (F.col("difficulty") == difficulty)
    return recipes.filter(keep)


def recipe_search(
    recipes: DataFrame,
    lines: DataFrame,
    mode: str = "kampanj",
    n: int = 15,
    required_words: bool = False,
    keyword_hits: Column | None = None,
    dessert: bool = False,
) -> DataFrame:
    """Price, score, gate, sort and spread already filtered recipes; lines come back nested.

    Recipes: recipe_id, source, rating, n_ratings, kcal, time_min, protein.
    Lines: recipe_id, ord, product_id, regular, promo, used_share.
    """
    priced = basket_price(lines.join(recipes.select("recipe_id"), "recipe_id", "left_semi")).filter("n_priced > 0")
    rows = priced.join(recipes, "recipe_id")
    saving = F.col("weighted_saving")
    kcal = F.lit(0.0) if dessert else F.col("kcal")
    rows = rows.withColumn(
        "promo_score",
        promo_score(saving, F.col("regular_total"), F.col("n_promo"), F.col("n_priced"), F.col("total")),
    ).withColumn(
        "relevance",
        relevance_score(
            F.lit(0) if keyword_hits is None else keyword_hits,
            F.col("rating"),
            F.col("n_ratings"),
            kcal,
            F.col("n_promo"),
            saving,
        ),
    )
    if mode == "billigt":
        rows = rows.filter("total > 0")
    elif mode == "kampanj":
        rows = relax_tiers(rows, n)
    first, second = sort_keys(F.lit(mode))
    rows = rows.withColumn("_k1", first).withColumn("_k2", second)
    order = ["_k1", "_k2", "recipe_id"]
    if required_words:
        top = rows.orderBy(*order).limit(n).withColumn("round", F.lit(1))
    else:
        top = diversify_round_robin(rows, "source", order, n)
    nested = (
        lines.join(F.broadcast(top.select("recipe_id")), "recipe_id")
        .groupBy("recipe_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "product_id", "regular", "promo"))).alias("lines"))
    )
    return top.drop("_k1", "_k2").join(nested, "recipe_id", "left")
