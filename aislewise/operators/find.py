"""Customer request to product and walking distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.operators.routes import routes
from aislewise.operators.search import containment_pairs, fuzzy_search
from aislewise.session import cut_lineage


def find_products(
    asks: DataFrame,
    placed: DataFrame,
    walls: DataFrame,
    meta: DataFrame,
    key: str,
    cell: float,
    catalogue: DataFrame | None = None,
    lex: Lexicon | None = None,
) -> DataFrame:
    """Placed product per request, with the route from the customer: its length and way-points.

    The product asked for by id; else the first placed one whose name contains the text; else, with a catalogue and
    a lexicon, the best product of the catalogue search, where it is placed.

    Asks: ask_id, key, product_id (nullable), name, start_x, start_z.
    Placed: key, product_id, name, ord, x, z.
    """
    spot = F.struct("product_id", "x", "z")
    by_id = placed.groupBy(key, "product_id").agg(F.min_by(spot, "ord").alias("_p1"))
    texts = placed.groupBy(key, F.lower("name").alias("text")).agg(F.min(F.struct("ord", spot.alias("s"))).alias("_m"))
    terms = asks.select(F.lower("name").alias("term"))
    named = (
        containment_pairs(terms, texts)
        .join(texts, "text")
        .groupBy(key, "term")
        .agg(F.min("_m").alias("_m"))
        .select(key, F.col("term").alias("_term"), F.col("_m.s").alias("_p2"))
    )
    found = (
        asks.withColumn("_term", F.lower("name"))
        .join(by_id, [key, "product_id"], "left")
        .join(named, [key, "_term"], "left")
        .withColumn("_p", F.when(F.col("product_id").isNotNull(), F.col("_p1")).otherwise(F.col("_p2")))
    )
    if catalogue is not None and lex is not None:
        found = cut_lineage(found)
        open_ = found.filter("_p is null and product_id is null and name is not null")
        words = open_.select(F.col("name").alias("query_id"), F.col("name").alias("query")).distinct()
        hits = fuzzy_search(words, catalogue, lex, n=1).select(F.col("query_id").alias("name"), F.col("product_id").alias("_hit"))
        there = by_id.select(key, F.col("product_id").alias("_hit"), F.col("_p1").alias("_p3"))
        searched = open_.select("ask_id", key, "name").join(hits, "name").join(there, [key, "_hit"]).select("ask_id", "_p3")
        found = found.join(searched, "ask_id", "left").withColumn("_p", F.coalesce("_p", "_p3"))
    walks = routes(
        found.filter("_p is not null").select(
            "ask_id",
            key,
            "start_x",
            "start_z",
            F.col("_p.x").alias("goal_x"),
            F.col("_p.z").alias("goal_z"),
        ),
        walls,
        meta,
        key,
        cell,
    ).select("ask_id", F.col("ok").alias("route_ok"), "length_m", "waypoints")
    return found.join(walks, "ask_id", "left").select(
        "ask_id",
        F.col("_p").isNotNull().alias("found"),
        F.col("_p.product_id").alias("product_id"),
        F.coalesce("route_ok", F.lit(False)).alias("route_ok"),
        "length_m",
        "waypoints",
    )
