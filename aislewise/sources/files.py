"""Catalogue files with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislewise.functions.numeric import parse_price

CATALOGUE = (
    "id string, name string, brand string, category string, department string, price string, unit_price string, "
    "promo_price string, promo_text string, image string, tags string"
)


def with_file_order(raw: DataFrame) -> DataFrame:
    """``raw``, a plain file scan, with ``ord``: the row's place, from 0, by file path and then place in the file.

    A first pass counts the rows of each split; a split's rows then follow those of all splits before it, so ``ord``
    does not depend on how the files are cut.  The table of splits is as small as the list of files.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = raw.select("*", *split, F.monotonically_increasing_id().alias("_id"))
    counts = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_file", "_start", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.join(offsets, ["_file", "_start"]).withColumn("ord", F.col("_id") + F.col("_shift"))
    return placed.select(*raw.columns, "ord")


def read_catalogue(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Catalogue rows with numeric prices, tags as a list and ``ord``, the row's place in the order of the files."""
    if kind == "csv":
        raw = spark.read.schema(CATALOGUE).option("header", True).csv(path)
    elif kind == "json":
        raw = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown catalogue kind: {kind}")
    return with_file_order(raw).select(
        "ord",
        F.col("id").alias("product_id"),
        "name",
        "brand",
        "category",
        "department",
        parse_price(F.col("price")).alias("price"),
        "unit_price",
        parse_price(F.col("promo_price")).alias("promo_price"),
        "promo_text",
        "image",
        F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t != "").alias("tags"),
    )
