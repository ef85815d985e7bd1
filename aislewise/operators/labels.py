"""Shelf-label readings: response text to rows, line statistics and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.text import contains_any, strip

_LINE = "namn string, name string, bbox array<double>, box array<double>"


def parse_label_lines(responses: DataFrame, lex: Lexicon, unknown: str = "OKÄND") -> DataFrame:
    """Rows {line_no, name, bbox} from reader responses (columns response, scale).

    A line is a JSON object with a name and perhaps a box, else plain text that must not be
    a noise phrase or digits only.  Boxes are scaled back and their corners put in order.
    """
    body = strip(F.regexp_replace("response", r"```json|```", ""))
    keep = [c for c in responses.columns if c not in ("response", "scale")]
    lines = (
        responses.withColumn("_body", body)
        .filter((F.col("_body") != "") & ~F.contains(F.upper("_body"), F.lit(unknown)))
        .select(*keep, "scale", F.posexplode(F.split("_body", "\n")).alias("line_no", "_raw"))
        .withColumn("_line", F.regexp_replace(strip(F.col("_raw")), ",+$", ""))
        .withColumn("_o", F.when(F.startswith("_line", F.lit("{")), F.from_json("_line", _LINE)))
    )
    box = F.coalesce("_o.bbox", "_o.box")
    scaled = F.transform(box, lambda v: v / F.col("scale"))
    ordered = F.array(
        F.least(scaled[0], scaled[2]),
        F.least(scaled[1], scaled[3]),
        F.greatest(scaled[0], scaled[2]),
        F.greatest(scaled[1], scaled[3]),
    )
    given = F.nullif(strip(F.coalesce(F.nullif("_o.namn", F.lit("")), "_o.name")), F.lit(""))
    plain = strip(F.regexp_replace(strip(F.regexp_replace("_line", r"^[0-9.\-) ]+", "")), r"[*#]", ""))
    digits = F.regexp_like(F.regexp_replace(plain, r"[ .,:-]", ""), F.lit(r"^\d+$"))
    readable = (plain != "") & ~contains_any(F.lower(plain), lex.label_noise) & ~digits
    return (
        lines.withColumn("name", F.coalesce(given, F.when(readable, plain)))
        .withColumn("bbox", F.when(given.isNotNull() & (F.size(box) == 4), ordered))
        .filter("name is not null")
        .select(*keep, "line_no", "name", "bbox")
    )


def ocr_summary(
    rows: DataFrame, key: str, text: str, confidence: str, order: str, floor: float = 0.30
) -> DataFrame:
    """Usable strings per group, mean confidence of all of them and the longest as fallback."""
    usable = (F.col(confidence) >= floor) & (F.length(text) > 1)
    return rows.groupBy(key).agg(
        F.count_if(usable).alias("kept"),
        F.avg(confidence).alias("mean_confidence"),
        F.max_by(text, F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"))).alias("fallback"),
    )


def quality_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shares, means and the advice they trigger; rows carry brand_matched, corrected, n_tags, confidence."""
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("brand_matched").cast("double")).alias("brand_share"),
        F.avg(F.col("corrected").cast("double")).alias("corrected_share"),
        F.avg("n_tags").alias("mean_tags"),
        F.avg("confidence").alias("mean_confidence"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("brand_share") < 0.5, "brands"),
            F.when(F.col("corrected_share") > 0.45, "corrections"),
            F.when(F.col("mean_confidence") < 0.6, "image"),
            F.when(F.col("mean_tags") < 5, "tags"),
        )
    )
    return stats.withColumn("advice", advice)


_TOOL = "produkter array<struct<id:string>>, alternativ array<struct<id:string>>, liknande array<struct<id:string>>"


def latest_tool_products(turns: DataFrame) -> DataFrame:
    """Last non-empty product list a tool returned in each conversation (columns conv_id, turn, content)."""
    parsed = turns.withColumn("_o", F.from_json("content", _TOOL))
    lists = [F.when(F.size(f"_o.{k}") > 0, F.col(f"_o.{k}")) for k in ("produkter", "alternativ", "liknande")]
    found = parsed.withColumn("_l", F.coalesce(*lists)).filter("_l is not null")
    return found.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("_l", "turn").alias("products"))
