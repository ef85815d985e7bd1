"""Already fetched pages to rows: recipe records from JSON-LD, and link lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.quantity import first_number
from aislewise.functions.text import parse_ingredient, strip

_BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _plain(v: Column, path: str) -> Column:
    """String value; null for objects and lists."""
    text = _text(v, path)
    return F.when(~F.regexp_like(text, F.lit(r"^\s*[\[{]")), text)


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _unfold(items: Column) -> Column:
    """Replace lists and @graph holders by what they contain."""
    return F.flatten(
        F.transform(
            items,
            lambda e: F.coalesce(
                _list(e, "$"),
                _list(e, '$["@graph"]'),
                F.when(
                    F.try_variant_get(e, '$["@graph"]', "variant").isNotNull(),
                    F.array(F.try_variant_get(e, '$["@graph"]', "variant")),
                ),
                F.array(e),
            ),
        )
    )


def _is_recipe(e: Column) -> Column:
    kinds = F.try_variant_get(e, '$["@type"]', "array<string>")
    return F.coalesce(_plain(e, '$["@type"]') == "Recipe", F.array_contains(kinds, "Recipe"), F.lit(False))


def _image(o: Column) -> Column:
    options = [_text(o, "$.image.url"), _text(o, '$.image["@id"]'), _text(o, "$.image[0].url")]
    options += [_text(o, '$.image[0]["@id"]'), _plain(o, "$.image[0]"), _plain(o, "$.image")]
    return F.coalesce(*options, F.lit(""))


def _steps(o: Column) -> Column:
    parts = F.transform(
        _list(o, "$.recipeInstructions"),
        lambda s: strip(F.coalesce(_text(s, "$.text"), _text(s, "$.name"), _plain(s, "$"), F.lit(""))),
    )
    single = strip(F.coalesce(_plain(o, "$.recipeInstructions"), F.lit("")))
    return F.filter(F.coalesce(parts, F.array(single)), lambda s: s != "")


def _joined(o: Column, path: str, by: str) -> Column:
    return F.coalesce(F.array_join(F.try_variant_get(o, path, "array<string>"), by), _plain(o, path), F.lit(""))


def page_id(url: Column) -> Column:
    """Digits at the end of the address, else its last path part."""
    digits = F.nullif(F.regexp_extract(url, r"-(\d+)/?$", 1), F.lit(""))
    return F.coalesce(digits, F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1))


def recipes_from_pages(pages: DataFrame) -> DataFrame:
    """One recipe row per page (url, html) with a JSON-LD recipe; unreadable blocks are skipped."""
    blocks = F.transform(
        F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(1)), lambda b: F.try_parse_json(strip(b))
    )
    items = _unfold(_unfold(F.filter(blocks, lambda v: v.isNotNull())))
    rows = pages.withColumn("_o", F.get(F.filter(items, _is_recipe), 0)).filter("_o is not null")
    o = F.col("_o")

    def number(path: str) -> Column:
        return first_number(_text(o, path))

    categories = F.coalesce(
        F.try_variant_get(o, "$.recipeCategory", "array<string>"),
        F.array_compact(F.array(_plain(o, "$.recipeCategory"))),
    )
    lines = F.coalesce(
        F.try_variant_get(o, "$.recipeIngredient", "array<string>"), F.array().cast("array<string>")
    )
    rows = rows.select(
        *[c for c in pages.columns if c != "html"],
        page_id(F.col("url")).alias("recipe_id"),
        strip(F.coalesce(_text(o, "$.name"), F.lit(""))).alias("name"),
        strip(F.coalesce(_text(o, "$.description"), F.lit(""))).alias("description"),
        _image(o).alias("image"),
        number("$.recipeYield").alias("portions"),
        F.coalesce(_text(o, "$.totalTime"), _text(o, "$.cookTime"), F.lit("")).alias("time"),
        number("$.aggregateRating.ratingValue").alias("rating"),
        F.coalesce(number("$.aggregateRating.ratingCount"), F.lit(0.0)).cast("int").alias("n_ratings"),
        categories.alias("categories"),
        _joined(o, "$.keywords", ", ").alias("keywords"),
        F.transform(lines, parse_ingredient).alias("ingredients"),
        _steps(o).alias("steps"),
        F.struct(
            number("$.nutrition.calories").alias("kcal"),
            number("$.nutrition.fatContent").alias("fat"),
            number("$.nutrition.carbohydrateContent").alias("carbs"),
            number("$.nutrition.proteinContent").alias("protein"),
            F.coalesce(number("$.nutrition.sodiumContent"), number("$.nutrition.saltContent")).alias("salt"),
        ).alias("nutrition"),
    )
    tags = F.concat_ws(
        " ",
        F.nullif("name", F.lit("")),
        F.nullif(F.array_join("categories", " "), F.lit("")),
        F.nullif("keywords", F.lit("")),
        F.array_join(F.transform("ingredients", lambda i: i["name"]), " "),
    )
    return rows.withColumn("tags", F.lower(tags))


def page_links(pages: DataFrame, finder: str, keep: str) -> DataFrame:
    """Distinct addresses found by ``finder`` (one group) that match ``keep``, sorted, with their id."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(finder), F.lit(1))).alias("url"))
    wanted = found.select(strip(F.col("url")).alias("url")).filter(F.regexp_like("url", F.lit(keep))).distinct()
    return wanted.withColumn("id", page_id(F.col("url"))).orderBy("url")


def recipes_last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """Append-only record log to one row per key: last record, first position."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(
        F.min(order).alias("position"), F.max_by(F.struct(*rest), order).alias("_r")
    ).select(key, "position", "_r.*")
