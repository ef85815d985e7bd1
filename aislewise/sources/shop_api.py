"""Nested shop answers to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.text import slug, strip
from aislewise.session import cut_lineage

_PRODUCT = """name string, title string, brand string, brandName string,
  price struct<amount:string,current:string,price:string,comparison:string>,
  unitPrice struct<price:struct<amount:string>,amount:string,unit:string>, promoPrice struct<amount:string>,
  promotions array<struct<description:string>>, image struct<src:string>, images array<struct<src:string>>,
  imagePaths array<string>"""


def _split_fields(text: str) -> list[str]:
    """Split at commas outside angle brackets."""
    depth, start, out = 0, 0, []
    for i, ch in enumerate(text + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return out


def _fields() -> list[tuple[str, str]]:
    return [tuple(f.split(None, 1)) for f in _split_fields(_PRODUCT.replace("\n", " "))]


def _field_list() -> str:
    """The product fields in struct<> spelling."""
    return ",".join(f"{name}:{kind.strip()}" for name, kind in _fields())


def _answer_schema() -> str:
    p = f"struct<{_field_list()}>"
    wrapped = f"struct<product:{p},{_field_list()}>"
    return (
        f"products array<{p}>, items array<{p}>, pages array<struct<products:array<{p}>>>, "
        f"productGroups array<struct<products:array<{wrapped}>,items:array<{wrapped}>>>"
    )


def _filled(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def unit_price_text(p: Column) -> Column:
    """'12.50 kr/kg' from the nested unit price, else the comparison text."""
    amount = F.nullif(F.coalesce(p["unitPrice"]["price"]["amount"], p["unitPrice"]["amount"]), F.lit(""))
    unit = F.coalesce(F.element_at(F.split(p["unitPrice"]["unit"], r"\."), -1), F.lit(""))
    return F.coalesce(F.concat(amount, F.lit(" kr/"), unit), p["price"]["comparison"], F.lit(""))


def first_image(p: Column) -> Column:
    path = F.get(p["imagePaths"], 0)
    sized = F.when(F.contains(path, F.lit("images-v3")), F.concat(path, F.lit("/300x300.jpg"))).otherwise(path)
    return F.coalesce(
        F.nullif(p["image"]["src"], F.lit("")), F.nullif(F.get(p["images"], 0)["src"], F.lit("")), sized, F.lit("")
    )


def flatten_products(answers: DataFrame, order: str = "ord") -> DataFrame:
    """Product rows from raw answers (ord, category_path, body); the first of equal ids stays."""
    body = F.when(F.startswith(F.trim("body"), F.lit("[")), F.concat(F.lit('{"products":'), "body", F.lit("}")))
    rows = answers.withColumn("_a", F.from_json(F.coalesce(body, F.col("body")), _answer_schema()))
    paged = F.flatten(F.transform("_a.pages", lambda g: F.coalesce(g["products"], F.array().cast(_array()))))

    def unwrap(item: Column) -> Column:
        own = F.struct(*[item[n].alias(n) for n in _names()])
        return F.coalesce(item["product"], own)

    grouped = F.flatten(
        F.transform("_a.productGroups", lambda g: F.transform(F.coalesce(_filled(g["products"]), g["items"]), unwrap))
    )
    products = F.coalesce(_filled(F.col("_a.products")), _filled(F.col("_a.items")), _filled(paged), grouped)
    opened = rows.select(order, "category_path", F.posexplode(products).alias("_pos", "_p"))
    p = F.col("_p")
    name = strip(F.coalesce(F.nullif(p["name"], F.lit("")), p["title"], F.lit("")))
    brand = strip(F.coalesce(F.nullif(p["brand"], F.lit("")), p["brandName"], F.lit("")))
    parts = F.split("category_path", " > ")
    flat = opened.withColumn("_name", name).withColumn("brand", brand).filter("_name <> ''")
    full = F.when(
        (F.col("brand") != "") & ~F.contains(F.lower("_name"), F.lower("brand")), F.concat_ws(" ", "brand", "_name")
    ).otherwise(F.col("_name"))
    price = p["price"]
    flat = flat.select(
        order,
        "_pos",
        full.alias("name"),
        "brand",
        F.element_at(parts, -1).alias("category"),
        F.get(parts, 0).alias("department"),
        F.coalesce(F.nullif(price["amount"], F.lit("")), price["current"], price["price"], F.lit("")).alias("price"),
        unit_price_text(p).alias("unit_price"),
        F.coalesce(p["promoPrice"]["amount"], F.lit("")).alias("promo_price"),
        strip(F.coalesce(F.get(p["promotions"], 0)["description"], F.lit(""))).alias("promo_text"),
        first_image(p).alias("image"),
        F.array_distinct(
            F.filter(
                F.array(F.lower(F.element_at(parts, -1)), F.lower("brand"), F.lower("_name")), lambda t: t != ""
            )
        ).alias("tags"),
    ).withColumn("id", slug(F.col("name")))
    keep = [c for c in flat.columns if c not in ("id", "_pos")]
    return (
        flat.groupBy("id")
        .agg(F.min_by(F.struct(*keep), F.struct(order, "_pos")).alias("_first"))
        .select("id", "_first.*")
    )


def _names() -> list[str]:
    return [name for name, _ in _fields()]


def _array() -> str:
    return f"array<struct<{_field_list()}>>"


_NODE = "struct<name:string,categoryId:string,childCategories:array<string>>"


def flatten_categories(answers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Leaf categories (keys, id, path 'A > B > C') of nested answers (body), of any depth.

    Children stay JSON text until their level is read, so the loop ends when no node has any.
    """
    body = F.when(F.startswith(F.trim("body"), F.lit("[")), F.concat(F.lit('{"categories":'), "body", F.lit("}")))
    wrapped = F.coalesce(
        body,
        F.when(F.regexp_like("body", F.lit(r'^\s*\{\s*"categories"')), F.col("body")),
        F.concat(F.lit('{"categories":['), "body", F.lit("]}")),
    )
    texts = F.from_json(wrapped, "categories array<string>")["categories"]
    level = answers.select(*keys, F.explode(texts).alias("_text"), F.lit("").alias("_up"))
    out = None
    while True:
        name = strip(F.coalesce("_n.name", F.lit("")))
        path = F.when(F.col("_up") == "", name).otherwise(F.concat_ws(" > ", "_up", name))
        level = level.withColumn("_n", F.from_json("_text", _NODE)).withColumn("_path", path)
        level = cut_lineage(level.drop("_text", "_up"))
        childless = F.coalesce(F.size("_n.childCategories") <= 0, F.lit(True))
        named = (F.coalesce("_n.name", F.lit("")) != "") & (F.coalesce("_n.categoryId", F.lit("")) != "")
        leaves = level.filter(childless & named).select(*keys, F.col("_n.categoryId").alias("id"), F.col("_path").alias("path"))
        out = leaves if out is None else out.unionByName(leaves)
        level = level.select(*keys, F.explode("_n.childCategories").alias("_text"), F.col("_path").alias("_up"))
        if level.isEmpty():
            return out
