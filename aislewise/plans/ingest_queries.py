"""Ingest: record logs, pages with embedded recipes, nested shop answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.plans.views import Registry, sql_round as r, view
from aislewise.session import widen
from aislewise.sources import shop_api as A
from aislewise.sources import web as W

REGISTRY = Registry()
add = REGISTRY.add


@add("recipes_last_wins", f"""select user_id as recipe_id, min(event_id) as position, max_by(event_type, event_id) as name,
     {r('max_by(value, event_id)')} as price from {{events}} group by user_id""")
def recipes_last_wins(spark, sf):
    log = view(spark, sf, "events").select(
        F.col("user_id").alias("recipe_id"), "event_id", F.col("event_type").alias("name"), F.col("value").alias("price")
    )
    return W.recipes_last_wins(log, "recipe_id", "event_id").withColumn("price", rounded("price"))


@add("pages_to_records", """with p as (select *, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '["\\\\]', '', 'g') as title from {pages})
   select page_id, trim(title) as name, cast(200 + page_id % 50 as double) + 0.5e0 as kcal, cast(2 as bigint) as n_ingredients,
     cast(case page_id % 4 when 0 then 1 else 2 end as bigint) as n_steps, 'img' || page_id as image,
     'middag vardag' as categories, 'vetemjöl' as first_ingredient from p where page_id % 4 < 3 or page_id % 8 = 3""")
def pages_to_records(spark, sf):
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r'["\\]', "")
    pid = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    image = (
        F.when(kind == 0, F.concat(F.lit('"img'), pid, F.lit('"')))
        .when(kind == 1, F.concat(F.lit('["img'), pid, F.lit('"]')))
        .otherwise(F.concat(F.lit('{"url": "img'), pid, F.lit('"}')))
    )
    steps = F.when(kind == 0, F.lit('"Koka allt"')).otherwise(F.lit('["Hacka", {"@type": "HowToStep", "text": "Stek"}, " "]'))
    recipe = F.concat(
        F.lit('{"@type": "Recipe", "name": " '), title, F.lit(' ", "image": '), image,
        F.lit(', "recipeCategory": ["Middag", "Vardag"], "recipeIngredient": ["2 1/2 dl vetemjöl", "salt"], "nutrition": {"calories": "'),
        (F.col("page_id") % 50 + 200).cast("string"), F.lit(',5 kcal"}, "recipeInstructions": '), steps, F.lit("}"),
    )
    body = (
        F.when(kind == 0, recipe)
        .when(kind == 1, F.concat(F.lit('[{"@type": "WebPage"}, '), recipe, F.lit("]")))
        .when(kind == 2, F.concat(F.lit('{"@graph": [{"@type": "Person"}, '), recipe, F.lit("]}")))
        .otherwise(F.concat(F.lit("{broken "), recipe))
    )
    script = F.lit('<script type="application/ld+json">')
    second = F.when(F.col("page_id") % 8 == 3, F.concat(script, recipe, F.lit("</script>"))).otherwise("")
    pages = widen(view(spark, sf, "pages")).select(
        "page_id", "url", F.concat("html", script, body, F.lit("</script>"), second).alias("html")
    )
    out = W.recipes_from_pages(pages)
    return out.select(
        "page_id",
        "name",
        F.col("nutrition.kcal").alias("kcal"),
        F.size("ingredients").cast("long").alias("n_ingredients"),
        F.size("steps").cast("long").alias("n_steps"),
        "image",
        F.lower(F.array_join("categories", " ")).alias("categories"),
        F.col("ingredients")[0]["name"].alias("first_ingredient"),
    )


@add("sitemap_urls", """with u as (select distinct trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) as url from {pages})
   select url, case when regexp_matches(url, '-\\d+/?$') then regexp_extract(url, '-(\\d+)/?$', 1)
     else list_last(string_split(regexp_replace(url, '/+$', ''), '/')) end as id from u where regexp_matches(url, '^/[a-zA-Z]') order by url""")
def sitemap_urls(spark, sf):
    return W.page_links(view(spark, sf, "pages"), 'href="([^"]*)"', "^/[a-zA-Z]")


@add("flatten_product_api", """with p as (select p_partkey, case when p_size % 2 = 0 then p_brand || ' ' || p_name else p_name end as own,
     p_brand, p_type, cast(cast(p_retailprice * 100 as bigint) as varchar) as price, p_size from {part}),
   f as (select p_partkey as ord, case when contains(lower(own), lower(p_brand)) then own else p_brand || ' ' || own end as name,
     p_brand as brand, p_type as category, price, cast(p_size as varchar) || ' kr/kg' as unit_price,
     case when p_partkey % 3 = 0 then 'img' || p_partkey else '' end as image from p)
   select regexp_replace(lower(min_by(name, ord)), '[^a-z0-9]', '-', 'g') as id, min_by(name, ord) as name, min_by(brand, ord) as brand,
     min_by(category, ord) as category, 'Mat' as department, min_by(price, ord) as price, min_by(unit_price, ord) as unit_price,
     min_by(image, ord) as image, min(ord) as ord from f group by lower(name)""")
def flatten_product_api(spark, sf):
    def q(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    key = F.col("p_partkey")
    own = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_name"))
    picture = F.when(
        key % 3 == 0, q(', "images": [{"src": "img', key.cast("string"), '"}]')
    ).otherwise("")
    price = (F.col("p_retailprice") * 100).cast("long").cast("string")
    product = q(
        '{"name": " ', own, '", "brand": "', F.col("p_brand"), '", "price": {"amount": "', price,
        '"}, "unitPrice": {"price": {"amount": "', F.col("p_size").cast("string"), '"}, "unit": "fop.price.per.kg"}', picture, "}",
    )
    shape = key % 5
    body = (
        F.when(shape == 0, q('{"products": [', product, "]}"))
        .when(shape == 1, q('{"products": [], "items": [{"name": ""}, ', product, "]}"))
        .when(shape == 2, q('{"pages": [{"products": []}, {"products": [', product, "]}]}"))
        .when(shape == 3, q('{"productGroups": [{"products": [{"product": ', product, "}]}]}"))
        .otherwise(q("[", product, "]"))
    )
    answers = view(spark, sf, "part").select(
        key.alias("ord"), q("Mat > Hylla > ", F.col("p_type")).alias("category_path"), body.alias("body")
    )
    return A.flatten_products(answers).select(
        "id", "name", "brand", "category", "department", "price", "unit_price", "image", "ord"
    )


@add("flatten_category_tree", """select s_suppkey as key, cast(s_suppkey as varchar) as id, r_name || ' > ' || n_name || ' > ' || s_name as path
     from {supplier} join {nation} on n_nationkey = s_nationkey join {region} on r_regionkey = n_regionkey
   union all select s_suppkey, 'n' || n_nationkey, r_name || ' > ' || n_name
     from {supplier} join {nation} on n_nationkey = s_nationkey join {region} on r_regionkey = n_regionkey where s_suppkey % 2 = 0""")
def flatten_category_tree(spark, sf):
    rows = (
        view(spark, sf, "supplier")
        .join(view(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(view(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )

    def q(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    key, nation = F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")
    leaf = q('{"name": " ', F.col("s_name"), ' ", "categoryId": "', key, '", "childCategories": []}')
    twig = q('{"name": "', F.col("n_name"), '", "categoryId": "n', nation, '"}')
    tree = q(
        '{"name": "', F.col("r_name"), '", "categoryId": "r", "childCategories": [{"name": "', F.col("n_name"),
        '", "categoryId": "x", "childCategories": [', leaf, "]}",
        F.when(F.col("s_suppkey") % 2 == 0, q(", ", twig)).otherwise(""), "]}",
    )
    body = F.when(F.col("s_suppkey") % 3 == 0, q("[", tree, "]")).otherwise(q('{"categories": [', tree, "]}"))
    return A.flatten_categories(rows.select(F.col("s_suppkey").alias("key"), body.alias("body")), ("key",))


@add("unit_price_text", """select p_partkey, case when p_size % 3 = 0 then cast(p_size as varchar) || ' kr/kg'
     when p_size % 3 = 1 then cast(p_size as varchar) || ' kr/' else 'jfr ' || cast(p_size as varchar) end as text from {part}""")
def unit_price_text(spark, sf):
    size = F.col("p_size").cast("string")
    body = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"unitPrice": {"price": {"amount": "'), size, F.lit('"}, "unit": "fop.price.per.kg"}}')))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"unitPrice": {"amount": "'), size, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"price": {"comparison": "jfr '), size, F.lit('"}}')))
    )
    rows = view(spark, sf, "part").select("p_partkey", F.from_json(body, A._PRODUCT).alias("p"))
    return rows.select("p_partkey", A.unit_price_text(F.col("p")).alias("text"))


@add("first_image", """select p_partkey, case p_size % 4 when 0 then 'a' || p_partkey when 1 then 'b' || p_partkey
     when 2 then 'images-v3/' || p_partkey || '/300x300.jpg' else '' end as image from {part}""")
def first_image(spark, sf):
    key = F.col("p_partkey").cast("string")
    body = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit('{"image": {"src": "a'), key, F.lit('"}, "images": [{"src": "z"}]}')))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit('{"image": {"src": ""}, "images": [{"src": "b'), key, F.lit('"}]}')))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit('{"imagePaths": ["images-v3/'), key, F.lit('"]}')))
        .otherwise("{}")
    )
    rows = view(spark, sf, "part").select("p_partkey", F.from_json(body, A._PRODUCT).alias("p"))
    return rows.select("p_partkey", A.first_image(F.col("p")).alias("image"))


@add("scan_inventory", """select 'session' as source, cast(session_id as varchar) as scan, n_frames as frames,
     (select count(*) from {flag} f where f.product_id = session_id) as products from {session}
   union all select 'upload', o_orderpriority, count(*), count(*) filter (o_orderstatus = 'F') from {orders} group by 2
   union all select 'map', split_part(url, '/', 3), count(*), 0 from {pages} group by 2""")
def scan_inventory(spark, sf):
    flags = view(spark, sf, "flag").groupBy(F.col("product_id").alias("session_id")).agg(F.count(F.lit(1)).alias("products"))
    sessions = view(spark, sf, "session").join(flags, "session_id", "left").select(
        F.lit("session").alias("source"),
        F.col("session_id").cast("string").alias("scan"),
        F.col("n_frames").alias("frames"),
        F.coalesce("products", F.lit(0)).alias("products"),
    )
    uploads = (
        view(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("scan"))
        .agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("o_orderstatus") == "F").alias("products"))
        .withColumn("source", F.lit("upload"))
    )
    maps = (
        view(spark, sf, "pages")
        .groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("scan"))
        .agg(F.count(F.lit(1)).alias("frames"))
        .withColumn("source", F.lit("map"))
        .withColumn("products", F.lit(0).cast("long"))
    )
    return sessions.unionByName(uploads).unionByName(maps)
