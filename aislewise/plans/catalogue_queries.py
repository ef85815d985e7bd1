"""Catalogue listings, text clean-up and per-row expressions on parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions import text as X
from aislewise.functions.numeric import parse_price, rounded
from aislewise.operators import catalogue as K
from aislewise.plans.views import Registry, sql_round as r, view
from aislewise.session import widen

REGISTRY = Registry()
add = REGISTRY.add


@add("scan_catalogue", f"""select product_id, ord, name, brand, {r('price')} as price, {r('promo_price')} as promo_price
     from {{catalogue}}""")
def scan_catalogue(spark, sf):
    # Prices arrive as comma text in shop files; they are parsed late and tolerantly.
    raw = view(spark, sf, "catalogue").withColumn(
        "price", F.replace(F.col("price").cast("string"), F.lit("."), F.lit(","))
    )
    return raw.select(
        "product_id",
        "ord",
        "name",
        "brand",
        rounded(parse_price(F.col("price"))).alias("price"),
        rounded("promo_price").alias("promo_price"),
    )


FILES_SQL = f"""select cast(product_id as varchar) as product_id, row_number() over (order by product_id) - 1 as ord, name, brand, category,
     {r('price')} as price, {r('promo_price')} as promo_price, lower(category) || ';' || lower(brand) as tags from {{catalogue}}"""


def catalogue_files(spark, sf, kind):
    """The catalogue written as shop files, several of them in the order of ids, and read again."""
    from aislewise.sources.files import CATALOGUE, read_catalogue
    from aislewise.sources.sinks import scratch_path

    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    rows = view(spark, sf, "catalogue").repartitionByRange(5, "product_id").sortWithinPartitions("product_id")
    known = {
        "id": F.col("product_id").cast("string"), "name": F.col("name"), "brand": F.col("brand"), "category": F.col("category"),
        "price": comma("price"), "promo_price": comma("promo_price"),
        "tags": F.concat(F.lower("category"), F.lit(", "), F.lower("brand"), F.lit(",")),
    }
    names = [c.split()[0] for c in CATALOGUE.split(", ")]
    rows = rows.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in names])
    path = scratch_path(spark, f"catalogue-{kind}")
    getattr(rows.write.option("header", True), kind)(path)
    out = read_catalogue(spark, path, kind)
    return out.select(
        "product_id", "ord", "name", "brand", "category", rounded("price").alias("price"),
        rounded("promo_price").alias("promo_price"), F.array_join("tags", ";").alias("tags"),
    )


@add("scan_catalogue_csv", FILES_SQL)
def scan_catalogue_csv(spark, sf):
    return catalogue_files(spark, sf, "csv")


@add("scan_catalogue_parquet", FILES_SQL)
def scan_catalogue_parquet(spark, sf):
    return catalogue_files(spark, sf, "parquet")


@add("catalogue_stats", """select count(*) as n_rows, count(price) as n_priced, count(promo_price) as n_promo,
     (select count(*) from {lineitem} where l_discount > 0) as n_offers from {catalogue}""")
def catalogue_stats(spark, sf):
    offers = view(spark, sf, "lineitem").filter("l_discount > 0").agg(F.count(F.lit(1))).scalar()
    return (
        view(spark, sf, "catalogue")
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_priced"), F.count("promo_price").alias("n_promo")
        )
        .withColumn("n_offers", offers)
    )


@add("compact_list", "select p_partkey as id, p_name as n, p_brand as v, p_type as k, 'img/' || p_partkey as b from {part}")
def compact_list(spark, sf):
    return view(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("n"),
        F.col("p_brand").alias("v"),
        F.col("p_type").alias("k"),
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("b"),
    )


@add("get_by_id", "select p_partkey, p_name, p_brand from {part} where p_partkey = 117")
def get_by_id(spark, sf):
    return view(spark, sf, "part").filter("p_partkey = 117").select("p_partkey", "p_name", "p_brand")


@add("list_products", "select p_partkey, p_name from {part} order by p_name, p_partkey")
def list_products(spark, sf):
    return view(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@add("products_in_category", """select product_id, name from {catalogue} where lower(category) = lower('Promo')
     order by ord limit 10""")
def products_in_category(spark, sf):
    rows = view(spark, sf, "catalogue").filter(F.lower("category") == F.lower(F.lit("Promo")))
    return rows.orderBy("ord").limit(10).select("product_id", "name")


@add("resume_pending", "select doc_id, lang from {documents} where doc_id not in (select doc_id from {labels})")
def resume_pending(spark, sf):
    return view(spark, sf, "documents").select("doc_id", "lang").join(
        view(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti"
    )


@add("set_difference", """select p_partkey from {part} except
     select l_partkey from {lineitem} where l_discount >= 0.05e0 and l_quantity > 40""")
def set_difference(spark, sf):
    used = view(spark, sf, "lineitem").filter("l_discount >= 0.05 and l_quantity > 40").select(
        F.col("l_partkey").alias("p_partkey")
    )
    return view(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@add("distinct_terms", """select distinct lower(split_part(p_name, ' ', 2)) || ' ' || lower(p_type) as term
     from {part} join {lineitem} on l_partkey = p_partkey order by term""")
def distinct_terms(spark, sf):
    used = view(spark, sf, "part").join(
        view(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi"
    )
    term = F.concat_ws(" ", F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lower("p_type"))
    return used.select(term.alias("term")).distinct().orderBy("term")


@add("frame_equi_join", f"""select l_orderkey, l_linenumber, l_partkey, {r('l_quantity * o_totalprice')} as weighted
     from {{lineitem}} join {{orders}} on o_orderkey = l_orderkey""")
def frame_equi_join(spark, sf):
    lines = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = view(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return lines.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("l_quantity") * F.col("o_totalprice")).alias("weighted")
    )


@add("attach_positions", f"""with pos as (select l_partkey as product_id, max_by(l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) as x,
        max(l_suppkey) as aisle from {{lineitem}} where l_returnflag = 'R' group by 1)
     select product_id, name, {r('x')} as x, aisle from {{catalogue}} left join pos using (product_id)""")
def attach_positions(spark, sf):
    placed = (
        view(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .groupBy(F.col("l_partkey").alias("product_id"))
        .agg(
            F.max_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_extendedprice")).alias("x"),
            F.max("l_suppkey").alias("aisle"),
        )
    )
    return view(spark, sf, "catalogue").join(placed, "product_id", "left").select(
        "product_id", "name", rounded("x").alias("x"), "aisle"
    )


@add("enrich_from_catalogue", """with o as (select l_orderkey, l_linenumber, l_partkey,
        case when l_linenumber % 2 = 0 then '' else l_returnflag end as category from {lineitem})
     select l_orderkey, l_linenumber, l_partkey, coalesce(nullif(category, ''), p_type) as category,
        'img/' || p_partkey as image from o left join {part} on p_partkey = l_partkey""")
def enrich_from_catalogue(spark, sf):
    rows = view(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_returnflag")).alias("category"),
    )
    part = view(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    joined = rows.join(part, "l_partkey", "left")
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.coalesce(F.nullif("category", F.lit("")), "p_type").alias("category"),
        F.concat(F.lit("img/"), F.col("l_partkey").cast("string")).alias("image"),
    )


@add("similar_products", """with s as (select a.product_id, b.product_id as similar_id, b.ord,
        50 + case when a.subcategory = b.subcategory then 30 else 0 end
           + case when a.brand = b.brand then 20 else 0 end as score
        from {catalogue} a join {catalogue} b on a.category = b.category and a.product_id <> b.product_id),
     q as (select *, cast(row_number() over (partition by product_id order by score desc, ord) as int) as rank from s)
     select product_id, similar_id, score, rank from q where rank <= 5""")
def similar_products(spark, sf):
    return K.similar_products(view(spark, sf, "catalogue"))


@add("healthier_products", f"""with s as (select a.product_id, b.product_id as better_id, b.ord,
        coalesce(greatest(a.sugar - b.sugar, 0) * 3, 0) + coalesce(greatest(a.fat - b.fat, 0) * 2, 0)
          + coalesce(greatest(a.kcal - b.kcal, 0) / 10e0, 0) as score
        from {{catalogue}} a join {{catalogue}} b on a.category = b.category and a.product_id <> b.product_id),
     q as (select *, cast(row_number() over (partition by product_id order by round(score, 1) desc, ord) as int) as rank
        from s where score > 0)
     select product_id, better_id, {r('score', 1)} as score, rank from q where rank <= 5""")
def healthier_products(spark, sf):
    return K.healthier_products(view(spark, sf, "catalogue")).withColumn("score", rounded("score", 1))


@add("catalogue_tags", """select product_id, lower(category) || ',' || lower(brand) || ',' ||
        case when split_part(name, ' ', 1) = lower(category) then '' else split_part(name, ' ', 1) || ',' end || lower(split_part(name, ' ', 2)) as tags from {catalogue}""")
def catalogue_tags(spark, sf):
    words = F.split(F.lower("name"), " ")
    tags = F.concat(F.array(F.lower("category"), F.lower("brand")), words)
    clean = F.array_distinct(F.filter(F.array_compact(tags), lambda t: F.trim(t) != ""))
    return view(spark, sf, "catalogue").select("product_id", F.array_join(clean, ",").alias("tags"))


@add("guess_aisle", """select product_id, case category when 'PROMO' then 'Kampanj' when 'SMALL' then 'Hylla 1'
     when 'LARGE' then 'Hylla 9' else 'okänd' end as aisle from {catalogue}""")
def guess_aisle(spark, sf):
    aisles = F.create_map(
        *[F.lit(v) for v in ("PROMO", "Kampanj", "SMALL", "Hylla 1", "LARGE", "Hylla 9")]
    )
    return view(spark, sf, "catalogue").select(
        "product_id", F.coalesce(F.try_element_at(aisles, F.col("category")), F.lit("okänd")).alias("aisle")
    )


@add("assortment_lines", """with l as (select category, '- ' || name || ' [' || case when subcategory = 0 then 'Slut'
        else 'I lager' end || ']' as line from {catalogue})
     select category, count(*) as n, md5(string_agg(line, chr(10) order by line)) as digest,
        min(line) as first_line from l group by category""")
def assortment_lines(spark, sf):
    state = F.when(F.col("subcategory") == 0, "Slut").otherwise("I lager")
    line = F.concat(F.lit("- "), "name", F.lit(" ["), state, F.lit("]"))
    # Equal lines are counted, not collected, so a hot category keeps one entry per distinct line.
    counted = view(spark, sf, "catalogue").groupBy("category", line.alias("line")).agg(F.count(F.lit(1)).alias("c"))
    packed = F.array_sort(F.collect_list(F.struct("line", "c")))
    text = F.array_join(F.flatten(F.transform(packed, lambda p: F.array_repeat(p["line"], p["c"].cast("int")))), "\n")
    return counted.groupBy("category").agg(
        F.sum("c").alias("n"), F.md5(text).alias("digest"), F.min("line").alias("first_line")
    )


@add("normalise_sv", """select doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(lower(text),
     'å', 'a'), 'ä', 'a'), 'ö', 'o'), 'é', 'e'), 'ú', 'u'), '^\\s+|\\s+$', '', 'g')) as digest from {documents}""")
def normalise_sv(spark, sf):
    return widen(view(spark, sf, "documents")).select("doc_id", F.md5(X.normalise(F.col("text"))).alias("digest"))


@add("slug", """select doc_id, md5(regexp_replace(regexp_replace(replace(replace(replace(lower(text),
     'å', 'a'), 'ä', 'a'), 'ö', 'o'), '[^\\p{L}\\p{N}]', '-', 'g'), '^-+|-+$', '', 'g')) as digest from {documents}""")
def slug(spark, sf):
    return widen(view(spark, sf, "documents")).select("doc_id", F.md5(X.slug(F.col("text"))).alias("digest"))


@add("clean_label_text", """select p_partkey, case when p_size % 2 = 0
        then upper(p_name[1]) || p_name[2:strpos(p_name, ' ')] || upper(p_name[strpos(p_name, ' ') + 1])
             || p_name[strpos(p_name, ' ') + 2:] else p_name || ' x' end as label from {part}""")
def clean_label_text(spark, sf):
    number = F.col("p_partkey").cast("string")
    shout = F.concat(F.lit("**"), number, F.lit(".  "), F.upper("p_name"), F.lit(" ("), "p_brand", F.lit(")* "))
    calm = F.concat(number, F.lit(". "), "p_name", F.lit("   ("), "p_brand", F.lit(") x"))
    raw = F.when(F.col("p_size") % 2 == 0, shout).otherwise(calm)
    return view(spark, sf, "part").select("p_partkey", X.clean_label(raw).alias("label"))


@add("tokens", """with w as (select doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '),
        lambda x: length(x) > 1) as w from {documents})
     select doc_id, len(w) as n, len(list_distinct(w)) as n_distinct from w""")
def tokens(spark, sf):
    words = widen(view(spark, sf, "documents")).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return words.select(
        "doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct")
    )


@add("normalise_query", """select doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as digest from {documents}""")
def normalise_query(spark, sf):
    return widen(view(spark, sf, "documents")).select("doc_id", F.md5(X.normalise_query(F.col("text"))).alias("digest"))


@add("main_category", "select product_id, lower(category) as main from {catalogue}")
def main_category(spark, sf):
    category = F.concat("category", F.lit(" , "), "brand")
    return view(spark, sf, "catalogue").select("product_id", X.main_category(category).alias("main"))


@add("word_overlap", """select product_id, len(list_intersect(string_split(name || ' ' || lower(category), ' '),
     ['red', 'small', 'gear', 'promo', lower(brand)])) as overlap from {catalogue}""")
def word_overlap(spark, sf):
    words = F.split(F.concat_ws(" ", "name", F.lower("category")), " ")
    other = F.array(*[F.lit(w) for w in ("red", "small", "gear", "promo")], F.lower("brand"))
    return view(spark, sf, "catalogue").select(
        "product_id", F.size(F.array_intersect(words, other)).cast("long").alias("overlap")
    )


@add("parse_price", f"""select o_orderkey, {r('o_totalprice')} as price from {{orders}}""")
def parse_price_query(spark, sf):
    text = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    return view(spark, sf, "orders").select("o_orderkey", rounded(parse_price(text)).alias("price"))


@add("corrected_flag", """select doc_id, lower(string_split(text, chr(10))[1]) <> lower(text) as corrected from {documents}""")
def corrected_flag(spark, sf):
    parts = F.split("text", "\n")
    return view(spark, sf, "documents").select(
        "doc_id", (F.lower(F.get(parts, 0)) != F.lower(F.array_join(parts, "\n"))).alias("corrected")
    )


@add("cache_fresh", """with n as (select max(ts) as now from {events})
     select event_id, epoch_us(now) - epoch_us(ts) < 691200000000 as fresh from {events}, n""")
def cache_fresh(spark, sf):
    events = view(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    now = events.agg(F.max("t")).scalar()
    return events.select("event_id", (now - F.col("t") < 8 * 86400 * 1000000).alias("fresh"))


@add("cache_listing", """select n.n as n_cached, doc_id, md5(text) as query from {documents},
     (select count(*) as n from {documents}) n order by doc_id limit 50""")
def cache_listing(spark, sf):
    docs = view(spark, sf, "documents")
    total = docs.agg(F.count(F.lit(1))).scalar()
    return docs.orderBy("doc_id").limit(50).select(total.alias("n_cached"), "doc_id", F.md5("text").alias("query"))


@add("anchor_points", f"""select n_nationkey as anchor, {r('n_nationkey * 2e0')} as x, {r('n_regionkey * 3e0')} as z from {{nation}}""")
def anchor_points(spark, sf):
    from aislewise.sources.sinks import replace_table, scratch_path

    rows = view(spark, sf, "nation").select(
        F.col("n_nationkey").alias("anchor"),
        rounded(F.col("n_nationkey") * 2.0).alias("x"),
        rounded(F.col("n_regionkey") * 3.0).alias("z"),
    )
    return replace_table(rows, scratch_path(spark, "anchors"))


@add("overwrite_snapshot", f"""select p_type, p_brand, count(*) as n, {r('avg(p_retailprice)')} as price from {{part}} group by all""")
def overwrite_snapshot(spark, sf):
    from aislewise.sources.sinks import replace_table, scratch_path

    rows = view(spark, sf, "part").groupBy("p_type", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("p_retailprice")).alias("price")
    )
    return replace_table(rows, scratch_path(spark, "snapshot"), partition_by=("p_type",))


@add("append_observations", """select map_id, 2 * count(*) as n from {observation} group by map_id""")
def append_observations(spark, sf):
    from aislewise.sources.sinks import append_table, scratch_path

    path = scratch_path(spark, "observations")
    rows = view(spark, sf, "observation").select("map_id", "ord", "name", "x", "y", "z")
    append_table(rows, path, partition_by=("map_id",))
    return append_table(rows, path, partition_by=("map_id",)).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


@add("export_csv", """select l_orderkey, l_partkey, l_quantity from {lineitem} where l_returnflag = 'R'""")
def export_csv(spark, sf):
    from aislewise.sources.sinks import export_csv as op, scratch_path

    rows = view(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")
    return op(rows, scratch_path(spark, "export"))
