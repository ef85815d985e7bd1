"""Baskets priced against promotions: orders are recipes, lines are ingredients."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.numeric import rounded
from aislewise.functions.text import INFLECTIONS
from aislewise.operators import basket as B
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add

PRICE_SQL = f"""
    select recipe_id, coalesce(sum(coalesce(promo, regular)), 0e0) as total,
           coalesce(sum(regular), 0e0) as regular_total, count(promo) as n_promo,
           count(coalesce(promo, regular)) as n_priced,
           coalesce(sum(case when promo is not null
                        then greatest(regular - promo, 0e0) * used_share end), 0e0) as weighted_saving
    from {{ingredient}} group by recipe_id"""

SCORE_SQL = """
    select p.*, case when regular_total <= 0 then 0e0 else
           weighted_saving / regular_total * 60 + n_promo / cast(greatest(n_priced, 3) as double) * 25
           + least(n_promo, 5) * 5 + least(weighted_saving, 60e0) * 0.4e0 - least(total, 250e0) * 0.03e0
           end as promo_score
    from price p"""

REL_SQL = """
    select s.*, q.source, q.time_min, q.kcal, q.rating,
           (case when q.source like '%HIGH%' then 10 else 0 end) + q.rating * 2
           + least(q.n_ratings, 200) * 0.02e0 + case when coalesce(q.kcal, 0) >= 350 then 6e0 else 0e0 end
           + least(n_promo, 5) * 3 + least(weighted_saving, 50e0) * 0.4e0 as relevance
    from score s join {recipe} q using (recipe_id)"""


def priced(spark, sf):
    return B.basket_price(view(spark, sf, "ingredient"))


def with_promo_score(df):
    return df.withColumn(
        "promo_score",
        B.promo_score(
            F.col("weighted_saving"), F.col("regular_total"), F.col("n_promo"), F.col("n_priced"), F.col("total")
        ),
    )


def scored(spark, sf):
    recipes = view(spark, sf, "recipe")
    rows = with_promo_score(priced(spark, sf)).join(recipes, "recipe_id")
    hits = F.when(F.contains("source", F.lit("HIGH")), 1).otherwise(0)
    return rows.withColumn(
        "relevance",
        B.relevance_score(
            hits, F.col("rating"), F.col("n_ratings"), F.col("kcal"), F.col("n_promo"), F.col("weighted_saving")
        ),
    )


@add(
    "basket_price",
    f"""with price as ({PRICE_SQL})
    select recipe_id, {r('total')} as total, {r('regular_total')} as regular_total,
           {r('regular_total - total')} as saving, n_promo, n_priced,
           {r('weighted_saving')} as weighted_saving from price""",
)
def basket_price(spark, sf):
    return priced(spark, sf).select(
        "recipe_id",
        rounded("total").alias("total"),
        rounded("regular_total").alias("regular_total"),
        rounded("saving").alias("saving"),
        "n_promo",
        "n_priced",
        rounded("weighted_saving").alias("weighted_saving"),
    )


@add("promo_score", f"with price as ({PRICE_SQL}), score as ({SCORE_SQL}) "
     f"select recipe_id, {r('promo_score')} as promo_score from score")
def promo_score(spark, sf):
    return with_promo_score(priced(spark, sf)).select("recipe_id", rounded("promo_score").alias("promo_score"))


@add("relevance_score", f"with price as ({PRICE_SQL}), score as ({SCORE_SQL}), rel as ({REL_SQL}) "
     f"select recipe_id, {r('relevance')} as relevance from rel")
def relevance_score(spark, sf):
    return scored(spark, sf).select("recipe_id", rounded("relevance").alias("relevance"))


TIER_SQL = f"""with price as ({PRICE_SQL}), score as ({SCORE_SQL}),
    base as (select *, weighted_saving / regular_total as share from score
             where total > 0 and n_priced >= 3 and regular_total > 0),
    counts as (select count(*) filter (n_promo >= 3 and share >= 0.1e0) as t0,
                      count(*) filter (n_promo >= 2 and share >= 0.1e0) as t1,
                      count(*) filter (n_promo >= 1 and share >= 0.1e0) as t2 from base),
    pick as (select case when t0 >= WANTED then 0 when t1 >= WANTED then 1
                         when t2 >= WANTED then 2 else 3 end as tier from counts),
    kept as (select base.*, tier from base, pick
             where (tier = 0 and n_promo >= 3 and share >= 0.1e0)
                or (tier = 1 and n_promo >= 2 and share >= 0.1e0)
                or (tier = 2 and n_promo >= 1 and share >= 0.1e0)
                or (tier = 3 and n_promo >= 1))"""


@add("relax_tiers", TIER_SQL.replace("WANTED", "1500") + " select recipe_id, tier, n_promo from kept")
def relax_tiers(spark, sf):
    return B.relax_tiers(with_promo_score(priced(spark, sf)), 1500).select("recipe_id", "tier", "n_promo")


@add("best_deals", TIER_SQL.replace("WANTED", "15") + f""" select recipe_id, {r('total')} as total,
     {r('weighted_saving')} as weighted_saving, n_promo, {r('promo_score')} as promo_score
     from kept order by kept.promo_score desc, recipe_id limit 15""")
def best_deals(spark, sf):
    kept = B.relax_tiers(with_promo_score(priced(spark, sf)), 15)
    return (
        kept.orderBy(F.desc("promo_score"), "recipe_id")
        .limit(15)
        .select(
            "recipe_id",
            rounded("total").alias("total"),
            rounded("weighted_saving").alias("weighted_saving"),
            "n_promo",
            rounded("promo_score").alias("promo_score"),
        )
    )


@add("top_n_order", "select recipe_id, rating, n_ratings from {recipe} order by rating desc, recipe_id limit 25")
def top_n_order(spark, sf):
    return (
        view(spark, sf, "recipe")
        .select("recipe_id", "rating", "n_ratings")
        .orderBy(F.desc("rating"), "recipe_id")
        .limit(25)
    )


@add("time_band", """select recipe_id, case when time_min is null then 9 when time_min <= 20 then 0
     when time_min <= 35 then 1 when time_min <= 50 then 2 else 3 end as band from {recipe}""")
def time_band(spark, sf):
    return view(spark, sf, "recipe").select("recipe_id", B.time_band(F.col("time_min")).alias("band"))


@add("difficulty", """with n as (select recipe_id, count(*) as lines, count(distinct supplier) as steps
       from {ingredient} group by recipe_id)
     select recipe_id, case when steps + lines * 0.4e0 + coalesce(time_min, 0) / 12e0 <= 9 then 'enkelt'
       when steps + lines * 0.4e0 + coalesce(time_min, 0) / 12e0 <= 16 then 'medel' else 'avancerat' end as level
     from n join {recipe} using (recipe_id)""")
def difficulty(spark, sf):
    lines = (
        view(spark, sf, "ingredient")
        .groupBy("recipe_id")
        .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("supplier").alias("steps"))
    )
    return lines.join(view(spark, sf, "recipe"), "recipe_id").select(
        "recipe_id", B.difficulty(F.col("steps"), F.col("lines"), F.col("time_min")).alias("level")
    )


@add("sort_modes", f"""with price as ({PRICE_SQL}), score as ({SCORE_SQL}), rel as ({REL_SQL}),
    keyed as (select mode, recipe_id,
        case mode when 'billigt' then -(weighted_saving + least(n_promo, 5) * 6)
                  when 'kampanj' then -promo_score when 'protein' then -coalesce(rating, 0)
                  when 'snabbt' then cast(case when time_min is null then 9 when time_min <= 20 then 0
                       when time_min <= 35 then 1 when time_min <= 50 then 2 else 3 end as double)
                  else -relevance end as k1,
        case mode when 'billigt' then total when 'snabbt' then -relevance
                  when 'kampanj' then 0 when 'protein' then 0 else -weighted_saving end as k2
      from rel, (select unnest(['billigt', 'kampanj', 'protein', 'snabbt', 'relevans']) as mode)),
    ranked as (select mode, recipe_id,
        cast(row_number() over (partition by mode order by k1, k2, recipe_id) as int) as rank from keyed)
    select * from ranked where rank <= 15""")
def sort_modes(spark, sf):
    rows = scored(spark, sf).withColumn("protein", F.col("rating"))
    return B.top_by_mode(rows, 15).select("mode", "recipe_id", "rank")


@add("diversify_round_robin", f"""with price as ({PRICE_SQL}), score as ({SCORE_SQL}), rel as ({REL_SQL}),
    ranked as (select source, recipe_id, relevance,
        cast(row_number() over (partition by source order by relevance desc, recipe_id) as int) as round from rel)
    select source, recipe_id, round from ranked order by round, relevance desc, recipe_id limit 15""")
def diversify_round_robin(spark, sf):
    return B.diversify_round_robin(scored(spark, sf), "source", [F.desc("relevance"), F.col("recipe_id")], 15).select(
        "source", "recipe_id", "round"
    )


@add("diversify_cap", """with hits as (select l_suppkey as query, l_partkey as item, p_type as category,
        l_quantity as score from {lineitem} join {part} on p_partkey = l_partkey),
    u as (select *, row_number() over (partition by query, item order by score desc, item) as a from hits),
    c as (select *, row_number() over (partition by query, category order by score desc, item) as b from u where a = 1),
    t as (select *, cast(row_number() over (partition by query order by score desc, item) as int) as rank
          from c where b <= 5)
    select query, item, score, rank from t where rank <= 12""")
def diversify_cap(spark, sf):
    lines, part = view(spark, sf, "lineitem"), view(spark, sf, "part")
    hits = lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("query"),
        F.col("l_partkey").alias("item"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").alias("score"),
    )
    return B.diversify_cap(hits, "query", "item", "category", [F.desc("score"), F.col("item")], 12).select(
        "query", "item", "score", "rank"
    )


@add("candidates_top12", """with best as (select l_suppkey as key, l_partkey as product_id, max(l_quantity) as score
      from {lineitem} group by 1, 2),
    ranked as (select *, cast(row_number() over (partition by key order by score desc, product_id) as int) as rank
      from best)
    select * from ranked where rank <= 12""")
def candidates_top12(spark, sf):
    rows = view(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("score")
    )
    return B.candidates_top(rows, "key", "product_id", "score")


@add("unique_ingredients", """with named as (select i.*, lower(c.name) as clean
       from {ingredient} i join {catalogue} c using (product_id))
     select recipe_id, clean, min(ord) as ord from named group by recipe_id, clean""")
def unique_ingredients(spark, sf):
    lines = (
        view(spark, sf, "ingredient")
        .join(view(spark, sf, "catalogue").select("product_id", "name"), "product_id")
        .select("recipe_id", "ord", F.lower("name").alias("clean"))
    )
    return B.unique_ingredients(lines, "recipe_id", F.col("clean"), ["ord"]).select("recipe_id", "clean", "ord")


CAND_SQL = """select recipe_id as key, product_id, i.ord, 50e0 + used_share * 25e0 as score,
        cast(line % 3 as int) as coverage, cast(supplier % 4 as int) as head,
        coalesce(regular - promo, 0e0) as saving, c.category = 'PROMO' as organic,
        c.subcategory <> 4 as valid
    from {ingredient} i join {catalogue} c using (product_id)"""


def candidates(spark, sf):
    lines = view(spark, sf, "ingredient")
    products = view(spark, sf, "catalogue").select("product_id", "category", "subcategory")
    return lines.join(products, "product_id").select(
        F.col("recipe_id").alias("key"),
        "product_id",
        "ord",
        (F.lit(50.0) + F.col("used_share") * 25.0).alias("score"),
        (F.col("line") % 3).cast("int").alias("coverage"),
        (F.col("supplier") % 4).cast("int").alias("head"),
        F.coalesce(F.col("regular") - F.col("promo"), F.lit(0.0)).alias("saving"),
        (F.col("category") == "PROMO").alias("organic"),
        (F.col("subcategory") != 4).alias("valid"),
    )


@add("choose_candidate", f"""with cand as ({CAND_SQL}), good as (select * from cand where valid and score >= 55),
    eco as (select key, bool_or(organic) as any_organic from good group by key),
    kept as (select good.* from good join eco using (key) where not any_organic or organic),
    ranked as (select *, row_number() over (partition by key
                 order by coverage desc, head desc, score desc, ord) as rn from kept),
    best as (select key, coverage as bc, head as bh, score as bs from ranked
             where rn = 1 and not (coverage = 0 and head <= 1 and score < 78)),
    near as (select kept.*, row_number() over (partition by key order by saving desc, score desc, ord) as pick
             from kept join best using (key) where coverage = bc and head = bh and score >= bs - 8)
    select key, product_id, {r('score')} as score, {r('saving')} as saving from near where pick = 1""")
def choose_candidate(spark, sf):
    return B.choose_candidate(candidates(spark, sf), "key", organic_wanted=True).select(
        "key", "product_id", rounded("score").alias("score"), rounded("saving").alias("saving")
    )


@add("prefer_promo_near_best", """with hits as (select brand as key, product_id, ord, promo_price,
        cast(coalesce(sugar, 0) + fat % 7 as double) as score from {catalogue} where fat is not null),
    best as (select key, max(score) as top from hits group by key),
    ranked as (select hits.*, row_number() over (partition by hits.key order by
        case when promo_price is not null and score >= top - 8 then 0 else 1 end, score desc, ord) as rn
        from hits join best on hits.key = best.key)
    select key, product_id from ranked where rn = 1""")
def prefer_promo_near_best(spark, sf):
    hits = (
        view(spark, sf, "catalogue")
        .filter("fat is not null")
        .select(
            F.col("brand").alias("key"),
            "product_id",
            "ord",
            "promo_price",
            (F.coalesce("sugar", F.lit(0)) + F.col("fat") % 7).cast("double").alias("score"),
        )
    )
    return B.prefer_promo_near_best(hits, "key")


# Products get words the gates look at; ingredients are a product's second word, alone or changed.
SWAP_NAME = """{n} || case when {i} % 11 = 0 then ' kyckling' when {i} % 13 = 0 then ' kaka' when {i} % 7 = 0 then ' krav'
     when {i} % 17 = 0 then ' schalottenlök' else '' end"""
SWAP_ASK = """case {s} % 4 when 0 then {h} when 1 then 'färsk ' || {h} when 2 then {h} || ' kaka' else 'bananschalottenlökar' end"""
SWAP_DIET = "case {s} % 3 when 1 then 'vegetariskt' when 2 then 'veganskt' end"
_ENDINGS = "[" + ", ".join(f"'{e}'" for e in INFLECTIONS) + "]"


def _named(words: str, head: str) -> str:
    return f"""(list_contains({words}, {head}) or len(list_filter({words}, lambda w: length(w) >= 6 and
        len(list_filter({_ENDINGS}, lambda e: length({head}) > length(w) + length(e) and ends_with({head}, w || e))) > 0)) > 0)"""


@add("promo_swap", f"""with c as (select *, {SWAP_NAME.format(n='name', i='product_id')} as nm from {{catalogue}}),
    lines as (select recipe_id * 1000000000000 + i.ord as line_id, product_id, category,
            {SWAP_ASK.format(s='supplier', h="split_part(name, ' ', 2)")} as ingredient,
            {SWAP_DIET.format(s='supplier')} as diet, supplier % 5 = 0 as organic
        from {{ingredient}} i join {{catalogue}} c using (product_id)),
    keys as (select distinct product_id, category, ingredient, diet, organic,
                 list_last(string_split(ingredient, ' ')) as head, string_split(ingredient, ' ') as asked from lines),
    free as (select k.*, k.category in ('SMALL', 'LARGE') and {_named("string_split(c.nm, ' ')", "k.head")} as free
        from keys k join c using (product_id)),
    promos as (select product_id as swap_id, ord, category, nm, string_split(nm, ' ') as words, price - promo_price as saving
               from c where promo_price is not null),
    offers as (select k.product_id, k.ingredient, k.diet, k.organic, p.swap_id, p.saving,
            row_number() over (partition by k.product_id, k.ingredient, k.diet, k.organic order by p.saving desc, p.ord) as rn
        from free k join promos p on p.category = k.category and p.swap_id <> k.product_id
        where (k.free or {_named("p.words", "k.head")})
          and (k.diet is null or not contains(p.nm, 'kyckling')) and (not k.organic or contains(p.nm, 'krav'))
          and (not contains(p.nm, 'kaka') or contains(k.ingredient, 'kaka')
               or (list_has_all(p.words, k.asked) and list_contains(k.asked, p.words[1])))),
    own as (select product_id, coalesce(price - promo_price, 0e0) as own_saving from {{catalogue}})
    select distinct l.line_id, case when b.saving > own_saving then b.swap_id else l.product_id end as product_id,
        {r("case when b.saving > own_saving then b.saving else own_saving end")} as saving,
        coalesce(b.saving > own_saving, false) as swapped
    from lines l join own using (product_id)
    left join offers b on b.rn = 1 and b.product_id = l.product_id and b.ingredient = l.ingredient
        and b.diet is not distinct from l.diet and b.organic = l.organic""")
def promo_swap(spark, sf):
    catalogue = view(spark, sf, "catalogue")
    second = "split_part(name, ' ', 2)"
    chosen = (
        view(spark, sf, "ingredient")
        .join(catalogue.select("product_id", "category", "name"), "product_id")
        .select(
            (F.col("recipe_id") * 1000000000000 + F.col("ord")).alias("line_id"),
            "product_id",
            "category",
            F.expr(SWAP_ASK.format(s="supplier", h=second)).alias("ingredient"),
            F.expr(SWAP_DIET.format(s="supplier")).alias("diet"),
            (F.col("supplier") % 5 == 0).alias("organic"),
        )
    )
    named = catalogue.withColumn("name", F.expr(SWAP_NAME.format(n="name", i="product_id")))
    out = B.promo_swap(chosen, named, F.col("category").isin("SMALL", "LARGE"))
    return out.withColumn("saving", rounded("saving")).distinct()


@add("main_ingredient_image", """with lines as (select recipe_id, i.ord, name,
          case when subcategory > 0 then 'img/' || cast(product_id as varchar) end as image,
          case recipe_id % 3 when 0 then 'bolt' when 1 then 'gear' else '' end as main
        from {ingredient} i join {catalogue} c using (product_id))
     select recipe_id, coalesce(min_by(image, ord) filter (image is not null and main <> '' and contains(name, main)),
                                min_by(image, ord) filter (image is not null)) as image
     from lines group by recipe_id""")
def main_ingredient_image(spark, sf):
    products = view(spark, sf, "catalogue").select("product_id", "name", "subcategory")
    lines = (
        view(spark, sf, "ingredient")
        .join(products, "product_id")
        .withColumn("image", F.when(F.col("subcategory") > 0, F.concat(F.lit("img/"), F.col("product_id").cast("string"))))
    )
    main = (
        F.when(F.col("recipe_id") % 3 == 0, "bolt").when(F.col("recipe_id") % 3 == 1, "gear").otherwise("")
    )
    return B.first_image(lines, "recipe_id", main)


@add("promo_products", """select l_orderkey, l_linenumber, l_partkey, l_discount from {lineitem}
     where l_discount > 0 order by l_orderkey, l_linenumber, l_partkey, l_discount limit 80""")
def promo_products(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"]
    return view(spark, sf, "lineitem").filter("l_discount > 0").select(*order).orderBy(*order).limit(80)


SLICES_SQL = """pool as (select * from {catalogue} where promo_price is not null order by price - promo_price desc, ord limit 600),
     p as (select *, row_number() over (order by md5('11:' || product_id), product_id) - 1 as p from pool),
     q as (select *, cast(p % 7 as int) as slice, cast(p // 7 as int) as place from p where p < 7 * 40)"""


def promo_pool(spark, sf):
    """The promotions that save most, shuffled and dealt to seven themes."""
    promos = view(spark, sf, "catalogue").filter("promo_price is not null")
    pool = promos.orderBy((F.col("price") - F.col("promo_price")).desc(), "ord").limit(600)
    return B.deal_slices(pool, "product_id", slices=7, each=40, seed=11)


@add("promo_slices", f"with {SLICES_SQL} select product_id, slice, place from q")
def promo_slices(spark, sf):
    return promo_pool(spark, sf).select("product_id", "slice", "place")


@add("theme_context_lines", f"""with {SLICES_SQL}
     select slice, string_agg('- ' || name || ': ' || cast(cast(round(promo_price) as bigint) as varchar) || ' kr'
            || case when subcategory > 0 then ' (offer ' || cast(subcategory as varchar) || ')' else '' end,
            chr(10) order by place) as context
     from q group by slice""")
def theme_context_lines(spark, sf):
    pool = promo_pool(spark, sf)
    line = F.concat(
        F.lit("- "),
        "name",
        F.lit(": "),
        F.round("promo_price").cast("long").cast("string"),
        F.lit(" kr"),
        F.when(F.col("subcategory") > 0, F.concat(F.lit(" (offer "), F.col("subcategory").cast("string"), F.lit(")")))
        .otherwise(F.lit("")),
    )
    top = pool.select("slice", F.struct("place", line.alias("line")).alias("e"))
    lines = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"])
    return top.groupBy("slice").agg(F.array_join(lines, "\n").alias("context"))
