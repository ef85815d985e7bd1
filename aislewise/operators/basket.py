"""Basket pricing, promotion scores, ranking and spreading over sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.recipes import is_organic, product_breaks_diet, valid_candidate
from aislewise.functions.text import INFLECTIONS, head_word, head_word_score, words_of
from aislewise.operators.ordered import top_per_group


def current_saving(regular: Column, promo: Column) -> Column:
    """How much a product is reduced now; 0 without a promotion price."""
    return F.when(promo.isNull() | regular.isNull(), 0.0).otherwise(F.greatest(regular - promo, F.lit(0.0)))


def basket_price(lines: DataFrame) -> DataFrame:
    """One row per recipe from (recipe_id, regular, promo, used_share) lines.

    A line without any price adds nothing, but a promotion still counts.
    """
    effective = F.coalesce("promo", "regular")
    saved = F.when(
        F.col("promo").isNotNull(), current_saving(F.col("regular"), F.col("promo")) * F.col("used_share")
    )
    sums = lines.groupBy("recipe_id").agg(
        F.coalesce(F.sum(effective), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum("regular"), F.lit(0.0)).alias("regular_total"),
        F.count("promo").alias("n_promo"),
        F.count(effective).alias("n_priced"),
        F.coalesce(F.sum(saved), F.lit(0.0)).alias("weighted_saving"),
    )
    return sums.withColumn("saving", F.col("regular_total") - F.col("total"))


def promo_score(saving: Column, regular: Column, n_promo: Column, n_priced: Column, total: Column) -> Column:
    """Relative saving, promotion coverage, count and size of the saving against the final price."""
    score = (
        saving / regular * 60
        + n_promo / F.greatest(n_priced, F.lit(3)) * 25
        + F.least(n_promo, F.lit(5)) * 5
        + F.least(saving, F.lit(60.0)) * 0.4
        - F.least(total, F.lit(250.0)) * 0.03
    )
    return F.when(regular <= 0, 0.0).otherwise(score)


def relevance_score(
    keyword_hits: Column,
    rating: Column,
    n_ratings: Column,
    kcal: Column,
    n_promo: Column,
    saving: Column,
    filling_kcal: float = 350.0,
) -> Column:
    return (
        keyword_hits * 10
        + F.coalesce(rating, F.lit(0.0)) * 2
        + F.least(F.coalesce(n_ratings, F.lit(0)), F.lit(200)) * 0.02
        + F.when(F.coalesce(kcal, F.lit(0.0)) >= filling_kcal, 6.0).otherwise(0.0)
        + F.least(n_promo, F.lit(5)) * 3
        + F.least(saving, F.lit(50.0)) * 0.4
    )


def time_band(minutes: Column) -> Column:
    return (
        F.when(minutes.isNull(), 9)
        .when(minutes <= 20, 0)
        .when(minutes <= 35, 1)
        .when(minutes <= 50, 2)
        .otherwise(3)
    )


def difficulty(steps: Column, ingredients: Column, minutes: Column) -> Column:
    points = steps + ingredients * 0.4 + F.coalesce(minutes, F.lit(0)) / 12
    return F.when(points <= 9, "enkelt").when(points <= 16, "medel").otherwise("avancerat")


SORT_MODES = ("billigt", "kampanj", "protein", "snabbt", "relevans")


def sort_keys(mode: Column) -> tuple[Column, Column]:
    """Two ascending keys for a row of the scored table under ``mode``."""
    first = (
        F.when(mode == "billigt", -(F.col("weighted_saving") + F.least("n_promo", F.lit(5)) * 6))
        .when(mode == "kampanj", -F.col("promo_score"))
        .when(mode == "protein", -F.coalesce("protein", F.lit(0.0)))
        .when(mode == "snabbt", time_band(F.col("time_min")).cast("double"))
        .otherwise(-F.col("relevance"))
    )
    second = (
        F.when(mode == "billigt", F.col("total"))
        .when(mode == "snabbt", -F.col("relevance"))
        .when(mode.isin("kampanj", "protein"), F.lit(0.0))
        .otherwise(-F.col("weighted_saving"))
    )
    return first, second


def top_by_mode(scored: DataFrame, n: int, modes: tuple[str, ...] = SORT_MODES, tie: str = "recipe_id") -> DataFrame:
    """The first ``n`` recipes of every sort mode, one pass over the scored table."""
    spread = scored.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    first, second = sort_keys(F.col("mode"))
    keyed = spread.withColumn("_k1", first).withColumn("_k2", second)
    return top_per_group(keyed, ["mode"], ["_k1", "_k2", tie], n, rank="rank").drop("_k1", "_k2")


TIERS = ((3, True), (2, True), (1, True), (1, False))


def relax_tiers(scored: DataFrame, wanted: int, floor: float = 0.10, tiers=TIERS) -> DataFrame:
    """Strictest tier (promotions needed, share floor kept) that still gives ``wanted``
    rows, else the loosest.  One counting pass decides; nothing is collected."""
    share = F.col("weighted_saving") / F.col("regular_total")
    base = (F.col("total") > 0) & (F.col("n_priced") >= 3) & (F.col("regular_total") > 0)
    passes = [base & (F.col("n_promo") >= k) & ((share >= floor) if keep else F.lit(True)) for k, keep in tiers]
    counts = scored.agg(*[F.count_if(p).alias(f"t{i}") for i, p in enumerate(passes)])
    chosen = F.lit(len(tiers) - 1)
    for i in reversed(range(len(tiers) - 1)):
        chosen = F.when(F.col(f"t{i}") >= wanted, i).otherwise(chosen)
    tier = counts.select(chosen.alias("tier")).scalar()
    keep = F.lit(False)
    for i, p in enumerate(passes):
        keep = keep | ((F.col("tier") == i) & p)
    return scored.withColumn("tier", tier).filter(keep)


def diversify_round_robin(scored: DataFrame, source: str, order: list, n: int) -> DataFrame:
    """Deal the best remaining row of every source, round after round, until ``n``.

    A source can fill at most ``n`` places, so only its first ``n`` rows take part.
    """
    dealt = top_per_group(scored, [source], order, n, rank="round")
    return dealt.orderBy("round", *order).limit(n)


def diversify_cap(
    hits: DataFrame, query: str, item: str, category: str, order: list, n: int, per_category: int = 5
) -> DataFrame:
    """Best hit per item, then at most ``per_category`` per category, then the first ``n``."""
    unique = top_per_group(hits, [query, item], order, 1)
    capped = top_per_group(unique, [query, category], order, per_category)
    return top_per_group(capped, [query], order, n, rank="rank")


def unique_ingredients(lines: DataFrame, recipe: str, key: Column, order: list[str]) -> DataFrame:
    """First line per recipe and ingredient key, as one partial aggregation."""
    rest = [c for c in lines.columns if c != recipe]
    packed = F.struct(*order, *[c for c in rest if c not in order])
    return (
        lines.withColumn("_key", key)
        .groupBy(recipe, "_key")
        .agg(F.min(packed).alias("_first"))
        .select(recipe, *[F.col(f"_first.{c}").alias(c) for c in rest])
    )


def candidates_top(scores: DataFrame, key: str, item: str, score: str, n: int = 12) -> DataFrame:
    """Best score per (key, item) over all search terms, then the first ``n`` items."""
    best = scores.groupBy(key, item).agg(F.max(score).alias(score))
    return top_per_group(best, [key], [F.desc(score), item], n, rank="rank")


def choose_candidate(
    candidates: DataFrame,
    key: str,
    min_score: float = 55.0,
    unrelated_floor: float = 78.0,
    promo_margin: float = 8.0,
    organic_wanted: bool = False,
) -> DataFrame:
    """Pick one product per ingredient from (key, product_id, ord, score, coverage, head,
    saving, organic, valid) rows: best (coverage, head), reject unrelated weak hits, then
    the largest saving among equals close to the best score."""
    good = candidates.filter(F.col("valid") & (F.col("score") >= min_score))
    if organic_wanted:
        any_organic = good.groupBy(key).agg(F.bool_or("organic").alias("_any"))
        good = good.join(any_organic, key).filter(~F.col("_any") | F.col("organic")).drop("_any")
    best = good.groupBy(key).agg(
        F.max(F.struct("coverage", "head", "score", (-F.col("ord")).alias("neg_ord"))).alias("_best")
    )
    best = best.filter(
        ~(
            (F.col("_best.coverage") == 0)
            & (F.col("_best.head") <= 1)
            & (F.col("_best.score") < unrelated_floor)
        )
    )
    near = good.join(best, key).filter(
        (F.col("coverage") == F.col("_best.coverage"))
        & (F.col("head") == F.col("_best.head"))
        & (F.col("score") >= F.col("_best.score") - promo_margin)
    )
    picked = near.groupBy(key).agg(
        F.max(F.struct("saving", "score", (-F.col("ord")).alias("neg_ord"), "product_id")).alias("_pick")
    )
    return picked.select(key, "_pick.product_id", "_pick.score", "_pick.saving")


def prefer_promo_near_best(hits: DataFrame, key: str, margin: float = 8.0) -> DataFrame:
    """First promoted hit within ``margin`` of the best score, else the best hit."""
    place = F.struct((-F.col("score")).alias("down"), "ord")
    best = hits.groupBy(key).agg(F.min_by("product_id", place).alias("_best"), F.max("score").alias("_top"))
    near = hits.join(best, key).filter(
        F.col("promo_price").isNotNull() & (F.col("score") >= F.col("_top") - margin)
    )
    promoted = near.groupBy(key).agg(F.min_by("product_id", place).alias("_promo"))
    return best.join(promoted, key, "left").select(key, F.coalesce("_promo", "_best").alias("product_id"))


ANY_WORD = "*"


def promo_swap(chosen: DataFrame, catalogue: DataFrame, staple: Column, lex: Lexicon = Lexicon()) -> DataFrame:
    """Swap a chosen product for the promotion of its main category that saves most and may stand for it.

    ``chosen``: (line_id, product_id, category, ingredient, diet, organic); ``staple`` is a condition on
    ``category``.  A promotion must be a valid candidate for the ingredient and the diet, organic where that is
    wished, and name the ingredient's head word with a score of two or more; where a staple's own name does, any
    promotion of the category will do.  The original stays unless the swap saves strictly more.

    Promotions that the gates cannot tell apart (what they break, forms they name, organic or not) are one kind.
    Two of each kind per category and word, and per category, are enough: two because the product itself never
    counts.  Only a prepared form that an ingredient names in full is judged by its whole name, so of those
    promotions two of each name are met on the head word.
    """
    name, category = F.col("name"), F.col("category")
    department = F.col("department") if "department" in catalogue.columns else F.lit(None).cast("string")
    tags = F.col("tags") if "tags" in catalogue.columns else F.lit(None).cast("array<string>")
    lowered = F.lower(F.coalesce(name, F.lit("")))
    forms = F.filter(F.array(*[F.lit(t) for t in lex.derived_forms]), lambda t: F.contains(lowered, t))
    breaks = [product_breaks_diet(name, category, F.lit(d), lex) for d in ("vegetariskt", "veganskt")]
    promos = catalogue.filter(F.col("promo_price").isNotNull()).select(
        category.alias("_cat"),
        current_saving(F.col("price"), F.col("promo_price")).alias("saving"),
        (-F.col("ord")).alias("neg_ord"),
        F.col("product_id").alias("swap_id"),
        name.alias("_name"),
        department.alias("_department"),
        is_organic(name, category, tags, lex).alias("_organic"),
        words_of(F.coalesce(name, F.lit(""))).alias("_words"),
        F.concat_ws("|", *[b.cast("string") for b in breaks], department, F.array_join(forms, ",")).alias("_kind"),
        (F.size(forms) > 0).alias("_formed"),
    )
    by_word = promos.withColumn("_word", F.explode(F.array_distinct("_words")))
    lists = promos.withColumn("_word", F.lit(ANY_WORD)).unionByName(by_word)
    order = [F.desc("saving"), F.desc("neg_ord")]
    formed = top_per_group(by_word.filter("_formed"), ["_cat", "_word", "_name", "_department", "_organic"], order, 2)
    lists = top_per_group(lists, ["_cat", "_word", "_kind", "_organic"], order, 2)
    lists = lists.unionByName(formed).drop("_words", "_kind", "_formed").distinct()

    own = catalogue.select(
        "product_id", name.alias("_own_name"), current_saving(F.col("price"), F.col("promo_price")).alias("own_saving")
    )
    # All but the product itself and its own name is alike for many lines: gates are judged once per kind of ask.
    lines = chosen.join(own, "product_id", "left")
    heads = lines.select(
        F.col("category").alias("_c"), F.col("ingredient").alias("_i"), F.col("_own_name").alias("_o")
    ).distinct()
    heads = heads.withColumn("_head", head_word(F.col("_i")))
    heads = heads.withColumn("_named", head_word_score(F.col("_o"), F.col("_head")) >= 2)
    same = F.col("category").eqNullSafe(F.col("_c")) & F.col("ingredient").eqNullSafe(F.col("_i"))
    asks = lines.join(heads, same & F.col("_own_name").eqNullSafe(F.col("_o")))
    asks = asks.withColumn("_free", F.coalesce(staple & F.col("_named"), F.lit(False))).drop("_c", "_i", "_o", "_named")
    ask = ["category", "ingredient", "diet", "organic", "_free"]
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k_{c}") for c in ask]
    kinds = asks.select(*ask, "_head", *keyed).distinct()
    every = F.when(F.col("_free"), F.array(F.lit(ANY_WORD))).otherwise(F.array().cast("array<string>"))
    kinds = kinds.withColumn("_word", F.explode(F.array_union(compound_tails(F.col("_head")), every)))
    met = kinds.join(lists, (kinds["category"] == lists["_cat"]) & (kinds["_word"] == lists["_word"]))
    allowed = (
        valid_candidate(F.col("_name"), F.col("category"), F.col("_department"), F.col("diet"), F.col("ingredient"), lex)
        & (~F.coalesce("organic", F.lit(False)) | F.col("_organic"))
        & (F.col("_free") | (head_word_score(F.col("_name"), F.col("_head")) >= 2))
    )
    keys = [f"_k_{c}" for c in ask]
    offers = met.filter(allowed).select(*keys, "saving", "neg_ord", "swap_id").distinct()
    # Two a kind, as the product itself never counts.
    offers = top_per_group(offers, keys, [F.desc("saving"), F.desc("neg_ord"), F.desc("swap_id")], 2)
    offers = offers.groupBy(*keys).agg(F.collect_list(F.struct("saving", "neg_ord", "swap_id")).alias("_two"))
    others = F.filter("_two", lambda o: o["swap_id"] != F.col("product_id"))
    joined = asks.select("*", *keyed).join(offers, keys, "left").withColumn("_offer", F.array_max(others))
    kept = F.coalesce("own_saving", F.lit(0.0))
    better = F.coalesce(F.col("_offer.saving") > kept, F.lit(False))
    return joined.select(
        "line_id",
        F.when(better, F.col("_offer.swap_id")).otherwise(F.col("product_id")).alias("product_id"),
        F.when(better, F.col("_offer.saving")).otherwise(kept).alias("saving"),
        better.alias("swapped"),
    )


def deal_slices(pool: DataFrame, key: str, slices: int, each: int, seed: int = 0) -> DataFrame:
    """``pool`` shuffled by a seed and dealt in turn to ``slices``, at most ``each`` a slice: with ``slice`` and ``place``.

    The order is that of a hash of seed and ``key``, so it can be repeated.  A slice that gets nothing, as the pool has
    fewer rows than there are slices, shows the first ``each`` rows instead.  Only slices x each rows are numbered.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    first = pool.withColumn("_h", digest).orderBy("_h", key).limit(slices * each)
    order = Window.orderBy("_h", key)
    dealt = first.withColumn("_p", F.row_number().over(order) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    own = dealt.withColumn("slice", F.col("_p") % slices).withColumn("place", F.floor(F.col("_p") / slices).cast("int"))
    spare = dealt.filter((F.col("_all") < slices) & (F.col("_p") < each))
    spare = spare.withColumn("slice", F.explode(F.sequence(F.col("_all").cast("int"), F.lit(slices - 1)))).withColumn("place", F.col("_p"))
    return own.unionByName(spare).drop("_h", "_p", "_all")


def compound_tails(head: Column, shortest: int = 6) -> Column:
    """The head word and every ending of it, without an inflection, that a product name could consist of."""
    stems = F.transform(
        F.filter(F.array(*[F.lit(e) for e in INFLECTIONS]), lambda e: F.endswith(head, e)),
        lambda e: F.substring(head, F.lit(1), F.length(head) - F.length(e)),
    )
    starts = lambda s: F.sequence(F.lit(1), F.greatest(F.length(s) - shortest + 1, F.lit(1)))
    tails = F.flatten(F.transform(stems, lambda s: F.transform(starts(s), lambda i: F.substring(s, i, F.length(s)))))
    return F.array_union(F.array(head), F.filter(tails, lambda t: F.length(t) >= shortest))


def first_image(lines: DataFrame, recipe: str, main_word: Column) -> DataFrame:
    """Image of the first ingredient naming the main word, else of the first with an image."""
    has = F.col("image").isNotNull()
    names_it = has & (main_word != "") & F.contains(F.lower("name"), main_word)
    return lines.groupBy(recipe).agg(
        F.coalesce(
            F.min_by("image", F.when(names_it, F.col("ord"))), F.min_by("image", F.when(has, F.col("ord")))
        ).alias("image")
    )
