"""Catalogue search for whole tables of queries.

Nothing here scans the catalogue once per query.  Distinct query words meet distinct
catalogue words (or texts) through shared pieces of text as equi-join keys; pieces are
chosen so that every pair that can score is met.  Scores are computed on distinct texts
and only the winners are expanded to product rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.numeric import let
from aislewise.functions.similarity import sequence_ratio
from aislewise.functions.text import main_category, normalise, squeeze, strip, tokens, word_match
from aislewise.operators.ordered import top_per_group
from aislewise.operators.set_similarity import processed, token_set_best, token_set_pairs
from aislewise.session import cut_lineage


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters (empty when the text is shorter)."""
    last = F.length(text) - size + 1
    made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


PIECE = 5  # letters of an anchor


def containment_pairs(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Every (term, text) with the term inside the text, for distinct terms and texts.

    A term meets the texts that hold its rarest piece of five letters (a shorter term is its own piece); which one
    that is comes from the number of texts that hold each piece.  A term with a piece in no text is in none.
    Terms of at most two letters meet the texts that hold them and no others.
    """
    terms = terms.select("term").distinct().filter(F.length("term") > 0)
    n = F.length("term")
    pieces = F.when(n <= PIECE, F.array("term")).otherwise(_grams(F.col("term"), PIECE))
    asked = cut_lineage(terms.select("term", pieces.alias("_pieces")))
    wanted = asked.select(F.explode("_pieces").alias("_g")).distinct()
    sizes = [r[0] for r in wanted.select(F.length("_g")).distinct().collect()]  # five at most
    if not sizes:
        return asked.select("term", F.col("term").alias("text")).limit(0)
    held = F.explode(F.concat(*[_grams(F.col("text"), k) for k in sorted(sizes)]))
    held = texts.select("text").distinct().select("text", held.alias("_g")).join(wanted, "_g", "left_semi")
    held = cut_lineage(held)
    often = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    ranked = asked.select("term", F.size("_pieces").alias("_all"), F.explode("_pieces").alias("_g")).join(often, "_g")
    anchors = (
        ranked.groupBy("term", "_all")
        .agg(F.min(F.struct("_n", "_g")).alias("_a"), F.count(F.lit(1)).alias("_met"))
        .filter(F.col("_met") == F.col("_all"))
        .select("term", F.col("_a._g").alias("_g"))
    )
    return anchors.join(held, "_g").filter(F.contains("text", F.col("term"))).select("term", "text")


def similar_words(query_words: DataFrame, target_words: DataFrame) -> DataFrame:
    """(q, t, ratio) for distinct words with a possible word score.

    Words stand between marks, so a prefix of any length, a suffix of four letters and an inner piece of five are
    all terms inside a text; so is a target of four letters that begins the query word.  A sequence ratio of at least
    0.8 on words of six letters and more leaves a fifth of both lengths, less one, as common letter pairs; so two
    words meet in the rarest pairs of each, all but that many less one, and only such words reach the UDF.
    """
    queries = cut_lineage(query_words.select(F.col("word").alias("q")).distinct())
    targets = cut_lineage(target_words.select(F.col("word").alias("t")).distinct().filter(F.length("t") > 0))
    begin, end, back = F.lit("\u0002"), F.lit("\u0003"), F.lit("\u0004")
    n = F.length("q")
    asks = F.array(F.concat(begin, "q"), F.when(n == 4, F.concat("q", end)), F.when(n >= 5, F.col("q")))
    asks = queries.select("q", F.explode(F.array_compact(asks)).alias("term"))
    starts = targets.filter(F.length("t") >= 4).select(F.concat(back, "t").alias("term"))
    texts = targets.select(F.concat(begin, "t", end).alias("text")).unionByName(
        queries.select(F.concat(back, "q").alias("text"))
    )
    met = cut_lineage(containment_pairs(asks.select("term").unionByName(starts), texts))
    bare = F.translate("text", "\u0002\u0003\u0004", "")
    forward = met.filter(F.startswith("text", begin)).join(asks, "term").select("q", bare.alias("t"))
    backward = met.filter(F.startswith("term", back)).select(bare.alias("q"), F.translate("term", "\u0004", "").alias("t"))
    literal = forward.unionByName(backward).distinct()
    close = (
        _spread(_close_words(queries, targets), "t")
        .withColumn("ratio", sequence_ratio("q", "t"))
        .filter("ratio >= 0.8")
    )
    return (
        literal.withColumn("ratio", F.lit(None).cast("double"))
        .unionByName(close)
        .groupBy("q", "t")
        .agg(F.max("ratio").alias("ratio"))
    )


def _close_words(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(q, t) of six letters and more that share enough letter pairs for a ratio of 0.8.

    With T letters on both sides and M of them matched, M >= 0.4 T; at most T - 2 M + 1 runs make up the match, so
    at least M - (T - 2 M + 1) >= T / 5 - 1 letter pairs are common, repeats counted.  The other word has two thirds
    of the letters at least, so a word of n letters leaves out its ceil(n / 3) - 2 commonest pairs.
    """

    def pairs(rows: DataFrame, word: str) -> DataFrame:
        places = F.sequence(F.lit(1), F.length(word) - 1)
        grams = F.transform(places, lambda i: F.substring(F.col(word), i, F.lit(2)))
        counted = F.transform(
            grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i), lambda h: h == g)).cast("string"))
        )
        return rows.filter(F.length(word) >= 6).select(word, F.explode(counted).alias("_g"))

    held = pairs(targets, "t")
    often = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))

    def rare(rows: DataFrame, word: str) -> DataFrame:
        known = rows.join(often, "_g", "left")
        order = Window.partitionBy(word).orderBy(F.coalesce("_n", F.lit(0)), "_g")
        left_out = F.greatest(F.ceil(F.length(word) / 3) - 2, F.lit(0))
        kept = known.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.length(word) - 1 - left_out)
        return kept.select(word, "_g")

    n, m = F.length("q"), F.length("t")
    met = rare(pairs(queries, "q"), "q").join(rare(held, "t"), "_g")
    return met.filter((F.least(n, m) * 3 >= F.greatest(n, m) * 2) & (F.col("q") != F.col("t"))).select("q", "t").distinct()


def search_texts(catalogue: DataFrame) -> DataFrame:
    """One row per distinct 'name brand' text: last row's values at the first row's place."""
    text = squeeze(F.lower(F.concat_ws(" ", "name", "brand")))
    return (
        catalogue.withColumn("text", text)
        .groupBy("text")
        .agg(
            F.min("ord").alias("ord"),
            F.max_by(F.struct("product_id", "name", "brand", "category"), "ord").alias("_p"),
        )
        .select("text", "ord", "_p.*")
    )


def text_scores(queries: DataFrame, texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(query, text, score) with score > 0 for distinct ``query`` strings."""
    asked = queries.select("query").distinct().withColumn("words", tokens(F.col("query")))
    asked = asked.filter(F.size("words") > 0)
    words = asked.select("query", F.posexplode("words").alias("_qpos", "q"))
    attribute = F.col("q").isin(*lex.attributes)
    listed = F.exists(F.array(*[F.lit(w) for w in lex.product_words]), lambda w: F.contains(w, F.col("q")))
    words = words.withColumn("_attr", attribute).withColumn(
        "_known", (listed | F.col("q").isin(*lex.brands)) & ~attribute
    )
    totals = words.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(~F.col("_attr")).alias("n_plain")
    )
    places = texts.select("text", F.posexplode(F.split("text", " ")).alias("_tpos", "t")).filter("t <> ''")
    pairs = similar_words(words.select(F.col("q").alias("word")), places.select(F.col("t").alias("word")))
    best = (
        places.join(pairs, "t")
        .withColumn("_m", word_match(F.col("q"), F.col("t"), F.col("_tpos"), F.col("ratio")))
        .groupBy("text", "q")
        .agg(F.max("_m").alias("best"))
        .filter("best >= 0.5")
    )
    met = words.join(best, "q")
    key = F.col("_known") | ((F.col("best") >= 1.0) & ~F.col("_attr"))
    sums = (
        met.withColumn("_key", key)
        .groupBy("query", "text")
        .agg(
            F.count(F.lit(1)).alias("n_met"),
            F.count_if(~F.col("_attr")).alias("n_plain_met"),
            F.count_if("_key").alias("n_key"),
            F.sum(F.when(F.col("_key"), F.col("best"))).alias("key_sum"),
            F.sum("best").alias("all_sum"),
            F.sum(
                F.when(F.col("_key"), 0.0)
                .when(F.col("_attr"), F.col("best") * 0.1)
                .otherwise(F.col("best") * 0.3)
            ).alias("extra"),
        )
        .join(totals, "query")
    )
    mean = F.when(
        (F.col("n_key") > 0) & (F.col("n_plain_met") == F.col("n_plain")),
        F.col("key_sum") / F.col("n_key") + F.col("extra"),
    ).when((F.col("n_key") == 0) & (F.col("n_met") == F.col("n_words")), F.col("all_sum") / F.col("n_words"))
    penalty = F.least(F.lit(12.0), F.length("text") / 10)
    score = (
        F.when(F.col("mean") >= 1.0, F.greatest(F.lit(78.0), F.lit(100.0) - penalty))
        .when(F.col("mean") >= 0.9, F.greatest(F.lit(70.0), F.lit(92.0) - penalty))
        .when(F.col("mean") >= 0.7, F.col("mean") * 25 + 60)
        .when(F.col("mean") >= 0.5, F.col("mean") * 30 + 45)
        .otherwise(F.col("mean") * 40)
    )
    return (
        sums.withColumn("mean", mean)
        .filter("mean is not null")
        .select("query", "text", score.alias("score"))
        .join(asked, "query")
    )


def _lookup(table: dict[str, tuple[str, ...]], words: Column) -> Column:
    """All terms the table lists for any of the words."""
    out = F.array().cast("array<string>")
    for word, terms in table.items():
        listed = F.array(*[F.lit(t) for t in terms])
        out = F.concat(
            out, F.when(F.array_contains(words, word), listed).otherwise(F.array().cast("array<string>"))
        )
    return out


def boosted_score(score: Column, words: Column, query: Column, name: Column, category: Column, lex: Lexicon) -> Column:
    """Category, size, non-food and '-free' adjustments on top of a text score."""
    name, category = F.lower(name), F.lower(F.coalesce(category, F.lit("")))

    def any_in(text: Column, terms: Column) -> Column:
        return F.exists(terms, lambda t: F.contains(text, t))

    def listed(terms: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(t) for t in terms])

    primary_hits = F.lit(0)
    secondary = F.lit(False)
    for word, terms in lex.primary.items():
        has = F.array_contains(words, word)
        primary_hits = primary_hits + F.when(has & any_in(category, listed(terms)), 1).otherwise(0)
        if word in lex.secondary:
            secondary = secondary | (has & any_in(category, listed(lex.secondary[word])))
    primary = primary_hits > 0
    non_food = any_in(category, listed(lex.non_food))
    excluded = any_in(name, _lookup(lex.exclusions, words))
    specific = any_in(query, listed(lex.specific))
    cat_words = F.split(category, " ")
    category_word = F.exists(
        words, lambda w: (F.length(w) >= 3) & F.exists(cat_words, lambda c: F.startswith(c, w))
    )
    first = score + primary_hits * 15 - F.when(secondary & ~primary & ~specific, 30).otherwise(0)
    plain = ~primary & ~secondary & ~non_food & category_word
    size = F.when(any_in(name, listed(lex.common_sizes)), 2).otherwise(0)
    return let(
        let(
            let(first, lambda s: s + F.when(plain & (s > 0), 8).otherwise(0) + size),
            lambda s: s - F.when(non_food & (s >= 40), 30).otherwise(0),
        ),
        lambda s: s - F.when(excluded & (s >= 40), 40).otherwise(0),
    )


def fuzzy_search(
    queries: DataFrame, catalogue: DataFrame, lex: Lexicon, n: int = 5, per_category: int = 5, floor: float = 40.0
) -> DataFrame:
    """Main search: (query_id, product_id, score, rank) for queries (query_id, query)."""
    asked = queries.select("query_id", squeeze(F.lower("query")).alias("query"))
    texts = search_texts(catalogue)
    scored = text_scores(asked, texts, lex).join(texts, "text")
    final = scored.withColumn(
        "score",
        boosted_score(F.col("score"), F.col("words"), F.col("query"), F.col("name"), F.col("category"), lex),
    ).filter(F.col("score") >= floor)
    order = [F.desc("score"), F.col("ord")]
    hits = final.select(
        "query", "product_id", "score", "ord", main_category(F.coalesce("category", F.lit("Okänd"))).alias("_cat")
    )
    hits = top_per_group(hits, ["query", "product_id"], order, 1)
    hits = top_per_group(hits, ["query", "_cat"], order, per_category)
    hits = top_per_group(hits, ["query"], order, n, rank="rank")
    return asked.join(hits.drop("_cat", "ord"), "query").select(
        "query_id", "product_id", F.round("score", 1).alias("score"), "rank"
    )


def fuzzy_match_top1(queries: DataFrame, catalogue: DataFrame, lex: Lexicon, min_score: float = 70.0) -> DataFrame:
    return fuzzy_search(queries, catalogue, lex, n=1).filter(F.col("score") >= min_score).drop("rank")


# Term scoring ------------------------------------------------------------------------


def expand_terms(queries: DataFrame, lex: Lexicon) -> DataFrame:
    """(query_id, term, is_original, origins): query words, their synonyms and concept words."""
    lowered = F.lower("query")
    words = F.filter(F.split(squeeze(lowered), " "), lambda w: F.length(w) >= 2)
    rows = queries.select("query_id", lowered.alias("_q"), words.alias("_w")).filter(F.size("_w") > 0)
    empty = F.array().cast("array<struct<term:string,origin:string,original:boolean>>")

    def entry(term: Column, origin: Column, original: bool) -> Column:
        return F.struct(term.alias("term"), origin.alias("origin"), F.lit(original).alias("original"))

    parts = F.transform("_w", lambda w: entry(w, F.lit(None).cast("string"), True))
    for word, terms in lex.synonyms.items():
        made = F.array(*[entry(F.lit(t), F.lit(word), False) for t in terms])
        parts = F.concat(parts, F.when(F.array_contains("_w", word), made).otherwise(empty))
    for concept, terms in lex.concepts.items():
        made = F.array(*[entry(F.lit(t), F.lit(None).cast("string"), False) for t in terms])
        parts = F.concat(parts, F.when(F.contains("_q", F.lit(concept)), made).otherwise(empty))
    return (
        rows.select("query_id", F.size("_w").alias("n_words"), F.explode(parts).alias("_e"))
        .groupBy("query_id", "n_words", F.col("_e.term").alias("term"))
        .agg(
            F.bool_or("_e.original").alias("is_original"),
            F.array_sort(F.collect_set("_e.origin")).alias("origins"),
        )
    )


def _fields(catalogue: DataFrame) -> DataFrame:
    """Distinct (name, category, brand) in lower case with one searchable text."""
    rows = catalogue.select(
        "product_id",
        "ord",
        *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("name", "brand", "category")],
    )
    return rows.withColumn("text", F.concat_ws(" ", "_name", "_brand", "_category"))


def _expand(scored: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Best ``n`` products per query from scored distinct texts."""
    firsts = top_per_group(rows.select("text", "product_id", "ord"), ["text"], ["ord"], n)
    best = top_per_group(scored, ["query_id"], [F.desc("score"), "first_ord"], n)
    joined = best.join(firsts, "text")
    return top_per_group(joined, ["query_id"], [F.desc("score"), "ord"], n, rank="rank").select(
        "query_id", "product_id", "score", "rank"
    )


def prefilter(queries: DataFrame, catalogue: DataFrame, lex: Lexicon, n: int = 50) -> DataFrame:
    """Candidate products per query: word, category and brand hits of all expanded terms."""
    rows = _fields(catalogue)
    distinct = rows.groupBy("text", "_name", "_brand", "_category").agg(F.min("ord").alias("first_ord"))
    terms = expand_terms(queries, lex)
    pairs = containment_pairs(terms, distinct)
    term = F.col("term")
    in_name, in_category = F.contains("_name", term), F.contains("_category", term)
    points = (
        F.when(F.array_contains(F.split("_name", r"\s+"), term), 15).when(in_name, 8).otherwise(0)
        + F.when(in_category, 10).otherwise(0)
        + F.when(F.contains("_brand", term), 3).otherwise(0)
    )
    empty = F.array().cast("array<string>")
    met = F.concat(
        F.when(F.col("is_original") & in_name, F.array(term)).otherwise(empty),
        F.when(in_category, F.col("origins")).otherwise(empty),
    )
    scored = (
        terms.join(pairs, "term")
        .join(distinct, "text")
        .withColumn("_pts", points)
        .withColumn("_met", met)
        .groupBy("query_id", "n_words", "text", "first_ord")
        .agg(F.sum("_pts").alias("_pts"), F.size(F.array_distinct(F.flatten(F.collect_list("_met")))).alias("_n"))
    )
    bonus = F.when((F.col("_n") == F.col("n_words")) & (F.col("n_words") > 1), 50).otherwise(0)
    scored = scored.withColumn("score", F.col("_pts") + bonus).filter("score > 0")
    return _expand(scored.select("query_id", "text", "first_ord", "score"), rows, n)


def local_search(queries: DataFrame, catalogue: DataFrame, lex: Lexicon, n: int = 20) -> DataFrame:
    """Word, prefix and substring points over name, brand and category."""
    rows = _fields(catalogue)
    distinct = rows.groupBy("text", "_name").agg(F.min("ord").alias("first_ord"))
    words = F.filter(F.split(squeeze(F.lower("query")), " "), lambda w: F.length(w) >= 2)
    asked = queries.select("query_id", words.alias("_w")).withColumn("n_words", F.size("_w"))
    terms = asked.select("query_id", "n_words", F.posexplode("_w").alias("_pos", "term"))
    term = F.col("term")
    whole = term.isin(*lex.whole_words) | (F.length(term) <= 3)
    all_words = F.split("text", " +")
    points = (
        F.when(F.array_contains(F.split("_name", " +"), term), 20)
        .when(F.array_contains(all_words, term), 12)
        .when(~whole & F.exists(all_words, lambda w: F.startswith(w, term)), 15)
        .when(~whole & ~F.contains("text", F.concat(term, F.lit("fri"))), 5)
        .otherwise(0)
    )
    found = F.when(whole, F.array_contains(all_words, term)).otherwise(F.lit(True))
    scored = (
        terms.join(containment_pairs(terms, distinct), "term")
        .join(distinct, "text")
        .withColumn("_pts", points)
        .withColumn("_found", found)
        .groupBy("query_id", "n_words", "text", "first_ord")
        .agg(F.sum("_pts").alias("_pts"), F.count_if("_found").alias("_n"))
        .filter("_pts > 0")
    )
    bonus = F.when((F.col("n_words") > 1) & (F.col("_n") == F.col("n_words")), 10).otherwise(0)
    return _expand(
        scored.select("query_id", "text", "first_ord", (F.col("_pts") + bonus).alias("score")), rows, n
    )


# Set similarity and cascades ---------------------------------------------------------


def _spread(pairs: DataFrame, by: str) -> DataFrame:
    """Scoring is costlier than the pairs are wide; keep one task per shuffle partition."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def short_search(queries: DataFrame, catalogue: DataFrame, floor: float = 40.0, n: int = 5) -> DataFrame:
    """Token-set search over name, brand and tags; ``direct`` marks a best hit of 75 or more."""
    texts = catalogue.select("product_id", "ord", processed(F.concat_ws(" ", "name", "brand", "category")).alias("b"))
    asked = queries.select("query_id", processed(F.col("query")).alias("a"))
    firsts = top_per_group(texts, ["b"], ["ord"], n)
    near = token_set_best(asked, texts, floor, n).select("a", "b", "score")
    top = top_per_group(near.join(firsts, "b"), ["a"], [F.desc("score"), "ord"], n, rank="rank")
    direct = top.groupBy("a").agg((F.max("score") >= 75).alias("direct"))
    return asked.join(top.join(direct, "a"), "a").select("query_id", "product_id", "score", "rank", "direct")


def brand_in_query(queries: DataFrame, brands: DataFrame) -> DataFrame:
    """Longest known brand inside each query (both normalised)."""
    asked = queries.select("query_id", normalise(F.col("query")).alias("text"))
    known = brands.select(normalise(F.col("brand")).alias("term")).filter("term <> ''")
    pairs = containment_pairs(known, asked)
    best = pairs.groupBy("text").agg(F.max_by("term", F.struct(F.length("term").alias("n"), "term")).alias("brand"))
    return asked.join(best, "text").select("query_id", "brand")


def lookup_cascade(queries: DataFrame, catalogue: DataFrame, min_score: float = 65.0, fuzzy: bool = True) -> DataFrame:
    """Product per query by the first tier that answers: inside the name (100), inside the
    normalised search text (95), fuzzy with brand repair, any product of the named brand
    (40), else nothing (0)."""
    asked = queries.select(
        "query_id",
        squeeze(F.lower("query")).alias("q"),
        normalise(F.col("query")).alias("qn"),
    )
    text = F.concat_ws(" ", "name", "brand", "category")
    rows = catalogue.select(
        "product_id",
        "ord",
        F.lower("name").alias("_name"),
        normalise(F.col("brand")).alias("_brand"),
        squeeze(F.lower(text)).alias("_plain"),
        squeeze(normalise(text)).alias("_norm"),
    )

    def first_with(term: str, field: str) -> DataFrame:
        by_text = rows.groupBy(F.col(field).alias("text")).agg(F.min(F.struct("ord", "product_id")).alias("_p"))
        hits = containment_pairs(asked.select(F.col(term).alias("term")), by_text).join(by_text, "text")
        return hits.groupBy("term").agg(F.min("_p").alias("_p")).select(F.col("term").alias(term), "_p.product_id")

    tier1 = first_with("q", "_name").select("q", F.col("product_id").alias("_t1"))
    tier2 = first_with("qn", "_norm").select("qn", F.col("product_id").alias("_t2"))
    named = brand_in_query(queries, catalogue)
    # A named brand stands for every product brand that contains it.
    brand_rows = rows.groupBy(F.col("_brand").alias("text")).agg(F.min(F.struct("ord", "product_id")).alias("_p"))
    brand_first = (
        containment_pairs(named.select(F.col("brand").alias("term")), brand_rows)
        .join(brand_rows, "text")
        .groupBy(F.col("term").alias("brand"))
        .agg(F.min("_p").alias("_p"))
        .select("brand", F.col("_p.product_id").alias("_t5"))
    )
    out = asked.join(tier1, "q", "left").join(tier2, "qn", "left").join(named, "query_id", "left")
    out = out.join(brand_first, "brand", "left")
    if fuzzy:
        out = cut_lineage(out)
        rest = out.filter("_t1 is null and _t2 is null").select("query_id", "q", "qn", "brand")
        out = out.join(_fuzzy_tier(rest, rows, min_score), "query_id", "left")
    else:
        out = out.withColumn("_t3", F.lit(None).cast(rows.schema["product_id"].dataType)).withColumn(
            "_s3", F.lit(None).cast("double")
        )
    return out.select(
        "query_id",
        F.coalesce("_t1", "_t2", "_t3", "_t5").alias("product_id"),
        F.when(F.col("_t1").isNotNull(), 100.0)
        .when(F.col("_t2").isNotNull(), 95.0)
        .when(F.col("_t3").isNotNull(), F.col("_s3"))
        .when(F.col("_t5").isNotNull(), 40.0)
        .otherwise(0.0)
        .alias("score"),
    )


def _fuzzy_tier(rest: DataFrame, rows: DataFrame, min_score: float) -> DataFrame:
    """Best fuzzy product; a hit of another brand than the one asked for is replaced by the
    best product of that brand scoring 50 or more."""
    sides = []
    for rank, (term, field) in enumerate((("qn", "_norm"), ("q", "_plain"))):
        ask = rest.select("query_id", "brand", processed(F.col(term)).alias("a"))
        text = rows.select("product_id", "ord", "_brand", processed(F.col(field)).alias("b"))
        pairs = token_set_best(ask, text, min_score).select("a", "b", "score")
        firsts = text.groupBy("b", "_brand").agg(F.min(F.struct("ord", "product_id")).alias("_p"))
        sides.append(
            ask.join(pairs, "a")
            .join(firsts, "b")
            .select("query_id", "brand", "_brand", "score", "_p", F.lit(-rank).alias("_side"))
        )
    hits = sides[0].unionByName(sides[1])
    place = F.struct("score", "_side", (-F.col("_p.ord")).alias("o"))
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("brand", "_brand", "score", "_p"), place).alias("_b"))
    best = cut_lineage(best)
    # Wrong brand: the best text of all brands that hold the one asked for.
    wrong = best.filter(F.col("_b.brand").isNotNull() & ~F.contains("_b._brand", F.col("_b.brand")))
    asks = wrong.select("query_id", F.col("_b.brand").alias("brand")).join(
        rest.select("query_id", processed(F.col("qn")).alias("a")), "query_id"
    )
    named = rows.groupBy("_brand", processed(F.col("_norm")).alias("b")).agg(
        F.min(F.struct("ord", "product_id")).alias("_p")
    )
    known = named.select(F.col("_brand").alias("text")).distinct()
    inside = containment_pairs(asks.select(F.col("brand").alias("term")), known)
    texts = inside.join(named, inside["text"] == named["_brand"]).select(F.col("term").alias("brand"), "b", "_p")
    texts = texts.groupBy("brand", "b").agg(F.min("_p").alias("_p"))
    near = token_set_best(asks, texts.select("brand", "b", F.col("_p.ord").alias("ord")), 50.0, within="brand")
    repaired = (
        asks.join(near.select("brand", "a", "b", "score"), ["brand", "a"])
        .join(texts, ["brand", "b"])
        .select("query_id", F.struct("score", "_p").alias("_r"))
    )
    chosen = best.join(repaired, "query_id", "left")
    return chosen.select(
        "query_id",
        F.coalesce("_r._p.product_id", "_b._p.product_id").alias("_t3"),
        F.round(F.coalesce("_r.score", "_b.score")).alias("_s3"),
    )


def alias_match(texts: DataFrame, aliases: DataFrame, floor: float = 65.0) -> DataFrame:
    """Best product alias for each label text, when similar enough.

    Texts: (text_id, text).  Aliases: (product_id, ord, alias).
    """
    asked = texts.select("text_id", processed(F.col("text")).alias("a"))
    known = aliases.select("product_id", "ord", processed(F.col("alias")).alias("b"))
    firsts = known.groupBy("b").agg(F.min(F.struct("ord", "product_id")).alias("_p"))
    best = token_set_best(asked, known, floor).select("a", "b", "score").join(firsts, "b")
    return asked.join(best, "a").select("text_id", "_p.product_id", "score")


def position_cascade(hits: DataFrame, placed: DataFrame, floor: float = 75.0, fuzzy: bool = True) -> DataFrame:
    """Position of each hit (hit_id, product_id, name): by id, by exact name, else by the most
    similar placed name.  The last placed row of an id or name wins."""
    by_id = placed.groupBy(F.col("product_id")).agg(F.max_by(F.struct("x", "y", "z"), "ord").alias("_p1"))
    named = placed.select(squeeze(F.lower("name")).alias("_n"), "ord", "x", "y", "z")
    by_name = named.groupBy("_n").agg(F.max_by(F.struct("x", "y", "z"), "ord").alias("_p2"))
    out = hits.withColumn("_n", squeeze(F.lower("name"))).join(by_id, "product_id", "left").join(by_name, "_n", "left")
    if fuzzy:
        rest = out.filter("_p1 is null and _p2 is null").select(processed(F.col("_n")).alias("a"))
        spots = named.groupBy(processed(F.col("_n")).alias("b")).agg(
            F.max_by(F.struct("x", "y", "z"), "ord").alias("_p3"), F.min("ord").alias("ord")
        )
        close = token_set_best(rest, spots, floor).select("a", "b").join(spots, "b").select("a", "_p3")
        out = out.withColumn("a", processed(F.col("_n"))).join(close, "a", "left")
    else:
        out = out.withColumn("_p3", F.lit(None).cast(by_name.schema["_p2"].dataType))
    tier = F.when(F.col("_p1").isNotNull(), 1).when(F.col("_p2").isNotNull(), 2).when(F.col("_p3").isNotNull(), 3)
    return out.withColumn("_p", F.coalesce("_p1", "_p2", "_p3")).select(
        "hit_id", "_p.x", "_p.y", "_p.z", tier.alias("tier")
    )


def cached_answers(
    queries: DataFrame, cache: DataFrame, catalogue: DataFrame, n: int, lex: Lexicon | None = None, candidates: int = 50
) -> DataFrame:
    """(query_id, product_id, rank, cached) of queries (query_id, query) looked up as trimmed small letters.

    A query in the cache (query, ids) gets its stored products that still exist, first ``n``; none of them left is an
    answer too.  With ``lex``, a query that is not in the cache gets the first ``n`` of its prefilter candidates.
    """
    key = strip(F.lower("query"))
    asked = queries.select("query_id", "query", key.alias("_key"))
    known = cache.select(key.alias("_key"), "ids")
    hits = asked.join(known, "_key").select("query_id", F.posexplode("ids").alias("place", "product_id"))
    alive = hits.join(catalogue.select("product_id"), "product_id", "left_semi")
    out = top_per_group(alive, ["query_id"], ["place"], n, rank="rank").select("query_id", "product_id", "rank")
    out = out.withColumn("cached", F.lit(True))
    if lex is None:
        return out
    missed = asked.join(known.select("_key"), "_key", "left_anti")
    texts = missed.select(F.col("_key").alias("query_id"), F.col("_key").alias("query")).distinct()
    found = prefilter(texts, catalogue, lex, candidates).filter(F.col("rank") <= n)
    found = found.select(F.col("query_id").alias("_key"), "product_id", "rank")
    new = missed.join(found, "_key").select("query_id", "product_id", "rank", F.lit(False).alias("cached"))
    return out.unionByName(new)


def cache_additions(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Cache rows (query, ids) for the answers of :func:`cached_answers` that did not come from the cache."""
    new = answers.filter(~F.col("cached")).join(queries.select("query_id", strip(F.lower("query")).alias("query")), "query_id")
    ranked = new.select("query", "rank", "product_id").distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"])
    return ranked.groupBy("query").agg(ids.alias("ids"))


def intent_search(rules: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Products per rule: category listed, one required word (if any), no excluded word and
    the brand (if set).  Rules: rule_id, categories, required, excluded, brand."""
    opened = rules.select("rule_id", "required", "excluded", "brand", F.explode("categories").alias("category"))
    rows = catalogue.select("product_id", "category", F.col("brand").alias("_b"), F.lower("name").alias("_n"))
    wanted = (F.size("required") == 0) | F.exists("required", lambda w: F.contains("_n", w))
    barred = F.exists("excluded", lambda w: F.contains("_n", w))
    return (
        rows.join(opened, "category")
        .filter(wanted & ~barred & (F.col("brand").isNull() | (F.col("brand") == F.col("_b"))))
        .select("rule_id", "product_id")
    )


def brand_match(names: DataFrame, brands: DataFrame, floor: float = 78.0) -> DataFrame:
    """First word of each name whose best brand similarity reaches ``floor``, with the score."""
    words = names.select("name", F.posexplode(F.split(processed(F.col("name")), " ")).alias("place", "a"))
    pairs = token_set_pairs(words.select(F.col("a").alias("text")), brands.select(F.col("brand").alias("text")), floor)
    best = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("_m"))
    hits = words.join(best, "a")
    first = hits.groupBy("name").agg(F.min_by(F.struct("a", "_m"), "place").alias("_f"))
    return first.select(
        "name", F.col("_f.a").alias("word"), F.col("_f._m.b").alias("brand"), F.col("_f._m.score").alias("score")
    )
