"""Ingredient lines, amounts and recipe predicates on text built from order lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions import quantity as Q
from aislewise.functions import recipes as P
from aislewise.functions import text as X
from aislewise.functions.lexicon import Lexicon
from aislewise.functions.numeric import rounded
from aislewise.functions.similarity import sequence_ratio, token_set_ratio
from aislewise.operators import labels as L
from aislewise.plans.similarity_sql import token_set_sql
from aislewise.plans.views import Registry, sql_round as r, view
from aislewise.session import widen

REGISTRY = Registry()
add = REGISTRY.add

LINE_SQL = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_name, p_type, p_size,
      cast(cast(l_quantity as int) as varchar) as qty from {lineitem} join {part} on p_partkey = l_partkey"""


def lines(spark, sf):
    part = view(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    rows = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return widen(rows).join(part, "l_partkey").withColumn("qty", F.col("l_quantity").cast("int").cast("string"))


def case4(values, selector="l_linenumber"):
    out = F.lit(values[3])
    for i in (2, 1, 0):
        out = F.when(F.col(selector) % 4 == i, values[i]).otherwise(out)
    return out


@add("parse_ingredient", f"""with l as ({LINE_SQL})
     select l_orderkey, l_linenumber, l_partkey,
       case l_linenumber % 4 when 0 then qty || ' 1/2' when 3 then qty || ',5' else qty end as amount,
       case l_linenumber % 4 when 0 then 'dl' when 1 then 'st' when 3 then 'kg.' else '' end as unit, p_name as name from l""")
def parse_ingredient(spark, sf):
    text = F.concat("qty", case4([" 1/2 dl ", " st ", "  ", ",5 kg. "]), "p_name")
    return lines(spark, sf).withColumn("_i", X.parse_ingredient(text)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "_i.*"
    )


@add("clean_ingredient", f"""with l as ({LINE_SQL}) select l_orderkey, l_linenumber, l_partkey, p_name as clean from l""")
def clean_ingredient(spark, sf):
    before = case4(["omkring 2 burkar ", "", "1,5 dl ", "helst "])
    after = case4([" (2 dl)", " till degen", " utan skal 2x2 cm", ""])
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", X.clean_ingredient(F.concat(before, "p_name", after)).alias("clean")
    )


@add("paren_alternatives", f"""with l as ({LINE_SQL}) select l_orderkey, l_linenumber, l_partkey,
     case l_linenumber % 4 when 1 then lower(p_type) || ',plommon' when 2 then lower(p_type) else '' end as alternatives from l""")
def paren_alternatives(spark, sf):
    inside = F.concat(
        "p_name",
        case4([" (färsk eller torkad)", " (exempelvis ", " (såsom ", " (2 dl, "]),
        F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.lower("p_type")),
        case4(["", " eller plommon)", ")", ")"]),
    )
    return lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.array_join(X.paren_alternatives(inside), ",").alias("alternatives"),
    )


@add("search_terms", f"""with l as ({LINE_SQL}) select l_orderkey, l_linenumber, l_partkey,
     p_name || ' eller ' || lower(p_type) || '|' || p_name || '|' || lower(p_type) as terms from l""")
def search_terms(spark, sf):
    # Every distinct text is taken apart once; the lines then look their terms up.
    text = F.concat("qty", F.lit(" dl "), "p_name", F.lit(" eller "), F.lower("p_type"))
    rows = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    terms = F.array_join(X.search_terms(F.col("text")), "|")
    known = rows.select("text").distinct().select("text", terms.alias("terms"))
    return rows.join(known, "text").drop("text")


@add("head_word", "select p_partkey, split_part(p_name, ' ', 2) as head from {part}")
def head_word(spark, sf):
    return view(spark, sf, "part").select("p_partkey", X.head_word(F.col("p_name")).alias("head"))


INFLECTED = "['" + "', '".join(X.INFLECTIONS) + "']"


def words_sql(text):
    return f"regexp_extract_all(lower({text}), '[a-zåäöéè]+')"


def docs(spark, sf):
    """Documents with their first line as a name."""
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return view(spark, sf, "documents").select("doc_id", "text", "lang", "source", line.alias("line"))


DOCS_SQL = "docs as (select doc_id, text, lang, source, split_part(coalesce(text, ''), chr(10), 1) as line from {documents})"


@add("head_word_score", f"""with {DOCS_SQL}, w as (select doc_id, {words_sql("line")} as ws, {words_sql("text")}[-1] as head from docs),
     f as (select *, ws[1] as first, head[length(ws[1]) + 1:] as tail from w)
     select doc_id, cast(case when coalesce(head, '') = '' or len(ws) = 0 then 0 when first = head then 3
       when list_contains(ws, head) or len(list_filter(ws, lambda w: length(w) >= 6 and len(list_filter({INFLECTED},
            lambda e: length(head) > length(w) + length(e) and ends_with(head, w || e))) > 0)) > 0 then 2
       when len(list_filter(ws, lambda w: ends_with(w, head) and length(w) > length(head))) > 0 then 1
       when length(first) >= 4 and starts_with(head, first) and (list_contains({INFLECTED}, tail) or length(tail) >= 3) then 1
       else 0 end as int) as score from f""")
def head_word_score(spark, sf):
    """How well the first line of a document names its last word."""
    head = X.head_word(F.col("text"))
    return docs(spark, sf).select("doc_id", X.head_word_score(F.col("line"), head).cast("int").alias("score"))


@add("first_number", f"""with l as ({LINE_SQL}) select l_orderkey, l_linenumber, l_partkey,
     {r('cast(qty as double) + 0.5e0')} as number from l""")
def first_number(spark, sf):
    text = F.concat(F.lower("p_type"), F.lit(": "), "qty", F.lit(",5 kcal 7"))
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(Q.first_number(text)).alias("number")
    )


@add("parse_number_fraction", f"""with l as ({LINE_SQL}) select l_orderkey, l_linenumber, l_partkey,
     {r("case l_linenumber % 4 when 0 then cast(qty as double) when 1 then cast(qty as double) + 0.5e0 when 2 then cast(qty as double) / 4e0 else cast(qty as double) + 0.75e0 end")}
     as number from l""")
def parse_number_fraction(spark, sf):
    text = F.concat("qty", case4(["", " 1/2", "/4", " ¾"]))
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(Q.parse_number(text)).alias("number")
    )


NEED_SQL = f"""with l as ({LINE_SQL}), n as (select *, cast(qty as double) *
        case l_linenumber % 4 when 0 then 100e0 when 1 then 1e0 when 2 then 1000e0 else 15e0 end as base,
        case l_linenumber % 4 when 0 then 'volym' when 1 then 'antal' when 2 then 'vikt' else 'volym' end as dim,
        case when p_size % 3 = 0 then cast(p_size * 10 as double) when p_size % 3 = 1 then p_size * 100e0 else cast(p_size as double) end as pack,
        case when p_size % 3 = 0 then 'volym' when p_size % 3 = 1 then 'vikt' else 'antal' end as pdim from l)"""


def needs(spark, sf):
    need = F.concat(F.lit("ca "), "qty", case4([" dl", " st", "kg", " msk"]))
    size = F.col("p_size").cast("string")
    pack = (
        F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" "), size, F.lit("cl")))
        .when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" 3g "), size, F.lit(" hg")))
        .otherwise(F.concat("p_name", F.lit(" "), size, F.lit("-p")))
    )
    return lines(spark, sf).withColumn("need", Q.quantity_base(need)).withColumn("pack", Q.package_size(pack))


@add("quantity_base", NEED_SQL + f" select l_orderkey, l_linenumber, l_partkey, {r('base')} as base, dim from n")
def quantity_base(spark, sf):
    return needs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded("need.base").alias("base"), F.col("need.dim").alias("dim")
    )


@add("package_size", NEED_SQL + f" select l_orderkey, l_linenumber, l_partkey, {r('pack')} as pack, pdim from n")
def package_size(spark, sf):
    return needs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded("pack.base").alias("pack"), F.col("pack.dim").alias("pdim")
    )


@add("packages_needed", NEED_SQL + f""" select l_orderkey, l_linenumber, l_partkey,
     cast(case when dim = pdim then greatest(1, ceil(base / pack)) end as bigint) as packages,
     {r('case when dim = pdim then greatest(1, ceil(base / pack)) * pack - base end')} as rest from n
     where dim = pdim""")
def packages_needed(spark, sf):
    need, pack = F.col("need"), F.col("pack")
    return needs(spark, sf).filter("need.dim = pack.dim").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        Q.packages_needed(need, pack).cast("long").alias("packages"),
        rounded(Q.package_rest(need, pack)).alias("rest"),
    )


@add("used_share", NEED_SQL + f""" select l_orderkey, l_linenumber, l_partkey,
     {r('case when dim = pdim then base / pack else 1e0 end')} as share from n""")
def used_share(spark, sf):
    return needs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(Q.used_share(F.col("need"), F.col("pack"))).alias("share")
    )


@add("format_quantity", NEED_SQL + """ select l_orderkey, l_linenumber, l_partkey,
     case when dim = 'vikt' then cast(cast(base / 1000 as bigint) as varchar) || ' kg'
        when dim = 'volym' and base >= 1000 then regexp_replace(cast(cast(base as bigint) / 1000e0 as varchar), '\\.0$', '') || ' l'
        when dim = 'volym' and base >= 100 and base % 100 = 0 then cast(cast(base / 100 as bigint) as varchar) || ' dl'
        when dim = 'volym' then cast(cast(base as bigint) as varchar) || ' ml'
        else cast(cast(base as bigint) as varchar) || ' st' end as text from n""")
def format_quantity(spark, sf):
    return needs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", Q.format_quantity(F.col("need.base"), F.col("need.dim")).alias("text")
    )


@add("iso8601_minutes", """select o_orderkey, cast(coalesce(nullif(case when o_orderkey % 3 = 0 then o_orderkey % 90
     when o_orderkey % 3 = 1 then 60 * (o_orderkey % 4) + o_orderkey % 60 else 60 * (o_orderkey % 5) end, 0), -1) as int) as minutes
     from {orders}""")
def iso8601_minutes(spark, sf):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("PT"), (k % 90).cast("string"), F.lit("M")))
        .when(k % 3 == 1, F.concat(F.lit("PT"), (k % 4).cast("string"), F.lit("H"), (k % 60).cast("string"), F.lit("M")))
        .otherwise(F.concat(F.lit("PT"), (k % 5).cast("string"), F.lit("H")))
    )
    return view(spark, sf, "orders").select("o_orderkey", F.coalesce(Q.iso8601_minutes(text), F.lit(-1)).alias("minutes"))


@add("needs_context_route", """select doc_id, contains(lower(text), 'recept') or contains(lower(text), 'middag')
     or contains(lower(text), 'tion') as routed from {documents}""")
def needs_context_route(spark, sf):
    words = F.array(*[F.lit(w) for w in ("recept", "middag", "tion")])
    return view(spark, sf, "documents").select(
        "doc_id", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("routed")
    )


@add("word_match_score", f"""with p as (select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b,
        cast(p_size % 7 as int) as pos from {{part}}),
     e as (select p_partkey, pos, unnest([1, 2, 3, 4, 5, 6, 7]) as kind, a, b from p),
     w as (select p_partkey, kind, pos, greatest(0e0, 0.1e0 - pos * 0.02e0) as bonus,
        case kind when 1 then a when 2 then b when 3 then b when 4 then b || 'er' when 5 then b when 6 then 'mini' || b else b || 'tärning' end as q,
        case kind when 1 then a when 2 then b || 'er' when 3 then b || 'xq' when 4 then b when 5 then 'mini' || b when 6 then 'zz' || b else b end as t from e)
     select p_partkey, kind, {r('''case when q = t then 1 + bonus when kind = 2 then 0.95e0 + bonus
        when starts_with(t, q) then 0.6e0
        when length(q) >= 4 and ends_with(t, q) then 0.85e0
        when length(q) >= 5 and contains(t, q) then 0.75e0
        when length(t) >= 4 and starts_with(q, t) then
           case when length(t) / cast(length(q) as double) >= 0.6e0 then 0.85e0
                when length(t) / cast(length(q) as double) >= 0.45e0 then 0.72e0 + bonus else 0.65e0 + bonus end
        else 0 end''')} as score from w""")
def word_match_score(spark, sf):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kinds = [
        (a, a),
        (b, F.concat(b, F.lit("er"))),
        (b, F.concat(b, F.lit("xq"))),
        (F.concat(b, F.lit("er")), b),
        (b, F.concat(F.lit("mini"), b)),
        (F.concat(F.lit("mini"), b), F.concat(F.lit("zz"), b)),
        (F.concat(b, F.lit("tärning")), b),
    ]
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("kind"), q.alias("q"), t.alias("t")) for i, (q, t) in enumerate(kinds)])
    rows = view(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("pos"), F.inline(pairs))
    return rows.select(
        "p_partkey", "kind", rounded(X.word_match(F.col("q"), F.col("t"), F.col("pos"))).alias("score")
    )


@add("sequence_ratio")
def ratio_query(spark, sf):
    pairs = view(spark, sf, "part").select("p_name", F.concat_ws(" ", "p_type", "p_name").alias("other")).distinct()
    return pairs.withColumn("ratio", sequence_ratio("p_name", F.lower("other")))


@add("token_set_ratio", f"""with d as (select distinct p_name, p_type || ' ' || p_brand as other from {{part}}),
   {token_set_sql("z", "select p_name as a, lower(other) as b from d")}
   select p_name, other, score as ratio from d join z on a = p_name and b = lower(other)""")
def token_set_query(spark, sf):
    pairs = view(spark, sf, "part").select("p_name", F.concat_ws(" ", "p_type", "p_brand").alias("other")).distinct()
    return pairs.withColumn("ratio", token_set_ratio("p_name", F.lower("other")))


# Words of the given documents stand in for those of recipes.
TEXT_LEX = Lexicon(
    pantry=("cold rod", "blue gear"),
    not_food=("old anvil",),
    organic=("zung", "ouio", "cion "),
    derived_forms=("ring", "widget", "old"),
    derived_categories=("small", "promo "),
    non_food_departments=("Brand#3", "Brand#11"),
    meat_fish=("oura", "verschl", "hot"),
    animal=("oura", "verschl", "hot", "eaux", "unge", "plate"),
    embedded_fish=("thst", "euxa"),
    english_meat=("ndwh", "gizmo"),
    dairy_inside=("tz",),
    dairy_lookalikes=("itz",),
    excused=(("quel", "tion"), ("new", "rod")),
    imitations=("tre", "schi"),
    imitation_words=("un", "the"),
    non_meal=("web", "forum", "en"),
    non_meal_endings=("ing", "aux.", "os"),
    drinks=("th", "qu", "sch"),
    protein_sources=(("one", ("ouxi", "erenst"), True), ("two", ("verun", "lale", "anment"), False), ("three", ("los", "the"), True)),
)


def starts_sql(text, terms):
    """A term at a word start."""
    return f"regexp_matches({text}, '(^|[^\\pL\\pN_])({'|'.join(terms)})')"


def inside_sql(text, terms):
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def forbidden_sql(text, vegan):
    lex, plain = TEXT_LEX, text
    for word in lex.dairy_lookalikes:
        plain = f"replace({plain}, '{word}', ' ')"
    strict = f"({starts_sql(text, lex.animal)} or {inside_sql(plain, lex.dairy_inside)})"
    return f"({inside_sql(text, lex.embedded_fish)} or case when {vegan} then {strict} else {starts_sql(text, lex.meat_fish)} end)"


def breaks_sql(text, diet):
    excused = " or ".join(f"(contains({text}, '{t}') and not contains({text}, '{e}'))" for t, e in TEXT_LEX.excused)
    vegan = f"coalesce({diet} = 'veganskt', false)"
    return f"""({diet} is not null and ({forbidden_sql(text, vegan)} or {inside_sql(text, TEXT_LEX.english_meat)}
        or ({vegan} and ({excused}))))"""


DIET_SQL = "case lang when 'en' then 'veganskt' when 'fr' then 'vegetariskt' when 'es' then 'veganskt' end"


def diet_of(lang):
    return F.when(lang.isin("en", "es"), "veganskt").when(lang == "fr", "vegetariskt")


def described_sql(word):
    lex = TEXT_LEX
    starts = " or ".join(f"starts_with({word}, '{t}')" for t in lex.imitations)
    listed = ", ".join(f"'{t}'" for t in lex.imitation_words)
    return f"coalesce({starts} or {word} in ({listed}), false)"


COMPOUND_SQL = " or ".join(f"starts_with(w, '{t}')" for t in TEXT_LEX.imitation_words)


@add("diet_match", f"""with {DOCS_SQL}, t as (select doc_id, {DIET_SQL} as diet,
        case doc_id % 4 when 0 then 'veganskt' when 1 then 'vegetariskt' when 2 then '' end as tag,
        string_split_regex(replace(lower(line), '-', ' '), '\\s+') as ws from docs),
     u as (select *, array_to_string(list_filter(ws, lambda w, i: not {described_sql("w")} and not ({COMPOUND_SQL})
        and not (i > 1 and {described_sql("ws[i - 1]")})), ' ') as plain from t)
     select doc_id, diet is null or ((coalesce(tag, '') = '' or (diet = 'veganskt' and tag = 'veganskt') or diet = 'vegetariskt')
        and not {forbidden_sql("plain", "diet = 'veganskt'")}) as ok from u""")
def diet_match(spark, sf):
    k = F.col("doc_id")
    tag = F.when(k % 4 == 0, "veganskt").when(k % 4 == 1, "vegetariskt").when(k % 4 == 2, "")
    return docs(spark, sf).select("doc_id", P.diet_match(tag, F.col("line"), diet_of(F.col("lang")), TEXT_LEX).alias("ok"))


@add("is_non_meal", f"""with {DOCS_SQL}, t as (select doc_id, lower(coalesce(source, '') || ' ' || coalesce(lang, '')) as kind, lower(line) as title from docs)
     select doc_id, {starts_sql("kind", TEXT_LEX.non_meal)} or (not contains(title, ' med ') and
        ({" or ".join(f"ends_with(string_split_regex(trim(title), '\\s+')[-1], '{e}')" for e in TEXT_LEX.non_meal_endings)})) as non_meal from t""")
def is_non_meal(spark, sf):
    kinds = F.array(F.coalesce("source", F.lit("")))
    return docs(spark, sf).select(
        "doc_id", P.is_non_meal(kinds, F.col("lang"), F.col("line"), TEXT_LEX).alias("non_meal")
    )


SOURCES_SQL = " ".join(
    f"when {(inside_sql if anywhere else starts_sql)('text', terms)} then '{name}'" for name, terms, anywhere in TEXT_LEX.protein_sources
)


@add("protein_source", f"""with t as (select doc_id, lower(coalesce(text, '')) as text from {{documents}})
     select doc_id, case {SOURCES_SQL} else 'övrigt' end as source from t""")
def protein_source(spark, sf):
    return view(spark, sf, "documents").select("doc_id", P.protein_source(F.col("text"), TEXT_LEX).alias("source"))


@add("is_drink", f"""with {DOCS_SQL} select doc_id, len(list_filter(string_split(line, ' '), lambda w: {inside_sql("lower(w)", TEXT_LEX.drinks)})) >= 3
     as drink from docs""")
def is_drink(spark, sf):
    return docs(spark, sf).select("doc_id", P.is_drink(F.split("line", " "), TEXT_LEX).alias("drink"))


PANTRY = (*TEXT_LEX.pantry, *TEXT_LEX.not_food)


@add("is_pantry", f"""with l as ({LINE_SQL}) select l_orderkey, l_linenumber, l_partkey,
     p_name in ({", ".join(f"'{t}'" for t in PANTRY)}) as pantry from l""")
def is_pantry(spark, sf):
    text = F.concat(case4(["", "omkring 2 ", "1,5 dl ", ""]), "p_name", case4(["", " (2 dl)", "", " till degen"]))
    return lines(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", P.is_pantry(text, TEXT_LEX).alias("pantry")
    )


@add("is_organic", f"""with t as (select doc_id, lower(coalesce(text, '') || ' ' || coalesce(source, '') || ' ' || coalesce(lang, '')) as text from {{documents}})
     select doc_id, {inside_sql("text", TEXT_LEX.organic)} as organic from t""")
def is_organic(spark, sf):
    tags = F.array(F.coalesce("lang", F.lit("")))
    return view(spark, sf, "documents").select(
        "doc_id", P.is_organic(F.col("text"), F.col("source"), tags, TEXT_LEX).alias("organic")
    )


#: Each part with the name of another as the ingredient asked for, which may be a part of its own name.
ASKED_PARTS = """asks as (select p.p_partkey, p.p_name, p.p_type, p.p_brand, case p.p_partkey % 3 when 0 then split_part(o.p_name, ' ', 2)
      else o.p_name end as asked, case p.p_size % 3 when 0 then 'veganskt' when 1 then 'vegetariskt' end as diet
      from {part} p join {part} o on o.p_partkey = p.p_partkey // 2 + 1)"""


def asked_parts(spark, sf):
    part = view(spark, sf, "part")
    other = part.select(F.col("p_partkey").alias("_o"), F.col("p_name").alias("_n"))
    rows = part.join(other, F.expr("_o = p_partkey div 2 + 1"))
    asked = F.when(F.col("p_partkey") % 3 == 0, F.split_part("_n", F.lit(" "), F.lit(2))).otherwise(F.col("_n"))
    diet = F.when(F.col("p_size") % 3 == 0, "veganskt").when(F.col("p_size") % 3 == 1, "vegetariskt")
    return rows.select("p_partkey", "p_name", "p_type", "p_brand", asked.alias("asked"), diet.alias("diet"))


def derived_sql():
    asked, named = words_sql("asked"), words_sql("p_name")
    cats = " or ".join(f"(contains(lower(p_type), '{t}') and not contains(lower(asked), '{t.strip()}'))" for t in TEXT_LEX.derived_categories)
    forms = " or ".join(f"(contains(lower(p_name), '{t}') and not contains(lower(asked), '{t}'))" for t in TEXT_LEX.derived_forms)
    explicit = f"""(len({asked}) > 0 and len(list_filter({asked}, lambda w: not list_contains({named}, w))) = 0
        and coalesce(list_contains({asked}, {named}[1]), false))"""
    return f"(not {explicit} and ({cats} or {forms}))"


@add("is_derived_form", f"with {ASKED_PARTS} select p_partkey, {derived_sql()} as derived from asks")
def is_derived_form(spark, sf):
    derived = P.is_derived_form(F.col("p_name"), F.col("p_type"), F.col("asked"), TEXT_LEX)
    return asked_parts(spark, sf).select("p_partkey", derived.alias("derived"))


BARRED = ", ".join(f"'{d}'" for d in TEXT_LEX.non_food_departments)
PART_TEXT = "lower(p_name || ' ' || p_type)"


@add("valid_candidate", f"""with {ASKED_PARTS} select p_partkey, p_brand not in ({BARRED}) and not {breaks_sql(PART_TEXT, "diet")}
     and not {derived_sql()} as ok from asks""")
def valid_candidate(spark, sf):
    columns = (F.col(c) for c in ("p_name", "p_type", "p_brand", "diet", "asked"))
    return asked_parts(spark, sf).select("p_partkey", P.valid_candidate(*columns, TEXT_LEX).alias("ok"))


@add("diet_conflict", f"""with t as (select doc_id, lower(coalesce(text, '') || ' ' || coalesce(source, '')) as text, {DIET_SQL} as diet from {{documents}})
     select doc_id, {breaks_sql("text", "diet")} as conflict from t""")
def diet_conflict(spark, sf):
    conflict = P.product_breaks_diet(F.col("text"), F.col("source"), diet_of(F.col("lang")), TEXT_LEX)
    return view(spark, sf, "documents").select("doc_id", conflict.alias("conflict"))


TEXT_LINES = """select conv_id, turn, text, string_split(text || chr(10) || '{"namn": " Mjölk ", "bbox": [' || (turn + 9)
       || ', 4, 3, 8]},' || chr(10) || '1234 .', chr(10)) as parts from {conversations} where role = 'assistant'"""


@add("parse_label_lines", f"""with c as ({TEXT_LINES}),
     l as (select conv_id, turn, unnest(parts) as raw, unnest(range(len(parts))) as line_no from c),
     s as (select *, regexp_replace(trim(raw, ' ' || chr(9) || chr(13)), ',+$', '') as line from l),
     f as (select conv_id, turn, line_no, line,
           trim(replace(replace(trim(ltrim(line, '0123456789.-) ')), '*', ''), '#', '')) as plain from s),
     t as (select conv_id, turn, line_no, case when starts_with(line, chr(123)) then 'Mjölk' else plain end as name,
            case when starts_with(line, chr(123)) then 3e0 / 2 end as x1 from f)
     select conv_id, turn, line_no, name, x1 from t
     where name <> '' and (x1 is not null or (not regexp_matches(lower(name),
        '{"|".join(Lexicon().label_noise)}')
        and not regexp_full_match(regexp_replace(name, '[ .,:-]', '', 'g'), '\\d+')))""")
def parse_label_lines(spark, sf):
    extra = F.concat(
        F.lit('\n{"namn": " Mjölk ", "bbox": ['), (F.col("turn") + 9).cast("string"), F.lit(", 4, 3, 8]},\n1234 .")
    )
    rows = (
        widen(view(spark, sf, "conversations"))
        .filter("role = 'assistant'")
        .select("conv_id", "turn", F.concat("text", extra).alias("response"), F.lit(2.0).alias("scale"))
    )
    return L.parse_label_lines(rows, Lexicon()).select(
        "conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), "name", F.col("bbox")[0].alias("x1")
    )


@add("ocr_line_filter", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line,
        unnest(range(len(string_split(text, chr(10))))) as n from {{documents}}),
     c as (select *, (length(line) + n) % 100 / 100e0 as conf from l)
     select doc_id, count(*) filter (conf >= 0.3e0 and length(line) > 1) as kept, {r('avg(conf)')} as mean_conf,
        max(length(line)) as longest from c group by doc_id""")
def ocr_line_filter(spark, sf):
    rows = view(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.withColumn("confidence", (F.length("line") + F.col("n")) % 100 / F.lit(100.0))
    out = L.ocr_summary(rows, "doc_id", "line", "confidence", "n")
    return out.select(
        "doc_id",
        "kept",
        rounded("mean_confidence").alias("mean_conf"),
        F.length("fallback").cast("long").alias("longest"),
    )


@add("recognition_quality_report", f"""with d as (select d.doc_id, lang, quality, toxic, n_chars from {{documents}} d left join {{labels}} l on l.doc_id = d.doc_id),
     s as (select lang, count(*) as n, avg(case when quality = 1 then 1e0 else 0e0 end) as brand_share,
        avg(case when toxic = 1 then 1e0 else 0e0 end) as corrected_share, avg(n_chars % 10) as tags,
        avg(n_chars % 100 / 100e0) as conf from d group by lang)
     select lang, n, {r('brand_share')} as brand_share, {r('corrected_share')} as corrected_share, {r('tags')} as mean_tags,
        {r('conf')} as mean_confidence, concat_ws(',', case when brand_share < 0.5e0 then 'brands' end,
          case when corrected_share > 0.45e0 then 'corrections' end, case when conf < 0.6e0 then 'image' end,
          case when tags < 5 then 'tags' end) as advice from s""")
def recognition_quality_report(spark, sf):
    rows = view(spark, sf, "documents").join(view(spark, sf, "labels"), "doc_id", "left").select(
        "lang",
        (F.coalesce("quality", F.lit(0)) == 1).alias("brand_matched"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("corrected"),
        (F.col("n_chars") % 10).alias("n_tags"),
        (F.col("n_chars") % 100 / F.lit(100.0)).alias("confidence"),
    )
    out = L.quality_report(rows, ["lang"])
    shares = ("brand_share", "corrected_share", "mean_tags", "mean_confidence")
    return out.select("lang", "n", *[rounded(c).alias(c) for c in shares], F.array_join("advice", ",").alias("advice"))


@add("latest_tool_products", """with a as (select conv_id, turn, text from {conversations} where role = 'assistant' and length(text) % 3 > 0)
     select conv_id, max(turn) as turn, max_by(length(text), turn) as product_id from a group by conv_id""")
def latest_tool_products(spark, sf):
    # The tool result is JSON made from the turn: a list under one of three keys, or an empty one.
    size = F.length("text")
    body = F.concat(
        F.lit('{"'),
        F.when(F.col("turn") % 2 == 0, "produkter").otherwise("alternativ"),
        F.lit('": ['),
        F.when(size % 3 > 0, F.concat(F.lit('{"id": "'), size.cast("string"), F.lit('"}'))).otherwise(""),
        F.lit("]}"),
    )
    rows = view(spark, sf, "conversations").filter("role = 'assistant'").withColumn("content", body)
    out = L.latest_tool_products(rows)
    return out.select("conv_id", "turn", F.col("products")[0]["id"].cast("long").alias("product_id"))
