"""Search of parts by queries taken from part names, types and document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.numeric import rounded
from aislewise.operators import search as S
from aislewise.plans.similarity_sql import proc_sql, token_set_sql
from aislewise.plans.views import Registry, sql_round as r, view

REGISTRY = Registry()
add = REGISTRY.add

LEX = Lexicon(
    product_words=("bolt", "gear"),
    brands=("brand#7",),
    attributes=("red", "blue"),
    non_food=("promo",),
    exclusions={"rod": ("old",)},
    primary={"ring": ("economy",), "plate": ("large",)},
    secondary={"ring": ("small",)},
    specific=("hot",),
    common_sizes=("new",),
    synonyms={"ring": ("economy", "gizmo"), "rod": ("standard",)},
    concepts={"cold": ("promo", "anvil")},
    whole_words=("old", "hot"),
)

ASKED_SQL = """asked as (select query, row_number() over (order by query) as query_id from (
     select distinct p_name as query from {part} union
     select distinct lower(p_type) || ' ' || split_part(p_name, ' ', 2) from {part} union
     select distinct substr(p_name, 2, 7) from {part}))"""
ID_SQL = """asked as (select distinct query from (select p_name as query from {part} union all
     select lower(p_type) || ' ' || split_part(p_name, ' ', 2) from {part}))"""


def asked(spark, sf, pieces=False):
    """Distinct query texts; the text is its own id."""
    part = view(spark, sf, "part")
    rows = part.select(F.col("p_name").alias("query")).unionByName(
        part.select(
            F.concat_ws(" ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("query")
        )
    )
    if pieces:
        rows = rows.unionByName(part.select(F.substring("p_name", 2, 7).alias("query")))
    return rows.distinct().withColumn("query_id", F.col("query"))


WORD_SCORE = """case when q = t then 1 + greatest(0e0, 0.1e0 - tpos * 0.02e0)
     when starts_with(t, q) and t[length(q) + 1:] in ('s', 'r', 'n', 't', 'a', 'e', 'er', 'ar', 'or', 'en', 'et', 'na',
        'as', 'rs', 'ns', 'ts', 'ena', 'erna', 'arna', 'orna') then 0.95e0 + greatest(0e0, 0.1e0 - tpos * 0.02e0)
     when starts_with(t, q) then 0.6e0 when length(q) >= 4 and ends_with(t, q) then 0.85e0
     when length(q) >= 5 and contains(t, q) then 0.75e0
     when length(t) >= 4 and starts_with(q, t) then case when length(t) / cast(length(q) as double) >= 0.6e0 then 0.85e0
        when length(t) / cast(length(q) as double) >= 0.45e0 then 0.72e0 + greatest(0e0, 0.1e0 - tpos * 0.02e0)
        else 0.65e0 + greatest(0e0, 0.1e0 - tpos * 0.02e0) end
     else 0e0 end"""

FUZZY_SQL = f"""with {ID_SQL},
  texts as (select lower(name || ' ' || brand) as text, min(ord) as ord, max_by(product_id, c.ord) as product_id,
     max_by(name, c.ord) as name, lower(max_by(category, c.ord)) as category from {{catalogue}} c group by 1),
  qw as (select query, unnest(list_filter(string_split(query, ' '), lambda x: length(x) > 1)) as q from asked),
  tw as (select text, unnest(string_split(text, ' ')) as t, unnest(range(len(string_split(text, ' ')))) as tpos from texts),
  qd as (select distinct q from qw),
  bw as (select text, q, max({WORD_SCORE}) as best from tw, qd group by 1, 2),
  m as (select qw.query, bw.text, qw.q, best, q in ('red', 'blue') as attr,
     (q in ('brand#7') or contains('bolt', q) or contains('gear', q)) as known from qw join bw using (q)),
  k as (select *, not attr and (known or best >= 1) as key from m),
  a as (select query, text, bool_or(key and best >= 0.5e0) as any_key, min(best) as lowest, avg(best) as mean_all,
     min(case when not attr then best else 1 end) as lowest_plain,
     avg(best) filter (key) as key_mean, sum(case when key then 0 when attr then best * 0.1e0 else best * 0.3e0 end) as extra
     from k group by 1, 2),
  v as (select query, text, case when any_key then case when lowest_plain < 0.5e0 then 0 else key_mean + extra end
     else case when lowest < 0.5e0 then 0 else mean_all end end as mean from a),
  s as (select v.query, t.*, case when mean >= 1 then greatest(78e0, 100 - least(12e0, length(text) / 10e0))
     when mean >= 0.9e0 then greatest(70e0, 92 - least(12e0, length(text) / 10e0))
     when mean >= 0.7e0 then 60 + mean * 25 when mean >= 0.5e0 then 45 + mean * 30 else mean * 40 end as s0,
     string_split(query, ' ') as ws from v join texts t using (text) where mean > 0),
  p as (select *, case when list_contains(ws, 'ring') and contains(category, 'economy') then 1 else 0 end
       + case when list_contains(ws, 'plate') and contains(category, 'large') then 1 else 0 end as prim,
     list_contains(ws, 'ring') and contains(category, 'small') as sec, contains(category, 'promo') as nonfood from s),
  b as (select *, s0 + prim * 15 - case when sec and prim = 0 and not contains(query, 'hot') then 30 else 0 end as s1 from p),
  c as (select *, s1 + case when prim = 0 and not sec and not nonfood and s1 > 0 and len(list_filter(ws, lambda w: length(w) >= 3
       and starts_with(category, w))) > 0 then 8 else 0 end + case when contains(name, 'new') then 2 else 0 end as s2 from b),
  d as (select *, s2 - case when nonfood and s2 >= 40 then 30 else 0 end as s3 from c),
  e as (select query, product_id, ord, category, s3 - case when list_contains(ws, 'rod') and contains(name, 'old')
       and s3 >= 40 then 40 else 0 end as score from d),
  f as (select *, row_number() over (partition by query, product_id order by score desc, ord) as r1 from e where score >= 40),
  g as (select *, row_number() over (partition by query, category order by score desc, ord) as r2 from f where r1 = 1),
  h as (select *, cast(row_number() over (partition by query order by score desc, ord) as int) as rank from g where r2 <= 5)"""


@add("fuzzy_search_topk", FUZZY_SQL + f" select query as query_id, product_id, {r('score', 1)} as score, rank from h where rank <= 12")
def fuzzy_search_topk(spark, sf):
    out = S.fuzzy_search(asked(spark, sf), view(spark, sf, "catalogue"), LEX, n=12)
    return out.withColumn("score", rounded("score", 1))


@add("fuzzy_match_top1", FUZZY_SQL + f" select query as query_id, product_id, {r('score', 1)} as score from h where rank = 1 and round(score + 1e-9, 1) >= 70")
def fuzzy_match_top1(spark, sf):
    out = S.fuzzy_match_top1(asked(spark, sf), view(spark, sf, "catalogue"), LEX)
    return out.withColumn("score", rounded("score", 1))


@add("fuzzy_word_score", FUZZY_SQL + f" select query, text, {r('s0')} as score from s")
def fuzzy_word_score(spark, sf):
    texts = S.search_texts(view(spark, sf, "catalogue"))
    return S.text_scores(asked(spark, sf).select("query"), texts, LEX).select(
        "query", "text", rounded("score").alias("score")
    )


@add("search_boosts", FUZZY_SQL + f" select query, product_id, {r('score')} as score from e where score >= 40")
def search_boosts(spark, sf):
    texts = S.search_texts(view(spark, sf, "catalogue"))
    scored = S.text_scores(asked(spark, sf).select("query"), texts, LEX).join(texts, "text")
    boosted = S.boosted_score(
        F.col("score"), F.col("words"), F.col("query"), F.col("name"), F.col("category"), LEX
    )
    return scored.select("query", "product_id", rounded(boosted).alias("score")).filter("score >= 40")


INDEX_SQL = FUZZY_SQL.replace(
    ID_SQL,
    """asked as (select distinct query from (select p_name as query from {part} union all
     select split_part(p_name, ' ', 2) from {part}))""",
)


@add("recipe_match_index", INDEX_SQL + """,
   best as (select n.name, product_id, max(round(score + 1e-9, 1)) as score from (select distinct name from {catalogue}) n
      join h on h.query = n.name or h.query = split_part(n.name, ' ', 2) where rank <= 12 group by 1, 2),
   top as (select name, product_id, row_number() over (partition by name order by score desc, product_id) as rn from best),
   lines as (select distinct recipe_id, c.name from {ingredient} i join {catalogue} c using (product_id))
   select recipe_id, name as term, product_id from lines join top using (name) where rn = 1""")
def recipe_match_index(spark, sf):
    from aislewise.operators.recipe_search import match_index

    catalogue = view(spark, sf, "catalogue")
    lines = (
        view(spark, sf, "ingredient")
        .join(catalogue.select("product_id", "name"), "product_id")
        .select("recipe_id", "name")
    )
    index = match_index(lines, catalogue, LEX)
    return index.select(
        "recipe_id", F.col("name").alias("term"), F.col("candidates")[0]["product_id"].alias("product_id")
    ).distinct()


TERM_SQL = f"""with {ASKED_SQL},
  w as (select query, list_filter(string_split(regexp_replace(trim(query), '\\s+', ' ', 'g'), ' '), lambda x: length(x) >= 2) as ws from asked),
  e as (select query, ws, unnest(ws) as term, null as origin, true as orig from w
     union all select query, ws, unnest(['economy', 'gizmo']), 'ring', false from w where list_contains(ws, 'ring')
     union all select query, ws, unnest(['standard']), 'rod', false from w where list_contains(ws, 'rod')
     union all select query, ws, unnest(['promo', 'anvil']), null, false from w where contains(query, 'cold')),
  terms as (select query, len(ws) as n_words, term, bool_or(orig) as is_original,
     list(distinct origin) filter (origin is not null) as origins from e group by 1, 2, 3)"""


@add("expand_terms", TERM_SQL + """ select query as query_id, term, is_original,
     coalesce(array_to_string(list_sort(origins), ','), '') as origins from terms""")
def expand_terms(spark, sf):
    return S.expand_terms(asked(spark, sf, True), LEX).select(
        "query_id", "term", "is_original", F.array_join("origins", ",").alias("origins")
    )


PREFILTER_SQL = TERM_SQL + """,
  p as (select product_id, ord, name, lower(brand) as brand, lower(category) as category from {catalogue}),
  s as (select query, n_words, product_id, ord, case when list_contains(string_split(name, ' '), term) then 15
        when contains(name, term) then 8 else 0 end + case when contains(category, term) then 10 else 0 end
        + case when contains(brand, term) then 3 else 0 end as pts,
        case when is_original and contains(name, term) then term end as m1,
        case when contains(category, term) then origins end as m2
     from terms, p where contains(name, term) or contains(category, term) or contains(brand, term)),
  a as (select query, n_words, product_id, ord, sum(pts) as pts,
        len(list_distinct(flatten([coalesce(list(m1) filter (m1 is not null), []), coalesce(flatten(list(m2) filter (m2 is not null)), [])]))) as n
     from s group by all),
  f as (select query, product_id, ord, cast(pts + case when n = n_words and n_words > 1 then 50 else 0 end as int) as score from a),
  g as (select query as query_id, product_id, score,
        cast(row_number() over (partition by query order by score desc, ord) as int) as rank from f where score > 0)"""


@add("prefilter_score", PREFILTER_SQL + " select * from g where rank <= 20")
def prefilter_score(spark, sf):
    out = S.prefilter(asked(spark, sf, True), view(spark, sf, "catalogue"), LEX, n=20)
    return out.withColumn("score", F.col("score").cast("int"))


@add("prefilter_top50", PREFILTER_SQL + " select query_id, product_id, rank from g where rank <= 50")
def prefilter_top50(spark, sf):
    return S.prefilter(asked(spark, sf, True), view(spark, sf, "catalogue"), LEX).drop("score")


@add("local_search_score", f"""with {ASKED_SQL},
  w as (select query, list_filter(string_split(regexp_replace(trim(query), '\\s+', ' ', 'g'), ' '), lambda x: length(x) >= 2) as ws from asked),
  t as (select query, len(ws) as n, unnest(ws) as term from w),
  p as (select product_id, ord, string_split(name, ' ') as nw, lower(name || ' ' || brand || ' ' || category) as text from {{catalogue}}),
  d as (select *, string_split(text, ' ') as aw from p),
  s as (select query, n, product_id, ord, term in ('old', 'hot') or length(term) <= 3 as whole, term, nw, aw, text
     from t, d where contains(text, term)),
  x as (select query, n, product_id, ord, case when list_contains(nw, term) then 20 when list_contains(aw, term) then 12
        when not whole and len(list_filter(aw, lambda a: starts_with(a, term))) > 0 then 15
        when not whole and not contains(text, term || 'fri') then 5 else 0 end as pts,
        case when not whole or list_contains(aw, term) then 1 else 0 end as found from s),
  a as (select query, product_id, ord, sum(pts) + case when n > 1 and sum(found) = n then 10 else 0 end as score, sum(pts) as base
     from x group by query, n, product_id, ord),
  g as (select query as query_id, product_id, cast(score as int) as score,
     cast(row_number() over (partition by query order by score desc, ord) as int) as rank from a where base > 0)
  select * from g where rank <= 20""")
def local_search_score(spark, sf):
    out = S.local_search(asked(spark, sf, True), view(spark, sf, "catalogue"), LEX)
    return out.withColumn("score", F.col("score").cast("int"))


BRAND_ASK = "select o_orderkey as query_id, 'hitta ' || p_brand || ' ' || p_type as query from {orders} join {part} on p_partkey = o_custkey"


@add("brand_in_query", f"""with q as ({BRAND_ASK}), b as (select distinct lower(p_brand) as brand from {{part}}),
   m as (select query_id, brand, row_number() over (partition by query_id order by length(brand) desc, brand desc) as rn
     from q join b on contains(lower(query), brand))
   select query_id, brand from m where rn = 1""")
def brand_in_query(spark, sf):
    part = view(spark, sf, "part")
    orders = view(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("p_partkey"))
    asks = orders.join(part, "p_partkey").select(
        "query_id", F.concat(F.lit("hitta "), "p_brand", F.lit(" "), "p_type").alias("query")
    )
    return S.brand_in_query(asks, part.select(F.col("p_brand").alias("brand")))


CASCADE_SQL = """with q as (select distinct query from (select p_name as query from {part} union all
        select lower(p_brand) || ' ' || lower(p_type) from {part} union all select 'Finns ' || p_brand || ' här' from {part}
        union all select 'saknas ' || s_name from {supplier})),
   p as (select product_id, ord, name, lower(brand) as brand, lower(name || ' ' || brand || ' ' || category) as text from {catalogue}),
   t1 as (select query, min(ord) as o from q join p on contains(name, lower(query)) group by 1),
   t2 as (select query, min(ord) as o from q join p on contains(text, lower(query)) group by 1),
   b as (select query, brand, row_number() over (partition by query order by length(brand) desc, brand desc) as rn
      from q join (select distinct brand from p) on contains(lower(query), brand)),
   t5 as (select query, min(ord) as o from b join p on contains(p.brand, b.brand) where rn = 1 group by 1)"""

FOLDED = "translate(lower(query), 'åäöéú', 'aaoeu')"
FUZZY_TIER_SQL = f""",
   rest as (select q.query, {proc_sql(FOLDED)} as qn, {proc_sql("query")} as qp, b.brand from q left join (select * from b where rn = 1) b using (query)
      where query not in (select query from t1) and query not in (select query from t2)),
   k as (select {proc_sql("text")} as b, brand, min(ord) as o from p group by 1, 2),
   {token_set_sql("z", "select qn as a, b from rest, k union select qp, b from rest, k")},
   h as (select query, rest.brand, k.brand as found, score, side, o from (select query, brand, unnest([qn, qp]) as a, unnest([0, -1]) as side from rest) rest
      join z using (a) join k using (b) where score >= 65),
   t3 as (select query, brand, found, score, o from h qualify row_number() over (partition by query order by score desc, side desc, o) = 1),
   fixed as (select query, z.score as score, k.o as o from t3 join rest using (query) join k on contains(k.brand, t3.brand) join z on z.a = rest.qn and z.b = k.b
      where not contains(t3.found, t3.brand) and z.score >= 50
      qualify row_number() over (partition by query order by z.score desc, k.o) = 1)"""


@add("lookup_cascade_exact", CASCADE_SQL + """
   select q.query as query_id, coalesce(t1.o, t2.o, t5.o, -1) as product_id,
     case when t1.o is not null then 100e0 when t2.o is not null then 95e0 when t5.o is not null then 40e0 else 0e0 end as score
   from q left join t1 using (query) left join t2 using (query) left join t5 using (query)""")
def lookup_cascade_exact(spark, sf):
    """The cascade without its fuzzy tier."""
    return S.lookup_cascade(cascade_asks(spark, sf), view(spark, sf, "catalogue"), fuzzy=False).withColumn(
        "product_id", F.coalesce("product_id", F.lit(-1))
    )


WHOLE_CASCADE_SQL = CASCADE_SQL + FUZZY_TIER_SQL + """
   select q.query as query_id, coalesce(t1.o, t2.o, fixed.o, t3.o, t5.o, -1) as product_id,
     case when t1.o is not null then 100e0 when t2.o is not null then 95e0 when t3.o is not null then round(coalesce(fixed.score, t3.score))
       when t5.o is not null then 40e0 else 0e0 end as score
   from q left join t1 using (query) left join t2 using (query) left join t3 using (query) left join fixed using (query) left join t5 using (query)"""


@add("lookup_cascade", WHOLE_CASCADE_SQL)
def lookup_cascade(spark, sf):
    return S.lookup_cascade(cascade_asks(spark, sf), view(spark, sf, "catalogue")).withColumn(
        "product_id", F.coalesce("product_id", F.lit(-1))
    )


def cascade_asks(spark, sf):
    part, supplier = view(spark, sf, "part"), view(spark, sf, "supplier")
    texts = [
        part.select(F.col("p_name").alias("query")),
        part.select(F.concat_ws(" ", F.lower("p_brand"), F.lower("p_type")).alias("query")),
        part.select(F.concat_ws(" ", F.lit("Finns"), "p_brand", F.lit("här")).alias("query")),
        supplier.select(F.concat_ws(" ", F.lit("saknas"), "s_name").alias("query")),
    ]
    rows = texts[0]
    for t in texts[1:]:
        rows = rows.unionByName(t)
    return rows.distinct().withColumn("query_id", F.col("query"))


@add("lookup_cascade_fuzzy", WHOLE_CASCADE_SQL)
def lookup_cascade_fuzzy(spark, sf):
    """The same as ``lookup_cascade``, which has its fuzzy tier too."""
    return lookup_cascade(spark, sf)


@add("fuzzy_short_search", f"""with {ID_SQL}, d as (select distinct query, {proc_sql("query")} as a from asked),
   c as (select product_id, ord, {proc_sql("name || ' ' || brand || ' ' || category")} as b from {{catalogue}}),
   {token_set_sql("z", "select d.a, c.b from d, (select distinct b from c) c")},
   r as (select query, product_id, score, cast(row_number() over (partition by query order by score desc, ord) as int) as rank
      from d join z using (a) join c using (b) where score >= 40)
   select query as query_id, product_id, score, rank, max(score) over (partition by query) >= 75 as direct from r where rank <= 5""")
def fuzzy_short_search(spark, sf):
    return S.short_search(asked(spark, sf), view(spark, sf, "catalogue"))


@add("alias_match", f"""with {ID_SQL}, d as (select distinct query, {proc_sql("query")} as a from asked),
   c as (select min(p_partkey) as product_id, {proc_sql("p_name || ' ' || p_type")} as b from {{part}} group by 2),
   {token_set_sql("z", "select d.a, c.b from d, c")}
   select query as text_id, product_id, score from d join z using (a) join c using (b) where score >= 65
   qualify row_number() over (partition by query order by score desc, product_id) = 1""")
def alias_match(spark, sf):
    part = view(spark, sf, "part")
    texts = asked(spark, sf).select(F.col("query_id").alias("text_id"), F.col("query").alias("text"))
    aliases = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_partkey").alias("ord"),
        F.concat_ws(" ", "p_name", "p_type").alias("alias"),
    )
    return S.alias_match(texts, aliases)


@add("brand_match", f"""with d as (select distinct p_name || ' ' || replace(lower(p_brand), '#', 'x') || ' ' || p_type as name from {{part}}),
   w as (select name, unnest(ws) as a, unnest(range(len(ws))) as place from (select name, string_split({proc_sql("name")}, ' ') as ws from d)),
   c as (select distinct replace(lower(p_brand), '#', '') as b from {{part}}),
   {token_set_sql("z", "select w.a, c.b from (select distinct a from w) w, c")},
   g as (select a, b, score from z where score >= 78 qualify row_number() over (partition by a order by score desc, b desc) = 1)
   select name, a as word, b as brand, score from w join g using (a)
   qualify row_number() over (partition by name order by place) = 1""")
def brand_match(spark, sf):
    part = view(spark, sf, "part")
    brands = part.select(F.translate(F.lower("p_brand"), "#", "").alias("brand")).distinct()
    names = part.select(
        F.concat_ws(" ", "p_name", F.translate(F.lower("p_brand"), "#", "x"), "p_type").alias("name")
    ).distinct()
    return S.brand_match(names, brands)


def position_sql(name):
    """The three tiers for hits whose name is the SQL expression ``name`` of a part's own."""
    return f"""with placed as (select p_partkey as id, p_partkey as ord, p_name || ' ' || cast(p_size % 3 as varchar) as name,
      p_size * 1e0 as x from {{part}} where p_type <> 'SMALL'),
   n as (select lower(name) as name, max_by(x, ord) as x from placed group by 1),
   h as (select l_orderkey, l_linenumber, l_partkey, lower({name}) as name from (select *, p_name || ' ' || cast(p_size % 3 as varchar) as name
      from {{lineitem}} join {{part}} on p_partkey = l_partkey)),
   c as (select {proc_sql("name")} as b, max_by(x, ord) as x, min(ord) as o from placed group by 1),
   d as (select distinct name, {proc_sql("name")} as a from h where l_partkey not in (select id from placed) and name not in (select name from n)),
   {token_set_sql("z", "select d.a, c.b from d, c")},
   t as (select d.name, c.x from d join z using (a) join c using (b) where score >= 75
      qualify row_number() over (partition by d.name order by score desc, c.o) = 1)
   select l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as hit_id, {r('coalesce(i.x, n.x, t.x)')} as x,
      cast(case when i.x is not null then 1 when n.x is not null then 2 when t.x is not null then 3 else 0 end as int) as tier
   from h left join placed i on i.id = h.l_partkey left join n on n.name = h.name left join t on t.name = h.name"""


@add("position_lookup_cascade", position_sql("name"))
def position_lookup_cascade(spark, sf):
    return position_tiers(spark, sf, misread=False)


@add("position_lookup_cascade_fuzzy", position_sql("replace(name, 'e', 'c')"))
def position_lookup_cascade_fuzzy(spark, sf):
    """As ``position_lookup_cascade`` for hits whose names are misread."""
    return position_tiers(spark, sf, misread=True)


def position_tiers(spark, sf, misread):
    part = view(spark, sf, "part")
    name = F.concat_ws(" ", "p_name", (F.col("p_size") % 3).cast("string"))
    placed = part.filter("p_type <> 'SMALL'").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_partkey").alias("ord"),
        name.alias("name"),
        (F.col("p_size") * 1.0).alias("x"),
        F.lit(0.0).alias("y"),
        F.lit(0.0).alias("z"),
    )
    hits = (
        view(spark, sf, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("hit_id"),
            F.col("l_partkey").alias("product_id"),
            (F.translate(name, "e", "c") if misread else name).alias("name"),
        )
    )
    return S.position_cascade(hits, placed).select(
        "hit_id", rounded("x").alias("x"), F.coalesce("tier", F.lit(0)).alias("tier")
    )


CACHED_SQL = """sp as (select max(p_partkey) * 5 // 4 as span from {part}),
   cc as (select c_name as query, [c_custkey * 3 % span, c_custkey * 7 % span, c_custkey % span] as ids from {customer}, sp),
   qq as (select cast(o_orderkey as varchar) as query_id, 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') as query from {orders}),
   e0 as (select query_id, unnest(ids) as product_id, unnest(range(3)) as place from qq join cc using (query)),
   a0 as (select query_id, product_id, cast(row_number() over (partition by query_id order by place) as int) as rank
     from e0 where product_id in (select p_partkey from {part}))"""


@add("cached_answer", PREFILTER_SQL.replace(ASKED_SQL, ASKED_SQL + ", " + CACHED_SQL) + """
   select query_id, product_id, rank, true as cached from a0 where rank <= 2
   union all select query_id, product_id, rank, false from g where rank <= 2""")
def cached_answer(spark, sf):
    """Asks of known customers from the cache, those of part texts from the prefilter."""
    k, span = F.col("c_custkey"), F.col("span")
    ids = view(spark, sf, "part").agg(F.expr("max(p_partkey) * 5 div 4").alias("span"))
    cache = view(spark, sf, "customer").crossJoin(ids).select(
        F.col("c_name").alias("query"), F.array(k * 3 % span, k * 7 % span, k % span).alias("ids")
    )
    asks = view(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("query_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("query"),
    )
    asks = asks.unionByName(asked(spark, sf, True).select("query_id", "query"))
    return S.cached_answers(asks, cache, view(spark, sf, "catalogue"), 2, LEX)


@add("cached_answer_whole", """with s as (select max(p_partkey) * 5 // 4 as span from {part}),
   c as (select c_name as query, [c_custkey * 3 % span, c_custkey * 7 % span, c_custkey % span] as ids from {customer}, s),
   q as (select o_orderkey as query_id, 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') as query from {orders}),
   e as (select query_id, unnest(ids) as product_id, unnest(range(3)) as place from q join c using (query)),
   a as (select query_id, product_id, cast(row_number() over (partition by query_id order by place) as int) as rank
     from e where product_id in (select p_partkey from {part}))
   select * from a where rank <= 2""")
def cached_answer_whole(spark, sf):
    """Asks of known customers only; a fifth of the stored ids lies beyond the part table and no longer exists."""
    k, span = F.col("c_custkey"), F.col("span")
    ids = view(spark, sf, "part").agg(F.expr("max(p_partkey) * 5 div 4").alias("span"))
    cache = view(spark, sf, "customer").crossJoin(ids).select(
        F.col("c_name").alias("query"), F.array(k * 3 % span, k * 7 % span, k % span).alias("ids")
    )
    asks = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("query"),
    )
    return S.cached_answers(asks, cache, view(spark, sf, "catalogue"), 2).drop("cached")


@add("intent_search", """with rules as (select n_nationkey as rule_id, case n_regionkey when 0 then ['PROMO', 'SMALL'] when 1 then ['LARGE']
        when 2 then ['ECONOMY', 'MEDIUM'] else ['STANDARD'] end as cats, case when n_nationkey % 2 = 0 then ['ring', 'gear'] else [] end as req,
        case when n_nationkey % 3 = 0 then ['red'] else [] end as exc, case when n_nationkey % 5 = 0 then 'Brand#' || (1 + n_nationkey) end as brand
        from {nation})
   select rule_id, product_id from rules, {catalogue} c where list_contains(cats, category)
     and (len(req) = 0 or len(list_filter(req, lambda w: contains(name, w))) > 0)
     and len(list_filter(exc, lambda w: contains(name, w))) = 0 and (rules.brand is null or rules.brand = c.brand)""")
def intent_search(spark, sf):
    n = F.col("n_nationkey")
    none = F.array().cast("array<string>")

    def words(*terms):
        return F.array(*[F.lit(t) for t in terms])

    rules = view(spark, sf, "nation").select(
        n.alias("rule_id"),
        F.when(F.col("n_regionkey") == 0, words("PROMO", "SMALL"))
        .when(F.col("n_regionkey") == 1, words("LARGE"))
        .when(F.col("n_regionkey") == 2, words("ECONOMY", "MEDIUM"))
        .otherwise(words("STANDARD"))
        .alias("categories"),
        F.when(n % 2 == 0, words("ring", "gear")).otherwise(none).alias("required"),
        F.when(n % 3 == 0, words("red")).otherwise(none).alias("excluded"),
        F.when(n % 5 == 0, F.concat(F.lit("Brand#"), (n + 1).cast("string"))).alias("brand"),
    )
    return S.intent_search(rules, view(spark, sf, "catalogue"))
