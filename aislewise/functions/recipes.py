"""Yes/no questions about recipes and products, answered with word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.numeric import let
from aislewise.functions.text import clean_ingredient, contains_any, strip, words_of


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def is_pantry(name: Column, lex: Lexicon) -> Column:
    known = (*lex.pantry, *lex.not_food)
    return strip(F.lower(_blank(name))).isin(*known) | clean_ingredient(name, lex).isin(*known)


def is_organic(name: Column, category: Column, tags: Column, lex: Lexicon) -> Column:
    text = F.lower(F.concat_ws(" ", _blank(name), _blank(category), F.array_join(F.coalesce(tags, F.array()), " ")))
    return contains_any(text, lex.organic)


def is_derived_form(name: Column, category: Column, ingredient: Column, lex: Lexicon) -> Column:
    """The product is a prepared form (cake, juice ...) the ingredient did not ask for."""
    n, c, i = F.lower(_blank(name)), F.lower(_blank(category)), F.lower(_blank(ingredient))
    asked, named = words_of(i), words_of(n)
    explicit = (
        (F.size(asked) > 0)
        & (F.size(F.array_except(asked, named)) == 0)
        & F.coalesce(F.array_contains(asked, F.get(named, 0)), F.lit(False))
    )
    cats = F.array(*[F.lit(t) for t in lex.derived_categories])
    forms = F.array(*[F.lit(t) for t in lex.derived_forms])
    veto = F.exists(cats, lambda t: F.contains(c, t) & ~F.contains(i, F.trim(t))) | F.exists(
        forms, lambda t: F.contains(n, t) & ~F.contains(i, t)
    )
    return ~explicit & veto


def _has_dairy(text: Column, lex: Lexicon) -> Column:
    """A dairy term anywhere, once words that only look like one are cut out."""
    plain = text
    for word in lex.dairy_lookalikes:
        plain = F.replace(plain, F.lit(word), F.lit(" "))
    return contains_any(plain, lex.dairy_inside)


def _forbidden(text: Column, vegan: Column, lex: Lexicon) -> Column:
    """The text names something that the vegan, or else the vegetarian, diet rules out."""
    strict = contains_any(text, lex.animal, True) | _has_dairy(text, lex)
    return contains_any(text, lex.embedded_fish) | F.when(vegan, strict).otherwise(contains_any(text, lex.meat_fish, True))


def product_breaks_diet(name: Column, category: Column, diet: Column, lex: Lexicon) -> Column:
    text = F.lower(F.concat_ws(" ", _blank(name), _blank(category)))
    vegan = diet == "veganskt"
    unexcused = F.lit(False)
    for term, excuse in lex.excused:
        unexcused = unexcused | (F.contains(text, F.lit(term)) & ~F.contains(text, F.lit(excuse)))
    breaks = _forbidden(text, vegan, lex) | contains_any(text, lex.english_meat) | (vegan & unexcused)
    return F.coalesce(diet.isNotNull() & breaks, F.lit(False))


def valid_candidate(
    name: Column, category: Column, department: Column, diet: Column, ingredient: Column, lex: Lexicon
) -> Column:
    return (
        name.isNotNull()
        & ~F.coalesce(department.isin(*lex.non_food_departments), F.lit(False))
        & ~product_breaks_diet(name, category, diet, lex)
        & ~is_derived_form(name, category, ingredient, lex)
    )


def without_imitations(text: Column, lex: Lexicon) -> Column:
    """Text without imitation words; one that is an adjective or stands alone takes the next word with it."""

    def describes(word: Column) -> Column:
        adjective = F.lit(False)
        for start in lex.imitations:
            adjective = adjective | F.startswith(word, F.lit(start))
        return F.coalesce(adjective | word.isin(*lex.imitation_words), F.lit(False))

    def compound(word: Column) -> Column:
        out = F.lit(False)
        for start in lex.imitation_words:
            out = out | F.startswith(word, F.lit(start))
        return out

    def real(words: Column) -> Column:
        return F.filter(words, lambda w, i: ~describes(w) & ~compound(w) & ~describes(F.get(words, i - 1)))

    return F.array_join(let(F.split(F.regexp_replace(text, "-", " "), r"\s+"), real), " ")


def word_veto(text: Column, diet: Column, lex: Lexicon) -> Column:
    """The recipe text names something the diet forbids; imitations are cut out first."""
    return _forbidden(without_imitations(F.lower(_blank(text)), lex), diet == "veganskt", lex)


def diet_match(tag: Column, text: Column, diet: Column, lex: Lexicon) -> Column:
    allowed = F.when(diet == "veganskt", tag == "veganskt").otherwise(tag.isin("vegetariskt", "veganskt"))
    tagged = F.coalesce(F.nullif(tag, F.lit("")).isNull() | allowed, F.lit(False))
    return diet.isNull() | (tagged & ~word_veto(text, diet, lex))


def is_non_meal(categories: Column, keywords: Column, name: Column, lex: Lexicon) -> Column:
    text = F.lower(F.concat_ws(" ", F.array_join(F.coalesce(categories, F.array()), " "), _blank(keywords)))
    title = F.lower(_blank(name))
    last = F.element_at(F.split(strip(title), r"\s+"), -1)
    ends = F.lit(False)
    for ending in lex.non_meal_endings:
        ends = ends | F.endswith(last, F.lit(ending))
    return contains_any(text, lex.non_meal, True) | (~F.contains(title, F.lit(" med ")) & ends)


def is_drink(ingredient_names: Column, lex: Lexicon, needed: int = 3) -> Column:
    terms = F.array(*[F.lit(d) for d in lex.drinks])
    hits = F.filter(
        F.coalesce(ingredient_names, F.array().cast("array<string>")),
        lambda n: F.exists(terms, lambda t: F.contains(F.lower(n), t)),
    )
    return F.size(hits) >= needed


def protein_source(text: Column, lex: Lexicon) -> Column:
    """First source, in priority order, whose words occur; 'övrigt' when none does."""
    lowered = F.lower(_blank(text))
    out = F.lit("övrigt")
    for name, terms, anywhere in reversed(lex.protein_sources):
        out = F.when(contains_any(lowered, terms, not anywhere), name).otherwise(out)
    return out


def contains_all(tags: Column, wanted: Column) -> Column:
    return F.forall(F.coalesce(wanted, F.array().cast("array<string>")), lambda w: F.contains(tags, F.lower(w)))
