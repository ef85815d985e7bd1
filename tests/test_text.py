from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from aislewise.functions import quantity as Q
from aislewise.functions import recipes as P
from aislewise.functions import text as X
from aislewise.functions.lexicon import Lexicon
from aislewise.functions.numeric import parse_price
from aislewise.operators import labels as L

LEX = Lexicon()


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_ingredients(spark):
    got = column(spark, ["2 1/2 dl vetemjöl", "salt", "1 förp. ägg", "3 st", "½ tsk. salt", None], X.parse_ingredient)
    assert [tuple(r) for r in got] == [
        ("2 1/2", "dl", "vetemjöl"),
        ("", "", "salt"),
        ("1", "", "förp. ägg"),
        ("3", "st", "3 st"),
        ("½", "tsk.", "salt"),
        ("", "", ""),
    ]


def test_cleaning(spark):
    cases = {
        "kalvlägg (2 kg)": "kalvlägg",
        "2 burkar majs": "majs",
        "apelsin (pressad)": "apelsin",
        "smör till plåten": "smör",
        "rotselleri i tärningar 2x2 cm": "rotselleri",
        "omkring 2 nypotatis utan skal": "nypotatis",
        "rostad lök": "rostad lök",
        "10 x 10 cm filodeg": "filodeg",
        "500ml grädde": "grädde",
        "7up läsk": "up läsk",
    }
    assert column(spark, list(cases), X.clean_ingredient) == list(cases.values())


def test_imitations_are_cut(spark):
    cases = {"vegansk kyckling med ris": "med ris", "vegobitar i sås": "i sås", "vego korv": "", "fiskgratäng": "fiskgratäng"}
    assert column(spark, list(cases), lambda c: P.without_imitations(c, LEX)) == list(cases.values())


def test_search_terms(spark):
    got = column(
        spark,
        ["2 dl mjölk", "smör eller margarin", "bär (exempelvis hallon eller björnbär)", "timjan (färsk eller torkad)",
         "bananschalottenlökar"],
        lambda c: X.search_terms(c, LEX),
    )
    assert got[0] == ["mjölk"]
    assert got[1] == ["smör eller margarin", "smör", "margarin"]
    assert got[2] == ["bär", "hallon", "björnbär"]
    assert got[3] == ["timjan"]
    assert got[4] == ["bananschalottenlökar", "bananschalottenlök"]


def test_head_word_score(spark):
    rows = [("Ägg 20-p", "ägg", 3), ("Smör med vitlök", "vitlök", 2), ("Schalottenlök", "bananschalottenlökar", 2),
            ("Fint Vetemjöl", "mjöl", 1), ("Citron", "citronsaft", 1), ("Mjölk", "mjöl", 0), ("Äggvita", "ägg", 0), ("X", "", 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, h string")
    assert [r[0] for r in df.select(X.head_word_score(F.col("n"), F.col("h"))).collect()] == [r[2] for r in rows]


def test_labels_and_slugs(spark):
    assert column(spark, ["**2. ARLA MJÖLK (1 l)**", " Arla  mjölk "], X.clean_label) == ["Arla Mjölk", "Arla mjölk"]
    assert column(spark, ["Åäö & Co!", "--a  b--"], X.slug) == ["aao---co", "a--b"]
    assert column(spark, [" Crème Fraîche Ö "], X.normalise) == ["crème fraîche o"]


def test_numbers(spark):
    assert column(spark, ["2", "2,5", "1/2", "2 1/2", "½", "2 ½", "x", ""], Q.parse_number) == [
        2.0, 2.5, 0.5, 2.5, 0.5, 2.5, None, None,
    ]
    assert column(spark, ["281 kcal", "1,2 g", "ingen"], Q.first_number) == [281.0, 1.2, None]
    assert column(spark, ["21,60", "21.60", "gratis", None], parse_price) == [21.6, 21.6, None, None]
    assert column(spark, ["PT30M", "PT1H15M", "PT2H", "PT0M", "", None], Q.iso8601_minutes) == [30, 75, 120, None, None, None]


def test_quantities(spark):
    got = column(spark, ["2 dl", "1 1/2 dl", "500 g", "2 msk", "3 st", "lite"], Q.quantity_base)
    assert [None if r is None else tuple(r) for r in got] == [
        (200.0, "volym"), (150.0, "volym"), (500.0, "vikt"), (30.0, "volym"), (3.0, "antal"), None,
    ]
    got = column(spark, ["Olivolja 500ml", "Färs 2x250g 500g", "Ägg 20-p", "Gurka"], Q.package_size)
    assert [None if r is None else tuple(r) for r in got] == [(500.0, "volym"), (500.0, "vikt"), (20.0, "antal"), None]
    df = spark.createDataFrame([("7 dl", "Mjölk 500ml"), ("2 st", "Mjölk 1l"), ("1 förp", "Ost")], "n string, p string")
    need, pack = Q.quantity_base(F.col("n")), Q.package_size(F.col("p"))
    rows = df.select(Q.packages_needed(need, pack), Q.package_rest(need, pack), Q.used_share(need, pack)).collect()
    assert [tuple(r) for r in rows] == [(2, 300.0, 1.4), (None, None, 1.0), (None, None, 1.0)]
    df = spark.createDataFrame(
        [(1500.0, "vikt"), (250.0, "vikt"), (2000.0, "volym"), (300.0, "volym"), (45.0, "volym"), (4.0, "antal")],
        "b double, d string",
    )
    got = [r[0] for r in df.select(Q.format_quantity(F.col("b"), F.col("d"))).collect()]
    assert got == ["1.5 kg", "250 g", "2 l", "3 dl", "45 ml", "4 st"]


def test_diet_rules(spark):
    rows = [
        ("Vegansk kyckling", "veganskt", "veganskt", True),
        ("Fiskgratäng", "veganskt", "veganskt", False),
        ("Rostad lök", None, "veganskt", True),
        ("Getost", None, "veganskt", False),
        ("Getost", None, "vegetariskt", True),
        ("Linsgryta", "vegetariskt", "veganskt", False),
        ("Biff", None, None, True),
    ]
    df = spark.createDataFrame(rows, "text string, tag string, diet string, want boolean")
    bad = df.filter(P.diet_match(F.col("tag"), F.col("text"), F.col("diet"), LEX) != F.col("want"))
    assert bad.collect() == []


def test_recipe_kinds(spark):
    df = spark.createDataFrame(
        [(["Middag"], "Pasta med tomatsås", ["pasta"]), (["Dessert"], "Paj", ["äpple"]), ([], "Tomatsås", ["tomat"]),
         ([], "Drink", ["4 cl vodka", "tonic", "lemonad", "is"])],
        "c array<string>, n string, i array<string>",
    )
    got = df.select(
        P.is_non_meal(F.col("c"), F.lit(None).cast("string"), F.col("n"), LEX), P.is_drink(F.col("i"), LEX)
    ).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, False), (True, False), (False, True)]


def test_label_responses(spark):
    rows = [
        (1, 2.0, '```json\n{"namn": "Mjölk 1l", "bbox": [20, 30, 10, 40]},\n{"name": "Ost", "box": [1, 2, 3]}\n```'),
        (2, 1.0, "1. **Arla Smör**\n12,90\nJmf per kg 55\nKetchup"),
        (3, 1.0, "okänd"),
    ]
    df = spark.createDataFrame(rows, "frame long, scale double, response string")
    got = [(r["frame"], r["name"], r["bbox"]) for r in L.parse_label_lines(df, replace(LEX, label_noise=("jmf",))).orderBy("frame", "line_no").collect()]
    assert got == [
        (1, "Mjölk 1l", [5.0, 15.0, 10.0, 20.0]),
        (1, "Ost", None),
        (2, "Arla Smör", None),
        (2, "Ketchup", None),
    ]


def test_priority_of_protein(spark):
    got = column(spark, ["kycklinggryta med bacon", "laxpasta", "plommon", "smörgås"], lambda c: P.protein_source(c, LEX))
    assert got == ["fågel", "fisk", "övrigt", "övrigt"]


def test_phrases_are_taken_literally(spark):
    """Signs of patterns in a lexicon's phrases stand for themselves."""
    lex = replace(LEX, empty_words=("c.a", "(ca)"), asides=("i [skivor]", "a|b"), purpose_words=("t.o.m",))
    got = column(spark, ["cxa lök c.a", "lök i [skivor] a|b", "lök txoym t.o.m fredag"], lambda c: X.clean_ingredient(c, lex))
    assert got == ["cxa lök", "lök", "lök txoym"]


def test_excused_terms(spark):
    lex = replace(LEX, excused=(("aioli", "vegan"),))
    rows = [("Aioli", "veganskt", True), ("Aioli vegan", "veganskt", False), ("Aioli", "vegetariskt", False), ("Aioli", None, False)]
    df = spark.createDataFrame(rows, "n string, d string, want boolean")
    got = df.select(P.product_breaks_diet(F.col("n"), F.lit(""), F.col("d"), lex)).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
