from __future__ import annotations

import json

from aislewise.operators.fusion import upsert_products
from aislewise.sources import shop_api as A
from aislewise.sources import web as W
from aislewise.sources.files import read_catalogue
from aislewise.sources.sinks import append_table, export_csv, replace_table


def page(*blocks):
    return "<html>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</html>"


def test_jsonld_shapes(spark):
    soup = {
        "@type": "Recipe",
        "name": " Soppa ",
        "image": ["a.jpg"],
        "recipeYield": "4 portioner",
        "totalTime": "PT30M",
        "aggregateRating": {"ratingValue": "4,2", "ratingCount": 17},
        "recipeCategory": "Middag",
        "keywords": ["snabb", "enkel"],
        "recipeIngredient": ["2 dl grädde", "salt"],
        "recipeInstructions": [{"text": "Koka"}, "Servera"],
        "nutrition": {"calories": "281 kcal", "proteinContent": "1,5 g"},
    }
    other = {"@type": ["Recipe", "Thing"], "name": "Paj", "image": {"@id": "b.jpg"}, "recipeInstructions": " Baka "}
    pages = [
        ("https://x/recept/soppa-123/", page(json.dumps(soup, ensure_ascii=False))),
        ("https://x/recept/paj", page("{broken", json.dumps([{"@type": "WebPage"}, other]))),
        ("https://x/recept/g-9", page(json.dumps({"@graph": [{"@type": "Person"}, soup]}, ensure_ascii=False))),
        ("https://x/om-oss/", page(json.dumps({"@type": "WebPage"}))),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {r["recipe_id"]: r for r in W.recipes_from_pages(df).collect()}
    assert set(got) == {"123", "paj", "9"}
    r = got["123"]
    assert (r["name"], r["image"], r["portions"], r["time"], r["rating"], r["n_ratings"]) == (
        "Soppa", "a.jpg", 4.0, "PT30M", 4.2, 17,
    )
    assert r["steps"] == ["Koka", "Servera"] and r["categories"] == ["Middag"] and r["keywords"] == "snabb, enkel"
    assert tuple(r["ingredients"][0]) == ("2", "dl", "grädde")
    assert r["nutrition"]["kcal"] == 281.0 and r["nutrition"]["fat"] is None
    assert r["tags"] == "soppa middag snabb, enkel grädde salt"
    assert got["paj"]["image"] == "b.jpg" and got["paj"]["steps"] == ["Baka"] and got["paj"]["ingredients"] == []


def test_product_answers(spark):
    milk = {"name": "Mjölk", "brand": "Arla", "price": {"amount": "12.50"}, "promoPrice": {"amount": "9"},
            "promotions": [{"description": " 2 för 1 "}], "unitPrice": {"price": {"amount": "12.5"}, "unit": "a.b.l"}}
    rows = [
        (1, "Mejeri > Mjölk", json.dumps({"items": [milk, {"name": ""}]}, ensure_ascii=False)),
        (2, "Annat", json.dumps({"products": [dict(milk, price={"current": "99"})]}, ensure_ascii=False)),
        (3, "Frukt", json.dumps({"productGroups": [{"products": [{"product": {"title": "Banan"}}]}, {"items": [{"name": "Kiwi"}]}]})),
        (4, "Kött", json.dumps({"pages": [{"products": [{"name": "Scan Korv", "brandName": "Scan"}]}]})),
        (5, "Kök", json.dumps([{"name": "Kniv", "imagePaths": ["https://images-v3/k"]}])),
        (6, "Trasig", "{nope"),
    ]
    df = spark.createDataFrame(rows, "ord long, category_path string, body string")
    got = {r["id"]: r for r in A.flatten_products(df).collect()}
    assert set(got) == {"arla-mjolk", "banan", "kiwi", "scan-korv", "kniv"}
    m = got["arla-mjolk"]
    assert (m["ord"], m["category"], m["department"], m["price"], m["promo_price"], m["promo_text"], m["unit_price"]) == (
        1, "Mjölk", "Mejeri", "12.50", "9", "2 för 1", "12.5 kr/l",
    )
    assert m["tags"] == ["mjölk", "arla"]
    assert got["kniv"]["image"] == "https://images-v3/k/300x300.jpg"


def test_category_tree(spark):
    tree = [{"name": "A", "categoryId": "1", "childCategories": [
        {"name": "B", "categoryId": "2", "childCategories": [{"name": "C", "categoryId": "3", "childCategories": [
            {"name": "D", "categoryId": "4"}]}]},
        {"name": "E", "categoryId": "5", "childCategories": []}]}, {"name": "", "categoryId": "6"}]
    rows = [(json.dumps(tree),), (json.dumps({"categories": tree}),), (json.dumps(tree[0]),)]
    got = A.flatten_categories(spark.createDataFrame(rows, "body string")).collect()
    assert sorted((r["id"], r["path"]) for r in got) == sorted([("4", "A > B > C > D"), ("5", "A > E")] * 3)


def test_deep_category_tree(spark):
    node = {"name": "L9", "categoryId": "9"}
    for k in range(8, -1, -1):
        node = {"name": f"L{k}", "categoryId": str(k), "childCategories": [node]}
    got = A.flatten_categories(spark.createDataFrame([(json.dumps(node),)], "body string")).collect()
    assert [(r["id"], r["path"]) for r in got] == [("9", " > ".join(f"L{k}" for k in range(10)))]


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "id,name,brand,category,department,price,unit_price,promo_price,promo_text,image,tags\n"
        'p1,Mjölk,Arla,Mjölk,Mejeri,"12,50",,9.90,2 för 1,,"mjölk, arla,"\np2,Ost,,,,okänt,,,,,\n'
    )
    rows = read_catalogue(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()
    assert rows[0]["price"] == 12.5 and rows[0]["promo_price"] == 9.9 and rows[0]["tags"] == ["mjölk", "arla"]
    assert rows[1]["price"] is None


def test_file_order_does_not_depend_on_splits(spark, tmp_path):
    head = "id,name,brand,category,department,price,unit_price,promo_price,promo_text,image,tags\n"
    ids = [[f"f{k}r{i}" for i in range(n)] for k, n in enumerate((700, 3, 0, 1500, 1))]
    for k, own in enumerate(ids):
        (tmp_path / f"part-{k}.csv").write_text(head + "".join(f"{i},n,,,,1,,,,,\n" for i in own))
    want = [i for own in ids for i in own]
    for size in ("1k", "7k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            rows = read_catalogue(spark, str(tmp_path)).select("ord", "product_id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r["product_id"] for r in sorted(rows)] == want
        assert [r["ord"] for r in sorted(rows)] == list(range(len(want)))
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('[{"id": "a1", "price": "2"}, {"id": "a2"}]')
    (tmp_path / "json" / "b.json").write_text('[{"id": "b1"}]')
    rows = read_catalogue(spark, str(tmp_path / "json"), "json").orderBy("ord").collect()
    assert [(r["ord"], r["product_id"]) for r in rows] == [(0, "a1"), (1, "a2"), (2, "b1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, p string")
    path = str(tmp_path / "t")
    append_table(df, path, ("p",))
    assert append_table(df, path, ("p",)).count() == 4
    only_a = spark.createDataFrame([(9, "a")], "n int, p string")
    got = sorted((r["n"], r["p"]) for r in replace_table(only_a, path, ("p",)).collect())
    assert got == [(2, "b"), (2, "b"), (9, "a")]
    assert export_csv(df, str(tmp_path / "csv")).count() == 2


def test_upsert_rules(spark):
    snapshot = spark.createDataFrame(
        [("old", 1.0, 1.0, 1.0, "Slut", "låg", 5, None, ["x"]), ("still", 0.0, 0.0, 0.0, "I lager", "hög", 2, None, [])],
        "product_id string, x double, y double, z double, status string, confidence string, points long, "
        "last_seen timestamp, aliases array<string>",
    )
    events = spark.createDataFrame(
        [
            ("old", 1, "kund", 9.0, 9.0, 9.0, None, ["no"], "2024-01-01 10:00:00"),
            ("old", 2, "personal", 3.0, None, 4.0, None, ["y", "x"], "2024-01-01 11:00:00"),
            ("new", 3, "kund", 7.0, 7.0, None, "hög", ["first"], "2024-01-01 12:00:00"),
            ("new", 4, "personal", None, None, None, "medium", ["second"], "2024-01-01 13:00:00"),
            ("still", 5, "kund", 5.0, 5.0, 5.0, None, ["q"], "2024-01-01 14:00:00"),
        ],
        "product_id string, event_id long, source string, x double, y double, z double, confidence string, "
        "aliases array<string>, at string",
    ).selectExpr("*", "cast(at as timestamp) as ts").drop("at")
    got = {r["product_id"]: r for r in upsert_products(snapshot, events).collect()}
    old, new, still = got["old"], got["new"], got["still"]
    assert (old["x"], old["y"], old["z"], old["status"], old["points"], old["aliases"]) == (3.0, 1.0, 4.0, "I lager", 6, ["x", "y"])
    assert (new["x"], new["z"], new["points"], new["confidence"], new["aliases"]) == (7.0, 2.5, 2, "medium", ["first", "second"])
    assert (still["x"], still["points"], still["confidence"], still["aliases"]) == (0.0, 2, "hög", [])
    assert still["last_seen"].hour == 14
