"""Blocked search against plain Python models over all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from aislewise.functions.lexicon import Lexicon
from aislewise.functions.similarity import common_subsequence, token_set
from aislewise.functions.text import INFLECTIONS, word_match
from aislewise.operators import search as S

LEX = Lexicon()

CATALOGUE = [
    ("Mellanmjölk 1l", "Arla", "Mellanmjölk, färsk"),
    ("Kokosmjölk 400ml", "Santa", "Kokosmjölk"),
    ("Mjölkfritt smör", "Carlshamn", "Smör"),
    ("Vetemjöl 2kg", "Kungsörnen", "Mjöl"),
    ("Tomater krossade", "Felix", "Konserv"),
    ("Tomat röd", "", "Tomat, färsk"),
    ("Granatäppelsirap", "Zeta", "Sirap"),
    ("Kycklingbuljong", "Knorr", "Buljong"),
    ("Ketchup", "Felix", "Ketchup"),
    ("Ketchup", "Heinz", "Ketchup"),
    ("Ketchup mild", "Heinz", "Ketchup"),
    ("Hushållsost 500g", "Arla", "Hårdost"),
    ("Färskost", "Arla", "Färskost"),
    ("Ostkniv", "Fiskars", "Tillbehör"),
    ("Bananer eko", "", "Banan, frukt"),
    ("Lök gul", "", "Lök"),
    ("Rödlök", "", "Lök"),
    ("Ketchup", "Felix", "Ketchup, stor"),
] + [(f"Pasta nr {i}", "Barilla", "Pasta") for i in range(8)]
QUERIES = [
    "mjölk", "mjöl", "tomat", "röd tomat", "granatäpplesirap", "kycklingbuljongtärning", "felix ketchup", "ost",
    "eko banan", "lök", "pasta", "gul lök", "kokosmjölk", "xyz", "färskost arla", "ketchup mild heinz",
]


def model_word(q, t, pos):
    bonus = max(0.0, 0.1 - 0.02 * pos)
    if q == t:
        return 1.0 + bonus
    best = 0.0
    if t.startswith(q):
        if t[len(q):] in INFLECTIONS:
            return 0.95 + bonus
        best = 0.6
    elif len(q) >= 4 and t.endswith(q):
        best = 0.85
    elif len(q) >= 5 and q in t:
        best = 0.75
    elif len(t) >= 4 and q.startswith(t):
        share = len(t) / len(q)
        best = 0.85 if share >= 0.6 else (0.72 if share >= 0.45 else 0.65) + bonus
    if len(q) >= 6 and len(t) >= 6:
        ratio = SequenceMatcher(None, q, t).ratio()
        if ratio >= 0.8:
            best = max(best, min(ratio, 0.9))
    return best


def model_text(query, text):
    words = [w for w in query.split() if len(w) > 1]
    rows = []
    for q in words:
        best = max(model_word(q, t, i) for i, t in enumerate(text.split()))
        attr = q in LEX.attributes
        known = (any(q in p for p in LEX.product_words) or q in LEX.brands or best >= 1.0) and not attr
        rows.append((best, known, attr))
    if any(k and b >= 0.5 for b, k, _ in rows):
        if any(b < 0.5 for b, _, a in rows if not a):
            return 0.0
        keys = [b for b, k, _ in rows if k]
        mean = sum(keys) / len(keys) + sum(b * (0.1 if a else 0.3) for b, k, a in rows if not k)
    else:
        if min(b for b, _, _ in rows) < 0.5:
            return 0.0
        mean = sum(b for b, _, _ in rows) / len(rows)
    penalty = min(12, len(text) / 10)
    if mean >= 1.0:
        return max(78, 100 - penalty)
    if mean >= 0.9:
        return max(70, 92 - penalty)
    return 60 + mean * 25 if mean >= 0.7 else 45 + mean * 30 if mean >= 0.5 else mean * 40


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(i, i, n, b, c) for i, (n, b, c) in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "product_id long, ord long, name string, brand string, category string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(q, q) for q in QUERIES], "query_id string, query string").cache()


def test_word_examples(spark):
    pairs = [("tomat", "tomater", 0, 1.05), ("mjöl", "mjölk", 0, 0.6), ("mjöl", "vetemjöl", 0, 0.85), ("lök", "lök", 1, 1.08)]
    df = spark.createDataFrame([p[:3] for p in pairs], "q string, t string, p int")
    got = [r[0] for r in df.select(word_match(F.col("q"), F.col("t"), F.col("p"))).collect()]
    assert got == pytest.approx([p[3] for p in pairs])


def test_text_scores_equal_all_pairs(asked, catalogue):
    texts = S.search_texts(catalogue)
    got = {(r["query"], r["text"]): r["score"] for r in S.text_scores(asked.select("query"), texts, LEX).collect()}
    want = {}
    for q in QUERIES:
        for row in texts.collect():
            score = model_text(q, row["text"])
            if score > 0:
                want[(q, row["text"])] = score
    assert got == pytest.approx(want)


def test_search_ranks_and_caps(asked, catalogue):
    got = S.fuzzy_search(asked, catalogue, LEX, n=7).toPandas()
    best = got[got["rank"] == 1].set_index("query_id")["product_id"].to_dict()
    assert CATALOGUE[best["mjölk"]][0] == "Mellanmjölk 1l"
    assert CATALOGUE[best["granatäpplesirap"]][0] == "Granatäppelsirap"
    assert CATALOGUE[best["kycklingbuljongtärning"]][0] == "Kycklingbuljong"
    assert (got["query_id"] == "pasta").sum() == 5
    # Same name and brand twice: the later row's product stands at the first row's place.
    assert best["felix ketchup"] == 17
    assert "xyz" not in best
    assert not S.fuzzy_match_top1(asked, catalogue, LEX).filter("score < 70").count()


def test_similar_words_find_every_scoring_pair(spark):
    rng = random.Random(4)
    letters = "aeostlmk"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(120)}
    for w in list(words)[:60]:
        words.add(w + rng.choice(["er", "ar", "k"]))
        if len(w) > 6:
            i = rng.randrange(len(w))
            words.add(w[:i] + rng.choice(letters) + w[i + 1:])
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["q"], r["t"]): r["ratio"] for r in S.similar_words(df, df).collect()}
    for q in words:
        for t in words:
            ratio = SequenceMatcher(None, q, t).ratio() if len(q) >= 6 and len(t) >= 6 and q != t else 0
            if model_word(q, t, 0) > 0:
                assert (q, t) in got, (q, t)
            if ratio >= 0.8:
                assert got[(q, t)] == pytest.approx(ratio)


def test_containment_pairs(spark):
    terms = ["a", "mj", "mjölk", "öl", "zzz", "", "mellanmjölk", "lanmjölk arla", "mellanmjölkx", "abcabcabc", "ölmjölk"]
    texts = ["mellanmjölk arla", "öl", "a", "x", "", "abcabcab", "xabcabcabcx", "mellanmjölk", "mjölköl"]
    got = {
        (r["term"], r["text"])
        for r in S.containment_pairs(
            spark.createDataFrame([(t,) for t in terms], "term string"),
            spark.createDataFrame([(t,) for t in texts], "text string"),
        ).collect()
    }
    assert got == {(t, x) for t in terms for x in texts if t and t in x}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        prev = row[:]
        for j, other in enumerate(b):
            row[j + 1] = prev[j] + 1 if ch == other else max(row[j], prev[j + 1])
    return row[-1]


def test_token_set_pairs_find_every_pair(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(90)})
    for a in texts[:20]:
        for b in texts[:20]:
            assert common_subsequence(a, b) == lcs(a, b)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    score = {(a, b): token_set(frozenset(a.split()), frozenset(b.split())) for a in texts for b in texts}
    for floor in (90.0, 65.0, 40.0, 1.0):
        got = {(r["a"], r["b"]): r["score"] for r in S.token_set_pairs(df, df, floor).collect()}
        assert got == pytest.approx({p: s for p, s in score.items() if s >= floor})


@pytest.mark.parametrize("per_block", [8192, 13])
def test_best_texts_equal_all_pairs(spark, monkeypatch, per_block):
    """Ties, hot words, long texts, groups, small blocks and empty sides."""
    from aislewise.operators import set_similarity as B

    monkeypatch.setattr(B, "PER_BLOCK", per_block)
    monkeypatch.setattr(B, "LEAST_ASKS", per_block)
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdeåß語") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["hot"]
    def made(k):
        return " ".join(rng.choice(words) for _ in range(k)) + (" hot" if rng.random() < 0.5 else "")
    texts = sorted({made(rng.randrange(1, 5)) for _ in range(150)} | {made(40), made(60)})
    asks = sorted({made(rng.randrange(1, 5)) for _ in range(60)} | {made(30), made(70), "zzz", *texts[:5]})
    groups = {t: k % 3 if k % 4 else None for k, t in enumerate(texts)}
    left = spark.createDataFrame([(a, g) for a in asks for g in (0, 1, None, 7)], "a string, g int")
    right = spark.createDataFrame([(t, k % 40, groups[t]) for k, t in enumerate(texts)], "b string, ord long, g int")
    score = {(a, t): token_set(frozenset(a.split()), frozenset(t.split())) for a in asks for t in texts}
    place = {t: k % 40 for k, t in enumerate(texts)}
    for n, floor in ((1, 60.0), (4, 30.0)):
        for within in (None, "g"):
            got = {}
            for r in B.token_set_best(left, right, floor, n, within).collect():
                got.setdefault((r["a"], r["g"] if within else "all"), []).append((-r["score"], r["ord"], r["rank"]))
            for a in asks:
                for g in (0, 1, None, 7) if within else ("all",):
                    mine = [t for t in texts if g == "all" or groups[t] == g]
                    want = sorted((-score[a, t], place[t]) for t in mine if score[a, t] >= floor)[:n]
                    have = sorted(got.get((a, g), []), key=lambda r: r[2])
                    assert [r[2] for r in have] == list(range(1, len(want) + 1))
                    assert [r[0] for r in have] == pytest.approx([w[0] for w in want])
                    assert [r[1] for r in have] == [w[1] for w in want]
    assert B.token_set_best(left.limit(0), right, 50.0).count() == B.token_set_best(left, right.limit(0), 50.0).count() == 0


def test_token_set_values():
    assert token_set(frozenset({"arla", "mjölk"}), frozenset({"mjölk"})) == 100.0
    assert token_set(frozenset(), frozenset({"x"})) == 0.0
    assert 50 < token_set(frozenset({"mjölk"}), frozenset({"mjöl"})) < 100


def test_short_search_fills_from_weaker_hits(spark, catalogue):
    asks = spark.createDataFrame([("a", "heinz ketchup"), ("b", "granatsirap")], "query_id string, query string")
    got = S.short_search(asks, catalogue).toPandas()
    a = got[got["query_id"] == "a"].sort_values("rank")
    assert a.iloc[0]["score"] == 100 and a.iloc[0]["direct"]
    assert CATALOGUE[got[(got["query_id"] == "b") & (got["rank"] == 1)]["product_id"].iloc[0]][0] == "Granatäppelsirap"


def test_cascade_tiers(spark, catalogue):
    asks = ["ketchup", "hushallsost", "felix kecthup", "heinz tomater", "arla", "helt okänt ord"]
    df = spark.createDataFrame([(q, q) for q in asks], "query_id string, query string")
    got = {r["query_id"]: r for r in S.lookup_cascade(df, catalogue).collect()}
    assert got["ketchup"]["score"] == 100 and got["ketchup"]["product_id"] == 8
    assert got["hushallsost"]["score"] == 95 and got["hushallsost"]["product_id"] == 11
    assert got["felix kecthup"]["product_id"] in (8, 17) and 65 <= got["felix kecthup"]["score"] < 100
    assert CATALOGUE[got["heinz tomater"]["product_id"]][1] == "Heinz"
    assert got["arla"]["score"] == 95
    assert got["helt okänt ord"]["product_id"] is None and got["helt okänt ord"]["score"] == 0


def test_position_cascade_equals_all_pairs(spark):
    rng = random.Random(17)
    terms = ["".join(rng.choice("abcdeo") for _ in range(rng.randrange(3, 7))) for _ in range(30)]
    placed = [(k, k, " ".join(rng.choice(terms) for _ in range(rng.randrange(1, 4))), float(k), 0.0, 0.0) for k in range(40)]
    hits = [(k, k + 20, rng.choice(placed)[2]) for k in range(30)]
    for k in range(30, 90):
        name = list(rng.choice(placed)[2])
        name[rng.randrange(len(name))] = "x"
        hits.append((k, k + 1000, "".join(name)))
    hits += [(90, 5000, "zzzz qqqq"), (91, 5001, "")]
    want = {}
    by_name = {}
    for p in placed:
        by_name.setdefault(p[2], []).append(p)
    for hit, product, name in hits:
        if product < 40:
            want[hit] = (1, {float(product)})
        elif name in by_name:
            want[hit] = (2, {by_name[name][-1][3]})
        else:
            score = {n: token_set(frozenset(name.split()), frozenset(n.split())) for n in by_name} if name else {}
            best = max(score.values(), default=0)
            close = [n for n in score if score[n] >= best - 1e-9]
            want[hit] = (3, {by_name[n][-1][3] for n in close}) if best >= 75 else (None, {None})
    df = spark.createDataFrame(hits, "hit_id int, product_id int, name string")
    spots = spark.createDataFrame(placed, "product_id int, ord int, name string, x double, y double, z double")
    got = {r["hit_id"]: (r["tier"], r["x"]) for r in S.position_cascade(df, spots).collect()}
    assert {t for t, _ in got.values()} == {1, 2, 3, None}
    assert all(got[h][0] == t and got[h][1] in xs for h, (t, xs) in want.items()) and got.keys() == want.keys()


def test_cache_misses_are_prefiltered_and_remembered(spark, catalogue):
    cache = spark.createDataFrame([("Ketchup ", [9, 999, 8, 10]), ("gone", [777])], "query string, ids array<long>")
    asks = spark.createDataFrame(
        [(1, "ketchup"), (2, " KETCHUP"), (3, "gone"), (4, "Gul lök"), (5, "gul lök"), (6, "xyzq"), (7, None)],
        "query_id long, query string",
    )
    answers = S.cached_answers(asks, cache, catalogue, 2, LEX)
    got = {}
    for r in answers.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.product_id, r.cached))
    assert sorted(got[1]) == sorted(got[2]) == [(1, 9, True), (2, 8, True)]
    assert not {3, 6, 7} & got.keys()
    assert sorted(got[4]) == sorted(got[5]) and [CATALOGUE[p][0] for _, p, _ in sorted(got[4])][0] == "Lök gul"
    assert not any(c for _, _, c in got[4])
    new = {r["query"]: r.ids for r in S.cache_additions(asks, answers).collect()}
    assert new == {"gul lök": [p for _, p, _ in sorted(got[4])]}
    again = S.cached_answers(asks, cache.unionByName(S.cache_additions(asks, answers)), catalogue, 2)
    assert {r.query_id for r in again.collect()} == {1, 2, 4, 5}
