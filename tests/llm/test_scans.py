"""Licence scans, vector codes and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import odd_rows, words

from aislewise.llm import licences as S
from aislewise.llm import periods as P
from aislewise.llm import vectorcodes as V
from aislewise.llm.common import read
from aislewise.llm.queries import REGISTRY


def same(got, want):
    def key(rows):
        return Counter(tuple(None if v is None or v != v else v for v in r) for r in rows)

    assert key(got) == key(want)


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- licences ---------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_row(doc, text):
    """The contract's columns, word by word."""
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    seen = WORD.findall(small)
    places = [
        (i, label) for phrase, label in S.BASE_PHRASES.items() for i in range(len(seen)) if seen[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return doc, len(seen), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


BASE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def licence_rows():
    rng = random.Random(3)
    bits = ["under", "the", "MIT", "License", "apache", "version", "2", "2.0", "cc", "BY", "nc", "é", "by-nc", "/", "\n", "ß2", "kelvin K"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 80))), None) for k in range(150)]
    rows += [
        (900, "Under the MIT-License. Under the mit license", None), (901, "xunder the mit license", None), (902, "under the mit licenses", None),
        (903, "under the mit licenseé", None), (904, "cc by nc by nc cc_by_nc", None), (905, "APACHE LICENSE,\r\nVERSION 2", None),
        (906, words(1, 90_000) + " cc by-nc", None), (None, "cc by nc", None), (907, "under the mit license " * 4000, None),
    ]
    return rows + odd_rows()


def test_licence_phrases_equal_word_by_word_search(spark, empty):
    rows = licence_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings string")
    same(collected(S.licence_digests(S.scan_licences(docs)), *BASE_COLUMNS), [base_row(d, t) for d, t, _ in rows])
    assert S.scan_licences(empty).count() == 0


def test_licence_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = REGISTRY.queries["op11_licence_scan"](spark, sf)
    docs = read(spark, sf, "documents").select("doc_id", "text").collect()
    same(collected(got, *BASE_COLUMNS), [base_row(*r) for r in docs])
    for r in got.collect():
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize(
    "text, tokens, labels, permits",
    [
        ("MIT", "mit", {"mit"}, 1.0),
        ("MIT AND (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0) */", "mit apache-2.0 gpl-2.0-only classpath-exception-2.0 with or and", {"mit", "apache-2", "gpl-2"}, 1.0),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only classpath-exception-2.0 with", {"gpl-2"}, 0.6),
        ("MIT OR ISC AND GPL-3.0+", "mit isc gpl-3.0+ and or", {"mit", "isc", "gpl-3"}, 1.0),
        ("(MIT OR ISC) AND GPL-3.0-or-later", "mit isc or gpl-3.0-or-later and", {"mit", "isc", "gpl-3"}, 0.4),
        ("MIT AND Own-1.0", "mit own-1.0 and", {"mit", "own-1.0"}, 0.0),
        ("MIT. This file", "mit", {"mit"}, 1.0),
        ("MIT OR (ISC AND", "mit", {"mit"}, 1.0),
        ("mit WITH a WITH b", "mit a with", {"mit"}, 1.0),
        ("(((MIT)))", "mit", {"mit"}, 1.0),
    ],
)
def test_expressions(text, tokens, labels, permits):
    got = S.postfix(S.read_expression(text.encode()))
    assert " ".join(got) == tokens
    found, least = S.evaluate(got)
    assert found == labels and least == pytest.approx(permits)


@pytest.mark.parametrize("text", ["", "(MIT OR", ") MIT", "AND MIT", "WITH x", "()", "((MIT)", "é"])
def test_no_expression(text):
    assert S.read_expression(text.encode()) == []


def brute_value(tokens):
    """Permission of infix tokens by Python's own operators, whose order is that of the expression's."""
    text = " ".join({"or": "|", "and": "&", "(": "(", ")": ")"}.get(t, f"L({S.identifier(t)[1]})") for t in tokens)

    class L(float):
        def __or__(self, other):
            return L(max(self, other))

        def __and__(self, other):
            return L(min(self, other))

    return eval(text, {"L": L})  # noqa: S307


def test_random_expressions_equal_the_languages_own():
    rng = random.Random(5)
    ids = list(S.IDENTIFIERS)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(ids)]
        left, right = made(depth - 1), made(depth - 1)
        inner = [*left, rng.choice(["and", "or"]), *right]
        return ["(", *inner, ")"] if rng.random() < 0.4 else inner

    for _ in range(300):
        tokens = made(5)
        raw = " ".join(tokens).replace("( ", "(").replace(" )", ")").encode()
        assert S.read_expression(raw) == tokens
        labels, permits = S.evaluate(S.postfix(tokens))
        assert permits == brute_value(tokens)
        assert labels == {S.identifier(t)[0] for t in tokens if t not in "()" and t not in ("and", "or")}


def test_tags_in_texts(spark):
    rows = [
        (1, "// SPDX-License-Identifier: MIT OR GPL-3.0-only\nunder the MIT license"), (2, 'License-Expression = "Apache-2.0"'),
        (3, "the license expression is discussed"), (4, "SPDX-License-Identifier: ((\nMIT"), (5, "no licence"), (6, None),
        (7, "GNU General Public License, version 3"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.licence_digests(S.scan_licences(docs)).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].permits, got[1].score) == ("gpl-3,mit", "mit", 1.0, 1.0)
    assert (got[2].labels, got[2].permits, got[2].score) == ("apache-2", 1.0, 0.95)
    assert (got[3].labels, got[3].score) == ("", 0.0)
    assert (got[4].labels, got[4].permits, got[4].score) == ("unreadable", None, 0.0)
    assert [(got[k].labels, got[k].n_base, got[k].score) for k in (5, 6)] == [("", 0, 0.0)] * 2
    assert (got[7].labels, got[7].n_base, got[7].score) == ("gpl-3", 0, 0.7)


# -- vector codes -----------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds with Python's whole numbers."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(by_id[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    by_id = [r for r in by_id if len(r[1]) == width * parts]
    cut = {p: [tuple(r[1][p * width : (p + 1) * width]) for r in kept] for p in range(parts)}
    books = {p: [list(r[1][p * width : (p + 1) * width]) for r in by_id[:entries]] for p in range(parts)}

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for x in cut[p]:
                mine[near(x, books[p])[1]].append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    totals = Counter()
    for r, x in zip(kept, last, strict=True):
        totals[r[2]] += sum(d for d, _ in x)
    sha = hashlib.sha256(",".join(str(v) for p in range(parts) for e in books[p] for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x), totals[r[2]], sha) for r, x in zip(kept, last, strict=True)]


def vector_rows(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, 16))
    rows = [(int(i), (centres[i % 5] + rng.normal(0, 0.05, 16)).astype(np.float32).tolist(), int(i % 3)) for i in rng.permutation(n)]
    rows[3] = (rows[3][0], rows[3][1], None)
    copy = rows[0][1]
    rows += [(n + k, copy, 7) for k in range(200)]  # a large group of copies
    rows += [(5000, None, 1), (5001, [float("nan")] + [0.0] * 15, 1), (5002, [float("inf")] + [0.0] * 15, 1), (5003, [None] + [0.0] * 15, 1)]
    rows += [(None, copy, None), (2, [0.0] * 16, 1), (2, [-0.00001] * 16, 1), (5004, [0.5] * 8, 1), (5005, [], 1)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, part string, ids string, error string"


@pytest.mark.parametrize("n, spread", [(400, 0.3), (30, 0.01), (7, 0.3)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, spread):
    monkeypatch.setattr(V, "FEW_LABELS", 100_000 if n > 100 else 0)
    rows = vector_rows(n, n, spread)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(5)
    same(collected(V.code_digests(df), "vec_id", "code", "error", "label_error", "codebooks_sha256"), brute_codes(rows))


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(9, [0.25, -1.0, 3.0, 1e-9] * 4, 1), (4, [0.5] * 16, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    same(collected(V.code_digests(df), "vec_id", "code", "error", "label_error", "codebooks_sha256"), brute_codes(rows))
    assert V.code_digests(df.limit(0)).count() == 0
    assert V.code_digests(df.selectExpr("vec_id", "cast(null as array<float>) as embedding", "label")).count() == 0
    with pytest.raises(ValueError, match="parts"):
        V.code_digests(spark.createDataFrame([(1, [0.5] * 9, 1, "", "", "")], VECTORS))


@pytest.mark.parametrize("n", [1, 2, 25, 600, 2000])
@pytest.mark.parametrize("size", [0, 1, 3, 60, 5000])
def test_cover_trees(n, size):
    """Nodes cover their points, children are apart, and a tree assigns as comparing all points does."""
    rng = np.random.default_rng(n + size)
    points = rng.integers(-size, size + 1, (n, 8))
    tree = V.CoverTree.of(points)
    laid = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(n))
    for i, (lo, hi) in enumerate(zip(tree.lo, tree.hi, strict=True)):
        assert np.sqrt(((laid[lo:hi] - laid[lo]) ** 2).sum(1)).max() <= tree.radius[i]
        mine = np.arange(tree.first[i], tree.first[i] + tree.children[i])
        if len(mine):
            assert tree.lo[mine[0]] == lo and tree.hi[mine[-1]] == hi and (tree.hi[mine[:-1]] == tree.lo[mine[1:]]).all()
            apart = np.sqrt(((laid[tree.lo[mine]][:, None] - laid[tree.lo[mine]]) ** 2).sum(2))
            assert apart[~np.eye(len(mine), dtype=bool)].min(initial=np.inf) > tree.radius[i] / 2 * (1 - 1e-6)
    for book in (rng.integers(-size, size + 1, (16, 8)), points[rng.integers(0, n, 16)]):
        entries = np.full(n, -1)
        runs, singles = tree.assign(laid, book)
        for lo, hi, entry in runs:
            for a, b, e in zip(lo, hi, entry, strict=True):
                entries[a:b] = e
        for at, entry in singles:
            entries[at] = entry
        assert (entries == V.nearest(laid, book)[0]).all()


def test_tight_clusters_are_assigned_whole():
    """Far clusters: no point is compared by itself."""
    rng = np.random.default_rng(2)
    points = np.repeat(rng.integers(-(10**6), 10**6, (16, 8)), 200, axis=0) + rng.integers(-3, 4, (3200, 8))
    tree = V.CoverTree.of(points)
    runs, singles = tree.assign(points[tree.order], points[::200])
    assert sum(int((hi - lo).sum()) for lo, hi, _ in runs) == 3200 and not singles


# -- periodic runs ----------------------------------------------------------------------------------


def brute_runs(seen, least):
    found = {}
    for q in range(1, len(seen) // 2 + 1):
        i = 0
        while i + q < len(seen):
            j = i
            while j + q < len(seen) and seen[j] == seen[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # a longer period of the same stretch is no smallest one
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def run_row(doc, text, planted=True):
    seen = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(seen), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        seen = [seen[i] if i < a else seen[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(seen, 12)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((-(e - s), s, q) for s, e, q in runs), default=None)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(seen) if i not in gone)
    sha = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))
    return (doc, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), *sha)


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_equal_all_periods():
    rng = random.Random(1)
    for _ in range(1200):
        least, docs = rng.choice([2, 4, 12]), []
        for _ in range(rng.randint(1, 4)):
            n, letters, kind = rng.randint(0, 60), rng.randint(1, 4), rng.random()
            seen = [rng.randrange(letters) for _ in range(n)]
            if kind < 0.5 and n:
                seen = [seen[i % rng.randint(1, n)] for i in range(n)] if kind < 0.1 else [seen[i % (1 + n // 3)] for i in range(n)]
                for _ in range(rng.randint(0, 3)):
                    seen[rng.randrange(n)] = rng.randrange(letters)
            elif kind < 0.65:
                f, seen = [0], [0, 1]
                for _ in range(rng.randint(1, 7)):
                    f, seen = seen, seen + f
                seen = seen[rng.randint(0, 3) :]
            elif kind < 0.8:
                seen = [x for _ in range(4) for x in [0] * rng.randint(1, 20) + [1]]
            docs.append([b"%d" % x for x in seen])
        got = [[tuple(map(int, r)) for r in rows] for rows in P.document_runs(docs, least)]
        assert got == [brute_runs(d, least) for d in docs]


def test_run_query_on_odd_rows(spark, odd, empty):
    rows = [(d, t) for d, t, _ in odd_rows()] + [(k, words(k, 10 + k % 50)) for k in range(300, 420)]
    rows += [(k, "na " * 40 + words(k, 30) + " la la" * 30) for k in range(420, 450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.run_digests(P.find_runs(P.with_periods(docs)))
    same(collected(got, *RUN_COLUMNS), [run_row(*r) for r in rows])
    plain = P.run_digests(P.find_runs(odd))
    same(collected(plain, *RUN_COLUMNS), [run_row(d, t, planted=False) for d, t, _ in odd_rows()])
    assert P.find_runs(empty).count() == 0


def test_run_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in read(spark, sf, "documents").select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    want = {r.doc_id: run_row(r.doc_id, r.text) for r in docs}
    got = [r for r in collected(REGISTRY.queries["op13_periodic_runs"](spark, sf), *RUN_COLUMNS) if r[0] in want]
    same(got, want.values())
