"""Dedup, joins, packing, decontamination, labels: brute force on odd rows, held-out accuracy on the tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import odd_rows, words
from pyspark.sql import functions as F

from aislewise.llm import decontam as D
from aislewise.llm import jaccardjoin as J
from aislewise.llm import langid as L
from aislewise.llm import linededup as N
from aislewise.llm import packing as P
from aislewise.llm import repeats as R
from aislewise.llm import rules as Q
from aislewise.llm.bpe import Encoder, encoder
from aislewise.llm.common import stored
from aislewise.session import checkpoint_dir

LEAST = -(1 << 63)


def own(doc) -> int:
    return LEAST if doc is None or doc != doc else int(doc)


def multiset(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


# -- packing ----------------------------------------------------------------------------------------


def test_packing_keeps_every_id(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = P.pack_documents(odd, path, 1).toPandas()
    tok = encoder(path)
    ids = {(own(d), t or ""): np.append(tok.whole(t or ""), 1).astype("<u4") for d, t, _ in odd_rows()}
    copies = Counter((own(d), t or "") for d, t, _ in odd_rows())
    want = Counter(own(d) for d, _, _ in odd_rows())
    assert Counter(own(d) for d in got[got.start == 0].doc_id) == want
    crc = {(own(d), s, n): [] for d, s, n in zip(got.doc_id, got.start, got.length, strict=True)}
    for r in got.itertuples():
        crc[own(r.doc_id), r.start, r.length].append(r.ids_crc32)
    for (doc, start, length), seen in crc.items():
        possible = {zlib.crc32(v[start : start + length].tobytes()) for (d, _), v in ids.items() if d == doc and len(v) >= start + length}
        assert set(seen) <= possible
    assert got.length.sum() == sum(len(ids[k]) * n for k, n in copies.items())
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist()
        total = int(part.length.sum())
        assert total <= 2048 and total & (total - 1) == 0
    assert P.pack_documents(empty, path, 1).count() == 0


def test_packing_prefers_lexical_neighbours():
    topics = [np.arange(k * 100, k * 100 + 40, dtype=np.uint64) for k in range(3)]
    terms = [topics[k % 3] for k in range(9)]
    pieces = P.pack([100] * 9, P.Shard(terms), 300)
    for sequence in range(3):
        assert len({d % 3 for d, _, _, s, _ in pieces if s == sequence}) == 1


def test_long_documents_ask_for_neighbours_once():
    """A document of many windows fills them alone; only its last one asks who is near."""

    class Counted(P.Shard):
        asked = 0

        def scores(self, seed):
            self.asked += 1
            return super().scores(seed)

    terms = [np.arange(40, dtype=np.uint64)] * 3
    shard = Counted(terms)
    pieces = P.pack([3050, 100, 150], shard, 300)
    assert sum(p[2] for p in pieces) == 3300 and len({p[3] for p in pieces}) == 11
    assert shard.asked <= 2


def test_ids_are_stored_once(spark, odd):
    before = scratch_tables(spark)
    P.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json"), 1).count()
    assert sum("ids" in c for c in columns_of(spark, scratch_tables(spark) - before)) == 1


def test_shards_hold_as_many_tokens(spark):
    """Long documents beside each other and many documents of one place do not make a shard large."""
    near = "case when id % 3 = 0 then (7 << 20) | (xxhash64(id) & 1048575) when id % 50 = 1 then id else xxhash64(id) end as near"
    ids = spark.range(3000).selectExpr("id as doc_id", "encode(string(id), 'utf-8') as ids", near, "if(id % 50 = 1, 20000, 1000) as n")
    got = P.sharded(ids, 6).join(ids.select("doc_id", "n"), "doc_id").groupBy("shard").sum("n").toPandas()["sum(n)"]
    total = 60 * 20000 + 2940 * 1000
    assert got.sum() == total and got.max() < 1.5 * total / 6


def test_scores_equal_whole_bm25():
    """Every shared term of the seed counts, common and rare, with statistics of a larger table."""
    rng = np.random.default_rng(8)
    terms = [rng.choice(400, rng.integers(1, 160), p=1 / np.arange(1, 401) / (1 / np.arange(1, 401)).sum()).astype(np.uint64) for _ in range(60)]
    more = {int(t): int(rng.integers(60, 900)) for t in range(400)}
    table = P.Table(1000, 55.5, np.arange(400, dtype=np.uint64), np.array([more[t] for t in range(400)]))
    shard = P.Shard(terms, table)
    counts = [Counter(t.tolist()) for t in terms]
    for seed in range(60):
        want = [0.0] * 60
        for d, c in enumerate(counts):
            for t in counts[seed]:
                if t in c and sum(t in x for x in counts) > 1:
                    idf = np.log1p((1000 - more[t] + 0.5) / (more[t] + 0.5))
                    want[d] += idf * c[t] * (P.K1 + 1) / (c[t] + P.K1 * (1 - P.B + P.B * len(terms[d]) / 55.5))
        assert np.allclose(shard.scores(seed), want, rtol=1e-4)


def test_scores_of_many_documents_equal_those_of_few(monkeypatch):
    """One product for all seeds of a small shard, row by row in a large one."""
    rng = np.random.default_rng(9)
    terms = [(rng.zipf(1.3, rng.integers(0, 90)) % 5000).astype(np.uint64) for _ in range(120)]
    small = P.Shard(terms)
    monkeypatch.setattr(P, "DENSE", 120 * 120 - 1)
    large = P.Shard(terms)
    assert small.joint and not large.joint and len(small.dense) > len(large.dense) > 0
    for seed in range(120):
        assert np.allclose(small.scores(seed), large.scores(seed), rtol=1e-4, atol=1e-4)


def test_terms_of_many_equal_those_of_each():
    rng = np.random.default_rng(10)
    opens = rng.random(500) < 0.4
    many = [rng.integers(0, 500, n).astype(np.uint16) for n in (0, 1, 3, 0, 0, 70000, 900, 0, 40000, 40000, 5, 0)]
    got = P.terms_of(many, opens)
    assert len(got) == len(many) and P.terms_of([], opens) == []
    for ids, terms in zip(many, got, strict=True):
        word = np.cumsum(opens[ids] | (np.arange(len(ids)) == 0)) - 1
        want = [P.mix(ids[word == w] + P.U64(1) + (np.arange((word == w).sum(), dtype=P.U64) << P.U64(32))).sum() for w in range(min(40, word.max(initial=-1) + 1))]
        assert terms[:40].tolist() == want and len(terms) == word.max(initial=-1) + 1


def test_distinct_pieces_are_encoded_once(monkeypatch):
    tok = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, plain = [], Encoder._encode_distinct
    monkeypatch.setattr(Encoder, "_encode_distinct", lambda self, p: asked.extend(p.to_pylist()) or plain(self, p))
    texts = [f"{words(k % 7, 60)} tail{k % 3}" for k in range(40)] + ["", "one", "x ", "y" * 900 + " " + "z" * 900]
    want = [tok.whole(t).tobytes() for t in texts]
    assert tok.encode(texts) == want and len(asked) == len(set(asked)) > 0
    assert tok.encode(texts) == want and len(asked) == len(set(asked))
    monkeypatch.setattr("aislewise.llm.bpe.KEPT_BYTES", 0)
    assert Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts) == want


def test_shards_know_the_frequencies_of_the_whole_table(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = encoder(path)
    placed = P.place(P.encode(odd, path, 1), path, 4)
    held, whole = {}, Counter()
    for r in placed.filter("ids is not null").collect():
        terms = set(P.word_terms(np.frombuffer(r["ids"], tok.dtype)[:-1], tok.opens).tolist())
        held.setdefault(r["shard"], Counter()).update(terms)
        whole.update(terms)
    assert len(held) > 1
    got = {(r["shard"], r["term"] % (1 << 64)): r["df"] for r in P.frequencies(placed).collect()}
    assert got == {(s, t): whole[t] for s, c in held.items() for t, n in c.items() if n > 1}


# -- repeated strings -------------------------------------------------------------------------------


def brute_repeats(rows, depth):
    raws = [(own(d), (t or "").encode()) for d, t in rows]
    count = Counter(r[k : k + depth] for _, r in raws for k in range(len(r) - depth + 1))
    for doc, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            if count[raw[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        yield doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("limit", [50_000, 1])
def test_repeats_equal_brute_force(odd, empty, monkeypatch, limit):
    monkeypatch.setattr(R, "GROUP_ROWS", limit)
    got = R.remove_repeats(odd).drop("kept").toPandas()
    have = multiset((own(r[0]), *r[1:]) for r in got.itertuples(index=False))
    assert have == multiset(brute_repeats([r[:2] for r in odd_rows()], 200))
    if limit > 1:
        assert R.remove_repeats(empty).count() == 0


def test_repeats_at_edges(spark):
    rng, rows = random.Random(11), []
    letters = lambda n: "".join(rng.choice("abcd efg") for _ in range(n))
    shared, other = letters(330), letters(205)
    for k in range(14):
        a, b = rng.randrange(0, 131), rng.randrange(200, 331)
        rows.append((k, letters(rng.randrange(0, 90)) + shared[a : max(a + 150, b)] + letters(rng.randrange(0, 90))))
    rows += [(20, other), (21, "x" + other), (22, other + "y"), (23, "z" * 201), (24, letters(199)), (25, letters(200) * 2)]
    got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").toPandas()
    assert multiset(map(tuple, got.itertuples(index=False))) == multiset(brute_repeats(rows, 200))


def test_groups_larger_than_a_batch(spark, monkeypatch):
    """A core whose surroundings arrive in many batches, beside small ones, on both paths."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = letters(240)
    rows = [(k, letters(120) + shared + letters(120)) for k in range(60)] + [(100 + k, letters(300)) for k in range(10)]
    want = multiset(brute_repeats(rows, 200))
    monkeypatch.setattr(R, "GROUP_ROWS", 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert multiset(map(tuple, got.itertuples(index=False))) == want


def test_long_texts_are_worked_in_chunks(monkeypatch):
    raw = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = R.anchors(raw, 200)
    monkeypatch.setattr(R, "CHUNK", 700)
    for a, b in zip(whole, R.anchors(raw, 200), strict=True):
        assert (a == b).all()


# -- Jaccard join -----------------------------------------------------------------------------------


def grams(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent):
    sets = [grams(t, width) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    for i, (doc, _) in enumerate(rows):
        named = [d for (d, _), p in zip(rows, part, strict=True) if p == part[i] and d is not None] if sets[i] else [doc]
        yield own(doc), len(sets[i]), own(min(named) if named and named != [None] else None)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(odd, empty, width, percent):
    got = J.jaccard_components(odd, width, percent)
    have = multiset((own(r.doc_id), r.n_shingles, own(r.component_id)) for r in got.toPandas().itertuples())
    assert have == multiset(brute_components([r[:2] for r in odd_rows()], width, percent))
    if width == 5:
        kept = J.one_of_each(odd, got)
        assert kept.columns == odd.columns
        names = Counter(own(r.doc_id) for r in kept.collect())
        assert {-5, 4, 5, 6, 10, 12, 14, 16} <= set(names) and not {1, 2, 3, 11, 13} & set(names)
        assert names[14] == names[18] == 1 and names[15] == 2
        assert J.jaccard_components(empty).count() == 0


def test_chains_of_near_copies_join(spark):
    """Each text is like the next; the ends are not alike, and one group has many members."""
    rng, rows, w = random.Random(4), [], words(77, 200).split()
    for k in range(40):
        w[rng.randrange(200)] = f"new{k}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(k, words(500 + k, 200)) for k in range(10)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).toPandas()
    have = multiset((r.doc_id, r.n_shingles, r.component_id) for r in got.itertuples())
    assert have == multiset(brute_components(rows, 4, 85))


# -- lines ------------------------------------------------------------------------------------------


def scratch_tables(spark) -> set[str]:
    folder = checkpoint_dir(spark).removeprefix("file://")
    return {os.path.join(folder, d) for d in os.listdir(folder)} if os.path.isdir(folder) else set()


def columns_of(spark, tables: set[str]) -> list[list[str]]:
    return [spark.read.parquet(t).columns for t in tables]


def test_repeated_lines_list_their_signatures_once(spark):
    """A line that many documents have is one class with one set of signatures, and no table of signatures stays."""
    near = words(71, 30)
    df = spark.createDataFrame([(k, f"{words(70, 30)}\n{near if k else near + ' x'}\n{words(k, 20, 'de')}") for k in range(50)], "doc_id long, text string")
    rows = N.with_row(df)
    lines = N.lines_of(rows, N.crowding(rows)).select(*N.LINE, "cid", F.size("toks").alias("n"), N.signatures(80).alias("sigs"))
    shared = N.shared_signatures(stored(N.line_classes(lines), "test-sets"))
    assert 0 < shared.groupBy("sig").count().agg(F.max("count")).first()[0] <= 3
    before = scratch_tables(spark)
    N.dedup_lines(df).count()
    assert not any({"sigs", "central"} & set(c) for c in columns_of(spark, scratch_tables(spark) - before))


def shuffle_files(spark) -> int:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.startswith("shuffle_") for d in folders for _, _, files in os.walk(str(d)) for f in files)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    step = spark.range(5000).withColumn("k", F.col("id") % 700).groupBy("k").agg(F.collect_list("id").alias("ids"))
    out = stored(step, "test-step")
    assert shuffle_files(spark) <= before  # though ``step`` is still referenced
    assert out.count() == 700


def brute_lines(spark, rows, percent):
    hashed = N.with_row(spark.createDataFrame(rows, "doc_id long, text string")).distinct().collect()
    lines = sorted((r.doc_id, r.row, k, line) for r in hashed for k, line in enumerate(r.text.split("\n")))
    sets = [{w for w in re.split("[ \t]+", line.lower()) if w} for *_, line in lines]
    gone = set()
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= percent * len(s | sets[j]):
                gone.add(lines[i][:3])
                break
    out = {}
    for r in hashed:
        kept = [x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, r.row, k) not in gone]
        total = r.text.count("\n") + 1
        out[r.doc_id, r.text] = (total, total - len(kept), "\n".join(kept))
    return multiset((own(d), *out[own(d), t or ""]) for d, t in rows)


def line_rows():
    rng, rows = random.Random(8), []
    base = [words(900 + k, rng.randrange(1, 60)) for k in range(25)]
    for doc in range(40):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(0, max(1, len(w) // 7) + 1)):
                at = rng.randrange(len(w))
                if rng.random() < 0.4:
                    w[at] = f"w{rng.randrange(9)}"
                elif rng.random() < 0.5:
                    w.insert(at, f"v{rng.randrange(9)}")
                elif len(w) > 1:
                    del w[at]
            rng.shuffle(w)
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        rows.append((doc, "\n".join(lines)))
    return rows


def test_line_dedup_equals_brute_force(spark, odd, empty):
    rows = line_rows() + [r[:2] for r in odd_rows()]
    got = N.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    have = multiset((own(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got.itertuples())
    assert have == brute_lines(spark, rows, 80)
    carried = N.dedup_lines(odd, 80, ("lang", "row", "carry")).collect()
    assert len(carried) == len(odd_rows()) and {r["carry"]["row"] for r in carried} == {"clash"}
    assert N.dedup_lines(empty).count() == 0


def steps_of(monkeypatch) -> list[tuple[str, int]]:
    """Name and rows of each step that line dedup stores from now on."""
    steps = []

    def noted(df, name, *args, **options):
        out = stored(df, name, *args, **options)
        steps.append((name, out.count()))
        return out

    monkeypatch.setattr(N, "stored", noted)
    return steps


def test_unrelated_lines_with_a_common_pair_are_not_compared(spark, monkeypatch):
    """Lines that share their two rarest words and little else: listing their pairs would grow with their square."""
    rng = random.Random(21)
    lines = [" ".join([f"w{k}" for k in rng.sample(range(100), 30)] + ["gluea", "glueb"] * (i < 40)) for i in range(300)]
    steps = steps_of(monkeypatch)
    rows = [(k, "\n".join(lines[k::30])) for k in range(30)]
    got = N.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got.n_removed.sum() == 0
    assert sum(n for name, n in steps if name in ("line-tested", "line-pairs", "line-rest")) < 40


def test_unrelated_long_lines_with_a_common_pair_are_not_compared(spark, monkeypatch):
    """As above with 150 words a line, where 64 bits would leave most pairs."""
    rng = random.Random(22)
    lines = [" ".join([f"w{k}" for k in rng.sample(range(700), 150)] + ["gluea", "glueb"] * (i < 30)) for i in range(240)]
    steps = steps_of(monkeypatch)
    rows = [(k, "\n".join(lines[k::30])) for k in range(30)]
    got = N.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert got.n_removed.sum() == 0
    assert sum(n for name, n in steps if name in ("line-tested", "line-pairs", "line-rest")) < 30


def test_sketches_differ_in_no_more_bits_than_sets_in_words(spark):
    rng = random.Random(23)
    rows = []
    for k in range(400):
        x = set(rng.sample(range(10_000), rng.choice((3, 20, 62, 66, 130, 300))))
        drop = rng.sample(sorted(x), rng.randrange(1 + len(x) // 5))
        y = (x - set(drop)) | set(rng.sample(range(10_000), rng.randrange(1 + len(x) // 7)))
        rows.append((k, sorted(x), sorted(y), 100 * len(x & y) >= 80 * len(x | y)))
    df = spark.createDataFrame(rows, "k long, x array<long>, y array<long>, match boolean")
    side = lambda c: df.select("k", F.transform(c, lambda w: F.xxhash64(w)).alias("toks")).select("k", F.size("toks").alias("n"), *N.sketch())
    both = df.join(side("x"), "k").join(side("y").select("k", *(F.col(c).alias(f"y_{c}") for c in ("n", "lo", "hi"))), "k")
    found = both.select("match", N.may_be_close(F.col, lambda c: F.col(f"y_{c}"), 80).alias("close")).collect()
    assert sum(r.match for r in found) > 50 and all(r.close for r in found if r.match)


def test_line_dedup_in_slices_and_rounds_equals_brute_force(spark, monkeypatch):
    """Signatures and texts in several slices, pairs compared in several rounds."""
    monkeypatch.setattr(N, "SLICE_CLASSES", 20)
    steps = steps_of(monkeypatch)
    rows = line_rows()
    got = N.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    have = multiset((own(r.doc_id), r.n_lines, r.n_removed, r.text) for r in got.itertuples())
    assert have == brute_lines(spark, rows, 80)
    names = Counter(name for name, _ in steps)
    assert names["line-lists"] == 4 and names["line-compared"] > 2


def test_line_dedup_runs_no_python(spark, tmp_path):
    df = N.dedup_lines(spark.createDataFrame(line_rows(), "doc_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString().replace("Scan ExistingRDD", ""))


# -- benchmark passages -----------------------------------------------------------------------------


def test_edit_distance_of_parts():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(5) for _ in range(rng.randrange(1, 9))]
        region = [rng.randrange(5) for _ in range(rng.randrange(0, 14))]
        best, last = len(item), list(range(len(item) + 1))
        for w in region:
            row = [0]
            for k, x in enumerate(item, 1):
                row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (x != w)))
            last, best = row, min(best, row[-1])
        assert D.best_match(np.array(item, np.uint64), np.array(region, np.uint64))[0] == best


def test_recall_of_edited_passages():
    assert D.sampled_recall(20, 0) == D.sampled_recall(60, 0) == 1
    assert D.sampled_recall(24, 2) >= 0.95 and D.sampled_recall(50, 5) >= 0.9


@pytest.mark.parametrize("size", [5, 9, 10, 20, 50, 100, 200, 500])
def test_copies_at_the_full_slack_are_found(size):
    rng = random.Random(size)
    vocabulary = words(size, 4000).split()
    items, docs, edits = [], [], size // 5
    for _ in range(20):
        item = rng.choices(vocabulary, k=size)
        copy = list(item)
        for at in sorted(rng.sample(range(size), edits), reverse=True):
            copy[at : at + 1] = ([f"new{at}"], [f"new{at}", copy[at]], [])[rng.randrange(3)]
        items.append(D.hashes(" ".join(item)))
        docs.append(" ".join(rng.choices(vocabulary, k=rng.randrange(60)) + copy + rng.choices(vocabulary, k=30)))
    got = {(d, i): (x, e) for d, i, x, e in D.Matcher(list(enumerate(items)), 80).find(docs)}
    want = {(d, i): D.best_match(item, D.hashes(text)) for d, text in enumerate(docs) for i, item in enumerate(items)}
    assert {(d, d) for d in range(20)} <= set(got)
    assert got == {pair: at for pair, at in want.items() if at[0] <= edits}


def test_short_items_are_found_inside_documents(spark):
    items = [(1, "Photosynthesis, chlorophyll"), (2, "one two"), (3, "electroencephalography")]
    docs = [(1, "about photosynthesis chlorophyll and more words"), (2, "of photosynthesis and chlorophyll"), (3, "say one two three"),
            (4, "an Electroencephalography."), (5, "one, two"), (6, "photosynthesis")]
    got = D.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["distance"], r["end_word"]) for r in got.collect()} == {(1, 1, 0, 3), (4, 3, 0, 2), (5, 2, 0, 2)}


def test_matches_equal_planted_passages(spark, odd, empty):
    items = [(k, words(700 + k, n)) for k, n in enumerate((5, 7, 12, 20, 33, 50, 80))] + [(90, "one, two!"), (91, None), (92, "")]
    rows, planted = [r[:2] for r in odd_rows()], set()
    for k, text in items[:7]:
        w = text.split()
        rows += [(1000 + k, words(60 + k, 90) + " " + text.upper().replace(" ", ",  ") + ". " + words(61 + k, 40)), (1100 + k, text)]
        planted |= {(1000 + k, k), (1100 + k, k)}
        if len(w) >= 12:
            w[len(w) // 2] = "edited"
            rows.append((1200 + k, words(62 + k, 30) + " " + " ".join(w)))
            planted.add((1200 + k, k))
        rows.append((1300 + k, " ".join(w[: len(w) // 2])))
    planted |= {(12, 90), (13, 90)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = D.benchmark_matches(docs, bench).toPandas()
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == planted
    assert all((r.distance == 1) == (1200 <= r.doc_id < 1300) for r in got.itertuples())
    left = D.without_matches(odd, bench)
    assert left.columns == odd.columns and left.count() == len(odd_rows()) - 2
    assert D.benchmark_matches(empty, bench).count() == 0
    assert D.benchmark_matches(docs, bench.limit(0)).count() == 0


# -- languages and quality --------------------------------------------------------------------------


def brute_marginals(p, a):
    k = p.shape[1]
    forward, state = [], np.full(k, 1 / k)
    for row in p:
        state = (state @ a) * row
        state /= state.sum()
        forward.append(state)
    out, back = [], np.ones(k)
    for f, row in zip(reversed(forward), reversed(p), strict=True):
        out.append(f * back / (f * back).sum())
        back = a @ (row * back)
        back /= back.sum()
    return np.array(out[::-1])


def test_marginals_equal_one_chain_at_a_time():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 31, 32, 33, 200, 2, 97])
    p, a = rng.random((sizes.sum(), 3)) + 1e-3, rng.random((3, 3)) + 0.05
    want = np.concatenate([brute_marginals(x, a) for x in np.split(p, np.cumsum(sizes)[:-1])])
    assert np.allclose(L.marginals(p, sizes, a), want)


def test_code_switched_words_are_labelled():
    texts = [(words(k, 150, lang), lang) for lang in ("en", "fr", "de") for k in range(30)]
    model = L.fit_crf(texts)
    mixed = words(900, 40, "fr").split() + words(901, 40, "de").split()
    best = model.posteriors([mixed])[0].argmax(1)
    want = [model.labels.index("fr")] * 40 + [model.labels.index("de")] * 40
    assert np.mean(best == want) > 0.9
    assert np.trace(model.transitions) > model.transitions.sum() - np.trace(model.transitions)


def test_language_rows(odd, empty):
    model = L.learn_languages(odd)
    got = L.label_languages(odd, model).toPandas()
    assert len(got) == len(odd_rows()) and got.score.between(0, 1).all()
    none = got[got.n_words == 0]
    assert set(none.lang_pred) == {"und"} and (none.score == 0).all()
    assert len(none) == sum(not any(c.isalpha() for c in t or "") for _, t, _ in odd_rows())
    kept = L.keep_languages(odd, model, 0.3)
    assert kept.columns == odd.columns and kept.count() == len(got) - len(none)
    assert L.label_languages(odd, L.learn_languages(empty)).filter("lang_pred <> 'und'").isEmpty()
    assert L.label_languages(empty, model).count() == 0


def test_labelling_holds_little_at_once():
    """A batch of 6 MB, of as many different words as texts can have, needs less than 20 times a part of it."""
    rng = random.Random(11)
    model = L.fit_crf([(words(k, 150, lang), lang) for lang in ("en", "fr", "de") for k in range(30)])
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)) for _ in range(300)]
    tracemalloc.start()
    counts, labels = L.labels_of(model, pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts == [3000] * 300 and len(labels) == 300
    assert peak < 330 << 20
    assert labels[:5] == [L.label(model, post) for post in model.posteriors([L.words_of(t) for t in texts[:5]])]


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.label_languages(docs, L.learn_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter(Q.held_out(got["doc_id"])).toPandas()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98


def test_lasso_keeps_the_rule_that_decides():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    y = ((x["a"] > 0.4) & (x["b"] <= 0.7)).astype(float)
    model = Q.fit_rules(x, y, trees=5)
    total = model.intercept + sum(w * r.holds(x) for r, w in model.rules)
    assert ((total > 0) == (y > 0)).mean() > 0.97
    assert 0 < len(model.rules) < 60


def test_held_out_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.learn_quality(docs, labels)
    got = Q.score_quality(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.97
    plain = Q.score_quality(odd, model)
    rows = plain.toPandas()
    assert len(rows) == len(odd_rows()) and rows.score.between(0, 1).all() and not rows.predicted.isna().any()
    assert not re.search("Python|Arrow|Pandas", plain._jdf.queryExecution().toString().split("== Physical Plan ==")[1])
    assert Q.score_quality(empty, model).count() == 0
    flat = Q.learn_quality(docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(odd, flat).collect()} == {0.5}
